"""Hard negatives by inner product: an exact distributed kNN join over a Voronoi partition of norm-augmented vectors.

Vectors become integers, floor(256 * x). With M the largest norm, each row gets one more component that brings its norm to M, and an anchor a zero:
then |a - v|^2 = |a|^2 + M^2 - 2 (a . v), so the largest inner products are the smallest distances, and distances obey the triangle inequality.
Anchors are assigned to the nearest of a few pivots, taken farthest-first from a bounded sample of anchors; a pivot's anchors are a group with a radius.

A row first serves its home group, that of its nearest pivot. What the anchors find there bounds what they still need. Then each row is sent
to just those other groups that it might serve: by its distance from the group's pivot and the group's radius the score of no anchor can be outside
an interval, and it has to meet the interval that the group needs. Groups that need rows meet them in units of at most about ``CHUNK`` rows and ``CELL_ANCHORS`` anchors, so a group, a
label or a vector that holds most rows makes more units, not larger ones. Within a unit all scores are exact products of integers, in blocks, and each anchor keeps the first k of
a unit only; the units' rows are ranked by a window, which Spark limits before its shuffle.

The join is made twice: for the positives (same label, no bound), and for the negatives (other label, one interval for each positive).

Where vectors have no near neighbours, as random ones, no row can be left out, and every row is sent to all groups: their number is the anchors' by ``CELL_ANCHORS``, ``MIN_CELLS`` at least.

Defined cases: rows with a null label or vector, or with a null or non-finite component, take no part; a missing component of a shorter vector counts as zero, and an empty
vector as one of zeros; a null vec_id is no anchor, is divisible by nothing and comes last in ties; rows with the same vec_id are different rows, and an anchor is never its own
positive, but a copy of it can be; products are of signed 64 bits; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from kinweave.storage import stored

SCALE = 256
ANCHOR_EVERY = 100
RELABEL_EVERY, LABELS = 7, 10
N_POSITIVES, N_NEGATIVES = 5, 10
#: A negative's score lies between these percentages of the positive's.
LOWEST, HIGHEST = 30, 90
#: Pivots come from at most so many anchors, those with the smallest hashes.
SAMPLE = 4096
MIN_CELLS, MAX_CELLS = 4, 1024
CELL_ANCHORS = 1 << 15
CHUNK = 1 << 18
BLOCK_CELLS = 1 << 22
LABEL_CLASSES = 64
#: A null id's place in the order.
LAST = (1 << 63) - 1
#: Scores below this are exact as floating point numbers.
EXACT = 1 << 53


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(ord, label, vec, norm2, n): vec is 32- or 64-bit integers, little-endian; norm2 is the square of the norm."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            ends = np.asarray(lists.offsets)
            flat, ends = np.asarray(lists.values, dtype=np.float64)[ends[0] : ends[-1]], ends - ends[0]
            whole = np.clip(np.floor(scale * flat), -float(1 << 62), float(1 << 62)).astype(np.int64)
            squares = np.bincount(np.repeat(np.arange(len(lists)), np.diff(ends)), weights=whole.astype(np.float64) ** 2, minlength=len(lists))
            small = bool(len(whole) == 0 or np.abs(whole).max() < 1 << 31)
            parts = (whole.astype("<i4") if small else whole.astype("<i8")).tobytes()
            width = 4 if small else 8
            packed = [parts[a * width : b * width] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            columns = [batch.column("ord"), batch.column("label"), pa.array(packed, pa.binary()), pa.array(squares), pa.array(np.diff(ends).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["ord", "label", "vec", "norm2", "n"])

    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    rows = rows.where(usable).select(F.coalesce("vec_id", F.lit(LAST)).cast("long").alias("ord"), moved.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(pack, "ord long, label long, vec binary, norm2 double, n int")


def unpacked(vecs: list[bytes], sizes: np.ndarray, dim: int) -> np.ndarray:
    """Matrix of ``dim`` integers a row; missing ones are zeros."""
    out = np.zeros((len(vecs), dim), dtype=np.int64)
    if len(vecs) and (sizes == dim).all() and all(len(v) == 4 * dim for v in vecs):
        out[:] = np.frombuffer(b"".join(vecs), dtype="<i4").reshape(len(vecs), dim)
        return out
    for i, (v, n) in enumerate(zip(vecs, sizes.tolist(), strict=True)):
        if n:
            out[i, :n] = np.frombuffer(v, dtype="<i4" if len(v) == 4 * n else "<i8")
    return out


def matrix(table: pa.Table | pa.RecordBatch, dim: int) -> np.ndarray:
    return unpacked(table.column("vec").to_pylist(), np.asarray(table.column("n")), dim)


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Exact inner products of all rows of ``a`` and of ``b``: by floating point where it is exact, by 64-bit integers elsewhere."""
    if exact:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.einsum("id,jd->ij", a, b)


def pivots_of(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of the sample, each the farthest from those before it."""
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


class Cells:
    """Pivots and the largest squared norm: what every task needs to place a row. At most ``MAX_CELLS`` vectors."""

    def __init__(self, pivots: np.ndarray, top: float, dim: int) -> None:
        self.pivots, self.top, self.dim = pivots.astype(np.float64), top, dim

    def distances(self, vecs: np.ndarray, norm2: np.ndarray) -> np.ndarray:
        """Of rows with these squared norms (``top`` for augmented ones) from all pivots."""
        square = norm2[:, None] + (self.pivots**2).sum(axis=1)[None, :] - 2 * vecs.astype(np.float64) @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))


def placed(rows: DataFrame, cells: Cells, augmented: bool) -> DataFrame:
    """``rows`` with the nearest pivot and the distance from it."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column("norm2"))
            d = cells.distances(matrix(batch, cells.dim), np.full(len(own), cells.top) if augmented else own)
            best = d.argmin(axis=1) if len(d) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32)), pa.array(d[np.arange(len(d)), best])], [*batch.schema.names, "cell", "far"])

    return rows.mapInArrow(place, StructType([*rows.schema.fields]).add("cell", IntegerType()).add("far", DoubleType()))


class Needs:
    """For each cell what its anchors still need: squared norms, radius, parts, and the scores' interval by class of label. Bounded by the cells."""

    def __init__(self, n_cells: int, found: list) -> None:
        shape = (n_cells, LABEL_CLASSES)
        self.radius, self.least, self.most = np.zeros(n_cells), np.full(n_cells, np.inf), np.zeros(n_cells)
        self.low, self.high, self.parts = np.full(shape, np.inf), np.full(shape, -np.inf), np.zeros(n_cells, dtype=np.int64)
        for r in found:
            self.radius[r.cell], self.parts[r.cell] = max(self.radius[r.cell], r.radius), max(self.parts[r.cell], r.parts)
            self.least[r.cell], self.most[r.cell] = min(self.least[r.cell], r.least), max(self.most[r.cell], r.most)
            self.low[r.cell, r.kind], self.high[r.cell, r.kind] = r.low, r.high


def label_class(label: str = "label") -> Column:
    return F.pmod(F.col(label), F.lit(LABEL_CLASSES)).cast("int")


def needs(anchors: DataFrame, n_cells: int) -> Needs:
    """From anchors with (cell, far, norm2, label, low, high); at most ``n_cells * LABEL_CLASSES`` rows reach the driver."""
    of_cell = anchors.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ANCHORS).cast("int").alias("parts"))
    of_label = anchors.groupBy("cell", label_class().alias("kind")).agg(
        F.max("far").alias("radius"), F.min("norm2").alias("least"), F.max("norm2").alias("most"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    return Needs(n_cells, of_label.join(of_cell, "cell").collect())


def served(rows: DataFrame, cells: Cells, need: Needs, same: bool, home: bool) -> DataFrame:
    """``rows`` with each (cell, part) of anchors that they may serve: those at home, or the others."""
    # an anchor of one label needs rows of the same one, or of any other; the second needs the interval of all labels
    low, high = (need.low, need.high) if same else (need.low.min(axis=1, keepdims=True), need.high.max(axis=1, keepdims=True))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = np.mod(np.asarray(batch.column("label")), LABEL_CLASSES) if same else np.zeros(batch.num_rows, dtype=np.int64)
            at_home = np.asarray(batch.column("cell"))[:, None] == np.arange(len(cells.pivots))[None, :]
            if home:
                ok = at_home & np.isfinite(low[:, kind].T)
            else:
                d = cells.distances(matrix(batch, cells.dim), np.full(batch.num_rows, cells.top))
                # distances are off by less than this, scores by less than the other
                slack_d, slack = 1e-3 + 1e-6 * cells.top**0.5, 1 + 1e-9 * cells.top
                near, far = np.maximum(d - need.radius - slack_d, 0), d + need.radius + slack_d
                most = (need.most + cells.top - near**2) / 2 + slack
                least = (need.least + cells.top - far**2) / 2 - slack
                ok = ~at_home & (most >= low[:, kind].T) & (least <= high[:, kind].T)
            row, cell = np.nonzero(ok)
            times = need.parts[cell]
            first = np.repeat(np.cumsum(times) - times, times)
            part = np.arange(int(times.sum())) - first
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            out = batch.select(["row", "ord", "label", "vec", "n"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32))], [*out.schema.names, "cell", "part"])

    return rows.mapInArrow(send, "row long, ord long, label long, vec binary, n int, cell int, part int")


def first_k(keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest keys of each column, without the least possible key."""
    k = min(k, len(keys))
    rows = np.argpartition(keys, len(keys) - k, axis=0)[len(keys) - k :] if k < len(keys) else np.broadcast_to(np.arange(len(keys))[:, None], keys.shape)
    columns = np.broadcast_to(np.arange(keys.shape[1])[None, :], rows.shape)
    ok = keys[rows, columns] != np.iinfo(np.int64).min
    return rows[ok], columns[ok]


def local_join(cells: Cells, same: bool, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The first ``k`` rows of a unit for each interval of each of its anchors, exactly."""
    least = np.iinfo(np.int64).min
    exact, cells_a_block = cells.top < EXACT, BLOCK_CELLS

    def join(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        a = matrix(anchors, cells.dim)
        a_row, a_label = np.asarray(anchors["row"]), np.asarray(anchors["label"])
        wanted = anchors["wanted"].combine_chunks() if anchors.num_rows else None
        windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if wanted is not None:
            ends, lows, highs = np.asarray(wanted.offsets), np.asarray(wanted.values.field("low")), np.asarray(wanted.values.field("high"))
            for j in range(int(np.diff(ends).max(initial=0))):
                has = np.flatnonzero(np.diff(ends) > j)
                windows.append((has, lows[ends[has] + j], highs[ends[has] + j]))
        if anchors.num_rows and rows.num_rows:
            rows = rows.take(pa.array(np.lexsort((np.asarray(rows["row"]), np.asarray(rows["ord"])))))
        size = max(1, cells_a_block // max(1, len(a)))
        for start in range(0, rows.num_rows if len(a) else 0, size):
            block = rows.slice(start, size)
            ids, row, label = (np.asarray(block[c]) for c in ("ord", "row", "label"))
            scores = products(matrix(block, cells.dim), a, exact)
            ok = (label[:, None] == a_label[None, :]) == same
            if same:
                ok &= row[:, None] != a_row[None, :]
            place = np.arange(len(ids))[::-1, None]
            for j, (has, low, high) in enumerate(windows):
                own = scores[:, has]
                fits = ok[:, has] & (own >= low) & (own <= high)
                if cells.top * len(ids) < 1 << 62:
                    # one key for the score and, among equal ones, the order of ids
                    r, c = first_k(np.where(fits, own * len(ids) + place, least), k)
                else:
                    r, c = slow_first_k(own, fits, k)
                out.append((a_row[has[c]], np.full(len(c), j, dtype=np.int32), ids[r], row[r], own[r, c]))
        columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int32 if i == 1 else np.int64) for i in range(5)]
        found = unit_first_k(columns, k)
        return pa.table([pa.array(c) for c in found], names=["anchor", "wanted", "ord", "row", "score"])

    return join


def slow_first_k(scores: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``first_k``, for scores that leave no room for the place in one number."""
    r, c = [], []
    for column in range(scores.shape[1]):
        rows = np.flatnonzero(fits[:, column])
        r.append(rows[np.lexsort((rows, ~scores[rows, column]))[:k]])
        c.append(np.full(len(r[-1]), column))
    return np.concatenate(r), np.concatenate(c)


def unit_first_k(columns: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The first ``k`` rows of each (anchor, interval), by score, id and row."""
    anchor, wanted, ids, row, score = columns
    order = np.lexsort((row, ids, ~score, wanted, anchor))
    anchor, wanted = anchor[order], wanted[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (wanted[1:] != wanted[:-1])
    begins = np.flatnonzero(fresh)
    number = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    return [c[order[number < k]] for c in columns]


def first_of(found: DataFrame, k: int) -> DataFrame:
    """Of all units' rows, the first ``k`` of each interval, with their rank."""
    ordered = Window.partitionBy("anchor", "wanted").orderBy(F.col("score").desc(), "ord", "row")
    return found.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k)


def knn_join(anchors: DataFrame, rows: DataFrame, cells: Cells, same: bool, k: int, chunks: int) -> DataFrame:
    """(anchor, wanted, ord, row, score, rank): for each anchor's intervals the first ``k`` rows whose scores lie in them.

    ``anchors`` has (row, label, vec, n, norm2, cell, far, wanted: array of (low, high)).
    """
    keys = ["cell", "part", "chunk"] + (["label"] if same else [])
    spread = F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int").alias("chunk")

    def units(need: Needs, home: bool) -> DataFrame:
        parts = F.array(*(F.lit(int(max(1, p))) for p in need.parts))
        at = anchors.select("row", "label", "vec", "n", "wanted", "cell", F.pmod(F.xxhash64("row"), F.get(parts, F.col("cell"))).cast("int").alias("part"))
        at = at.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        sent = served(rows, cells, need, same, home).withColumn("chunk", spread)
        join = local_join(cells, same, k)
        return at.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(lambda a, r: join(a, r), "anchor long, wanted int, ord long, row long, score long")

    bounds = anchors.select("*", F.array_min("wanted.low").alias("low"), F.array_max("wanted.high").alias("high"))
    at_home = stored(units(needs(bounds, len(cells.pivots)), True), "home")
    # an interval with k rows at home needs nothing below the last of them
    last = first_of(at_home, k).groupBy("anchor", "wanted").agg(F.count("*").alias("n"), F.min("score").alias("last")).where(F.col("n") == k)
    flat = anchors.select("row", F.posexplode("wanted").alias("wanted", "w")).join(last.select(F.col("anchor").alias("row"), "wanted", "last"), ["row", "wanted"], "left")
    still = flat.groupBy("row").agg(F.min(F.greatest("w.low", F.coalesce("last", "w.low"))).alias("low"), F.max("w.high").alias("high"))
    need = needs(anchors.select("row", "cell", "far", "norm2", "label").join(still, "row"), len(cells.pivots))
    return first_of(at_home.unionByName(units(need, False)), k)


def interval(low: Column, high: Column) -> Column:
    return F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"))


def mined(rows: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    rows = stored(quantised(rows).withColumn("row", F.monotonically_increasing_id()), "vectors")
    anchors = rows.where((F.col("ord") != LAST) & (F.col("ord") % ANCHOR_EVERY == 0))
    size = rows.agg(F.count("*").alias("n"), F.max("norm2").alias("top"), F.max("n").alias("dim")).first()
    sample = anchors.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("vec", "n").collect()
    dim, n_anchors = int(size.dim or 0), anchors.count()
    if not n_anchors:
        sample_matrix = np.zeros((1, dim))
    else:
        sample_matrix = unpacked([bytes(r.vec) for r in sample], np.array([r.n for r in sample]), dim).astype(np.float64)
    wanted_cells = min(MAX_CELLS, max(MIN_CELLS, -(-n_anchors // CELL_ANCHORS)))
    cells = Cells(pivots_of(sample_matrix, wanted_cells), float(size.top or 0), dim)
    chunks = max(1, -(-size.n // CHUNK))
    rows = stored(placed(rows, cells, True), "placed")
    anchors = stored(placed(anchors, cells, False), "anchors")

    everything = F.array(interval(F.lit(-LAST - 1), F.lit(LAST)))
    positives = stored(knn_join(anchors.withColumn("wanted", everything), rows, cells, True, N_POSITIVES, chunks).drop("wanted"), "positives")
    # the least and the largest integer in the interval, which is empty below a score of 0
    low = F.expr(f"{LOWEST} * (score div 100) + ({LOWEST} * (score % 100) + 99) div 100")
    high = F.expr(f"{HIGHEST} * (score div 100) + {HIGHEST} * (score % 100) div 100")
    asked = positives.where("score >= 0").select("anchor", "rank", "ord", "score", interval(low, high).alias("w")).where("w.low <= w.high")
    asked = asked.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(F.struct("rank", "ord", "score", "w"))).alias("asked"))
    asked = stored(anchors.join(asked, "row").withColumn("wanted", F.col("asked.w")), "asked")
    negatives = knn_join(asked.drop("asked"), rows, cells, False, N_NEGATIVES, chunks)
    positive = F.get("asked", F.col("wanted"))
    named = negatives.join(asked.select(F.col("row").alias("anchor"), F.col("ord").alias("anchor_id"), "asked"), "anchor")
    known = lambda c: F.when(c != LAST, c)
    return named.select("anchor_id", known(positive["ord"]).alias("positive_id"), "rank", known(F.col("ord")).alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))
