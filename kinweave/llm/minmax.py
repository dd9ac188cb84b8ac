"""Near copies by min-max hashing: a signature keeps both ends of every permutation.

A text's set holds its distinct five-word shingles. Texts with the same set are one class and are looked at once. ``PERMUTATIONS``
linear permutations of 32-bit hashes are evaluated once for each shingle; the smallest *and* the largest value under each stay, one
byte each. Either end of two sets agrees with a chance of their Jaccard similarity, so half the evaluations give a signature of the same
length; the ends of one permutation never both miss through the same shingle, which lowers the variance. A band is ``ROWS`` values,
half of them smallest and half largest ones of different permutations; its twin holds the other ends. Two sets of
similarity s meet in some of the ``BANDS`` bands with a chance of 1 - (1 - s ** ROWS) ** BANDS: 0.9999997 at 0.85, more above it.

Only components are wanted, so not all pairs of a bucket are compared. First each class is compared with one pivot, the smallest class of
its buckets, and then with the pivots of buckets that it doesn't share a component with: rows in proportion to
the classes. Only buckets that still hold several components are compared in blocks: a large component is cut into blocks of about ``BLOCK`` classes, small ones share
blocks, and two blocks of one component never meet. Signatures that are too different for a link (five standard deviations)
aren't compared there; all links are confirmed on the full sets. Nothing is capped: a bucket of any size only makes more blocks.

Defined cases: words are runs of characters other than blanks, A-Z lowered; a text of fewer than five words has one shingle of them all; null and
empty texts, and texts of blanks, have no shingles and are linked with nothing, not even each other; null doc_ids are no component's id unless all of its ids are null, and
such a component is kept; rows with the same doc_id are different documents; repeated rows are near copies; very long texts are read whole; an empty table
gives no rows; other columns may have any names and are carried by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.components import components
from kinweave.storage import stored

from .jaccard import body_of, common, local_roots
from .words import BASE, LOWERED, U, chunks, mix, powers, shingle_hashes

SHINGLE = 5
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 85
PERMUTATIONS = 96
BANDS, ROWS = 32, 6
BLOCK = 256
BLOCK_SHINGLES = 1 << 18
STAR = 512
_s = PERCENT / 100
#: Least share of equal signature bytes that is compared in blocks: all but 3 in 10 million links of the threshold's similarity.
LIKELY = _s - 5 * (_s * (1 - _s) / (BANDS * ROWS)) ** 0.5

#: The blanks of the word rule, space and the bytes 9 to 13.
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[[32, 9, 10, 11, 12, 13]] = False

_seeds = mix(np.arange(7001, 7001 + 2 * PERMUTATIONS, dtype=U))
FACTORS = (_seeds[:PERMUTATIONS] >> U(32)).astype(np.uint32) | np.uint32(1)
SHIFTS = (_seeds[PERMUTATIONS:] >> U(32)).astype(np.uint32)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, place of each text's first word, with the end); no word crosses from one text to the next."""
    low = LOWERED[data]
    inside = IN_WORD[low]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    n = 1 << max(12, int(len(low)).bit_length())
    sums = np.zeros(len(low) + 1, dtype=U)
    np.cumsum((low.astype(U) + U(1)) * powers(n, BASE)[: len(low)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(n, pow(BASE, -1, 1 << 64))[starts]), np.searchsorted(starts, offsets)


def ends_of(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest value of the set under each permutation."""
    short = (shingles >> U(32)).astype(np.uint32)
    least, most = np.full(PERMUTATIONS, 0xFFFFFFFF, dtype=np.uint32), np.zeros(PERMUTATIONS, dtype=np.uint32)
    for i in range(0, len(short), 1024):
        values = short[i : i + 1024, None] * FACTORS + SHIFTS
        np.minimum(least, values.min(axis=0), out=least)
        np.maximum(most, values.max(axis=0), out=most)
    return least, most


def signature(shingles: np.ndarray) -> bytes:
    """One byte for each value, band by band: half a band's values are smallest ones, the others largest ones."""
    low, high = (((e * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).reshape(BANDS // 2, 2, ROWS // 2) for e in ends_of(shingles))
    bands = np.stack([np.concatenate([low[:, 0], high[:, 1]], axis=1), np.concatenate([high[:, 0], low[:, 1]], axis=1)], axis=1)
    return bands.tobytes()


def sets_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    for _, _, data, offsets in chunks(texts):
        hashes, firsts = word_hashes(data, offsets)
        for a, b in zip(firsts[:-1], firsts[1:], strict=True):
            yield np.unique(shingle_hashes(hashes[a:b], SHINGLE))


def id_of(own: np.ndarray) -> bytes | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, body, set_id, sig, n_shingles): set_id tells texts with the same set; it and sig are null without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sigs, sizes = [], [], []
            for own in sets_of(batch.column("text")):
                ids.append(id_of(own))
                sigs.append(signature(own) if len(own) else None)
                sizes.append(len(own))
            columns = [batch.column("doc_id"), batch.column("body"), pa.array(ids, pa.binary()), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "body", "set_id", "sig", "n_shingles"])

    rows = docs.select("doc_id", body_of().alias("body"), "text")
    return rows.mapInArrow(sign, "doc_id long, body binary, set_id binary, sig binary, n_shingles long")


def shingled(docs: DataFrame) -> DataFrame:
    """(set_id, shingles) of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(sets_of(batch.column("text")))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([id_of(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["set_id", "shingles"])

    return docs.select("text").mapInArrow(cut, "set_id binary, shingles array<long>")


def bucketed(classes: DataFrame) -> DataFrame:
    """(band, key, set_id, n_shingles) of the classes that share a band with others."""
    leaf = classes.select("set_id", "n_shingles", "sig", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    # substring counts a binary's bytes
    leaf = leaf.select("band", F.substring("sig", F.col("band") * ROWS + 1, F.lit(ROWS)).alias("key"), "set_id", "n_shingles")
    shared = leaf.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1")
    return leaf.join(shared.select("band", "key"), ["band", "key"])


def grouped(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The rows of one key after another, from rows sorted by it."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        tuples = list(zip(*columns, strict=True))
        start = 0
        for i in range(1, len(tuples) + 1):
            if i < len(tuples) and tuples[i] == tuples[start]:
                continue
            if last is not None and tuples[start] != last:
                yield pa.Table.from_batches(rest)
                rest = []
            last = tuples[start]
            rest.append(batch.slice(start, i - start))
            start = i
    if rest:
        yield pa.Table.from_batches(rest)


def linked(both: np.ndarray, joint: np.ndarray) -> np.ndarray:
    return 100 * both >= PERCENT * joint


def stars(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (pivot, set_id) of ``pairs`` that are linked. A pivot of many pairs has a copy for each ``STAR`` of them."""
    cut = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / STAR).cast("int").alias("cut"))
    members = pairs.join(cut, "pivot").select("pivot", F.pmod(F.xxhash64("set_id"), "cut").cast("int").alias("part"), F.lit(1).alias("role"), "set_id")
    centres = cut.select("pivot", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("part"), F.lit(0).alias("role"), F.col("pivot").alias("set_id"))
    units = members.unionByName(centres).join(sets.hint("merge"), "set_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, pivot = np.zeros(0, np.int64), None
        for batch in batches:
            found_a, found_b = [], []
            values = batch.column("shingles")
            flat, ends = np.asarray(values.values), np.asarray(values.offsets)
            for i, (a, role, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("pivot", "role", "set_id")), strict=True)):
                own = flat[ends[i] : ends[i + 1]].view(U)
                if role == 0:
                    centre, pivot = own.copy(), a
                    continue
                assert pivot == a
                place = np.searchsorted(centre, own)
                both = int((centre[np.minimum(place, len(centre) - 1)] == own).sum())
                if linked(both, len(centre) + len(own) - both):
                    found_a.append(a)
                    found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.binary()), pa.array(found_b, pa.binary())], ["a", "b"])

    keys = ["pivot", "part"]
    return units.repartition(*keys).sortWithinPartitions(*keys, "role").mapInArrow(verify, "a binary, b binary")


UNIT = ["band", "key", "low", "high"]


def block_units(mixed: DataFrame) -> DataFrame:
    """(band, key, low, high, side, set_id, label): blocks of a bucket that meet, from (band, key, set_id, n_shingles, label).

    A component of at least ``BLOCK`` classes (or ``BLOCK_SHINGLES`` shingles) in the bucket has blocks of its own, which never meet each other.
    """
    weight = F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)
    parts = mixed.groupBy("band", "key", "label").agg(weight.alias("weight"), F.count("*").alias("m"))
    own = F.when(F.col("weight") >= 1, F.col("label"))
    parts = parts.select("band", "key", "label", "weight", "m", own.alias("own"), F.coalesce(own, F.unhex(F.lit(""))).alias("pool"))
    pools = parts.groupBy("band", "key", "pool").agg(F.greatest(F.least(F.ceil(F.sum("weight")), F.sum("m")), F.lit(1)).cast("int").alias("cut"))
    parts = parts.join(pools, ["band", "key", "pool"]).select("band", "key", "label", "own", "pool", "cut")
    members = mixed.join(parts, ["band", "key", "label"])
    members = members.select("band", "key", "set_id", "label", "own", F.xxhash64("pool", F.pmod(F.xxhash64("set_id"), "cut")).alias("block"))
    blocks = members.select("band", "key", "own", "block").distinct()
    a, b = (blocks.select("band", "key", F.col("own").alias(f"own_{s}"), F.col("block").alias(s)) for s in ("low", "high"))
    meet = a.join(b, ["band", "key"]).where("low <= high AND NOT (own_low IS NOT NULL AND own_low <=> own_high)").select("band", "key", "low", "high")
    sides = meet.select("*", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    return members.join(sides, ["band", "key", "block"]).select(*UNIT, F.col("block").alias("side"), "set_id", "label")


def fresh(unit: pa.Table) -> np.ndarray:
    """Matrix of the pairs (row < column, or of two sides) that a unit has to compare: of different components, likely, and together in no earlier band."""
    n = unit.num_rows
    low, high, band = (unit.column(c)[0].as_py() for c in ("low", "high", "band"))
    ok = np.triu(np.ones((n, n), dtype=bool), 1)
    if low != high:
        side = unit.column("side").to_numpy()
        ok = (side[:, None] == low) & (side[None, :] == high)
    _, label = np.unique(np.array(unit.column("label").to_pylist(), dtype=object), return_inverse=True)
    ok &= label[:, None] != label[None, :]
    sigs = np.frombuffer(b"".join(unit.column("sig").to_pylist()), dtype=np.uint8).reshape(n, BANDS * ROWS)
    for row in np.flatnonzero(ok.any(axis=1)):
        same = sigs[row] == sigs
        earlier = same[:, : band * ROWS].reshape(n, band, ROWS).all(axis=2).any(axis=1)
        ok[row] &= (same.mean(axis=1) >= LIKELY) & ~earlier
    return ok


def crossing(mixed: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between different components of one bucket."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in grouped(batches, *UNIT):
            ok = fresh(unit)
            some = np.flatnonzero(ok.any(axis=0) | ok.any(axis=1))
            if len(some):
                yield from unit.take(pa.array(some)).combine_chunks().to_batches()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in grouped(batches, *UNIT):
            ok = fresh(unit)
            if not ok.any():
                continue
            own = [np.asarray(s.values).view(U) for s in unit.column("shingles").combine_chunks()]
            both, sizes = common(own, ok), np.array([len(s) for s in own])
            links = ok & linked(both, sizes[:, None] + sizes[None, :] - both)
            joined = np.flatnonzero(links.any(axis=0) | links.any(axis=1))
            ids, roots = unit.column("set_id").to_pylist(), local_roots(links)
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in joined], pa.binary()), pa.array([ids[roots[i]] for i in joined], pa.binary())], ["a", "b"])

    units = block_units(mixed).join(classes.select("set_id", "sig").hint("merge"), "set_id")
    likely = stored(units.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(sift, units.schema), "units")
    whole = likely.join(sets.hint("merge"), "set_id")
    return whole.repartition(*UNIT).sortWithinPartitions(*UNIT, "set_id").mapInArrow(verify, "a binary, b binary")


def labelled(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, label) of linked classes, and ``members`` with the label of their component, a class alone being its own."""
    found = stored(components(links), "labels")
    return found, members.join(found.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): links that connect all classes which are connected."""
    members = stored(bucketed(classes), "members")
    wanted = stored(members.select("set_id").distinct().join(classes.select("set_id", "body").hint("merge"), "set_id"), "wanted")
    texts = docs.select(body_of().alias("body"), "text").join(wanted.select("body").hint("merge"), "body", "left_semi")
    sets = stored(shingled(texts).dropDuplicates(["set_id"]), "sets")
    pivots = members.groupBy("band", "key").agg(F.min("set_id").alias("pivot"))
    pairs = stored(members.join(pivots, ["band", "key"]).where("set_id <> pivot").select("pivot", "set_id").distinct(), "pairs")
    nearest = pairs.groupBy("set_id").agg(F.min("pivot").alias("pivot"))
    found = stored(stars(nearest, sets), "links")
    own, labels = labelled(pairs, found)
    pivot_label = own.select(F.col("node").alias("pivot"), F.col("label").alias("beyond"))
    apart = labels.join(pivot_label, "pivot", "left").where(F.coalesce("beyond", "pivot") != F.col("label"))
    apart = apart.join(nearest, ["set_id", "pivot"], "left_anti").select("pivot", "set_id")
    found = found.unionByName(stored(stars(stored(apart, "apart"), sets), "links"))
    _, labels = labelled(members, found)
    labels = stored(labels, "members")
    mixed = labels.groupBy("band", "key").agg(F.min("label").alias("first"), F.max("label").alias("last")).where("first <> last").select("band", "key")
    return found.unionByName(stored(crossing(stored(labels.join(mixed, ["band", "key"]), "mixed"), classes, sets), "links"))


def near_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, body, set_id, n_shingles) of every document; (set_id, label, component_id) of every class."""
    rows = stored(signed(docs.select("doc_id", "text")), "signed")
    firsts = F.min_by("body", F.struct("doc_id", "body"))
    classes = rows.where("sig IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("low"), firsts.alias("body"), F.any_value("sig").alias("sig"), F.any_value("n_shingles").alias("n_shingles"))
    classes = stored(classes, "classes")
    groups = components(links(docs, classes)).withColumnRenamed("node", "set_id")
    joined = stored(classes.select("set_id", "low").join(groups, "set_id", "left").withColumn("label", F.coalesce("label", "set_id")), "class_labels")
    lowest = joined.groupBy("label").agg(F.min("low").alias("component_id"))
    return rows.drop("sig"), stored(joined.join(lowest, "label").select("set_id", "label", "component_id"), "near_sets")


def kept(doc_id: str = "doc_id") -> Column:
    return F.col(doc_id).eqNullSafe(F.col("component_id"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    rows, classes = near_sets(docs)
    alone = rows.where("set_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    joined = rows.where("set_id IS NOT NULL").join(classes, "set_id").select("doc_id", "n_shingles", "component_id")
    return alone.unionByName(joined).withColumn("kept", kept())


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the first one by doc_id, nulls last; all texts without words."""
    rows, classes = near_sets(docs)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "body")
    firsts = stored(rows.where("set_id IS NOT NULL").join(classes, "set_id").groupBy("label").agg(F.min_by("body", order).alias("body")).select("body"), "firsts")
    wrapped = docs.select(F.struct(*docs.columns).alias("row"), body_of().alias("body"))
    chosen = wrapped.join(firsts, "body", "left_semi").groupBy("body").agg(F.any_value("row").alias("row"))
    wordless = wrapped.join(rows.where("set_id IS NULL").select("body").distinct(), "body", "left_semi")
    return chosen.select("row.*").unionByName(wordless.select("row.*"))
