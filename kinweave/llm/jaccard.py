"""Join of near-equal texts by the Jaccard similarity of their five-word shingles, over a MinHash LSH forest.

Texts with the same words are one class and are looked at once. Each class gets ``TREES`` labels of ``DEPTH``
one-byte minhashes. A tree of the forest is the sorted trie of its labels; the classes below one node of it, a
common prefix, are candidates. The join begins with whole labels and shortens the prefixes by one byte at a time,
until the recall reaches its target for the least similar links too: p(s) = 1 - (1 - s ** depth) ** TREES is the chance
that a pair of similarity s meets below some node, and p(THRESHOLD) has to reach it. What was found has no say, so a
pair's chance doesn't hang on the rest of the corpus.

The rounds' units are written first and compared together, so texts move once. A tree's nodes are its sorted label prefixes. A node's classes are compared in blocks of about ``BLOCK`` classes and
``BLOCK_SHINGLES`` shingles a side, so a node of m classes becomes about (m / BLOCK) ** 2 / 2 units of bounded size, and no
pair is ever written as a row. A unit first drops classes whose signatures are too different from all others', then compares
the sets of shingles exactly, by products of 0/1 matrices. A pair that meets below several nodes is counted at the first one
only, which both signatures tell.

A unit names the smallest class of each of its connected parts. Each class is tied to the smallest class that its units
name, and so is every other class they name: in a group of m like texts that is m ties and a few for each block, where
tying a class to what every unit names would be m * m / BLOCK.

Result: one row per document, with the class id (smallest doc_id of all texts connected by links), the smallest doc_id
with the same words, and the number of links (other classes with a similarity of ``THRESHOLD`` or more).

Defined cases: null and empty texts have no words; they are copies of each other and have no links; a text with
fewer than five words has one shingle of all its words; null doc_ids are never the id of a class unless all of its ids are null; rows with
the same doc_id are different documents, and two classes may then share an id; empty tables give no rows; extra columns are carried by ``keep_one`` and may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.components import components
from kinweave.storage import stored

from .words import U, chunks, mix, shingle_hashes, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 32, 8
TARGET_RECALL = 0.9995
BLOCK = 256
BLOCK_SHINGLES = 1 << 18
#: Signatures that agree in a smaller share aren't compared: five standard deviations below the threshold. That keeps all
#: but 3 in 10 million links of the threshold's similarity, which ``recall`` counts.
LIKELY = THRESHOLD - 5 * (THRESHOLD * (1 - THRESHOLD) / (TREES * DEPTH)) ** 0.5
LIKELY_KEPT = 1 - 3e-7

_seeds = mix(np.arange(1, 2 * TREES * DEPTH + 1, dtype=U))
FACTORS = (_seeds[: TREES * DEPTH] >> U(32)).astype(np.uint32) | np.uint32(1)
SHIFTS = (_seeds[TREES * DEPTH :] >> U(32)).astype(np.uint32)


def signature(shingles: np.ndarray) -> bytes:
    """One byte for each minhash."""
    short = (shingles >> U(32)).astype(np.uint32)
    least = np.full(TREES * DEPTH, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(short), 1024):
        np.minimum(least, (short[i : i + 1024, None] * FACTORS + SHIFTS).min(axis=0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def body_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128 bits that tell apart rows with other ids or texts; a null is not an empty text."""
    known = F.concat_ws("\n", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.when(F.col(text).isNull(), "-").otherwise("+"), F.coalesce(text, F.lit("")))
    return F.unhex(F.md5(known.cast("binary")))


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, body, words_id, sig, n_words): words_id tells texts with the same words; sig is null without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sigs, sizes = [], [], []
            for first, last, data, offsets in chunks(batch.column("text")):
                hashes, firsts = word_hashes(data, offsets)
                for i in range(last - first):
                    words = hashes[firsts[i] : firsts[i + 1]]
                    ids.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest())
                    sigs.append(signature(shingle_hashes(words, SHINGLE)) if len(words) else None)
                    sizes.append(len(words))
            columns = [batch.column("doc_id"), batch.column("body"), pa.array(ids, pa.binary()), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "body", "words_id", "sig", "n_words"])

    rows = docs.select("doc_id", body_of().alias("body"), "text")
    return rows.mapInArrow(sign, "doc_id long, body binary, words_id binary, sig binary, n_words long")


def shingled(docs: DataFrame) -> DataFrame:
    """(words_id, shingles): the sorted set of shingle hashes of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text")):
                hashes, firsts = word_hashes(data, offsets)
                texts = [hashes[a:b] for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
                ids = [hashlib.blake2b(w.tobytes(), digest_size=16).digest() for w in texts]
                sets = [np.unique(shingle_hashes(w, SHINGLE)).view(np.int64) for w in texts]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["words_id", "shingles"])

    return docs.select("text").mapInArrow(cut, "words_id binary, shingles array<long>")


def nodes(classes: DataFrame, depth: int) -> DataFrame:
    """(depth, tree, node, low, high, side, words_id): the units that each class takes part in, below nodes with several classes.

    A node is a prefix of ``depth`` bytes, as a number. Long texts make more blocks, so that a block's shingles stay bounded too.
    """
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    leaf = classes.select("words_id", "sig", "n_words", tree.alias("tree"))
    # substring counts a binary's bytes; eight of them may have a sign
    prefix = F.conv(F.hex(F.substring("sig", F.col("tree") * DEPTH + 1, F.lit(depth))), 16, -10).cast("long")
    leaf = leaf.select("words_id", "n_words", "tree", prefix.alias("node"))
    shared = leaf.groupBy("tree", "node").agg(F.count("*").alias("m"), F.sum("n_words").alias("n_words")).where("m > 1")
    cut = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("n_words") / BLOCK_SHINGLES)).cast("int")
    shared = shared.select("tree", "node", F.least(cut, F.col("m").cast("int")).alias("cut"))
    members = leaf.select("words_id", "tree", "node").join(shared, ["tree", "node"]).withColumn("side", F.pmod(F.xxhash64("words_id"), "cut").cast("int"))
    units = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    return units.select(F.lit(depth).alias("depth"), "tree", "node", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "words_id")


UNIT = ["depth", "tree", "node", "low", "high"]


def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one unit after another, from rows sorted by unit."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in UNIT])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            key = tuple(keys[:, start])
            if last is not None and key != last:
                yield pa.Table.from_batches(rest)
                rest = []
            last = key
            rest.append(batch.slice(start, end - start))
    if rest:
        yield pa.Table.from_batches(rest)


def fresh_pairs(unit: pa.Table) -> np.ndarray:
    """Matrix of the pairs (row < column) that this unit has to compare.

    Left out: pairs of one side in a unit of two sides, pairs that meet in an earlier tree, or that met at the
    prefixes of the round before, and pairs whose signatures are too different.
    """
    sigs = np.frombuffer(b"".join(unit.column("sig").to_pylist()), dtype=np.uint8).reshape(unit.num_rows, TREES * DEPTH)
    depth, tree, low, high = (unit.column(c)[0].as_py() for c in ("depth", "tree", "low", "high"))
    ok = np.triu(np.ones((len(sigs), len(sigs)), dtype=bool), 1)
    if low != high:
        side = unit.column("side").to_numpy()
        ok = (side[:, None] == low) & (side[None, :] == high)
    labels = sigs.reshape(len(sigs), TREES, DEPTH).copy().view(">u8")[:, :, 0].astype(U)
    for t in range(TREES):
        for d in ([depth] if t < tree else []) + ([depth + 1] if depth < DEPTH else []):
            prefix = labels[:, t] >> U(8 * (DEPTH - d))
            ok &= prefix[:, None] != prefix[None, :]
    for row in np.flatnonzero(ok.any(axis=1)):
        ok[row] &= (sigs[row] == sigs).mean(axis=1) >= LIKELY
    return ok


def common(sets: list[np.ndarray], ok: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (row, column) for which ``ok`` may hold."""
    rows, columns = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[place] > 1
    owner, place = owner[shared], (np.cumsum(n > 1) - 1)[place[shared]]
    out = np.zeros((len(rows), len(columns)), dtype=np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    width = 4096
    for first in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, [first, first + width])
        held = np.zeros((len(sets), width), dtype=np.float32)
        held[owner[a:b], place[a:b] - first] = 1
        out += held[rows] @ held[columns].T
    whole = np.zeros(ok.shape, dtype=np.int64)
    whole[np.ix_(rows, columns)] = np.rint(out)
    return whole


def likely(units: DataFrame) -> DataFrame:
    """The rows of ``units`` (with signatures) that have a pair to compare."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in by_unit(batches):
            ok = fresh_pairs(unit)
            some = np.flatnonzero(ok.any(axis=0) | ok.any(axis=1))
            if len(some):
                yield from unit.take(pa.array(some)).combine_chunks().to_batches()

    return units.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(sift, units.schema)


def local_roots(links: np.ndarray) -> np.ndarray:
    """The first place that each place is connected with: the least neighbour's label, until nothing moves."""
    joined = links | links.T
    label = np.arange(len(links))
    while True:
        moved = np.minimum(label, np.where(joined, label, len(links)).min(axis=1))
        moved = moved[moved]
        if (moved == label).all():
            return label
        label = moved


def verified(units: DataFrame) -> DataFrame:
    """(words_id, root, n_links): links of each class in each unit, and the smallest class of its part of the unit."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in by_unit(batches):
            ok = fresh_pairs(unit)
            sets = [np.asarray(s.values).view(U) for s in unit.column("shingles").combine_chunks()] if unit.num_rows else []
            both, sizes = common(sets, ok), np.array([len(s) for s in sets])
            joint = sizes[:, None] + sizes[None, :] - both
            links = ok & (both >= THRESHOLD * joint - 1e-9)
            if not links.any():
                continue
            n_links = links.sum(axis=0) + links.sum(axis=1)
            ids = unit.column("words_id").to_pylist()
            linked = np.flatnonzero(n_links)
            roots = [ids[a] for a in local_roots(links)[linked].tolist()]  # rows are in the order of words_id
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in linked], pa.binary()), pa.array(roots, pa.binary()), pa.array(n_links[linked])],
                ["words_id", "root", "n_links"],
            )

    return units.repartition(*UNIT).sortWithinPartitions(*UNIT, "words_id").mapInArrow(verify, "words_id binary, root binary, n_links long")


def recall(s: float, depth: int) -> float:
    """Share of the links of similarity ``s`` that are found at ``depth``."""
    return (1 - (1 - s**depth) ** TREES) * LIKELY_KEPT


def links(docs: DataFrame, classes: DataFrame, target: float = TARGET_RECALL) -> DataFrame:
    """(words_id, root, n_links) over all rounds; prefixes of one byte find a share of ``LIKELY_KEPT``, which no target can exceed."""
    units = None
    for depth in range(DEPTH, 0, -1):
        round_ = stored(likely(nodes(classes, depth).join(classes.select("words_id", "sig").hint("merge"), "words_id")), "units")
        units = round_ if units is None else units.unionByName(round_)
        if recall(THRESHOLD, depth) >= target:
            break
    # one way at every size: what is wanted grows with the corpus
    wanted = stored(units.select("words_id").distinct().join(classes.select("words_id", "body").hint("merge"), "words_id"), "wanted")
    rows = docs.select(body_of().alias("body"), "text").join(wanted.select("body").hint("merge"), "body", "left_semi")
    sets = shingled(rows).dropDuplicates(["words_id"])
    return stored(verified(units.join(sets.hint("merge"), "words_id")), "links")


def ties(found: DataFrame) -> DataFrame:
    """(a, b): each class with the smallest one that its units name, and the others they name with that one too."""
    least = F.min("root").over(Window.partitionBy("words_id"))
    named = found.select("words_id", "root", least.alias("low"))
    return named.select(F.col("words_id").alias("a"), F.col("low").alias("b")).unionByName(named.select(F.col("root").alias("a"), F.col("low").alias("b"))).distinct()


def near_classes(docs: DataFrame, target: float = TARGET_RECALL) -> tuple[DataFrame, DataFrame]:
    """(doc_id, body, words_id) of every document; (words_id, copy_id, class_id, n_links) of every class."""
    rows = stored(signed(docs.select("doc_id", "text")), "signed")
    classes = rows.groupBy("words_id").agg(
        F.min("doc_id").alias("copy_id"), F.min_by("body", F.struct("doc_id", "body")).alias("body"), F.any_value("sig").alias("sig"), F.any_value("n_words").alias("n_words")
    )
    classes = stored(classes, "classes")
    found = links(docs, classes.where("sig IS NOT NULL"), target)
    groups = components(ties(found)).withColumnRenamed("node", "words_id")
    counts = found.groupBy("words_id").agg(F.sum("n_links").alias("n_links"))
    joined = classes.select("words_id", "copy_id").join(groups, "words_id", "left").join(counts, "words_id", "left")
    joined = stored(joined.withColumn("label", F.coalesce("label", "words_id")), "class_labels")
    lowest = joined.groupBy("label").agg(F.min("copy_id").alias("class_id"))
    out = joined.join(lowest, "label").select("words_id", "copy_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "label")
    return rows.drop("sig", "n_words"), stored(out, "near_classes")


def report(docs: DataFrame) -> DataFrame:
    rows, classes = near_classes(docs)
    return rows.join(classes, "words_id").select("doc_id", "class_id", "copy_id", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """The first document of each group: by doc_id, nulls last; of repeated rows, one stays."""
    rows, classes = near_classes(docs)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "body")
    firsts = stored(rows.join(classes.select("words_id", "label"), "words_id").groupBy("label").agg(F.min_by("body", order).alias("first")), "firsts")
    wrapped = docs.select(F.struct(*docs.columns).alias("row"), body_of().alias("body"))
    chosen = wrapped.join(firsts.select(F.col("first").alias("body")), "body", "left_semi")
    return chosen.groupBy("body").agg(F.any_value("row").alias("row")).select("row.*")
