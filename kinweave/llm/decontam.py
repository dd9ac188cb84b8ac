"""Benchmark decontamination by a distributed positional inverted index.

Items are cut into windows of 13 words (an item with fewer words is one window).

1. Count the benchmark's terms over all documents; the two rarest places of each window are its anchors.
2. Store the postings (term, document, positions) of all anchors' terms: one index for the whole benchmark.
3. Shift each position by the anchor's place in its item, and intersect the lists of a window's two anchors: equal
   shifts are candidates for the exact phrase, shifts at most ``slop`` apart are proximity matches.
4. Compare a candidate's words with the document's at their place. A candidate has the words of all windows with the
   same anchors, 2 * 13 - 1 at most, so a document's candidates follow its own matches and not the length of items.

Step 3 misses nothing, as an occurrence of a window holds both of its anchors at one shift. Terms are held by tasks in
blocks of ``MAX_TERMS`` at most; a benchmark of more different words takes further passes over the documents. Everything else about
items is a table. Rows with equal id and text share their postings, so repeated rows don't meet each other.

Defined cases: null and empty texts have no words and no hits; an item without words has no windows; items without an
id mark hits and aren't listed; rows with the same doc_id are different documents; repeated items count once; empty tables give
documents without hits, or no rows; extra columns are carried by ``clean`` and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.storage import stored

from .words import U, chunks, word_hashes

WINDOW = 13
SLOP = 10
#: Different terms that the driver and each task hold at once, but for the spread of a hash.
MAX_TERMS = 2_000_000
#: Parts of each anchor's postings, so that a frequent one isn't a single join key.
SALTS = 8


def docs_with_body(docs: DataFrame) -> DataFrame:
    return docs.select("text", F.xxhash64("doc_id", "text").alias("body"))


def item_words(items: DataFrame) -> DataFrame:
    """(item, item_id, words): the words' hashes of each different item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column("text")):
                hashes, firsts = word_hashes(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("item")[first:last],
                        batch.column("item_id")[first:last],
                        pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(hashes.view(np.int64))),
                    ],
                    ["item", "item_id", "words"],
                )

    distinct = items.select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("string").alias("item_id"), "text").dropDuplicates(["item"])
    return distinct.mapInArrow(cut, "item long, item_id string, words array<long>").where(F.size("words") > 0)


def blocks(terms: DataFrame) -> Iterator[np.ndarray]:
    """The different values of ``terms`` (term) in sorted arrays of about ``MAX_TERMS``."""
    terms = stored(terms.distinct(), "terms")
    n_blocks = -(-terms.count() // MAX_TERMS)
    for block in range(n_blocks):
        own = terms.where(F.pmod(F.xxhash64("term"), F.lit(n_blocks)) == block).toArrow().column("term").to_numpy()
        yield np.sort(own.view(U))


def term_counts(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(term, n): occurrences of each of ``terms`` (sorted hashes) in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text")):
                hashes, _ = word_hashes(data, offsets)
                place, known = lookup(terms, hashes)
                total += np.bincount(place[known], minlength=len(terms))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(terms[seen].view(np.int64)), pa.array(total[seen])], ["term", "n"])

    return docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lookup(terms: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted ``terms``, whether it is one) of each hash."""
    place = np.searchsorted(terms, hashes)
    place[place == len(terms)] = 0
    return place, (terms[place] == hashes) if len(terms) else np.zeros(len(hashes), dtype=bool)


def anchors(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(item, item_id, term, place, other, other_place, begin, words): the two rarest places of windows, ties to the left.

    ``words``, from place ``begin`` on, are those of all windows with these anchors: such windows follow each other.
    """
    places = items.select("item", "item_id", F.size("words").alias("size"), F.posexplode("words").alias("at", "word"))
    known = places.join(counts, places.word == counts.term, "left").select("item", "item_id", "size", "at", "word", F.coalesce("n", F.lit(0)).alias("n"))
    frame = Window.partitionBy("item").orderBy("at").rowsBetween(0, window - 1)
    held = F.collect_list(F.struct("n", "at", "word")).over(frame)
    width = F.least(F.col("size"), F.lit(window))
    windows = known.select("item", "item_id", "at", "size", F.transform(held, lambda x: x["word"]).alias("words"), F.slice(F.sort_array(held), 1, 2).alias("two"))
    windows = windows.where(F.col("at") + width <= F.col("size")).withColumns({"one": F.col("two")[0], "last": F.element_at("two", -1)})
    windows = windows.where("one.n > 0")  # else no document can hold the window
    keys = [F.col("one.word").alias("term"), F.col("one.at").alias("place"), F.col("last.word").alias("other"), F.col("last.at").alias("other_place")]
    grouped = windows.groupBy("item", "item_id", *keys).agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("w"))
    rest = F.transform(F.slice("w", F.lit(2), F.size("w")), lambda x: F.element_at(x["words"], -1))
    return grouped.select("item", "item_id", "term", "place", "other", "other_place", F.col("w")[0]["at"].alias("begin"), F.concat(F.col("w")[0]["words"], rest).alias("words"))


def postings(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(term, body, positions) of ``terms`` in all documents."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column("text")):
                hashes, firsts = word_hashes(data, offsets)
                place, known = lookup(terms, hashes)
                at = np.flatnonzero(known)
                doc = np.searchsorted(firsts, at, side="right") - 1
                order = np.lexsort((at, place[at], doc))
                at, doc = at[order], doc[order]
                term = place[at]
                new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])]) if len(at) else np.zeros(0, dtype=np.int64)
                owner = pa.array(doc[new] + first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(terms[term[new]].view(np.int64)),
                        batch.column("body").take(owner),
                        pa.ListArray.from_arrays(pa.array(np.r_[new, len(at)].astype(np.int32)), pa.array((at - firsts[doc]).astype(np.int32))),
                    ],
                    ["term", "body", "positions"],
                )

    return docs.select("body", "text").mapInArrow(post, "term long, body long, positions array<int>").distinct()


PAIR = ["item", "place", "other_place"]


def intersect(index: DataFrame, pairs: DataFrame, slop: int) -> DataFrame:
    """(item, place, other_place, body, shift, exact): shifts at which both anchors of a window lie, at most ``slop`` apart.

    Shifts are met by buckets of ``slop`` + 1: a bucket of one anchor and document holds that many places at most.
    """
    width = slop + 1
    posted = index.select("term", "body", F.pmod(F.xxhash64("body"), F.lit(SALTS)).cast("int").alias("salt"), F.explode("positions").alias("at"))
    salted = pairs.select(*PAIR, "term", "other", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    one = posted.join(salted.drop("other"), ["term", "salt"]).select(*PAIR, "body", (F.col("at") - F.col("place")).alias("shift"))
    two = posted.join(salted.drop("term").withColumnRenamed("other", "term"), ["term", "salt"]).select(*PAIR, "body", (F.col("at") - F.col("other_place")).alias("other_shift"))
    one = one.withColumn("bucket", F.floor(F.col("shift") / width))
    two = two.withColumn("bucket", F.explode(F.array(*[F.floor(F.col("other_shift") / width) + i for i in (-1, 0, 1)])))
    met = one.join(two, [*PAIR, "body", "bucket"]).where(F.abs(F.col("shift") - F.col("other_shift")) <= slop)
    return met.groupBy(*PAIR, "body", "shift").agg(F.max(F.col("shift") == F.col("other_shift")).alias("exact"))


def search(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """(body, candidates, near): each document's exact candidates (words, places, item ids), and the ids of all items near by."""
    spark = docs.sparkSession
    items = stored(item_words(items), "items")
    counts = spark.createDataFrame([], "term long, n long")
    for terms in blocks(items.select(F.explode("words").alias("term"))):
        counts = counts.unionByName(stored(term_counts(docs, terms), "term_counts"))
    pairs = stored(anchors(items, counts, window), "anchors")
    index = spark.createDataFrame([], "term long, body long, positions array<int>")
    for terms in blocks(pairs.select("term").unionByName(pairs.select(F.col("other").alias("term")))):
        index = index.unionByName(stored(postings(docs, terms), "postings"))
    met = stored(intersect(index, pairs, slop), "met")
    exact = met.where("exact").join(pairs.select(*PAIR, "item_id", "begin", "words"), PAIR)
    same = exact.groupBy("body", "words").agg(F.collect_set(F.col("begin") + F.col("shift")).alias("places"), F.collect_set("item_id").alias("item_ids"))
    found = same.groupBy("body").agg(F.collect_list(F.struct("words", "places", "item_ids")).alias("candidates"))
    near = met.select("item", "body").distinct().join(items.select("item", "item_id"), "item").groupBy("body").agg(F.collect_set("item_id").alias("near"))
    return near.join(found, "body", "left")


def occurrences(words: np.ndarray, phrase: np.ndarray, places: np.ndarray, window: int) -> np.ndarray:
    """Starts in ``words`` of the windows of ``phrase`` that occur with it at one of ``places``, which may reach beyond the ends."""
    n = min(window, len(phrase))
    found = [np.zeros(0, dtype=np.int64)]
    for first in range(0, len(places), 4096):
        at = places[first : first + 4096, None] + np.arange(len(phrase))
        inside = (at >= 0) & (at < len(words))
        equal = inside & (words[np.where(inside, at, 0)] == phrase)
        sums = np.concatenate([np.zeros((len(at), 1), dtype=np.int64), np.cumsum(equal, axis=1)], axis=1)
        found.append(at[:, : len(phrase) - n + 1][sums[:, n:] - sums[:, :-n] == n])
    return np.unique(np.concatenate(found))


def judge(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """(row, n_words, n_hit, items, near): each row of ``docs`` as a struct; near has the items whose anchors come within ``slop`` of their places.

    The documents always move to their candidates, whose number grows with the corpus.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            candidates = batch.column("candidates")
            out: list[list] = [[], [], []]
            for first, last, data, offsets in chunks(pc.struct_field(batch.column("row"), "text")):
                hashes, firsts = word_hashes(data, offsets)
                for i in range(last - first):
                    words = hashes[firsts[i] : firsts[i + 1]]
                    edges, found = np.zeros(len(words) + 1, dtype=np.int64), set()
                    for c in candidates[first + i].as_py() or ():
                        phrase = np.array(c["words"], dtype=np.int64).view(U)
                        starts = occurrences(words, phrase, np.array(c["places"], dtype=np.int64), window)
                        if len(starts):
                            edges[starts] += 1
                            np.subtract.at(edges, starts + min(window, len(phrase)), 1)
                            found.update(c["item_ids"])
                    hit = np.cumsum(edges)[:-1] > 0
                    for column, value in zip(out, (len(words), int(hit.sum()), sorted(found)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.string())), batch.column("near")],
                ["row", "n_words", "n_hit", "items", "near"],
            )

    per_doc = stored(search(docs_with_body(docs), items, window, slop), "candidates")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", "text").alias("body"))
    joined = rows.join(per_doc.hint("merge"), "body", "left").select("row", "candidates", F.coalesce("near", F.array().cast("array<string>")).alias("near"))
    return joined.mapInArrow(compare, f"row {rows.schema['row'].dataType.simpleString()}, n_words long, n_hit long, items array<string>, near array<string>")


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text"), items).select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that aren't contaminated."""
    return judge(docs, items).where(~contaminated()).select("row.*")
