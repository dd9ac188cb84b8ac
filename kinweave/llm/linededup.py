"""Line dedup against levelled sorted runs of line hashes.

A run is a table (h1, h2, n_docs, keep_id) bucketed and sorted by the 128-bit line hash; all runs of a corpus have the same
buckets. A batch of documents is counted by hash, dealt into these buckets, and merge-anti-joins each run: a key that a run has
settled already (enough documents, and a keeper beyond the batch's) adds nothing; all other keys go into a new run of level 0.
Two runs of one level are merged into one run of the next level, by a full join on the hash, so a corpus of n batches has log(n) runs
at most. Anti-joins, merges and the last totals go bucket by bucket: only a batch's own counts are shuffled, no run ever is.

A key's lines are removed from all documents but its keeper (the largest doc_id holding it) once the key has
been found in ``min_docs`` documents, over all batches.

Defined cases: a null or empty text is one empty line; a null doc_id counts as smaller than any other; rows with the
same doc_id count as different documents and all of them keep a line whose keeper has that id; short keys
never leave; extra columns are carried along and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.columns import let
from kinweave.storage import emptied, fresh_path, stored

# The white space that is stripped, and the letters that are lowered.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

HASH = ["h1", "h2"]
NO_ID = -(2**63)
BUCKET_LINES = 500_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def lowered(trimmed: Column) -> Column:
    """A-Z lowered, other letters left alone; the plain function does for ASCII and is faster."""
    return F.when(F.length(trimmed) == F.octet_length(trimmed), F.lower(trimmed)).otherwise(F.translate(trimmed, UPPER, LOWER))


def line_table(docs: DataFrame, batches: int, min_chars: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row (batch, id, body, pos, h1, h2, first) for each line whose key has ``min_chars`` code points.

    ``body`` tells apart rows with one doc_id; ``first`` marks a key's first line in its document.
    """
    # a key is never longer than its line, so most short lines go before any key is made
    long_enough = F.filter(F.transform(lines_of(F.col(text)), lambda line, i: F.struct(line.alias("s"), i.alias("pos"))), lambda x: F.length(x["s"]) >= min_chars)
    trimmed = F.transform(long_enough, lambda x: F.struct(F.btrim(x["s"], F.lit(STRIPPED)).alias("s"), x["pos"].alias("pos")))
    keys = F.filter(F.transform(trimmed, lambda x: F.struct(lowered(x["s"]).alias("s"), x["pos"].alias("pos"))), lambda x: F.length(x["s"]) >= min_chars)
    hashed = F.transform(keys, lambda x: F.struct(F.xxhash64(x["s"]).alias("h1"), F.xxhash64(F.lit("second"), x["s"]).alias("h2"), x["pos"].alias("pos")))

    def marked(all_: Column) -> Column:
        def mark(x: Column, i: Column) -> Column:
            previous = F.get(all_, i - 1)
            again = (previous["h1"] == x["h1"]) & (previous["h2"] == x["h2"])
            return F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["pos"].alias("pos"), (~F.coalesce(again, F.lit(False))).alias("first"))

        return F.transform(all_, mark)

    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("body"),
        F.explode(let(F.sort_array(hashed), marked)).alias("x"),
    )
    return rows.select(F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int").alias("batch"), "id", "body", "x.*")


def same_key(a: DataFrame, b: DataFrame) -> Column:
    return (a.h1 == b.h1) & (a.h2 == b.h2)


class LineRuns:
    """The levelled runs of one corpus; ``add`` takes batches in any order, ``close`` forgets the runs' tables and frees their space."""

    def __init__(self, spark: SparkSession, buckets: int, min_docs: int = 5):
        self.spark, self.buckets, self.min_docs = spark, buckets, min_docs
        self.levels: list[DataFrame | None] = []
        self.names: dict[str, str] = {}

    def runs(self) -> list[DataFrame]:
        return [run for run in self.levels if run is not None]

    @staticmethod
    def merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """Documents and keeper of every key of two runs; equal buckets meet where they are."""
        other = b.withColumnsRenamed({"n_docs": "n_too", "keep_id": "keep_too"})
        docs = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n_too", F.lit(0))
        return a.join(other.hint("merge"), HASH, "full_outer").select(*HASH, docs.alias("n_docs"), F.greatest("keep_id", "keep_too").alias("keep_id"))

    def unsettled(self, batch: DataFrame) -> DataFrame:
        """The keys of a bucketed ``batch`` that no run has settled."""
        for run in self.runs():
            settled = run.where(F.col("n_docs") >= self.min_docs).select(*HASH, F.col("keep_id").alias("_settled"))
            batch = batch.join(settled.hint("merge"), same_key(batch, settled) & (settled["_settled"] >= batch.keep_id), "left_anti")
        return batch

    def add(self, lines: DataFrame) -> None:
        """Take a batch of ``line_table`` rows."""
        own = self._written(lines.where("first").groupBy(*HASH).agg(F.count("*").alias("n_docs"), F.max("id").alias("keep_id")))
        run = self._written(self.unsettled(own)) if self.runs() else own
        for level, held in enumerate(self.levels):
            if held is None:
                self.levels[level] = run
                return
            run, self.levels[level] = self._written(self.merged(held, run)), None
        self.levels.append(run)

    def _written(self, run: DataFrame) -> DataFrame:
        path = fresh_path(self.spark, "line_run")
        name = path.rpartition("/")[2].replace("-", "_")
        run.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", path).saveAsTable(name)
        self.names[name] = path
        return self.spark.table(name)

    def shared(self) -> DataFrame:
        """(h1, h2, keep_id) of the keys found in enough documents, as a table of its own."""
        total, *larger = self.runs()
        for run in larger:
            total = self._written(self.merged(run, total))
        return stored(total.where(F.col("n_docs") >= self.min_docs).select(*HASH, "keep_id"), "shared_lines")

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        emptied(self.spark, *self.names.values())


def drop_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, batches: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(row, lines, gone): each row of ``docs`` as a struct, its lines, and the places of those that go, or null."""
    lines = stored(line_table(docs, batches, min_chars, text, doc_id), "lines")
    # as many buckets as an exchange has partitions, but fewer for few lines
    buckets = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + lines.count() // BUCKET_LINES)
    runs = LineRuns(docs.sparkSession, buckets, min_docs)
    try:
        for batch in range(batches):
            runs.add(lines.where(F.col("batch") == batch))
        shared = runs.shared()
    finally:
        runs.close()
    removed = lines.join(shared, HASH).where(F.col("id") < F.col("keep_id")).select("id", "body", "pos")
    gone = removed.groupBy("id", "body").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    keyed = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("body"),
    )
    # one way at every size: what goes grows with the corpus, so it is never sent to all tasks
    return keyed.join(stored(gone, "lines_gone").hint("merge"), ["id", "body"], "left").select("row", lines_of(F.col("row")[text]).alias("lines"), "gone")


def kept_text() -> Column:
    """The lines that stay, joined again."""
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    chosen = let(F.col("lines"), lambda lines: F.transform(places, lambda i: F.get(lines, i)))
    return F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(chosen, "\n"))


def dedup_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: line counts and the checksum of the kept text."""
    return drop_lines(docs.select("doc_id", "text"), **options).select(
        "row.doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept_text(), 256).alias("kept_sha256"),
    )


def dedup_texts(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the kept text in place of the text; a document that loses no line keeps its text as it is, null included."""
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept_text())
    return drop_lines(docs, **options).select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
