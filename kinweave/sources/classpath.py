"""Class paths: an index of what archives hold, and the classes of a path that are needed, read on demand.

An index has a row for each class file of an archive, by its name in the archive, without reading the file. ``catch_up`` is a fixpoint: the
classes that the known rows name, and that aren't known, meet the index; just these entries are read and parsed, and only their rows name further ones.
So a path of any size costs its index and the closure of what refers to it. Of several entries for one class, that of the first
input counts, by the order in which the inputs are given.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.storage import stored

from . import classfile

INDEX = "rank int, archive string, entry string, class string"


def index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(rank, archive, entry, class) of all class files in the archives under ``paths``; the rank is the place of the path. An archive that can't be opened has no rows."""

    def listed(rank: int):
        def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                    try:
                        with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as archive:
                            rows += [(rank, path, n, n.removesuffix(".class")) for n in archive.namelist() if n.endswith(".class")]
                    except zipfile.BadZipFile:
                        continue
                types = (pa.int32(), pa.string(), pa.string(), pa.string())
                columns = zip(*rows, strict=True) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["rank", "archive", "entry", "class"])

        return names

    def files(path: str) -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    return stored(reduce(DataFrame.unionByName, [files(p).mapInArrow(listed(i), INDEX) for i, p in enumerate(paths)]), "class_index")


def first_entries(known: DataFrame) -> DataFrame:
    """One entry of each class: that of the smallest rank, then by archive and entry."""
    return known.groupBy("class").agg(F.min(F.struct("rank", "archive", "entry")).alias("e")).select("class", "e.*")


def read_entries(spark: SparkSession, entries: DataFrame) -> DataFrame:
    """Rows of class files (see ``classfile``) of ``entries`` (archive, entry); archives without any aren't opened."""
    wanted = entries.groupBy("archive").agg(F.collect_set("entry").alias("entries"))
    archives = [r.archive for r in wanted.select("archive").collect()]
    if not archives:
        return spark.createDataFrame([], classfile.SCHEMA)
    files = spark.read.format("binaryFile").load(archives).select(F.col("path").alias("archive"), "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, names, content in zip(batch.column("archive").to_pylist(), batch.column("entries").to_pylist(), batch.column("content"), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as opened:
                    yield from classfile.batches_of(archive, ((n, classfile.content_of(opened, n)) for n in sorted(names)))

    return files.join(wanted, "archive").mapInArrow(parse, classfile.SCHEMA)


def named_classes(rows: DataFrame) -> DataFrame:
    """(class): every class that the rows name: parents, interfaces, owners of members that are referred to, and all in descriptors."""
    text = F.explode(F.array("other", "name", "value", F.col("id")))
    relevant = rows.where("kind IN ('class', 'implements', 'outer', 'field', 'method', 'calls', 'reads', 'writes', 'class ref', 'site', 'signature', 'local')")
    types = relevant.select(text.alias("t")).where("t IS NOT NULL").select(F.explode(F.regexp_extract_all("t", F.lit(r"L([\w$/]+)[;<]"), F.lit(1))).alias("class"))
    whole = relevant.where("kind IN ('class', 'implements', 'outer', 'class ref')").select(F.regexp_replace("other", r"^\[+L?|;$", "").alias("class"))
    owners = relevant.where("kind IN ('calls', 'reads', 'writes')").select(F.regexp_extract("other", r"^(.*?)/[^/(;]+(?:\(.*|;;.*)$", 1).alias("class"))
    return reduce(DataFrame.unionByName, [types, whole, owners]).where("class <> ''").distinct()


def known_classes(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'class'").select(F.col("id").alias("class")).distinct()


def catch_up(spark: SparkSession, rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows of the classes of ``entries`` (an index) that ``rows`` need, directly or by each other; those of ``rows`` aren't among them.

    Each pass parses the entries that the last pass's rows have named for the first time.
    """
    first = stored(first_entries(entries), "class_entries")
    known = stored(known_classes(rows), "known")
    front, parts = rows, []
    while True:
        new = stored(named_classes(front).join(known, "class", "left_anti").join(first, "class"), "wanted")
        if new.isEmpty():
            return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], classfile.SCHEMA)
        front = stored(read_entries(spark, new), "class_rows")
        parts.append(front)
        known = stored(known.unionByName(new.select("class")).unionByName(known_classes(front)).distinct(), "known")
