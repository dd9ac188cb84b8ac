"""Lines of text files with their numbers, and what lines carry on to later ones, without one task for a file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.storage import stored

#: Lines in a block within which values are carried on; blocks of one file are tied by one row each.
BLOCK = 50_000


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, lines counted from 0. Large files are read in ranges.

    A range's rows come in the order of the file, so a line's number is that of the lines in the ranges before, and its place among its own range's.
    """
    raw = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"),
        F.when(F.contains("value", F.lit("\r")), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value")).alias("value"),
    )
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = raw.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # one row a range, of 128 MB as a rule: met by a shuffle, all lines of a range would be in one task
    return raw.join(F.broadcast(ranges), ["file", "start"]).select("file", (F.col("before") + F.col("id") - F.col("first")).alias("line"), "value")


def carried(rows: DataFrame, values: dict[str, Column | tuple[Column, Column]], block: int = BLOCK, made: Callable[[DataFrame], DataFrame] = lambda rows: rows, gaps: bool = True) -> DataFrame:
    """``made(rows)`` (file, line, ...) with columns of the last value so far in their file that isn't null. A value may be a pair of the condition that it isn't null and what it is then.

    Line numbers may have ``gaps`` of any size: blocks are tied in blocks of blocks, so no window holds more rows than a block has lines. Without gaps blocks are few, so they are
    met where rows are, and their last values are found by the numbers of these lines, with no row sorted for them. What ``made`` adds is made behind the shuffle, so only ``rows`` go through it.
    """
    here = {f"_own_{name}": F.when(*value) if isinstance(value, tuple) else value for name, value in values.items()}
    there = [value[0] if isinstance(value, tuple) else value.isNotNull() for value in values.values()]
    rows = rows.withColumn("_block", F.floor(F.col("line") / block))
    so_far = Window.partitionBy("file", "_block").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = rows
    if not gaps:
        # a block without any value passes on what came before it, so its first line stands for it
        few = made(rows).groupBy("file", "_block").agg(F.array(F.min("line"), *[F.max(F.when(c, F.col("line"))) for c in there]).alias("lines"))
        few = few.select("file", F.explode(F.array_distinct(F.array_compact("lines"))).alias("line"))
        told = rows.join(F.broadcast(few), ["file", "line"])
    told = made(told).select("file", "line", "_block", *[value.alias(c) for c, value in here.items()])
    ends = told.groupBy("file", "_block").agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct("line", F.col(c).alias("v")))).alias(c) for c in here])
    before = before_blocks(stored(ends, "ends"), list(here), max(block, 2)).select("file", "_block", *[F.col(c)["v"].alias(f"_before{c}") for c in here])
    if gaps:
        both = made(rows).withColumns(here).join(before, ["file", "_block"])
        both = both.withColumns({name: F.last(F.col(f"_own_{name}"), ignorenulls=True).over(so_far) for name in values})
    else:
        both = made(rows.repartition("file", "_block")).withColumns(here)
        both = both.withColumns({name: F.last(F.col(f"_own_{name}"), ignorenulls=True).over(so_far) for name in values}).join(F.broadcast(before), ["file", "_block"])
    return both.withColumns({name: F.coalesce(name, f"_before_own_{name}") for name in values}).drop("_block", *here, *[f"_before{c}" for c in here])


def before_blocks(ends: DataFrame, columns: list[str], block: int) -> DataFrame:
    """(file, _block, columns): the last value in the blocks of the file before, from (file, _block, columns), the last value in each block."""
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first, last = ends.agg(F.min("_block"), F.max("_block")).first()
    if first is None or last - first < block:
        within = earlier.partitionBy("file")
        return ends.select("file", "_block", *[F.last(c, ignorenulls=True).over(within).alias(c) for c in columns])
    ends = ends.withColumn("_above", F.floor(F.col("_block") / block))
    above = ends.groupBy("file", F.col("_above").alias("_block")).agg(*[F.max(c).alias(c) for c in columns])
    outside = before_blocks(stored(above, "ends"), columns, block).select("file", F.col("_block").alias("_above"), *[F.col(c).alias(f"_outside{c}") for c in columns])
    within = earlier.partitionBy("file", "_above")
    inside = ends.select("file", "_block", "_above", *[F.last(c, ignorenulls=True).over(within).alias(c) for c in columns])
    return inside.join(outside, ["file", "_above"]).select("file", "_block", *[F.coalesce(c, f"_outside{c}").alias(c) for c in columns])
