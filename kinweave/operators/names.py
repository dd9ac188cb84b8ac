"""Names: resolution, propagation, upserts, and running numbers without a single task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.storage import stored


def resolved(*choices: tuple[Column, Column]) -> Column:
    """The first name whose condition holds and that isn't null."""
    return F.coalesce(*[F.when(condition, name) for condition, name in choices])


def least_uid(a: Column, b: Column) -> Column:
    """The smaller of two ids, where a negative one or a null is none; -1 for two of those."""
    a, b = F.when(a >= 0, a), F.when(b >= 0, b)
    return F.coalesce(F.least(a, b), F.lit(-1).cast("long"))


def ranged(rows: DataFrame, order: list[str], buckets: int) -> DataFrame:
    """``rows`` dealt over partitions by ranges of ``order``, with the partition as _part.

    Written once: the ranges come from a sample, and all that is computed from them has to see the same ones.
    """
    return stored(rows.repartitionByRange(buckets, *order).withColumn("_part", F.spark_partition_id()), "ranged")


def numbered(rows: DataFrame, order: list[str], column: str, start: int = 0, buckets: int = 64, group: str | None = None) -> DataFrame:
    """``rows`` numbered from ``start`` in ``order``, without gaps; in each ``group`` anew if that is given. The group isn't null.

    Rows are ranged over partitions by group and order, counted per partition, and numbered inside it after the sum of
    the counts before. Only the counts, one for each of ``buckets`` partitions and group in it, meet in one task, so a large
    group is numbered by many tasks.
    """
    keys = [group] if group else []
    dealt = ranged(rows, [*keys, *order], buckets)
    counts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    at = (F.col("_before") + F.col("_at") - 1 + start).cast("long")
    return dealt.withColumn("_at", within).join(before, [*keys, "_part"]).select(*rows.columns, at.alias(column))


def followed(rows: DataFrame, group: str, order: str, column: str, buckets: int = 64) -> DataFrame:
    """``rows`` with the value of ``order`` in the next row of their ``group``, null in the last one.

    As in ``numbered``, a large group lies in many partitions: the last row of one takes the first value of the group's next
    partition. Null groups are one group.
    """
    dealt = ranged(rows, [group, order], buckets)
    firsts = dealt.groupBy(group, "_part").agg(F.min(order).alias("_first"))
    onward = firsts.select(F.col(group).alias("_group"), F.col("_part").alias("_own"), F.lead("_first").over(Window.partitionBy(group).orderBy("_part")).alias("_onward"))
    here = dealt.withColumn("_next", F.lead(order).over(Window.partitionBy(group, "_part").orderBy(order)))
    joined = here.join(onward, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_own")))
    return joined.select(*rows.columns, F.coalesce("_next", "_onward").alias(column))


def upserted(old: DataFrame, new: DataFrame, key: str, column: str, replace: bool) -> DataFrame:
    """``old`` with ``new`` values set where there was none, or everywhere if ``replace``; the least of several new values counts."""
    one = new.groupBy(key).agg(F.min(column).alias("_new"))
    value = F.coalesce("_new", column) if replace else F.coalesce(column, "_new")
    return old.join(one, key, "left").withColumn(column, value).drop("_new")


def propagated(members: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """``members`` with nulls replaced by the first name of their group."""
    first = members.where(F.col(name).isNotNull()).groupBy(group).agg(F.min_by(name, order).alias("_first"))
    return members.join(first, group, "left").withColumn(name, F.coalesce(name, "_first")).drop("_first")


def once_per_group(members: DataFrame, group: str, order: str) -> DataFrame:
    """The first member of each group."""
    return members.groupBy(group).agg(F.min_by(F.struct(*members.columns), order).alias("r")).select("r.*")


def short_first(name: Column) -> Column:
    """Sort key: shorter names first, nulls last."""
    return F.struct(name.isNull(), F.length(name), name)


def nest_aware(name: Column) -> Column:
    """Sort key: part by part of a nested name, shorter parts first, and an outer name before its inner ones."""
    return F.transform(F.split(name, r"\$"), lambda part: F.struct(F.length(part), part))


def natural(name: Column) -> Column:
    """Sort key: runs of digits by length and then value, other runs as they are."""
    runs = F.regexp_extract_all(name, F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def key(run: Column) -> Column:
        digits = run.rlike("^[0-9]")
        return F.struct(digits, F.when(digits, F.length(run)).otherwise(0), run)

    return F.transform(runs, key)


def natural_key(name: Column) -> Column:
    """A binary sort key of paths of nested names: bytes in order are the natural order, so sorts and range partitions need no comparison of their own.

    A name is cut into runs of digits, single separators (``.``, ``/`` and ``$``) and runs of what else there is. Names are compared run by run: one that lies
    before another path separator comes after one that doesn't, so deeper paths are later; digits come by their number of digits, then by value;
    others by code points, and a run before those that it starts. A name is smaller than those that go on after it. Whether a separator follows
    is asked of the whole name, so the order is a total one for any names. Null stays null.
    """
    runs = F.regexp_extract_all(name, F.lit(r"[./$]|[0-9]+|[^0-9./$]+"), F.lit(0))
    back = F.array_position(F.reverse(F.transform(runs, lambda x: x.isin(".", "/"))), F.lit(True))
    last = F.when(back > 0, F.size(runs) - back).otherwise(-1)

    def part(run: Column, i: Column) -> Column:
        # a mark that is below all others ends a run; a zero in it is told from that mark
        text = F.when(run.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(run).cast("string"), 10, "0"), run)).otherwise(F.replace(run, F.lit("\0"), F.lit("\0\1")))
        return F.concat(F.when(i <= last, "\2").otherwise("\1"), text, F.lit("\0\0"))

    return F.array_join(F.transform(runs, part), "").cast("binary")
