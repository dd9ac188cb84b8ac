"""The match state as a journal: an append-only table of changes, from which the state at any time follows.

An entry is (time, kind, a, b, cause): kind is match, unmatch, reset or load; a reset has no ends. Entries of one time are one change; those that
follow from another entry of that time have its element as their cause. The state is what each element's last entry since the last reset says. Nothing
is rewritten: a match in place of another adds the unmatch of what it replaces, an undone change adds its reverse, a reset one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.storage import bucketed, buckets_for, emptied, fresh_path, shuffled, stored, unregistered

ENTRY = "time long, kind string, a string, b string, cause string"


def started(spark, matches: DataFrame | None = None, time: int = 0) -> DataFrame:
    """A journal that begins with ``matches`` (a, b), which a file's rows or a run before have given."""
    begun = spark.createDataFrame([(time, "reset", None, None, None)], ENTRY)
    return begun if matches is None else begun.unionByName(entries(matches, "load", time))


def entries(pairs: DataFrame, kind: str, time: int, cause: str | None = None) -> DataFrame:
    why = F.col("cause").cast("string") if "cause" in pairs.columns else F.lit(cause).cast("string")
    return pairs.select(F.lit(time).cast("long").alias("time"), F.lit(kind).alias("kind"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), why.alias("cause"))


def state_at(journal: DataFrame, time: int | None = None) -> DataFrame:
    """(a, b): the matches after the changes up to ``time``. A pair stands if no later entry since the last reset undid it."""
    rows = journal if time is None else journal.where(F.col("time") <= time)
    begun = F.lit(rows.where("kind = 'reset'").agg(F.coalesce(F.max("time"), F.lit(-1))).first()[0])
    rows = rows.where("kind <> 'reset'").where((F.col("time") > begun) | ((F.col("time") == begun) & (F.col("kind") == "load")))
    # of one time, what is undone goes before what is matched
    order = F.struct("time", F.col("kind") != "unmatch")
    last = rows.groupBy("a", "b").agg(F.max_by("kind", order).alias("kind"))
    return last.where("kind <> 'unmatch'").select("a", "b")


def matched(journal: DataFrame, pairs: DataFrame, time: int) -> DataFrame:
    """Entries that match ``pairs`` (a, b) and undo the other matches of their ends."""
    state = state_at(journal)
    new = pairs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).distinct()
    lost = state.join(new.select("a", F.col("b").alias("_to")), "a").where("b <> _to").select("a", "b", F.col("a").alias("cause"))
    lost = lost.unionByName(state.join(new.select("b", F.col("a").alias("_to")), "b").where("a <> _to").select("a", "b", F.col("_to").alias("cause"))).groupBy("a", "b").agg(F.min("cause").alias("cause"))
    return entries(lost, "unmatch", time).unionByName(entries(new.join(state, ["a", "b"], "left_anti"), "match", time))


def cascade(gone: DataFrame, follows: DataFrame) -> DataFrame:
    """(a, cause): everything that goes with ``gone`` (a), by ``follows`` (a, then), each with the element that it goes by; the first ones have none.

    A fixpoint over new elements only: members go with their class, variables with their method, a hierarchy's members with each other, arrays and their elements with each other.
    Steps lie in buckets of their causes and found elements in buckets of their own, so a pass shuffles only what it finds, and writes only what is new.
    """
    spark, buckets = gone.sparkSession, buckets_for(follows)
    ways, path = fresh_path(spark, "follows"), fresh_path(spark, "cascade")
    steps = follows.select(F.col("a").cast("string").alias("cause"), F.col("then").cast("string").alias("a")).where("a <> cause")
    first = gone.select(F.col("a").cast("string").alias("a"), F.lit(None).cast("string").alias("cause"), F.lit(0).alias("pass"))
    try:
        steps = bucketed(steps.repartition(buckets, "cause").distinct(), ways, ["cause"], buckets)
        found = bucketed(first.repartition(buckets, "a").distinct(), path, ["a"], buckets)
        last = 0
        while True:
            front = found.where(F.col("pass") == last).select(F.col("a").alias("cause"))
            new = steps.join(shuffled(front), "cause").repartition(buckets, "a").groupBy("a").agg(F.min("cause").alias("cause"))
            last += 1
            # an anti join would be moved below the other join, where all steps are shuffled for it
            met = new.join(shuffled(found.select("a", F.lit(True).alias("_known"))), "a", "left").where("_known IS NULL")
            found = bucketed(met.select("a", "cause", F.lit(last).alias("pass")), path, ["a"], buckets)
            if found.where(F.col("pass") == last).isEmpty():
                break
    finally:
        unregistered(spark, ways, path)
    emptied(spark, ways)
    return spark.read.schema(first.schema).parquet(path).drop("pass")


def unmatched(journal: DataFrame, gone: DataFrame, follows: DataFrame, time: int) -> DataFrame:
    """Entries that undo the matches of ``gone`` (a) and of all that goes with them. What isn't matched stops a cascade, as there is nothing to undo."""
    state = stored(state_at(journal), "state")
    held = state.select(F.col("a").alias("then"))
    live = follows.select(F.col("a").cast("string").alias("a"), F.col("then").cast("string").alias("then")).join(held, "then", "left_semi")
    lost = cascade(gone.select(F.col("a").cast("string").alias("a")).join(state, "a", "left_semi"), live)
    return entries(state.join(lost, "a"), "unmatch", time)


def undone(journal: DataFrame, time: int, now: int) -> DataFrame:
    """Entries that bring back the state before the changes of ``time``."""
    before, after = state_at(journal, time - 1), state_at(journal, time)
    back = entries(before.join(after, ["a", "b"], "left_anti"), "match", now)
    return back.unionByName(entries(after.join(before, ["a", "b"], "left_anti"), "unmatch", now))


def reset(journal: DataFrame, now: int, matches: DataFrame | None = None) -> DataFrame:
    """Entries that leave nothing matched but ``matches`` (a, b), those of a file's header and rows."""
    return started(journal.sparkSession, matches, now)


def history(journal: DataFrame) -> DataFrame:
    """(a, time, kind, b, cause, place): every element's entries in order, the causes of its last state among them."""
    order = Window.partitionBy("a").orderBy("time", F.col("kind") != "unmatch", "b")
    return journal.where("a IS NOT NULL").withColumn("place", F.row_number().over(order)).select("a", "time", "kind", "b", "cause", "place")
