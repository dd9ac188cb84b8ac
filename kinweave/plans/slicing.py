"""Slices over the driver's events: each user's events in order are a program, and an error with a value is what is traced back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinweave.operators import slices

from .tables import table

#: An event as an instruction: (taken cells, left cells). A view is a constant, a click reads a variable, a sign-up writes one, a purchase
#: joins two cells, and an error takes one; a small error is a jump, a large one is what is traced.
POPS = "CASE WHEN event_type IN ('view', 'click') THEN 0 WHEN event_type = 'purchase' THEN 2 ELSE 1 END"
PUSHES = "CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 1 ELSE 0 END"
SLOT = "CAST(floor(value / 25) AS INT)"
JUMP = "CASE WHEN event_type = 'error' AND value < 20 THEN CAST(floor(value * 2) AS INT) END"
TRACED = "event_type = 'error' AND value >= 20"


def programs(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr("user_id AS method", "ts", "event_id", "event_type", "value", f"{POPS} AS pops", f"{PUSHES} AS pushes", f"{SLOT} AS slot", f"{JUMP} AS jump", f"{TRACED} AS traced")
    order = Window.partitionBy("method").orderBy("ts", "event_id")
    rows = events.withColumn("place", (F.row_number().over(order) - 1))
    rows = rows.withColumn("height", F.coalesce(F.sum(F.col("pushes") - F.col("pops")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    count = rows.groupBy("method").agg(F.count("*").alias("n"))
    rows = rows.join(count, "method")
    return rows.select(
        "method", "place", "height", "pops", "pushes", F.lit(None).cast("array<int>").alias("moves"), F.when(F.col("event_type") == "click", F.col("slot")).alias("load"),
        F.when(F.col("event_type") == "signup", F.array("slot")).otherwise(F.array().cast("array<int>")).alias("stores"),
        F.when(F.col("jump") < F.col("n"), F.array("jump")).otherwise(F.array().cast("array<int>")).alias("jumps"), F.lit(True).alias("falls"), "traced",
    )


def event_slices(spark, sf_dir):
    """(user_id, traced, place): for each large error of a user the events that its value comes from."""
    rows = programs(spark, sf_dir)
    starts = rows.where("traced").select(F.col("place").alias("item"), "method", "place")
    found = slices.Graph(rows.drop("traced")).slices(starts)
    return found.select(F.col("method").alias("user_id"), F.col("item").alias("traced"), "place")


EVENT_SLICES = f"""
WITH RECURSIVE e AS (SELECT user_id AS m, event_type AS t, row_number() OVER w - 1 AS place, {POPS} AS pops, {PUSHES} AS pushes, {SLOT} AS slot, {JUMP} AS jump, {TRACED} AS traced,
  coalesce(sum({PUSHES} - {POPS}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h,
  count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
next AS (SELECT m, place AS src, place + 1 AS dst FROM e WHERE place + 1 < n UNION SELECT m, place, jump FROM e WHERE jump < n),
used AS (SELECT m, place, unnest(range((h - pops)::BIGINT, h::BIGINT)) * 2 AS loc FROM e UNION ALL SELECT m, place, slot * 2 + 1 FROM e WHERE t = 'click'),
made AS (SELECT m, place, ((h - pops) * 2)::BIGINT AS loc FROM e WHERE pushes = 1 UNION ALL SELECT m, place, slot * 2 + 1 FROM e WHERE t = 'signup'),
walk AS (SELECT m, place AS item, place, -1::BIGINT AS loc FROM e WHERE traced
  UNION SELECT m, item, place, loc FROM (
    SELECT w.m, w.item, u.place, u.loc FROM walk w JOIN used u ON w.m = u.m AND w.place = u.place AND w.loc = -1
    UNION ALL SELECT w.m, w.item, x.src, CASE WHEN d.m IS NULL THEN w.loc ELSE -1 END FROM walk w JOIN next x ON w.m = x.m AND w.place = x.dst AND w.loc <> -1 LEFT JOIN made d ON d.m = w.m AND d.place = x.src AND d.loc = w.loc))
SELECT m AS user_id, item AS traced, place FROM walk WHERE loc = -1"""

QUERIES = {"event_slices": event_slices}
ORACLES = {"event_slices": EVENT_SLICES}
