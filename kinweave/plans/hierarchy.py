"""Queries about the hierarchy of places and groups of members, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators import graph, lookups

from .tables import places, table

EDGES = """edges AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'w' FROM region)"""
PATHS = f"""WITH RECURSIVE {EDGES}, paths AS (SELECT src AS sub, src AS sup, 0 AS distance FROM (SELECT src FROM edges UNION SELECT dst FROM edges)
UNION SELECT sub, dst, distance + 1 FROM paths JOIN edges ON sup = src)"""


def inverse_edges(spark, sf_dir):
    return graph.inverse(places(spark, sf_dir).withColumn("rel", F.lit("in"))).groupBy("src", "rel").agg(F.count("*").alias("n"), F.min("dst").alias("first"))


def ancestor_closure(spark, sf_dir):
    return graph.closure(places(spark, sf_dir))


def hierarchy_depth(spark, sf_dir):
    return graph.depths(graph.closure(places(spark, sf_dir)))


def assignable_pairs(spark, sf_dir):
    """How many customers and suppliers can stand where a node is asked for."""
    return graph.closure(places(spark, sf_dir)).where("sub <> sup").groupBy(F.col("sup").alias("node")).agg(F.count("*").alias("below"))


def sibling_count(spark, sf_dir):
    edges = places(spark, sf_dir)
    counts = edges.groupBy("dst").agg(F.count("*").alias("siblings"))
    return edges.join(counts, "dst").select(F.col("src").alias("node"), "siblings")


def place_members(spark, sf_dir) -> DataFrame:
    """(member, owner, name, apart): every node but the leaves has two members, named by its key's remainder; some are apart."""
    owners = places(spark, sf_dir).select(F.col("dst").alias("owner")).distinct()
    number = F.coalesce(F.substring("owner", 2, 10).try_cast("int"), F.lit(0))
    return owners.select(
        "owner",
        F.explode(F.array(F.struct(F.concat(F.lit("m"), (number % 2).cast("string")).alias("name"), F.lit(False).alias("apart")), F.struct(F.lit("p").alias("name"), (number % 3 == 0).alias("apart")))).alias("m"),
    ).select(F.concat_ws(".", "owner", "m.name").alias("member"), "owner", "m.name", "m.apart")


def hierarchy_components(spark, sf_dir):
    return graph.member_groups(graph.closure(places(spark, sf_dir)), place_members(spark, sf_dir))


def nearest_override(spark, sf_dir):
    return graph.nearest_override(graph.closure(places(spark, sf_dir)), place_members(spark, sf_dir))


def resolve_member(spark, sf_dir):
    """For every place and member name, the member it finds in itself or upwards."""
    paths = graph.closure(places(spark, sf_dir))
    wanted = paths.select(F.col("sub").alias("owner")).distinct().select("owner", F.explode(F.array(F.lit("m0"), F.lit("m1"), F.lit("p"))).alias("name"))
    return lookups.resolved_members(wanted, paths, place_members(spark, sf_dir).where("NOT apart"))


MEMBERS = f"""{PATHS}, o AS (SELECT DISTINCT dst AS owner, coalesce(try_cast(substr(dst, 2, 10) AS INT), 0) AS k FROM edges),
mem AS (SELECT owner || '.m' || (k % 2) AS member, owner, 'm' || (k % 2) AS name, false AS apart FROM o UNION ALL SELECT owner || '.p', owner, 'p', k % 3 = 0 FROM o)"""


def top10_children(spark, sf_dir):
    """Ten children of each node, by name; those on the way to customer 7 always."""
    path = graph.closure(places(spark, sf_dir)).where("sub = 'c7'").select(F.col("sup").alias("src"))
    edges = places(spark, sf_dir).select("dst", "src")
    # a limit on the rank alone is applied before the exchange, so a node with many children sends ten from each task
    first = edges.withColumn("place", F.row_number().over(Window.partitionBy("dst").orderBy("src"))).where("place <= 10")
    return first.select("dst", "src").union(edges.join(path, "src", "left_semi").select("dst", "src")).distinct()


def local_then_shared_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part")).distinct()
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("name"))
    return lookups.local_then_shared(wanted, parts.where("part % 3 = 0"), parts.where("part % 2 = 0"), "part", "name").select("part", "name", "found")


def unique_name_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("owner"), F.col("c_mktsegment").alias("name")).distinct()
    entities = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("owner"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("entity"))
    return lookups.by_unique_name(wanted, entities, "owner", "name", "entity").select("owner", "name", "entity")


def _spans(spark, sf_dir, kind: str) -> DataFrame:
    """Events of one kind as ranges of ten ids in their user's slot."""
    rows = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return rows.select(F.col("user_id").alias("slot"), F.col("event_id").alias("start"), (F.col("event_id") + 10).alias("stop"), F.col("event_id").alias("entity"))


def interval_lookup(spark, sf_dir):
    wanted = _spans(spark, sf_dir, "click").select("slot", "start", "stop").distinct()
    return lookups.overlapping(wanted, _spans(spark, sf_dir, "view"), "slot", "entity").select("slot", "start", "stop", "entity")


def asof_lookup(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("slot"), F.col("event_id").alias("at"), F.col("event_id").alias("entity"), "event_type")
    wanted = events.where("event_type = 'click'").select("slot", "at")
    return lookups.at_or_after(wanted, events.where("event_type = 'purchase'").select("slot", "at", "entity"), "slot", "at", "entity").select("slot", "at", "entity")


ORACLES = {
    "inverse_edges": f"WITH {EDGES} SELECT dst AS src, 'inverse in' AS rel, count(*) AS n, min(src) AS first FROM edges GROUP BY dst",
    "ancestor_closure": f"{PATHS} SELECT sub, sup, min(distance)::INT AS distance FROM paths GROUP BY 1, 2",
    "hierarchy_depth": f"{PATHS} SELECT sub AS node, max(distance)::INT AS depth FROM paths GROUP BY 1",
    "assignable_pairs": f"{PATHS} SELECT sup AS node, count(*) AS below FROM paths WHERE sub <> sup GROUP BY 1",
    "sibling_count": f"WITH {EDGES} SELECT src AS node, count(*) OVER (PARTITION BY dst) AS siblings FROM edges",
    "hierarchy_components": f"""{MEMBERS}, leaves AS (SELECT sub AS leaf, sup AS owner FROM paths WHERE sub NOT IN (SELECT sup FROM paths WHERE sub <> sup)),
seen AS (SELECT leaf, name, member FROM leaves JOIN mem USING (owner) WHERE NOT apart), tie AS (SELECT DISTINCT x.member AS a, y.member AS b FROM seen x JOIN seen y USING (leaf, name)),
reach AS (SELECT a, b FROM tie UNION SELECT reach.a, tie.b FROM reach JOIN tie ON reach.b = tie.a)
SELECT a AS member, min(b) AS grouped FROM reach GROUP BY 1 UNION ALL SELECT member, member FROM mem WHERE apart""",
    "nearest_override": f"""{MEMBERS}, ov AS (SELECT m.member, p.member AS parent FROM mem m JOIN paths ON m.owner = sub AND distance > 0 JOIN mem p ON p.owner = sup AND p.name = m.name WHERE NOT m.apart AND NOT p.apart)
SELECT member, parent FROM ov o WHERE NOT EXISTS (SELECT 1 FROM ov x JOIN ov y ON x.parent = y.member WHERE x.member = o.member AND y.parent = o.parent)""",
    "resolve_member": f"""{MEMBERS}, f AS (SELECT sub AS owner, name, arg_min(member, {{'d': distance, 'm': member}}) AS member FROM paths JOIN mem ON sup = mem.owner AND NOT apart GROUP BY 1, 2)
SELECT w.owner, w.name, f.member FROM (SELECT DISTINCT sub AS owner, name FROM paths, (VALUES ('m0'), ('m1'), ('p')) v(name)) w LEFT JOIN f USING (owner, name)""",
    "top10_children": f"""{PATHS}, e AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS r FROM edges) SELECT dst, src FROM e WHERE r <= 10 OR src IN (SELECT sup FROM paths WHERE sub = 'c7')""",
    "local_then_shared_lookup": """SELECT part, CASE WHEN part % 3 = 0 OR part % 2 = 0 THEN p_name END AS name,
CASE WHEN p_name IS NULL THEN 'placeholder' WHEN part % 3 = 0 THEN 'local' WHEN part % 2 = 0 THEN 'shared' ELSE 'placeholder' END AS found
FROM (SELECT DISTINCT l_partkey AS part FROM lineitem) LEFT JOIN part ON p_partkey = part""",
    "unique_name_lookup": """WITH e AS (SELECT c_nationkey AS owner, c_mktsegment AS name, min(c_custkey) AS entity FROM customer GROUP BY 1, 2 HAVING count(*) = 1)
SELECT owner, name, entity FROM (SELECT DISTINCT c_nationkey AS owner, c_mktsegment AS name FROM customer) LEFT JOIN e USING (owner, name)""",
    "interval_lookup": """SELECT c.user_id AS slot, c.event_id AS start, c.event_id + 10 AS stop, (SELECT min(v.event_id) FROM events v WHERE v.event_type = 'view' AND v.user_id = c.user_id AND v.event_id < c.event_id + 10
AND v.event_id + 10 > c.event_id) AS entity FROM events c WHERE c.event_type = 'click'""",
    "asof_lookup": """SELECT c.user_id AS slot, c.event_id AS at, (SELECT min(p.event_id) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = c.user_id AND p.event_id >= c.event_id) AS entity
FROM events c WHERE c.event_type = 'click'""",
}

QUERIES = {
    f.__name__: f
    for f in (
        inverse_edges, ancestor_closure, hierarchy_depth, assignable_pairs, sibling_count, hierarchy_components, nearest_override, resolve_member, top10_children, local_then_shared_lookup, unique_name_lookup,
        interval_lookup, asof_lookup,
    )
}
