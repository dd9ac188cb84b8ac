"""Relations derived from a hierarchy: depths, closures, groups of members, nearest overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.storage import stored

from .components import components


def inverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.concat(F.lit("inverse "), "rel").alias("rel"))


def closure(edges: DataFrame, passes: int = 64) -> DataFrame:
    """(sub, sup, distance) of all ancestors, the node itself included, from (src, dst) edges upwards.

    The longest known length doubles in each pass, so the passes grow with the logarithm of the depth. A longer path starts with one of just that length, so
    only these meet the known ones, and each pass writes what is new. Cycles are harmless.
    """
    nodes = edges.select(F.col("src").alias("n")).union(edges.select("dst")).distinct()
    steps = edges.where("src <> dst").select(F.col("src").alias("sub"), F.col("dst").alias("sup"), F.lit(1).alias("distance")).distinct()
    longest, length = stored(steps, "paths"), 1
    ways = longest
    for _ in range(passes):
        onward = ways.select(F.col("sub").alias("sup"), F.col("sup").alias("end"), F.col("distance").alias("rest"))
        more = longest.where(F.col("distance") == length).join(onward, "sup").where("sub <> end")
        more = more.groupBy("sub", F.col("end").alias("sup")).agg((F.lit(length) + F.min("rest")).cast("int").alias("distance"))
        longest, length = stored(more.join(ways.select("sub", "sup"), ["sub", "sup"], "left_anti"), "paths"), 2 * length
        if longest.isEmpty():
            return nodes.select(F.col("n").alias("sub"), F.col("n").alias("sup"), F.lit(0).alias("distance")).unionByName(ways)
        ways = ways.unionByName(longest)
    raise RuntimeError(f"the hierarchy is deeper than {passes} doublings")


def depths(paths: DataFrame) -> DataFrame:
    """(node, depth): length of the longest of the shortest ways up."""
    return paths.groupBy(F.col("sub").alias("node")).agg(F.max("distance").alias("depth"))


def member_groups(paths: DataFrame, members: DataFrame) -> DataFrame:
    """(member, grouped): members with one name in classes that share a descendant, joined transitively.

    ``members`` has (member, owner, name, apart); those set apart (private or static ones) are groups of their own. Every
    member is tied to the first one seen from each leaf below its owner, so ties grow with members, not with pairs.
    """
    above = paths.where("sub <> sup").select(F.col("sup").alias("inner")).distinct()
    leaves = paths.join(above, F.col("sub") == F.col("inner"), "left_anti").select(F.col("sub").alias("leaf"), F.col("sup").alias("owner"))
    seen = leaves.join(members.where("not apart"), "owner").select("leaf", "name", "member")
    first = seen.groupBy("leaf", "name").agg(F.min("member").alias("first"))
    ties = seen.join(first, ["leaf", "name"]).select("member", "first").distinct()
    return components(ties, "member", "first").select(F.col("node").alias("member"), F.col("label").alias("grouped")).unionByName(
        members.where("apart").select("member", F.col("member").alias("grouped"))
    )


def nearest_override(paths: DataFrame, members: DataFrame) -> DataFrame:
    """(member, parent): for each member, the members of that name above it with none of that name between them."""
    open_ = members.where("not apart").select("member", "owner", "name")
    up = open_.join(paths.where("distance > 0").select(F.col("sub").alias("owner"), F.col("sup").alias("above")), "owner")
    over = up.join(open_.select(F.col("owner").alias("above"), "name", F.col("member").alias("parent")), ["above", "name"]).select("member", "parent")
    between = over.alias("x").join(over.alias("y"), F.col("x.parent") == F.col("y.member")).select("x.member", F.col("y.parent").alias("parent"))
    return over.join(between.distinct(), ["member", "parent"], "left_anti")
