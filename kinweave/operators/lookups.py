"""Lookups: a side's own entities before shared ones, unique names, intervals, and the next entry at or after a place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.storage import stored


def local_then_shared(wanted: DataFrame, local: DataFrame, shared: DataFrame, key: str, value: str) -> DataFrame:
    """``wanted`` with the value of its own side, or else of the shared entities; found says which, or "placeholder"."""
    own = local.select(key, F.col(value).alias("_own"))
    common = shared.select(key, F.col(value).alias("_common"))
    joined = wanted.join(own, key, "left").join(common, key, "left")
    found = F.when(F.col("_own").isNotNull(), "local").when(F.col("_common").isNotNull(), "shared").otherwise("placeholder")
    return joined.withColumns({value: F.coalesce("_own", "_common"), "found": found}).drop("_own", "_common")


def by_unique_name(wanted: DataFrame, entities: DataFrame, owner: str, name: str, entity: str) -> DataFrame:
    """``wanted`` with the entity of that name in that owner, null unless there is just one."""
    single = entities.groupBy(owner, name).agg(F.min(entity).alias(entity), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return wanted.join(single, [owner, name], "left")


def overlapping(wanted: DataFrame, ranges: DataFrame, slot: str, entity: str, width: int = 64) -> DataFrame:
    """``wanted`` (slot, start, stop) with the first entity of that slot whose range overlaps; null if none does.

    Steps are ``width`` places wide on the first level and four times as wide on each further one. A range touches two steps at most from the level of its
    own length on, and is filed there and on all levels above; a pair meets on the level of the longer one. So long ranges make few rows, and
    ranges meet only their neighbours, however many a slot has. An empty range overlaps nothing.
    """

    def leveled(rows: DataFrame) -> DataFrame:
        length = F.greatest(F.col("stop") - F.col("start"), F.lit(1))
        return rows.withColumn("_own", F.greatest(F.ceil(F.log2(length / width) / 2), F.lit(0)).cast("int"))

    left, right = leveled(wanted), leveled(ranges)
    top = left.select("_own").unionByName(right.select("_own")).agg(F.max("_own")).first()[0] or 0

    def filed(rows: DataFrame) -> DataFrame:
        step = F.lit(width) * F.pow(F.lit(4), "_level")
        rows = rows.withColumn("_level", F.explode(F.sequence("_own", F.lit(top))))
        return rows.withColumn("_step", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor((F.greatest("stop", F.col("start") + 1) - 1) / step))))

    same = (F.col(f"w.{slot}") == F.col(f"r.{slot}")) & (F.col("w._level") == F.col("r._level")) & (F.col("w._step") == F.col("r._step"))
    same = same & (F.col("w._level") == F.greatest("w._own", "r._own"))
    met = filed(left).alias("w").join(filed(right).alias("r"), same & (F.col("r.start") < F.col("w.stop")) & (F.col("r.stop") > F.col("w.start")))
    met = met.where("w.start < w.stop AND r.start < r.stop")
    first = met.groupBy(*[F.col(f"w.{c}").alias(c) for c in wanted.columns]).agg(F.min_by(f"r.{entity}", F.struct("r.start", f"r.{entity}")).alias(entity))
    return wanted.join(first, wanted.columns, "left")


def at_or_after(wanted: DataFrame, entries: DataFrame, slot: str, at: str, entity: str) -> DataFrame:
    """``wanted`` with the entity of that slot at the smallest place not before ``at``.

    Both tables are merged by slot and falling place, and the last entry so far is carried on, so no slot's pairs are made and each row is visited once.
    """
    left = wanted.select(slot, F.col(at).alias("_at"), F.struct(*wanted.columns).alias("_row"), F.lit(None).cast(entries.schema[entity].dataType).alias("_entity"))
    best = entries.groupBy(slot, at).agg(F.min(entity).alias("_entity"))
    right = best.select(slot, F.col(at).alias("_at"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), "_entity")
    after = Window.partitionBy(slot).orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    merged = left.unionByName(right).withColumn(entity, F.last("_entity", ignorenulls=True).over(after))
    return merged.where("_row IS NOT NULL").select("_row.*", entity)


def resolved_members(wanted: DataFrame, paths: DataFrame, members: DataFrame, interfaces: DataFrame | None = None) -> DataFrame:
    """``wanted`` (owner, name) with the member of that name in the owner or the nearest owner above it; null if there is none.

    Owners that are ``interfaces`` (owner) come after all others, members that are abstract after those that aren't, and
    of equal ones the smallest counts. ``paths`` is a closure (sub, sup, distance).
    """
    found = wanted.select("owner", "name").distinct().join(paths.select(F.col("sub").alias("owner"), F.col("sup").alias("holder"), "distance"), "owner")
    abstract = F.col("abstract") if "abstract" in members.columns else F.lit(False)
    found = found.join(members.select(F.col("owner").alias("holder"), "name", "member", abstract.alias("open")), ["holder", "name"])
    if interfaces is not None:
        found = found.join(interfaces.select(F.col("owner").alias("holder"), F.lit(True).alias("face")), "holder", "left")
    else:
        found = found.withColumn("face", F.lit(False))
    rank = F.struct(F.coalesce("face", F.lit(False)), "open", "distance", "member")
    best = found.groupBy("owner", "name").agg(F.min_by("member", rank).alias("member"))
    return wanted.join(best, ["owner", "name"], "left")


def alike(rows: DataFrame, owner: str) -> DataFrame:
    """(owner, like): for each owner the smallest one that has the same ``rows`` but for the owner's column."""
    sets = stored(rows.groupBy(owner).agg(F.sort_array(F.collect_set(F.struct(*[c for c in rows.columns if c != owner]))).alias("_set")), "sets")
    return sets.join(sets.groupBy("_set").agg(F.min(owner).alias("like")), "_set").select(owner, "like")


def ways_to_members(classes: DataFrame, told: DataFrame) -> DataFrame:
    """(owner, holder, distance) of those ``classes`` (sub, sup, distance) whose holder has any of the members ``told``."""
    ways = classes.select(F.col("sub").alias("owner"), F.col("sup").alias("holder"), "distance")
    return ways.join(told.select("holder").distinct(), "holder", "left_semi")


def specific_methods(wanted: DataFrame, classes: DataFrame, interfaces: DataFrame, members: DataFrame, handles: DataFrame | None = None) -> DataFrame:
    """``wanted`` (owner, name, faced) with the member that a reference to a method means; null if there is none.

    ``classes`` (sub, sup, distance) are the ways up by parents, a class itself included; ``interfaces`` (sub, sup) all interfaces that a class or
    interface has by any way. ``members`` have (owner, name, member, abstract, private, static, public). A class's own member counts first, then the nearest parent's. If it is an
    interface that is referred to (``faced``), just its own one, or a public one of its parent that isn't static. Then come the
    interfaces' members that are neither private nor static: those that aren't abstract, if there are some, and of these only the
    maximal ones, whose interface is above no other's. Of several, the smallest counts.
    ``handles`` (owner, name, member) are members that stand for every call of a name, before the owner's own ones.

    Owners with the same interfaces find the same member in these, so one of them stands for all: no interface above most classes meets all of them.
    """
    asked = wanted.select("owner", "name", "faced").distinct()
    told = members.select(F.col("owner").alias("holder"), "name", "member", "abstract", "private", "static", "public")
    own = asked.join(ways_to_members(classes, told), "owner").join(told, ["holder", "name"]).where("distance = 0 OR NOT faced OR (public AND NOT static)")
    own = own.select("owner", "name", "faced", F.struct("distance", F.lit(1).alias("step"), "member").alias("found"))
    if handles is not None:
        general = handles.select(F.col("owner").alias("holder"), "name", "member")
        general = asked.where("NOT faced").join(ways_to_members(classes, general), "owner").join(general, ["holder", "name"])
        own = own.unionByName(general.select("owner", "name", "faced", F.struct("distance", F.lit(0).alias("step"), "member").alias("found")))
    own = own.groupBy("owner", "name", "faced").agg(F.min("found").alias("found"))
    rest = asked.join(own, ["owner", "name", "faced"], "left_anti").select("owner", "name").distinct()
    above = interfaces.select(F.col("sub").alias("owner"), F.col("sup").alias("holder"))
    rest = rest.join(alike(above, "owner"), "owner")
    met = rest.select(F.col("like").alias("owner"), "name").distinct().join(above, "owner").join(told, ["holder", "name"]).where("NOT private AND NOT static")
    real = met.groupBy("owner", "name").agg(F.bool_or(~F.col("abstract")).alias("real"))
    met = met.join(real, ["owner", "name"]).where("NOT real OR NOT abstract").select("owner", "name", "holder", "member")
    # an interface above that of another candidate isn't maximal
    lower = met.select("owner", "name", F.col("holder").alias("sub")).join(interfaces.select("sub", F.col("sup").alias("holder")), "sub").where("sub <> holder")
    best = met.join(lower.select("owner", "name", "holder").distinct(), ["owner", "name", "holder"], "left_anti").groupBy(F.col("owner").alias("like"), "name").agg(F.min("member").alias("_face"))
    best = rest.join(best, ["like", "name"]).drop("like")
    joined = wanted.join(own, ["owner", "name", "faced"], "left").join(best, ["owner", "name"], "left")
    return joined.withColumn("member", F.coalesce("found.member", "_face")).drop("found", "_face")


def interface_paths(implements: DataFrame) -> DataFrame:
    """(sub, sup, path): the first way to each interface above, in the order of a search in depth; ``implements`` has (sub, sup, ord).

    A path has the place of each step: of a class's interfaces the first one comes first, of an interface's own the last one. The first way to an interface goes by the
    first way to the one before it, so one path for each pair is enough, and passes grow with the depth.
    """
    first = implements.select("sub", "sup", F.array("ord").alias("path"))
    paths = stored(first.groupBy("sub", "sup").agg(F.min("path").alias("path")), "paths")
    front = paths
    steps = implements.select(F.col("sub").alias("sup"), F.col("sup").alias("next"), F.col("ord").alias("step"))
    while True:
        longer = front.join(steps, "sup").where("sub <> next").select("sub", F.col("next").alias("sup"), F.concat("path", F.array(-F.col("step"))).alias("path"))
        longer = longer.groupBy("sub", "sup").agg(F.min("path").alias("path"))
        old = paths.select("sub", "sup", F.col("path").alias("_old"))
        front = stored(longer.join(old, ["sub", "sup"], "left").where("_old IS NULL OR path < _old").drop("_old"), "front")
        if front.isEmpty():
            return paths
        paths = stored(paths.unionByName(front).groupBy("sub", "sup").agg(F.min("path").alias("path")), "paths")


def resolved_fields(wanted: DataFrame, classes: DataFrame, paths: DataFrame, fields: DataFrame) -> DataFrame:
    """``wanted`` (owner, name) with the field that a reference means: the owner's own, else the first of its interfaces by ``paths``, else the nearest parent's own.

    Owners with the same paths to the same interfaces find the same field in these, so one of them stands for all.
    """
    asked = wanted.select("owner", "name").distinct()
    told = fields.select(F.col("owner").alias("holder"), "name", "member")
    none = F.array().cast("array<int>")
    own = asked.join(ways_to_members(classes, told), "owner").join(told, ["holder", "name"])
    own = own.select("owner", "name", F.struct(F.when(F.col("distance") == 0, 0).otherwise(2).alias("step"), F.array(F.col("distance").cast("int")).alias("way"), "member").alias("found"))
    faces = paths.select(F.col("sub").alias("owner"), F.col("sup").alias("holder"), F.coalesce(F.col("path").cast("array<int>"), none).alias("way"))
    rest = asked.join(alike(faces, "owner"), "owner")
    met = rest.select(F.col("like").alias("owner"), "name").distinct().join(faces, "owner").join(told, ["holder", "name"])
    met = met.groupBy(F.col("owner").alias("like"), "name").agg(F.min(F.struct(F.lit(1).alias("step"), "way", "member")).alias("found"))
    found = own.unionByName(rest.join(met, ["like", "name"]).drop("like"))
    best = found.groupBy("owner", "name").agg(F.min("found").alias("found")).select("owner", "name", "found.member")
    return wanted.join(best, ["owner", "name"], "left")
