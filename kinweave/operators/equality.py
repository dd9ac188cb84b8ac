"""What could be equal: potential equality of candidates, matchable flags, and candidates narrowed by what is matched.

Sides are tables of elements with ``id``, ``name``, ``disguised`` and ``matchable``; ``matches`` has (a, b). Pairs are met with both
sides and both ends' matches by equi-joins, and the answer is one boolean column ``potential``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.storage import shuffled


def with_ends(pairs: DataFrame, a: DataFrame, b: DataFrame, matches: DataFrame) -> DataFrame:
    """``pairs`` with the structs ``x`` and ``y`` of their ends, and the partners ``x_met`` and ``y_met`` of these. Sides get their matches first: there are more pairs than elements."""
    left, right = (side.select(F.col("id").alias(c), F.struct(*[n for n in side.columns if n != "id"]).alias(s)) for side, c, s in ((a, "a", "x"), (b, "b", "y")))
    left = left.join(shuffled(matches.select("a", F.col("b").alias("x_met"))), "a", "left")
    right = right.join(shuffled(matches.select("b", F.col("a").alias("y_met"))), "b", "left")
    return pairs.join(shuffled(left), "a").join(shuffled(right), "b")


def names_fit(both_or_none: bool) -> Column:
    """Two disguised names fit, two plain ones if they are equal; one of each only unless sides are disguised ``both_or_none``."""
    one = F.lit(not both_or_none)
    return F.when(F.col("x.disguised") & F.col("y.disguised"), True).when(F.col("x.disguised") | F.col("y.disguised"), one).otherwise(F.col("x.name") == F.col("y.name"))


def by_matches(otherwise: Column) -> Column:
    """A matched end decides; else both have to be matchable and ``otherwise`` has to hold."""
    free = F.col("x.matchable") & F.col("y.matchable") & otherwise
    return F.when(F.col("x_met").isNotNull(), F.col("x_met") == F.col("b")).when(F.col("y_met").isNotNull(), F.col("y_met") == F.col("a")).otherwise(F.coalesce(free, F.lit(False)))


def known() -> Column:
    return F.col("x_met").isNotNull() | F.col("y_met").isNotNull()


def below(base: DataFrame, owners: DataFrame, fits: Column) -> DataFrame:
    """(a, b, potential) of what ``fits`` or is matched; unmatched pairs need potentially equal ``owners``. All but that is decided before the owners are met, so little moves."""
    decided = base.select("a", "b", F.col("x.owner").alias("_oa"), F.col("y.owner").alias("_ob"), known().alias("_known"), by_matches(fits).alias("_fits"))
    above = owners.select(F.col("a").alias("_oa"), F.col("b").alias("_ob"), F.col("potential").alias("_above"))
    joined = decided.join(shuffled(above), ["_oa", "_ob"], "left")
    return joined.select("a", "b", (F.col("_fits") & (F.col("_known") | F.coalesce("_above", F.lit(False)))).alias("potential"))


def potential_classes(pairs: DataFrame, a: DataFrame, b: DataFrame, matches: DataFrame, both_or_none: bool = False) -> DataFrame:
    """(a, b, potential). A side may have ``element``, the class that an array is of: arrays need arrays of potentially equal classes."""
    return class_verdicts(pairs, a, b, matches, {"potential": both_or_none})


def class_verdicts(pairs: DataFrame, a: DataFrame, b: DataFrame, matches: DataFrame, ways: dict[str, bool]) -> DataFrame:
    """(a, b) and a column for each of ``ways``, from its name to its ``both_or_none``."""
    pairs = pairs.select("a", "b").distinct()
    base = with_ends(pairs, a, b, matches)
    if "element" not in a.columns:
        return base.select("a", "b", *[by_matches(names_fit(both_or_none)).alias(way) for way, both_or_none in ways.items()])
    of_a, of_b = (side.where("element IS NOT NULL").select(F.col("id").alias(c), F.col("element").alias(f"_e{c}")) for side, c in ((a, "a"), (b, "b")))
    parts = pairs.join(shuffled(of_a), "a").join(shuffled(of_b), "b").select(F.col("_ea").alias("a"), F.col("_eb").alias("b"))
    parts = class_verdicts(parts, a.drop("element"), b.drop("element"), matches, ways)
    parts = parts.select(F.col("a").alias("_ea"), F.col("b").alias("_eb"), F.lit(0).cast("long").alias("_spread"), *[F.col(way).alias(f"_{way}") for way in ways])
    both, none = F.col("x.element").isNotNull() & F.col("y.element").isNotNull(), F.col("x.element").isNull() & F.col("y.element").isNull()
    # pairs without two elements meet nothing, so they go anywhere but to one task; all but the elements' verdict is decided before
    spread = F.when(both, F.lit(0).cast("long")).otherwise(F.xxhash64("a", "b"))
    fitting = [by_matches(names_fit(both_or_none)).alias(f"_fits_{way}") for way, both_or_none in ways.items()]
    decided = base.select("a", "b", F.col("x.element").alias("_ea"), F.col("y.element").alias("_eb"), spread.alias("_spread"), (known() | none).alias("_free"), *fitting)
    joined = decided.join(shuffled(parts), ["_ea", "_eb", "_spread"], "left")
    return joined.select("a", "b", *[(F.col(f"_fits_{way}") & (F.col("_free") | F.coalesce(f"_{way}", F.lit(False)))).alias(way) for way in ways])


def owned(members: DataFrame, owners: DataFrame, matches: DataFrame, own: str) -> DataFrame:
    """``members`` with ``above``: what decides about their owner, and its partner by ``matches`` (a, b), where ``own`` is this side. An owner that isn't there is null."""
    other = "b" if own == "a" else "a"
    rows = owners.join(shuffled(matches.select(F.col(own).alias("id"), F.col(other).alias("met"))), "id", "left")
    return members.join(shuffled(rows.select(F.col("id").alias("owner"), F.struct("name", "disguised", "matchable", "met").alias("above"))), "owner", "left")


def owners_fit(both_or_none: bool) -> Column:
    """``by_matches`` of ``names_fit`` for the owners of two members that are ``owned``."""
    x, y = F.col("x.above"), F.col("y.above")
    one = F.lit(not both_or_none)
    names = F.when(x["disguised"] & y["disguised"], True).when(x["disguised"] | y["disguised"], one).otherwise(x["name"] == y["name"])
    free = F.coalesce(x["matchable"] & y["matchable"] & names, F.lit(False))
    verdict = F.when(x["met"].isNotNull(), x["met"] == F.col("y.owner")).when(y["met"].isNotNull(), y["met"] == F.col("x.owner")).otherwise(free)
    return x.isNotNull() & y.isNotNull() & verdict


def potential_members(pairs: DataFrame, a: DataFrame, b: DataFrame, matches: DataFrame, owners: DataFrame | None, group_matches: DataFrame | None = None, both_or_none: bool = False) -> DataFrame:
    """(a, b, potential) of fields, or of methods if ``group_matches`` (a_group, b_group) is given.

    ``owners`` has (a, b, potential) of the owners; an owner pair that isn't there isn't potentially equal. Without it members are ``owned``: what is known of their owners
    comes with them, and a pair decides about its owners itself, with no table of owner pairs. Methods have ``grouped``: if either's
    hierarchy is matched, it has to be with the other's. Names that begin with < fit only their like.
    """
    if group_matches is not None:
        a = a.join(shuffled(group_matches.select(F.col("a_group").alias("grouped"), F.col("b_group").alias("_to"))), "grouped", "left")
        b = b.join(shuffled(group_matches.select(F.col("b_group").alias("grouped"), F.col("a_group").alias("_from"))), "grouped", "left")
    # dealt by a, pairs are made once and meet their a by one exchange
    base = with_ends(pairs.select("a", "b").repartition("a").distinct(), a, b, matches)
    fits = names_fit(both_or_none)
    if group_matches is not None:
        special = F.col("x.name").startswith("<") | F.col("y.name").startswith("<")
        alone = F.col("x._to").isNull() & F.col("y._from").isNull()
        fits = fits & (~special | (F.col("x.name") == F.col("y.name"))) & (alone | F.coalesce(F.col("x._to") == F.col("y.grouped"), F.lit(False)))
    if owners is None:
        return base.select("a", "b", (by_matches(fits) & (known() | owners_fit(both_or_none))).alias("potential"))
    return below(base, owners, fits)


def potential_lambdas(found: DataFrame, lambdas_a: DataFrame, lambdas_b: DataFrame, calls_a: DataFrame, calls_b: DataFrame, matches: DataFrame) -> DataFrame:
    """``found`` (a, b, potential) without the pairs of lambda bodies (id) none of whose callers are potentially equal in ``found``.

    Calls are (caller, callee). Matched bodies stay as they are. Other columns of ``found`` stay too.
    """
    free = lambdas_a.select(F.col("id").alias("a")).join(shuffled(matches.select("a")), "a", "left_anti")
    both = found.where("potential").select("a", "b").join(shuffled(free), "a", "left_semi").join(shuffled(lambdas_b.select(F.col("id").alias("b"))), "b", "left_semi")
    # the callers of a, what these could be, and whether that calls b: never all callers of the one with all of the other
    met = both.join(shuffled(calls_a.select(F.col("caller").alias("_ca"), F.col("callee").alias("a"))), "a")
    callers = found.where("potential").select(F.col("a").alias("_ca"), F.col("b").alias("_cb"))
    held = met.join(shuffled(callers), "_ca").join(shuffled(calls_b.select(F.col("caller").alias("_cb"), F.col("callee").alias("b"))), ["_cb", "b"], "left_semi").select("a", "b").distinct()
    lost = both.join(shuffled(held), ["a", "b"], "left_anti").withColumn("_lost", F.lit(True))
    more = [c for c in found.columns if c not in ("a", "b", "potential")]
    # what isn't potentially equal has nothing to lose, and stays where it is
    could = F.coalesce("potential", F.lit(False))
    kept = found.where(could).join(shuffled(lost), ["a", "b"], "left").select("a", "b", *more, F.col("_lost").isNull().alias("potential"))
    return found.where(~could).select("a", "b", *more, "potential").unionByName(kept)


def potential_variables(pairs: DataFrame, a: DataFrame, b: DataFrame, matches: DataFrame, methods: DataFrame, both_or_none: bool = False) -> DataFrame:
    """(a, b, potential) of arguments and local variables: of one sort (``argument``), in potentially equal ``methods`` (a, b, potential)."""
    fits = (F.col("x.argument") == F.col("y.argument")) & names_fit(both_or_none)
    return below(with_ends(pairs.select("a", "b").distinct(), a, b, matches), methods, fits)


def matchable(elements: DataFrame, owners: DataFrame) -> DataFrame:
    """``elements`` (id, owner, own) with ``matchable``: their own flag, of a member's hierarchy or a variable, and their owner's (id, matchable). A null flag is no."""
    above = owners.select(F.col("id").alias("owner"), F.col("matchable").alias("_above"))
    return elements.join(above, "owner", "left").withColumn("matchable", F.coalesce(F.col("own") & F.col("_above"), F.lit(False))).drop("_above")


def toggled(elements: DataFrame, wanted: DataFrame, matched: DataFrame, potential: DataFrame | None = None) -> DataFrame:
    """``elements`` (id, own, above) with the flags of ``wanted`` (id, value) where these are allowed, and ``refused`` where they aren't.

    A matched element (id) can't be made unmatchable, one below an unmatchable owner (above) can't be made matchable, and one
    that nothing could match (``potential`` has its id with false) can't be changed.
    """
    rows = elements.join(wanted, "id", "left").join(matched.select("id", F.lit(True).alias("_met")), "id", "left")
    refused = (~F.col("value") & F.col("_met").isNotNull()) | (F.col("value") & ~F.col("above"))
    if potential is not None:
        rows = rows.join(potential.select("id", F.col("potential").alias("_could")), "id", "left")
        refused = refused | ~F.coalesce("_could", F.lit(True))
    refused = F.coalesce(F.col("value").isNotNull() & refused, F.lit(False))
    rows = rows.withColumn("refused", refused)
    return rows.withColumn("own", F.when(F.col("value").isNotNull() & ~F.col("refused"), F.col("value")).otherwise(F.col("own"))).select(*elements.columns, "refused")


def method_candidates(owner_matches: DataFrame, a: DataFrame, b: DataFrame, matches: DataFrame, group_matches: DataFrame) -> DataFrame:
    """(a, b) of the methods of matched owners: a matched one has its partner only, one of a matched hierarchy the methods of that hierarchy's partner."""
    # what decides about a pair is known of its a, so a's rows get it before they meet the b: there are more pairs than methods
    left = a.select(F.col("id").alias("a"), F.col("owner").alias("_oa"), F.col("grouped").alias("_ga")).join(shuffled(matches.select("a", F.col("b").alias("_met"))), "a", "left")
    left = left.join(shuffled(group_matches.select(F.col("a_group").alias("_ga"), F.col("b_group").alias("_to"))), "_ga", "left").drop("_ga")
    left = left.join(shuffled(owner_matches.select(F.col("a").alias("_oa"), F.col("b").alias("_ob"))), "_oa").drop("_oa")
    met = left.join(shuffled(b.select(F.col("id").alias("b"), F.col("owner").alias("_ob"), F.col("grouped").alias("_gb"))), "_ob")
    kept = F.when(F.col("_met").isNotNull(), F.col("_met") == F.col("b")).when(F.col("_to").isNotNull(), F.col("_to") == F.col("_gb")).otherwise(True)
    return met.where(kept).select("a", "b")


def array_matches(matches: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b) of the arrays (id, element, dims) of matched classes with equal dimensions: each unmatched one, in order of id, with the next unmatched one of the other side."""
    left = a.join(matches.select("a").withColumnRenamed("a", "id"), "id", "left_anti").join(matches.select(F.col("a").alias("element"), F.col("b").alias("_to")), "element")
    right = b.join(matches.select("b").withColumnRenamed("b", "id"), "id", "left_anti")
    place = F.row_number().over(Window.partitionBy("element", "dims").orderBy("id"))
    left, right = left.withColumn("_n", place), right.withColumn("_n", place)
    right = right.select(F.col("id").alias("b"), F.col("element").alias("_to"), "dims", "_n")
    return left.select(F.col("id").alias("a"), "_to", "dims", "_n").join(right, ["_to", "dims", "_n"]).select("a", "b")


def unobfuscated_members(owner_matches: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b) of the members (id, owner, full, name, disguised) of matched owners that aren't disguised on either side: with the same full id, else with the only member of that name."""
    left = owner_matches.select(F.col("a").alias("_oa"), F.col("b").alias("_ob")).join(a.where("NOT disguised").select(F.col("id").alias("a"), F.col("owner").alias("_oa"), "full", "name"), "_oa")
    full = b.groupBy(F.col("owner").alias("_ob"), "full").agg(F.min(F.struct("id", "disguised")).alias("_full"))
    only = b.groupBy(F.col("owner").alias("_ob"), "name").agg(F.min(F.struct("id", "disguised")).alias("_only"), F.count("*").alias("_n")).where("_n = 1")
    met = left.join(full, ["_ob", "full"], "left").join(only, ["_ob", "name"], "left").withColumn("m", F.coalesce("_full", "_only"))
    return met.where("NOT m.disguised").select("a", F.col("m.id").alias("b"))


def overlaps(inputs: DataFrame) -> DataFrame:
    """(path, roles): paths that several of the roles of ``inputs`` (role, path) share; without any, the roles are disjoint."""
    return inputs.groupBy("path").agg(F.array_sort(F.collect_set("role")).alias("roles")).where(F.size("roles") > 1)


def problems(inputs: DataFrame, needed: list[str], patterns: list[str] = ()) -> DataFrame:
    """(problem): what keeps a configuration from being used: roles without a path, shared paths, and patterns that don't compile."""
    import re

    spark = inputs.sparkSession
    roles = spark.createDataFrame([(r,) for r in needed], "role string").join(inputs.select("role").distinct(), "role", "left_anti")
    broken = []
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            broken.append((f"pattern {p}",))
    shared = overlaps(inputs).select(F.concat(F.lit("shared "), "path").alias("problem"))
    return roles.select(F.concat(F.lit("nothing for "), "role").alias("problem")).unionByName(shared).unionByName(spark.createDataFrame(broken, "problem string"))
