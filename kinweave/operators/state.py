"""The match state and its changes: pairs of whole entities, of their members, and what follows from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.storage import stored


def prematch(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(a, b) of entities whose names aren't disguised on either side and are equal."""
    left = a.where("NOT disguised").select(F.col("id").alias("a"), key)
    right = b.where("NOT disguised").select(F.col("id").alias("b"), key)
    return left.join(right, key).select("a", "b")


def replaced(matches: DataFrame, new: DataFrame) -> DataFrame:
    """``matches`` with ``new`` pairs in place of all old pairs of their ends."""
    old = matches.join(new.select("a").distinct(), "a", "left_anti").join(new.select("b").distinct(), "b", "left_anti")
    return old.select("a", "b").unionByName(new.select("a", "b"))


def member_matches(matches: DataFrame, a_members: DataFrame, b_members: DataFrame, name: str) -> DataFrame:
    """(a, b) of the members with one unique name in matched owners; the members have (id, owner, name)."""

    def unique(members: DataFrame, side: str) -> DataFrame:
        single = members.groupBy("owner", name).agg(F.min("id").alias(side), F.count("*").alias("n")).where("n = 1")
        return single.select(F.col("owner").alias(f"{side}_owner"), name, side)

    owners = matches.select(F.col("a").alias("a_owner"), F.col("b").alias("b_owner"))
    return owners.join(unique(a_members, "a"), "a_owner").join(unique(b_members, "b"), ["b_owner", name]).select("a", "b")


def fan_out(group_pairs: DataFrame, a_members: DataFrame, b_members: DataFrame, owner_matches: DataFrame) -> DataFrame:
    """(a, b) of all members of matched groups (a_group, b_group) whose owners are matched."""
    left = group_pairs.join(a_members.select(F.col("grouped").alias("a_group"), F.col("id").alias("a"), F.col("owner").alias("a_owner")), "a_group")
    left = left.join(owner_matches.select(F.col("a").alias("a_owner"), F.col("b").alias("b_owner")), "a_owner")
    right = b_members.select(F.col("grouped").alias("b_group"), F.col("id").alias("b"), F.col("owner").alias("b_owner"))
    return left.join(right, ["b_group", "b_owner"]).select("a", "b")


def unmatched(matches: DataFrame, gone: DataFrame, member_pairs: DataFrame, a_members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches and member matches without the entities ``gone`` (a) and the members they own."""
    kept = matches.join(gone, "a", "left_anti")
    lost = a_members.join(gone.withColumnRenamed("a", "owner"), "owner", "left_semi").select(F.col("id").alias("a"))
    return kept, member_pairs.join(lost, "a", "left_anti")


def fully_matched(entities: DataFrame, members: DataFrame, matches: DataFrame) -> DataFrame:
    """(id, fully): whether every matchable member of an entity has a match."""
    open_ = members.where("matchable").join(matches.select(F.col("a").alias("id")), "id", "left_anti").select(F.col("owner").alias("id")).distinct()
    return entities.select("id").join(open_.withColumn("open", F.lit(True)), "id", "left").select("id", F.col("open").isNull().alias("fully"))


def potential(entities: DataFrame, others: DataFrame, matches: DataFrame) -> DataFrame:
    """(id, potential): whether anything on the other side could be an entity; both sides have (id, scope, name, disguised).

    A matched entity has its partner. Another one needs an unmatched entity of its scope with its name, or with any name if
    either is disguised. Counts of each scope tell, so no pairs are made.
    """
    free = others.join(matches.select(F.col("b").alias("id")), "id", "left_anti")
    scopes = free.groupBy("scope").agg(F.count("*").alias("free"), F.count_if("disguised").alias("masked"))
    names = free.where("NOT disguised").select("scope", "name").distinct().withColumn("same", F.lit(True))
    rows = entities.join(matches.select(F.col("a").alias("id"), F.lit(True).alias("met")), "id", "left").join(scopes, "scope", "left").join(names, ["scope", "name"], "left")
    found = F.coalesce("met", F.lit(False)) | (F.coalesce("masked", F.lit(0)) > 0) | F.coalesce("same", F.lit(False)) | (F.col("disguised") & (F.coalesce("free", F.lit(0)) > 0))
    return rows.select("id", found.alias("potential"))


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Repeat ``step`` (state to new pairs) until it finds nothing. Each pass is one job, written before the next.

    A step depends on the state alone. So if a state comes again, as when pairs replace each other in turns, so would all between; it is returned as it is then.
    States are known by their number of pairs and two checksums of their pairs.
    """
    state, seen = stored(state.select("a", "b"), "matches"), set()
    while True:
        digest = state.agg(F.count("*"), *[F.bit_xor(F.xxhash64(F.lit(seed), "a", "b")) for seed in (1, 2)]).first()
        if tuple(digest) in seen:
            return state
        seen.add(tuple(digest))
        new = stored(step(state).select("a", "b"), "new_matches")
        if new.isEmpty():
            return state
        state = stored(replaced(state, new), "matches")


def schedule(level_passes: Callable[[str, str], bool]) -> None:
    """Run passes in the order of the levels. ``level_passes`` takes (kind, level), runs a pass, and says whether it matched anything.

    Classes at the first level, twice if the first pass matched; at each further level members and classes in turns until nothing
    changes; then arguments and variables until nothing changes.
    """
    if level_passes("class", "initial"):
        level_passes("class", "initial")
    for level in ("intermediate", "full", "extra"):
        classes, any_ = True, True
        while any_:
            any_ = any([level_passes("method", level), level_passes("field", level)])
            if not any_ and not classes:
                break
            classes = level_passes("class", level)
            any_ = any_ or classes
    while any([level_passes("argument", "full"), level_passes("variable", "full")]):
        pass
