"""Similarity measures between 0 and 1, as column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.storage import stored

from .components import components


def of_counts(a: Column, b: Column) -> Column:
    """1 if equal, else one less the relative difference; two nulls are equal, a null and a count aren't."""
    both = F.when(a == b, 1.0).otherwise(1 - F.abs(a - b) / F.greatest(a, b))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(both)


def of_sets(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def of_flags(a: Column, b: Column, mask: int, divisor: int) -> Column:
    """One less the share of ``divisor`` that the differing bits under ``mask`` make."""
    return 1 - F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(mask))) / divisor


def of_optional(a: Column, b: Column, equal: Column) -> Column:
    """1 for two nulls, 0 for one, else whether ``equal``."""
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(equal.cast("double"))


def ratio(matched: Column, mismatched: Column) -> Column:
    """Share of matches, 1 if there is nothing to match."""
    return F.when(matched + mismatched == 0, 1.0).otherwise(matched / (matched + mismatched))


def of_identities(pairs: DataFrame, a_sets: DataFrame, b_sets: DataFrame, matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Similarity of two sets of entities that may be matched, for each of ``pairs`` (a, b).

    ``a_sets`` (a, x) and ``b_sets`` (b, y) hold the members, ``matches`` (x, y) the matched ones, ``candidates``
    (x, y) what unmatched ones could be. A matched member counts as missing if its partner isn't in the other set, an
    unmatched one if nothing unmatched in the other set could be it. Two empty sets are equal.
    """
    left = pairs.join(a_sets.distinct(), "a").join(matches.withColumnRenamed("y", "partner"), "x", "left")
    right = pairs.join(b_sets.distinct(), "b").join(matches.withColumnRenamed("x", "partner"), "y", "left")
    met_left = right.where("partner IS NOT NULL").select("a", "b", F.col("partner").alias("x"), F.lit(True).alias("met"))
    met_right = left.where("partner IS NOT NULL").select("a", "b", F.col("partner").alias("y"), F.lit(True).alias("met"))
    free_left, free_right = left.where("partner IS NULL").select("a", "b", "x"), right.where("partner IS NULL").select("a", "b", "y")
    possible = free_left.join(candidates, "x").join(free_right, ["a", "b", "y"]).select("a", "b", "x", "y")
    can_left, can_right = possible.select("a", "b", "x").distinct().withColumn("can", F.lit(True)), possible.select("a", "b", "y").distinct().withColumn("can", F.lit(True))
    missing = F.count_if(F.coalesce("met", "can", F.lit(False)) == F.lit(False))
    lost_left = left.join(met_left, ["a", "b", "x"], "left").join(can_left, ["a", "b", "x"], "left").groupBy("a", "b").agg(F.count("*").alias("n_a"), missing.alias("lost_a"))
    lost_right = right.join(met_right, ["a", "b", "y"], "left").join(can_right, ["a", "b", "y"], "left").groupBy("a", "b").agg(F.count("*").alias("n_b"), missing.alias("lost_b"))
    zero = F.lit(0)
    n_a, n_b = F.coalesce("n_a", zero), F.coalesce("n_b", zero)
    score = F.when((n_a == 0) & (n_b == 0), 1.0).when((n_a == 0) | (n_b == 0), 0.0).otherwise((n_a + n_b - F.col("lost_a") - F.col("lost_b")) / (n_a + n_b))
    return pairs.join(lost_left, ["a", "b"], "left").join(lost_right, ["a", "b"], "left").select("a", "b", score.alias("similarity"))


def by_shared_tokens(tokens: DataFrame) -> DataFrame:
    """(a, b, common, similarity, class_id): sets that share tokens, from (id, token).

    Each token ties the sets that have it to the smallest of them, so a token of any frequency gives rows in proportion to its sets, and a set has a
    row for each such representative a that it shares a token with, with their exact Jaccard similarity. All sets that are connected by shared tokens have one class, its smallest id.
    """
    tokens = stored(tokens.where("id IS NOT NULL AND token IS NOT NULL").distinct(), "tokens")
    first = tokens.groupBy("token").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").select("token", "a")
    pairs = stored(tokens.join(first, "token").where("id <> a").select("a", F.col("id").alias("b")).distinct(), "pairs")
    # the tokens of b that a has too
    own = pairs.join(tokens.select(F.col("id").alias("b"), "token"), "b")
    common = own.join(tokens.select(F.col("id").alias("a"), "token"), ["a", "token"]).groupBy("a", "b").agg(F.count("*").alias("common"))
    sizes = tokens.groupBy("id").agg(F.count("*").alias("n"))
    rows = common.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("n_b")), "b")
    classes = components(pairs).select(F.col("node").alias("b"), F.col("label").alias("class_id"))
    return rows.join(classes, "b").select("a", "b", "common", (F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("similarity"), "class_id")
