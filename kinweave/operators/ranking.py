"""Weighted scores of candidate pairs, their ranking, acceptance, and one-to-one matches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The default thresholds of acceptance.
ABSOLUTE, RELATIVE = 0.85, 0.085
LEVELS = ("initial", "intermediate", "full", "extra")


@dataclass(frozen=True)
class Measure:
    """A weighted similarity of a pair's columns; used at ``levels``, all of them if empty."""

    name: str
    weight: float
    similarity: Column
    levels: tuple[str, ...] = ()

    def at(self, level: str) -> bool:
        return not self.levels or level in self.levels


def largest(measures: list[Measure], level: str = "initial") -> float:
    return float(sum(m.weight for m in measures if m.at(level)))


def cutoff(top: float, absolute: float = ABSOLUTE, relative: float = RELATIVE) -> float:
    """A pair that misses this much of ``top`` can neither be accepted nor keep another from being accepted."""
    return top - (absolute * (1 - relative)) ** 0.5 * top


def score(pairs: DataFrame, measures: list[Measure], level: str = "initial", limit: float | None = None) -> DataFrame:
    """``pairs`` with parts (name, similarity, weight) and score; pairs that miss ``limit`` or more go.

    Measures are applied one after another, cheap ones first, and a pair leaves as soon as it has missed the limit.
    """
    used = [m for m in measures if m.at(level)]
    missed = F.lit(0.0)
    for i, m in enumerate(used):
        pairs = pairs.withColumn(f"_s{i}", m.similarity.cast("double"))
        missed = missed + m.weight * (1 - F.col(f"_s{i}"))
        if limit is not None:
            pairs = pairs.where(missed < limit)
    parts = F.array(*[F.struct(F.lit(m.name).alias("name"), F.col(f"_s{i}").alias("similarity"), F.lit(float(m.weight)).alias("weight")) for i, m in enumerate(used)])
    total = sum((m.weight * F.col(f"_s{i}") for i, m in enumerate(used)), F.lit(0.0))
    return pairs.withColumns({"parts": parts, "score": F.round(total, 9)}).drop(*[f"_s{i}" for i in range(len(used))])


def normal(raw: Column, top: float) -> Column:
    return F.pow(raw / top, 2)


def ranked(scored: DataFrame) -> DataFrame:
    """With the place of each b among its a's candidates, ties by b."""
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b")))


def accepted(scored: DataFrame, top: float, absolute: float = ABSOLUTE, relative: float = RELATIVE) -> DataFrame:
    """(a, b, score): each a's best b, if it is good enough and far enough ahead of the second.

    Only the first two places are asked for, so each task cuts its part of a ranking down to two rows before the exchange, and
    the candidates are computed once.
    """
    two = ranked(scored.select("a", "b", "score")).where("place <= 2")
    at = lambda place, column: F.max(F.when(F.col("place") == place, F.col(column)))
    best = two.groupBy("a").agg(at(1, "b").alias("b"), at(1, "score").alias("score"), at(2, "score").alias("second"))
    ahead = F.col("second").isNull() | (normal(F.col("second"), top) < normal(F.col("score"), top) * (1 - relative))
    return best.where((normal(F.col("score"), top) >= absolute) & ahead).select("a", "b", "score")


def one_to_one(pairs: DataFrame) -> DataFrame:
    """Without the pairs whose b is claimed more than once: all claims of such a b go. A pair that is alone is its group's only row."""
    once = pairs.groupBy("b").agg(F.count("*").alias("claims"), F.any_value(F.struct(*pairs.columns)).alias("pair"))
    return once.where("claims = 1").select("pair.*")


def perfect(scored: DataFrame, top: float) -> DataFrame:
    """Pairs with the full score, if an a has just one of them, one-to-one."""
    full = scored.where(F.col("score") >= top - 1e-6)
    only = full.groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("n")).where("n = 1").select("a", "b")
    return one_to_one(only)


def link(pairs: DataFrame, measures: list[Measure], level: str = "initial") -> DataFrame:
    """One pass: score, cut, accept, and make one-to-one."""
    top = largest(measures, level)
    return one_to_one(accepted(score(pairs, measures, level, cutoff(top)), top))


def members_full(scored: DataFrame, counts: DataFrame, top: float, absolute: float = 0.8, relative: float = 0.08) -> DataFrame:
    """(owner, similarity): sum of the accepted members' normal scores over the larger number of members.

    ``scored`` has (owner, a, b, score), ``counts`` (owner, n) with the larger number of members of the two owners.
    """
    owners = scored.select("a", "owner").distinct()
    sums = accepted(scored, top, absolute, relative).join(owners, "a").groupBy("owner").agg(F.sum(normal(F.col("score"), top)).alias("total"))
    return counts.join(sums, "owner", "left").select("owner", (F.coalesce("total", F.lit(0.0)) / F.col("n")).alias("similarity"))
