"""Quality rules as a short-circuit cascade, cheapest rejection first.

A document is kept if it breaks no rule, so the order of the rules changes the cost of a verdict and never the
verdict. On a bounded sample each rule's cost and selectivity (share of the sample that it rejects) are measured, and the
rules are ordered by rejection per cost. A rule's cost is the time of a job that evaluates it ``REPEATS`` times on each row, less
that of a job without it, so that starting a job doesn't count; the statistics are part of the result and cost the same in any order. The verdict is one nested
conditional in that order: a document leaves at the first rule it breaks, and later rules aren't evaluated.

Repeats inside a document are found with sorted arrays in its own row: no exchange, n log n steps.

Defined cases: a null text has no words and breaks the base rule; an empty table gives an empty result and the
given order of rules; null doc_ids and repeated rows are judged like others; other columns are dropped.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.columns import let
from kinweave.storage import stored

# The words, the counted symbols, and the base limits.
WORD = "[^ \t-\r]+"
GAP = "[ \t-\r]+"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

#: Rows of the sample on which costs and selectivities are measured, at most.
SAMPLE_ROWS = 1000
#: Evaluations of a rule on each row of the sample, runs of which the fastest counts, and the least time told apart.
REPEATS, RUNS, LEAST_SECONDS = 20, 2, 0.005


@dataclass(frozen=True)
class Rule:
    """``breaks`` is true for documents that the rule rejects."""

    name: str
    breaks: Callable[[], Column]


def letters(pattern: str) -> Column:
    return F.length(F.regexp_replace("text", pattern, ""))


RULES = (
    Rule("many_symbols", lambda: F.col("n_symbols") * 10 > F.col("n_words") * 2),
    Rule("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
    Rule("same_lines", lambda: (F.col("n_dup_lines") >= 4) & (F.col("n_dup_lines") * 10 > F.col("n_lines") * 3)),  # a share of a few lines says little
    Rule("shouting", lambda: letters("[^A-Z]") > letters("[^a-z]")),
    Rule("exclamations", lambda: letters("[^!]") * 10 > F.col("n_words")),
)


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a three-word window found twice or more."""

    def window_at(w: Column, i: Column) -> Column:
        return F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("at"))

    def twins(windows: Column) -> Column:
        def has_twin(x: Column, i: Column) -> Column:
            return F.coalesce(x["h"] == F.get(windows, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(windows, i + 1)["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(windows, has_twin), lambda x: x["at"]))

    def covered(acc: Column, at: Column) -> Column:
        return F.struct((acc["n"] + F.least(F.lit(3), at + 3 - acc["to"])).alias("n"), (at + 3).alias("to"))

    windows = F.sort_array(F.slice(F.transform(words, window_at), F.lit(1), F.size(words) - 2))
    counted = F.aggregate(let(windows, twins), F.struct(F.lit(0).alias("n"), F.lit(-1).alias("to")), covered, lambda acc: acc["n"])
    return F.when(F.size(words) > 3, counted).otherwise(0).cast("long")


def word_statistics(words: Column) -> Column:
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        repeated_words(words).alias("n_repeat_words"),
    )


def line_statistics(lines: Column) -> Column:
    def repeats(with_word: Column) -> Column:
        return (F.size(with_word) - F.size(F.array_distinct(with_word))).cast("long")

    found = F.when(F.size(lines) > 1, let(F.filter(lines, lambda x: x.rlike(WORD)), repeats)).otherwise(F.lit(0).cast("long"))
    return F.struct(F.size(lines).cast("long").alias("n_lines"), found.alias("n_dup_lines"))


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the text, and the statistics that rules are about."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, GAP, -1), lambda w: w != "")
    return docs.select(
        *keep,
        t.alias("text"),
        let(words, word_statistics).alias("_w"),
        let(F.split(t, "\n", -1), line_statistics).alias("_l"),
    ).select(*keep, "text", "_w.*", letters("[^#*$%&|<>]").cast("long").alias("n_symbols"), "_l.*")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)


def sample_of(docs: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` documents, and never more than twice as many, chosen by the hash of their id and text."""
    total = docs.count()
    if total > rows:
        docs = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < max(1, rows * (1 << 40) // total))
    return docs.limit(2 * rows)


def seconds(sample: DataFrame, breaks: Column) -> tuple[float, int]:
    """(seconds, rows that break the rule) of the fastest of ``RUNS`` jobs, over ``REPEATS`` copies of each row."""
    copies = sample.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))
    found = []
    for _ in range(RUNS):
        began = time.perf_counter()
        rejected = copies.agg(F.count_if(breaks)).first()[0]
        found.append((time.perf_counter() - began, rejected // REPEATS))
    return min(found)


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, cost in seconds, selectivity) in the order of the cascade, from a sample of ``docs``."""
    sample = stored(measured(sample_of(docs.select("doc_id", "text"), rows)), "rule_sample")
    total = sample.count()
    if not total:
        return [(rule, 0.0, 0.0) for rule in rules]
    nothing, _ = seconds(sample, F.col("_copy") < 0)
    found = []
    for rule in rules:
        spent, rejected = seconds(sample, rule.breaks())
        found.append((rule, max(spent - nothing, LEAST_SECONDS), rejected / total))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0].name))


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that a measured document breaks, or null."""
    first = F.lit(None).cast("string")
    for rule in reversed(rules):
        first = F.when(rule.breaks(), rule.name).otherwise(first)
    return first


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Statistics and verdict: one row per document. The base rule stands first whatever its cost."""
    order = [rule for rule, _, _ in ordered(docs, rules)]
    judged = measured(docs).withColumn("base_failed", base_failed())
    kept = F.when(F.col("base_failed"), False).otherwise(cascade(order).isNull())
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
