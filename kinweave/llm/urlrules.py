"""URL verdicts: explicit rules, and rules mined from labelled URLs by FP-growth.

An explicit rule (host, path) fits its host and all subdomains if the URL's path starts with the rule's path;
the longest one wins. URLs that no explicit rule fits are judged by mined rules: FP-growth finds token
combinations, of any length, that come with a label often enough (support) and nearly always (confidence). Labels are the
verdicts of the explicit rules. Tokens are the labels of the host, all directories of the path, the names of all query
parameters, and the number of directories.

Tokens that the same labelled URLs have are one to the miner, and one to the URLs that are judged: rules that differ in such
tokens only are equally sure. So a long URL, or many copies of one, don't make a combination of each set of its tokens. Tokens all of whose labelled URLs have one label
are rules by themselves and aren't mined further (``sure``).

A rule is redundant, and goes, if one with a part of its tokens has at least its confidence: every URL that it fits is
decided by the shorter rule. The other rules are kept in an inverted index, each filed under its rarest token, so a
URL meets only the few rules filed under its tokens, and then has to hold all tokens of the rule. The same index finds the redundant rules.

Defined cases: a null URL, or one without "://", has an empty host and path, no rule and the default verdict;
null page_ids and repeated rows are judged like others; without any mined rule all other verdicts are the default; a very long
URL has a token for each directory and parameter; of mined rules that tie, the shorter one decides, then "allow"; other columns are dropped.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.storage import stored

from .linededup import lowered

# The explicit rules, by host, path and verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.9
#: Parts of the rows of one URL, so that a frequent one isn't a single join key.
SALTS = 16
DEFAULT = "allow"
LABELS = ("label=allow", "label=block")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return lowered(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def explicit(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest explicit rule that fits, or nulls."""
    text = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the last one that fits wins
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, rule_host + rule_path).otherwise(text)
        verdict = F.when(fits, says).otherwise(verdict)
    return text, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels, directories, names of query parameters, and the number of directories."""

    def named(kind: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(kind + "="), lowered(x)))

    folders = F.filter(F.split(F.regexp_extract(path, "^.*/", 0), "/", -1), lambda x: x != "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&", -1), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    depth = F.array(F.concat(F.lit("depth="), F.size(folders).cast("string")))
    return F.array_distinct(F.concat(named("host", F.split(host, r"\.", -1)), named("dir", folders), named("query", names), depth))


def alike(labelled: DataFrame) -> DataFrame:
    """(token, face): the smallest of the tokens that the same rows of ``labelled`` (n, tokens) have; sets of rows are known by 128 bits."""
    rows = labelled.select("n", F.explode("tokens").alias("token"))
    sets = rows.groupBy("token").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("n")).alias("h1"), F.bit_xor(F.xxhash64(F.lit("second"), "n")).alias("h2"))
    faces = sets.groupBy("k", "h1", "h2").agg(F.min("token").alias("face"))
    return sets.join(faces, ["k", "h1", "h2"]).select("token", "face")


def faced(rows: DataFrame, faces: DataFrame, key: str) -> DataFrame:
    """``rows`` (key, tokens) with the faces of their tokens in place of these, without unknown ones."""
    return rows.select(key, F.explode("tokens").alias("token")).join(faces, "token").groupBy(key).agg(F.sort_array(F.collect_set("face")).alias("tokens"))


def sure(labelled: DataFrame, faces: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """Rules of single tokens all of whose labelled rows (n, tokens, verdict) have one verdict.

    Every longer rule with such a token is redundant, so the token needn't be mined: tokens that come with one verdict only and
    nearly always together, as parameters do, would make a frequent combination of each set of them.
    """
    total = labelled.count()
    rows = labelled.select("n", "verdict", F.explode("tokens").alias("token")).join(faces, "token").select("n", "verdict", "face").distinct()
    pure = rows.groupBy("face").agg(F.count("*").alias("k"), F.min("verdict").alias("verdict"), F.max("verdict").alias("other")).where(F.col("verdict") == F.col("other"))
    often = pure.where(F.col("k") >= F.ceil(F.lit(min_support * total)))
    return often.select(F.array("face").alias("antecedent"), "verdict", F.lit(1.0).alias("confidence"), F.round(F.col("k") / total, 9).alias("support"), F.col("face").alias("token"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (antecedent, verdict, confidence, support) from rows (tokens, verdict), redundant ones included."""
    if labelled.isEmpty():
        return labelled.sparkSession.createDataFrame([], "antecedent array<string>, verdict string, confidence double, support double")
    baskets = labelled.select(F.array_append("tokens", F.concat(F.lit("label="), F.col("verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.get("consequent", F.lit(0)).isin(*LABELS) & ~F.arrays_overlap("antecedent", F.array(*map(F.lit, LABELS))))
    return rules.select(
        F.sort_array("antecedent").alias("antecedent"),
        F.substring_index(F.get("consequent", F.lit(0)), "=", -1).alias("verdict"),
        F.round("confidence", 9).alias("confidence"),
        F.round("support", 9).alias("support"),
    )


def indexed(rules: DataFrame, labelled: DataFrame) -> DataFrame:
    """The inverted index: each rule under the one of its tokens that is rarest in the labelled URLs."""
    frequency = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    filed = rules.withColumn("token", F.explode("antecedent")).join(frequency, "token")
    return filed.groupBy("antecedent", "verdict", "confidence", "support").agg(F.min_by("token", F.struct("n", "token")).alias("token"))


def pruned(index: DataFrame) -> DataFrame:
    """The rules of ``index`` that aren't redundant."""
    long = index.select("antecedent", "confidence", F.explode("antecedent").alias("token"))
    short = index.select("token", F.col("antecedent").alias("part"), F.col("confidence").alias("as_sure"))
    met = long.join(short, "token").where((F.size("part") < F.size("antecedent")) & (F.col("as_sure") >= F.col("confidence")))
    redundant = met.where(F.size(F.array_except("part", "antecedent")) == 0).select("antecedent").distinct()
    return index.join(redundant, "antecedent", "left_anti")


def match(urls: DataFrame, index: DataFrame) -> DataFrame:
    """(url, mined): verdict of the best mined rule of each distinct URL: by confidence, support, fewer tokens, then verdict."""
    posted = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    fits = posted.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    rank = F.struct(-F.col("confidence"), -F.col("support"), F.size("antecedent"), "verdict")
    return fits.groupBy("url").agg(F.min_by("verdict", rank).alias("mined"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url)."""
    url = F.col("url")
    host, path = host_and_path(url)
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    text, verdict = explicit(F.col("host"), F.col("path"), rules)
    seen = split.withColumns({"rule": text, "said": verdict})
    own = tokens(url, F.col("host"), F.col("path")).alias("tokens")
    labelled = stored(seen.where("said IS NOT NULL").select(F.monotonically_increasing_id().alias("n"), own, F.col("said").alias("verdict")), "url_labels")
    faces = stored(alike(labelled), "url_faces")
    single = stored(sure(labelled, faces), "url_sure")
    open_ = faces.join(single.select(F.col("token").alias("face")), "face", "left_anti")
    # a row without a token left still counts for the support
    baskets = labelled.select("n", "verdict").join(faced(labelled, open_, "n"), "n", "left")
    known = stored(baskets.select(F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), "verdict"), "url_baskets")
    index = stored(pruned(stored(indexed(mine(known), known).unionByName(single), "url_rules")), "url_index")
    others = faced(seen.where("said IS NULL AND url IS NOT NULL").select("url", own).dropDuplicates(["url"]), faces, "url")
    mined = match(others, index).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = seen.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return salted.join(mined, ["url", "salt"], "left").select("page_id", "host", "path", "rule", F.coalesce("said", "mined", F.lit(DEFAULT)).alias("verdict"))
