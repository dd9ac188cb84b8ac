"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import classifier, decontam, jaccard, linededup, minmax, negatives, packing, pii, rules, sharding, spelling, sql, urlrules, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op2_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_report(table(spark, sf_dir, "documents"))


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.report(table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op7_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(table(spark, sf_dir, "documents"))


def op10_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"))


def op11_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.report(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.report(table(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_pii, op2_linededup, op3_decontam, op4_rules, op5_jaccard, op6_packing, op7_classifier, op8_warc, op9_sharding, op10_urlrules, op11_minmax, op12_spelling, op13_negatives)
}

#: Not in SQL: tokens (op6), boosted trees (op7), the minimax partition (op9).
ORACLES: dict[str, str] = {
    "op1_pii": sql.PII,
    "op2_linededup": sql.LINES,
    "op3_decontam": sql.DECONTAM,
    "op4_rules": sql.RULES,
    "op5_jaccard": sql.JACCARD,
    "op8_warc": sql.WARC,
    "op10_urlrules": sql.URLS,
    "op11_minmax": sql.MINMAX,
    "op12_spelling": sql.SPELLING,
    "op13_negatives": sql.NEGATIVES,
}
