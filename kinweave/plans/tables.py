"""The driver's tables seen as two sides of one hierarchy.

Side A is what odd line numbers show, side B what even ones show; B's keys are shifted so they can't give a match away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHIFT = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def side(frame: DataFrame, parity: int, column: str = "l_linenumber") -> DataFrame:
    return frame.where(F.col(column) % 2 == parity)


def suppliers(spark: SparkSession, sf_dir: str, parity: int) -> DataFrame:
    """(id, nation, balance, lines, orders, flags, parts) of the suppliers on one side."""
    lines = side(table(spark, sf_dir, "lineitem"), parity).groupBy("l_suppkey").agg(
        F.count("*").alias("lines"),
        F.countDistinct("l_orderkey").alias("orders"),
        F.countDistinct("l_returnflag", "l_linestatus").alias("flags"),
        F.collect_set("l_partkey").alias("parts"),
    )
    s = table(spark, sf_dir, "supplier")
    joined = s.join(lines, s.s_suppkey == lines.l_suppkey)
    shift = 0 if parity else SHIFT
    return joined.select((F.col("s_suppkey") + shift).alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), "lines", "orders", "flags", "parts")


def orders(spark: SparkSession, sf_dir: str, parity: int) -> DataFrame:
    """(id, owner, status, priority, lines, quantity, ord, n): orders as members of customers on one side."""
    lines = side(table(spark, sf_dir, "lineitem"), parity).groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    o = table(spark, sf_dir, "orders")
    shift = 0 if parity else SHIFT
    joined = o.join(lines, o.o_orderkey == lines.l_orderkey)
    return joined.select(
        (F.col("o_orderkey") + shift).alias("id"),
        (F.col("o_custkey") + shift).alias("owner"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").alias("day"),
        "lines",
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) upwards: customers and suppliers to nations, nations to regions, regions to the world."""
    customer, supplier, nation, region = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation", "region"))

    def name(kind: str, key: str):
        return F.concat(F.lit(kind), F.col(key).cast("string"))

    return (
        customer.select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"))
        .union(supplier.select(name("s", "s_suppkey"), name("n", "s_nationkey")))
        .union(nation.select(name("n", "n_nationkey"), name("r", "n_regionkey")))
        .union(region.select(name("r", "r_regionkey"), F.lit("w")))
    )
