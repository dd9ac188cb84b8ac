"""Tables that cut lineage, written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Rows in a bucket.
BUCKET_ROWS = 200_000
#: Rows that one task of a shuffle takes at once.
TASK_ROWS = 500_000

_local: dict[str, str] = {}
#: The open scopes of this thread or task: what another one stores isn't theirs.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """Folder named in ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a single-machine master; on a cluster that
    folder would not be shared, so it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
            context.setCheckpointDir(_local[context.applicationId])
        base = _local[context.applicationId]
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/kinweave/{name}-{uuid.uuid4().hex}"
    if _scopes.get():
        _scopes.get()[-1].append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: later plans start here, and its size is known to them."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side that meets others by a shuffle of both. For what grows with the input where its size is judged too low: by compressed files, or before an explode."""
    return df.hint("merge")


def buckets_for(rows: DataFrame) -> int:
    """As many buckets as an exchange has partitions, but fewer for few rows."""
    return min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + rows.count() // BUCKET_ROWS)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """As many tasks as an exchange has partitions, but more for many rows, so that what one of them holds doesn't grow with the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + rows // TASK_ROWS)


def table_name(path: str) -> str:
    return path.rpartition("/")[2].replace("-", "_")


def bucketed(rows: DataFrame, path: str, keys: list[str], buckets: int) -> DataFrame:
    """``rows``, already dealt by ``keys``, added to the bucketed table at ``path``; only tables of the catalog have buckets."""
    rows.write.mode("append").bucketBy(buckets, *keys).option("path", path).saveAsTable(table_name(path))
    return rows.sparkSession.table(table_name(path))


def unregistered(spark: SparkSession, *paths: str) -> None:
    """Take bucketed tables out of the catalog; their files stay."""
    for path in paths:
        spark.sql(f"DROP TABLE IF EXISTS {table_name(path)}")


def emptied(spark: SparkSession, *paths: str) -> None:
    """Put an empty table in place of each of ``paths``, so that their space is free. Only for tables that no plan reads again."""
    for path in paths:
        spark.range(0, 0, 1, 1).write.mode("overwrite").parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside, by the same thread, are emptied at the end: what they served for has to be written by then, to a path made outside."""
    own: list[str] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        emptied(spark, *own)
