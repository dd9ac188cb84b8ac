"""The binary key of the natural order against a comparison run by run."""

import random
import re
from functools import cmp_to_key

from pyspark.sql import functions as F

from kinweave.operators import names


def compared(a: str, b: str) -> int:
    runs = [re.findall(r"[./$]|[0-9]+|[^0-9./$]+", x) for x in (a, b)]
    for i in range(max(map(len, runs))):
        if i >= len(runs[0]) or i >= len(runs[1]):
            return -1 if i >= len(runs[0]) else 1
        inner = ["." in r[i:] or "/" in r[i:] for r in runs]
        if inner[0] != inner[1]:
            return 1 if inner[0] else -1
        x, y = runs[0][i], runs[1][i]
        if x[0].isdigit() and y[0].isdigit() and len(x) != len(y):
            return -1 if len(x) < len(y) else 1
        if x != y:
            return -1 if x < y else 1
    return 0


def test_bytes_sort_as_names_compare(spark):
    rng = random.Random(9)
    found = {"", "a", "a1", "a10", "a9", "a09", "a/b", "a/b/c", "a$1", "a$b", "/", "//", "1", "01", "\0", "a\0", "a\0b", "a\1", "é1", "\U0001f600", "￮"}
    found |= {"".join(rng.choice(["a", "b", "Z", "1", "12", "0", "/", ".", "$", "é", "￮", "\U0001f600", "\0"]) for _ in range(rng.randrange(1, 9))) for _ in range(3000)}
    want = sorted(found, key=cmp_to_key(compared))
    rows = spark.createDataFrame([(x,) for x in found], "name string").withColumn("key", names.natural_key(F.col("name")))
    assert [r.name for r in rows.orderBy("key").collect()] == want
    assert rows.select("key").distinct().count() == len(found)


def test_nulls_and_examples(spark):
    rows = spark.createDataFrame([(None,), ("p/b",), ("p/a10",), ("p/a9",), ("p/q/a",), ("p/a$1",)], "name string").withColumn("key", names.natural_key(F.col("name")))
    assert rows.where("name IS NULL").first().key is None
    assert [r.name for r in rows.where("name IS NOT NULL").orderBy("key").collect()] == ["p/a$1", "p/a9", "p/a10", "p/b", "p/q/a"]
