"""Candidates by rare features: none is lost against all pairs, and few are made where features are rare."""

import random
from collections import defaultdict

import pytest

from kinweave.operators import engine, measures, prefixes

ENTITY = "id string, kind string, owner string, name string, disguised boolean, flags int, depth int, siblings int, shape string, size int, ord int"


def model(spark, side: str, n: int, seed: int, shared: bool):
    """Classes with strings, numbers and methods; some empty, some with a null, some with a very common string."""
    rng, entity, token = random.Random(seed), [], []
    for i in range(n):
        me = f"{side}{i}"
        entity.append((me, "class", None, me, True, rng.choice([0, 512, 1536]), i % 3, i % 2, None, None, None))
        for j in range(i % 4):
            entity.append((f"{me}.{j}", "method", me, "m", True, 0, 0, 0, rng.choice(["()V", "(I)V", None]), rng.choice([3, 4, None]), j))
        own = random.Random(i if shared else seed * 1000 + i)
        token += [(me, "string", f"text {own.randrange(3 * n)}") for _ in range(i % 5)] + [(me, "string", "common")] * (i % 3 == 0) + [(me, "string", None)] * (i % 7 == 0)
        token += [(me, "int", str(own.randrange(n))) for _ in range(i % 2 + 1)] + [(me, "double", "1.5")] * (i % 4 == 1)
    edge = [("method of", e[0], e[2]) for e in entity if e[1] == "method"]
    return measures.Model(spark.createDataFrame(entity, ENTITY), spark.createDataFrame(edge, "rel string, src string, dst string"), spark.createDataFrame(token, "owner string, sort string, value string"))


@pytest.fixture(scope="module")
def sides(spark):
    return model(spark, "a", 40, 1, True), model(spark, "b", 40, 2, True), spark.createDataFrame([("a1", "b1")], "x string, y string")


@pytest.mark.parametrize("limit", [2.0, 11.0, 30.0])
def test_no_pair_below_the_limit_is_lost(spark, sides, limit):
    a, b, matches = sides
    every = spark.createDataFrame([(f"a{i}", f"b{j}") for i in range(40) for j in range(40) if i != 1 and j != 1], "a string, b string")
    missed = defaultdict(float)
    for d in measures.REGISTRY["class"]:
        if d.how in ("flags", "count", "degree", "tokens", "numbers", "greedy") and "initial" in d.levels:
            for r in measures.evaluate(d, every, a, b, matches).collect():
                missed[r.a, r.b] += d.weight * (1 - r.similarity)
    want = {p for p, m in missed.items() if m < limit}
    got = [tuple(r) for r in engine.class_pairs(a, b, matches, limit).collect()]
    assert len(got) == len(set(got)) and want <= set(got) and want
    if limit < 11:
        assert len(got) < len(missed) / 4


def test_candidates_grow_with_the_classes(spark):
    """Ten times the classes, with numbers and texts that are rare, make about ten times the candidates."""
    sizes = []
    for n in (30, 300):
        rows = [[(f"{s}{i}", sort, f"{i}") for i in range(n) for sort in ("string", "int")] for s in "ab"]
        found = [prefixes.features(spark.createDataFrame([(f"{s}{i}",) for i in range(n)], "id string"), spark.createDataFrame(r, "id string, sort string, value string"), {"string": 8, "int": 6, "long": 2}) for s, r in zip("ab", rows, strict=True)]
        left, right = prefixes.indexed(*found, 10)
        sizes.append(left.join(right.withColumnsRenamed({"id": "b", "reach": "r"}), "key").select("id", "b").distinct().count())
    assert sizes == [30, 300]


def test_what_is_needed(spark):
    ids = spark.createDataFrame([("p",), ("q",)], "id string")
    values = spark.createDataFrame([("p", "string", "x"), ("p", "string", None), ("q", "other", "x")], "id string, sort string, value string")
    rows = {(r.id, r.key): (r.gain, r.all) for r in prefixes.features(ids, values, {"string": 8, "shape": 4}, frozenset({"shape"})).collect()}
    assert rows == {("p", "string\0x"): (4.0, False), ("p", "shape"): (4.0, True), ("q", "string"): (8.0, False), ("q", "shape"): (4.0, True)}
    found = prefixes.features(ids, values, {"string": 8, "shape": 4}, frozenset({"shape"}))
    assert {(r.id, r.key): r.reach for r in prefixes.indexed(found, found, 5)[0].collect()} == {("p", "string\0x"): 8.0, ("q", "string"): 12.0}
    assert {r.key for r in prefixes.indexed(found, found, 0)[0].where("id = 'p'").collect()} == {"", "shape", "string\0x"}
    empty = found.where("false")
    assert prefixes.indexed(empty, found, 0)[0].isEmpty() and not prefixes.indexed(empty, found, 0)[1].isEmpty()
