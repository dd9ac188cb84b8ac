"""Two versions of one program with different names: extraction, the remaining measures, and linking from end to end."""

import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import engine, measures, positions, sequences
from kinweave.sources import classfile, extraction

BASE = "java/lang/Object"


def program(names: dict[str, str]) -> list[tuple]:
    """Rows of six classes, each with methods that differ in code and strings; ``names`` says what things are called."""
    rng = random.Random(5)
    n = lambda x: names.get(x, x)
    rows = []
    for i in range(6):
        me = n(f"C{i}")
        parent = BASE if i < 3 else n(f"C{i - 3}")
        rows.append(("x.jar", "class", None, me, me, parent, 0x21 if i % 2 else 0x421, None))
        rows.append(("x.jar", "field", me, f"{n(f'f{i}')};;L{me};", n(f"f{i}"), f"L{me};", 2, "0"))
        for j in range(2 + i % 3):
            desc = "(" + "I" * j + ")V"
            method = f"{n(f'm{i}_{j}')}{desc}"
            owner = f"{me}/{method}"
            rows.append(("x.jar", "method", me, method, n(f"m{i}_{j}"), desc, 1, str(j)))
            for k in range(3 + 2 * j + i):
                op = rng.choice([1, 2, 3, 4, 87, 88])
                rows.append(("x.jar", "code", owner, str(k), None, None, op, None))
            text = f"text {i} {j}"
            rows.append(("x.jar", "code", owner, str(100), None, None, 18, text))
            rows.append(("x.jar", "string", owner, None, None, None, None, text))
            called = f"{n(f'C{(i + 1) % 6}')}/{n(f'm{(i + 1) % 6}_0')}()V"
            rows.append(("x.jar", "code", owner, str(101), None, called, 184, None))
            rows.append(("x.jar", "calls", owner, None, None, called, None, None))
    return rows


NAMES = {f"C{i}": f"q{(i * 5 + 2) % 6}" for i in range(6)} | {f"m{i}_{j}": f"z{i * 7 + j}" for i in range(6) for j in range(4)} | {f"f{i}": f"y{i}" for i in range(6)}


@pytest.fixture(scope="module")
def models(spark):
    return [extraction.extract(spark.createDataFrame(program(names), classfile.SCHEMA), prefix=side) for side, names in (("a:", {}), ("b:", NAMES))]


def test_extraction(models):
    a = models[0]
    entity = {r.id: r for r in a.entity.collect()}
    assert len(entity) == 6 + 6 + 18 + 1 and entity["a:" + BASE].kind == "placeholder" and not entity["a:" + BASE].disguised
    assert entity["a:C4"].depth == 2 and entity["a:C4"].siblings == 1 and entity["a:C0"].siblings == 3
    edges = {tuple(r) for r in a.edge.select("rel", "src", "dst").collect()}
    assert ("calls", "a:C0/m0_1(I)V", "a:C1/m1_0()V") in edges and ("class ref", "a:C0/m0_1(I)V", "a:C1") in edges
    assert ("type", "a:C2/f2;;LC2;", "a:C2") in edges and ("extends", "a:C5", "a:C2") in edges
    assert a.token.where("owner = 'a:C0' AND sort = 'string'").count() == 2
    assert a.seq.where("owner = 'a:C0/m0_1(I)V' AND sort = 'arg type'").count() == 1


def test_every_measure_is_1_between_versions(spark, models):
    """With all matches given, nothing differs but names."""
    a, b = models

    def other(x: str) -> str:
        for old in sorted(NAMES, key=len, reverse=True):
            x = x.replace(old, "\0" + NAMES[old] + "\0")
        return "b:" + x.replace("\0", "")[2:]

    pairs = [(r.id, other(r.id), r.kind) for r in a.entity.collect()]
    matches = spark.createDataFrame([p[:2] for p in pairs], "x string, y string")
    assert matches.join(b.entity.select(F.col("id").alias("y")), "y", "left_anti").isEmpty()
    for kind, level in (("class", "extra"), ("method", "extra"), ("field", "intermediate")):
        own = spark.createDataFrame([p[:2] for p in pairs if p[2] == kind], "a string, b string")
        for d in measures.REGISTRY[kind]:
            if level in d.levels and d.name in ("position", "code", "in references (bci)", "similar methods", "members full"):
                scores = [r.similarity for r in measures.evaluate(d, own, a, b, matches).collect()]
                assert len(scores) == own.count() and min(scores) > 0.999, d.name


def test_link_from_end_to_end(models):
    a, b = models
    seeds = engine.prematched(a, b)
    assert [tuple(r) for r in seeds.collect()] == [("a:" + BASE, "b:" + BASE)]
    top = measures.usable_total("class", "initial", a, b)
    new = engine.one_pass("class", "initial", a, b, seeds)
    got = {r.x[2:]: r.y[2:] for r in new.collect()}
    assert got and all(NAMES[x] == y for x, y in got.items()) and top == 93
    members = engine.one_pass("method", "initial", a, b, seeds.unionByName(new))
    assert members.count() and all(NAMES[r.x.split("/")[1].split("(")[0]] == r.y.split("/")[1].split("(")[0] for r in members.collect())


def plain_position(a_place, a_n, b_place, b_n, marks):
    if a_place == b_place and a_n == b_n:
        return 1.0
    low = max((i for i in marks if i < a_place), default=None)
    high = min((i for i in marks if i > a_place), default=None)
    start_a, start_b = (0, 0) if low is None else (low + 1, marks[low] + 1)
    end_a, end_b = (a_n, b_n) if high is None else (high, marks[high])
    if start_b >= end_b or start_b > b_place or end_b <= b_place:
        start_a, start_b, end_a, end_b = 0, 0, a_n, b_n
    rel = lambda p, n: 0.5 if n == 1 else p / (n - 1)
    return 1 - abs(rel(a_place - start_a, end_a - start_a) - rel(b_place - start_b, end_b - start_b))


def test_positions(spark):
    rng = random.Random(2)
    left, right, pairs, matches, want = [], [], [], [], {}
    for owner in range(25):
        na, nb = rng.randrange(1, 7), rng.randrange(1, 7)
        left += [(f"{owner}a{i}", owner, i) for i in range(na)]
        right += [(f"{owner}b{i}", owner, i) for i in range(nb)]
        marks = {i: p for i, p in zip(rng.sample(range(na), na), rng.sample(range(nb), nb)) if rng.random() < 0.4}
        matches += [(f"{owner}a{i}", f"{owner}b{p}") for i, p in marks.items()]
        for i in range(na):
            for j in range(nb):
                pairs.append((f"{owner}a{i}", f"{owner}b{j}"))
                want[pairs[-1]] = plain_position(i, na, j, nb, marks)
    frame = spark.createDataFrame
    got = positions.of_places(frame(pairs, "a string, b string"), frame(left, "id string, owner int, place int"), frame(right, "id string, owner int, place int"), frame(matches, "x string, y string"))
    assert {(r.a, r.b): pytest.approx(r.similarity) for r in got.collect()} == want


def test_lists_of_tokens():
    t = lambda value, key=None, name=None, disguised=False: {"value": value, "key": key, "name": name, "disguised": disguised}
    assert sequences.could_equal(t("1"), t("1")) == 0 and sequences.could_equal(t("1"), t("2")) == 2
    assert sequences.could_equal(t("1", "k"), t("1", "k")) == 0 and sequences.could_equal(t("1", "k"), t("1", name="k", disguised=True)) == 2
    assert sequences.could_equal(t("1", name="p", disguised=True), t("1", name="q")) == 0 and sequences.could_equal(t("1", name="p"), t("1", name="q")) == 2
    assert sequences.of_lists([t("1"), t("2")], [t("1")], sequences.could_equal) == 0.5 and sequences.of_lists([], [], sequences.could_equal) == 1.0


def test_generic_shape(spark):
    rows = spark.createDataFrame([("<K:Ljava/lang/Object;>La/B<TK;>;",), ("<Q:Lx/y;>Lz<TQ;>;",), ("Lz<TQ;>;",)], "s string")
    one, two, three = [r[0] for r in rows.select(extraction.generic_shape(F.col("s"))).collect()]
    assert one == two == "<:L;>L<T;>;" and three == "L<T;>;"
