"""Operators whose semantics SQL doesn't give, against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kinweave.functions import filters
from kinweave.operators import assignment, graph, lookups, names, ranking, sequences, similarity, state
from kinweave.operators.components import components
from kinweave.sources import matchfile


def plain_costs(a, b, cost):
    out = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
        if i and j:
            out[i][j] = min(out[i - 1][j] + 2, out[i][j - 1] + 2, out[i - 1][j - 1] + cost(a[i - 1], b[j - 1]))
        else:
            out[i][j] = 2 * (i + j)
    return out


def test_costs_are_least_and_alignments_in_order():
    rng = random.Random(0)
    cost = lambda x, y: min(abs(x - y), 2)
    for _ in range(80):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(9))] for _ in range(2))
        costs = plain_costs(a, b, cost)
        assert sequences.table(a, b, cost).tolist() == costs
        places = sequences.align(a, b, cost)
        kept = [p for p in places if p >= 0]
        assert kept == sorted(set(kept)) and len(places) == len(a)
        paid = sum(cost(x, b[p]) for x, p in zip(a, places, strict=True) if p >= 0)
        free_a, free_b = len(a) - len(kept), len(b) - len(kept)
        assert costs[-1][-1] <= paid + 2 * (free_a + free_b) and all(cost(x, b[p]) < 2 for x, p in zip(a, places, strict=True) if p >= 0)


def test_alignment_of_equal_and_empty_sequences():
    assert sequences.align("abc", "abc") == [0, 1, 2] and sequences.align("abc", "") == [-1] * 3 and sequences.align("", "x") == []
    assert sequences.align("axc", "abc") == [0, -1, 2] and sequences.align("bc", "abc") == [1, 2]


def test_cutoff_changes_no_acceptance(spark):
    rng = random.Random(1)
    rows = [(a, 100 + b, rng.random() ** 0.2, rng.random() ** 0.2) for a in range(40) for b in range(6)] + [(a, 200 + a, 1.0, 0.99) for a in range(0, 40, 3)]
    pairs = spark.createDataFrame(rows, "a long, b long, x double, y double")
    measures = [ranking.Measure("x", 6, F.col("x")), ranking.Measure("y", 4, F.col("y"), ("initial",))]
    whole = ranking.accepted(ranking.score(pairs, measures), 10.0).collect()
    cut = ranking.accepted(ranking.score(pairs, measures, limit=ranking.cutoff(10.0)), 10.0).collect()
    assert sorted(whole) == sorted(cut) and whole
    expected = []
    for a in range(40):
        scores = sorted(((round(6 * x + 4 * y, 9), -b) for i, b, x, y in rows if i == a), reverse=True)
        norms = [(s / 10) ** 2 for s, _ in scores]
        if norms[0] >= 0.85 and norms[1] < norms[0] * 0.915:
            expected.append((a, -scores[0][1], scores[0][0]))
    assert sorted(map(tuple, whole)) == sorted(expected)
    assert ranking.largest(measures, "full") == 6.0


def test_ties_are_never_accepted(spark):
    tied = spark.createDataFrame([(1, 10, 10.0), (1, 11, 10.0), (2, 12, 10.0)], "a long, b long, score double")
    assert [tuple(r)[:2] for r in ranking.accepted(tied, 10.0).collect()] == [(2, 12)]


def test_set_similarity_of_identities(spark):
    frame = lambda rows, names_: spark.createDataFrame(rows, names_)
    pairs = frame([(1, 1), (2, 2), (3, 3)], "a long, b long")
    a_sets = frame([(1, 10), (1, 11), (1, 12), (1, 13), (2, 10)], "a long, x long")
    b_sets = frame([(1, 20), (1, 22), (1, 29)], "b long, y long")
    matches = frame([(10, 20), (11, 21)], "x long, y long")  # 11's partner isn't in the other set
    candidates = frame([(12, 22), (12, 23)], "x long, y long")  # 13 and 29 have none
    got = {r.a: r.similarity for r in similarity.of_identities(pairs, a_sets, b_sets, matches, candidates).collect()}
    assert got == {1: pytest.approx((7 - 3) / 7), 2: 0.0, 3: 1.0}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(40)] + [(500, 500)]
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.label for r in components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
    assert got == root


def test_components_of_long_chains(spark):
    """Chains with random ids, whose labels once needed a pass for nearly each node."""
    rng = random.Random(4)
    ids = rng.sample(range(10**6), 3000)
    chains = [ids[:2000], ids[2000:2500], sorted(ids[2500:])]
    edges = [(a, b) for c in chains for a, b in zip(c, c[1:], strict=False)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: min(c) for c in chains for n in c}


def test_fixpoint_goes_on_while_states_are_new_and_ends_where_one_comes_again(spark):
    start = spark.createDataFrame([(0, 0)], "a long, b long")
    grow = lambda s: s.groupBy().agg(F.max("a").alias("m")).where("m < 6").select((F.col("m") + 1).alias("a"), (F.col("m") + 1).alias("b"))
    assert sorted(map(tuple, state.fixpoint(start, grow).collect())) == [(i, i) for i in range(7)]
    assert list(map(tuple, state.fixpoint(start, lambda s: s.select("a", (1 - F.col("b")).alias("b"))).collect())) == [(0, 0)]
    steps = {0: 1, 1: 2, 2: 3, 3: 1}
    onward = F.create_map(*[F.lit(x).cast("long") for p in steps.items() for x in p])
    assert list(map(tuple, state.fixpoint(start, lambda s: s.select("a", onward[F.col("b")].alias("b"))).collect())) == [(0, 1)]


def test_closure_is_that_of_a_walk_from_each_node(spark):
    rng = random.Random(8)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(75)} | {(100 + i, 101 + i) for i in range(37)}
    want = {}
    for start in {n for e in edges for n in e}:
        reached, front, far = {start: 0}, {start}, 0
        while front:
            far += 1
            front = {b for a, b in edges if a in front} - set(reached)
            reached |= dict.fromkeys(front, far)
        want |= {(start, n): d for n, d in reached.items()}
    rows = graph.closure(spark.createDataFrame(sorted(edges), "src int, dst int")).collect()
    assert {(r.sub, r.sup): r.distance for r in rows} == want and len(rows) == len(want)


def test_closure_of_a_diamond_and_a_cycle(spark):
    edges = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("x", "y"), ("y", "x")], "src string, dst string")
    got = {(r.sub, r.sup): r.distance for r in graph.closure(edges).collect()}
    assert got[("d", "a")] == 2 and got[("x", "y")] == 1 and got[("x", "x")] == 0 and ("a", "d") not in got


def test_member_groups_and_overrides(spark):
    """An interface and a class that share a method only through a common subclass; private namesakes stay apart."""
    edges = spark.createDataFrame([("sub", "base"), ("sub", "face"), ("base", "root"), ("face", "root")], "src string, dst string")
    rows = [("b.m", "base", "m", False), ("f.m", "face", "m", False), ("r.m", "root", "m", False), ("s.m", "sub", "m", False), ("b.p", "base", "p", True), ("s.p", "sub", "p", True)]
    members = spark.createDataFrame(rows, "member string, owner string, name string, apart boolean")
    paths = graph.closure(edges)
    assert {r.member: r.grouped for r in graph.member_groups(paths, members).collect()} == {"b.m": "b.m", "f.m": "b.m", "r.m": "b.m", "s.m": "b.m", "b.p": "b.p", "s.p": "s.p"}
    assert {tuple(r) for r in graph.nearest_override(paths, members).collect()} == {("s.m", "b.m"), ("s.m", "f.m"), ("b.m", "r.m"), ("f.m", "r.m")}


def test_next_entry(spark):
    wanted = spark.createDataFrame([(1, 5, "p"), (1, 9, "q"), (2, 1, "r"), (1, 5, "s")], "slot long, at long, tag string")
    entries = spark.createDataFrame([(1, 5, 50), (1, 7, 70), (1, 7, 71), (2, 0, 0)], "slot long, at long, entity long")
    got = {r.tag: r.entity for r in lookups.at_or_after(wanted, entries, "slot", "at", "entity").collect()}
    assert got == {"p": 50, "q": None, "r": None, "s": 50}


def test_numbering_has_no_gaps(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = names.numbered(rows, ["k"], "n", 5, 8).collect()
    assert all(r.n == r.k + 5 for r in got) and len(got) == 1000


def test_schedule():
    def run(found):
        seen = []

        def one(kind, level):
            seen.append((kind, level))
            return (kind, level) in found and seen.count((kind, level)) == 1

        state.schedule(one)
        return seen

    quiet = [(k, level) for level in ("intermediate", "full", "extra") for k in ("method", "field", "class")]
    assert run(set()) == [("class", "initial"), *quiet, ("argument", "full"), ("variable", "full")]
    busy = run({("class", "initial"), ("method", "full")})
    assert busy[:2] == [("class", "initial")] * 2 and busy.count(("method", "full")) == 2 and busy.count(("class", "full")) == 1


def test_filters(spark):
    rows = spark.createDataFrame([("ab", "x"), ("b", "ab"), ("c", None)], "name string, aux string")
    columns = {"name": rows["name"], "aux": rows["aux"]}
    kept = lambda text: "".join(sorted(r.name[0] for r in rows.where(filters.compiled(text, columns, rows["name"])).collect()))
    assert kept("a startswith") == "a" and kept("a startswith not") == "bc" and kept("b") == "b" and kept("aux") == ""
    assert kept("dup a startswith swap b eq or") == "ab"
    assert kept("and") == kept("name and") == kept("x y z") == kept("a startswith name") == "abc"


def test_match_files(spark, tmp_path):
    text = "header\nc\tA\tB\n\tm\tm1\tn1\n\t\tma\t0\t1\n\tfu\ta\tf1\n\tf\tonly\ncu\ta\tC\nc\tD\tE\n\t\tmv\t2\t3\nbroken"
    (tmp_path / "one.match").write_text(text)
    got = [tuple(r)[2:] for r in matchfile.read(spark, f"file://{tmp_path}/one.match").orderBy("line").collect()]
    assert got == [
        (0, "c", "A", "B", "A", "B", None, None), (1, "m", "m1", "n1", "A", "B", None, None), (2, "ma", "0", "1", "A", "B", "m1", "n1"), (1, "fu", "a", "f1", "A", "B", None, None),
        (0, "cu", "a", "C", "a", "C", None, None), (0, "c", "D", "E", "D", "E", None, None), (2, "mv", "2", "3", "D", "E", "a", "f1"),
    ]
    owners = spark.createDataFrame([("A", "B"), ("D", "E")], "a string, b string")
    members = spark.createDataFrame([("A", "m", "m1", "n1"), ("D", "f", "f1", "g1")], "owner string, kind string, a string, b string")
    matchfile.write(matchfile.lines(owners, members), f"file://{tmp_path}/out")
    back = matchfile.read(spark, f"file://{tmp_path}/out/part-*").select("tag", "first", "second", "owner_a").collect()
    assert sorted(map(tuple, back)) == [("c", "A", "B", "A"), ("c", "D", "E", "D"), ("f", "f1", "g1", "D"), ("m", "m1", "n1", "A")]


def plain_greedy(a, b, carry):
    """Straight from the definition, over all pairs."""
    if not a or not b:
        return float(not a and not b)
    free, total, best, score = list(range(len(b))), 0.0, None, 0.0
    for shape, size in a:
        if not carry:
            best, score = None, 0.0
        for j in free:
            own = 1 - abs(size - b[j][1]) / max(size, b[j][1]) if shape == b[j][0] else 0.0
            if own > score:
                best, score = j, own
        if best is not None:
            total += score
            free = [j for j in free if j != best]
    return total / max(len(a), len(b))


@pytest.mark.parametrize("carry", [True, False])
def test_greedy_assignment(spark, carry):
    rng = random.Random(7)
    lists = {k: [(rng.choice("xyz"), rng.randrange(1, 6)) for _ in range(rng.randrange(7))] for k in range(60)}
    rows = [(k, i, s, n) for k, members in lists.items() for i, (s, n) in enumerate(members)]
    members = spark.createDataFrame(rows, "owner long, place int, shape string, size int")
    pairs = spark.createDataFrame([(k, (k * 7 + 1) % 60) for k in lists], "a long, b long")
    got = {(r.a, r.b): r.similarity for r in assignment.greedy_similarity(pairs, members, members, ["place"], carry).collect()}
    assert got == {(k, (k * 7 + 1) % 60): pytest.approx(plain_greedy(lists[k], lists[(k * 7 + 1) % 60], carry)) for k in lists}
    assert assignment.greedy([{"shape": None, "size": None}], [{"shape": None, "size": None}]) == 1.0


def test_references_at_aligned_places(spark):
    rng = random.Random(8)
    a, b = ({c: [rng.randrange(4) for _ in range(rng.randrange(1, 9))] for c in range(12)} for _ in range(2))
    matched = {c: (c * 5 + 1) % 12 for c in range(9)}
    places = {c: sequences.align([x % 2 for x in a[c]], [x % 2 for x in b[p]]) for c, p in matched.items()}
    want = {}
    for x in range(4):
        kept = lost = 0
        for c in a:
            if x in a[c] and (c not in matched or x not in b[matched[c]]):
                lost += 1
            elif x in a[c]:
                met = [b[matched[c]][p] == x for t, p in zip(a[c], places[c], strict=True) if t == x and p >= 0]
                kept, lost = kept + sum(met), lost + len(met) - sum(met)
        want[x] = kept / (kept + lost) if kept + lost else 1.0
    refs = lambda side: spark.createDataFrame([(c, i, x) for c, xs in side.items() for i, x in enumerate(xs)], "caller long, place int, target long")
    aligned = spark.createDataFrame([(c, i, p) for c, ps in places.items() for i, p in enumerate(ps)], "caller long, place int, partner_place int")
    pairs = spark.createDataFrame([(x, x) for x in range(5)], "a long, b long")
    matches = spark.createDataFrame(list(matched.items()), "caller long, partner long")
    got = {r.a: r.ratio for r in sequences.reference_ratio(pairs, refs(a), refs(b), aligned, matches).collect()}
    assert got == {x: pytest.approx(want.get(x, 1.0)) for x in range(5)}


def test_large_groups_are_numbered_and_followed_over_many_partitions(spark):
    rows = [("hot" if i % 3 else "g" + str(i % 5), (i * 7919) % 1000) for i in range(1000)]
    frame = spark.createDataFrame(rows, "grouped string, at long")
    numbered = sorted(map(tuple, names.numbered(frame, ["at"], "n", 5, buckets=9, group="grouped").collect()))
    followed = sorted(map(tuple, names.followed(frame, "grouped", "at", "next", buckets=9).collect()))
    want_numbers, want_next = [], []
    for group in sorted({g for g, _ in rows}):
        at = sorted(a for g, a in rows if g == group)
        want_numbers += [(group, a, 5 + i) for i, a in enumerate(at)]
        want_next += [(group, a, b) for a, b in zip(at, [*at[1:], None], strict=True)]
    assert numbered == want_numbers and followed == want_next
    empty = frame.where("at < 0")
    assert names.numbered(empty, ["at"], "n", group="grouped").count() == names.followed(empty, "grouped", "at", "next").count() == 0


def test_overlaps_across_steps(spark):
    rng = random.Random(3)
    spans = lambda n: [(rng.randrange(3), s := rng.randrange(-40, 200), s + rng.randrange(40), i) for i in range(n)]
    wanted, ranges = sorted({x[:3] for x in spans(60)}), spans(80)
    got = lookups.overlapping(spark.createDataFrame(wanted, "slot int, start int, stop int"), spark.createDataFrame(ranges, "slot int, start int, stop int, entity int"), "slot", "entity", width=8)
    want = []
    for slot, start, stop in wanted:
        met = [(s, e) for k, s, t, e in ranges if k == slot and start < stop and s < t and s < stop and t > start]
        want.append((slot, start, stop, min(met)[1] if met else None))
    assert sorted(tuple(r) for r in got.select("slot", "start", "stop", "entity").collect()) == want


def test_filters_about_parts_and_ancestors(spark):
    rows = spark.createDataFrame([("p/q/A$B", ["p/q/A$B", "Base"]), ("A", ["A"])], "name string, up array<string>")
    kept = lambda text: [r.name for r in rows.where(filters.compiled(text, {"b": rows["name"]}, rows["name"], rows["up"])).orderBy("name").collect()]
    assert kept("Base instanceof") == ["p/q/A$B"] and kept("class A eq") == ["A"] and kept("package p/q EQ") == ["p/q/A$B"]
    assert kept("inner B eq") == ["p/q/A$B"] and kept("outer p/q/A eq") == ["p/q/A$B"] and kept("b eq") == ["A", "p/q/A$B"]
    assert kept("instanceof") == kept("x y instanceof") == ["A", "p/q/A$B"]


def test_header_of_match_files(spark):
    files = [("a", 5, "SHA256", "aGFzaA==", "one.jar"), ("a", 6, "SHA1", "aA==", "two words.jar"), ("cp b", 7, "SHA1", "bA==", "lib.jar")]
    lines = matchfile.header_lines("2020-01-01T00:00:00Z", files, {"non-obf cls a": "a/.*", "non-obf mem b": "x\ty"})
    lines[2:2] = ["\t\told.jar", "\t\t9\tYQ==\tolder.jar"]
    lines += ["c\tA\tB", "\tm\tx\ty", "\t\tma\t0\t0", ""]
    frame = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line int, value string")
    got = [tuple(r)[1:] for r in matchfile.header(frame).orderBy("ord").drop("ord").collect()]
    assert got == [("a", None, None, None, "old.jar"), ("a", 9, "SHA256", "YQ==", "older.jar"), *files, ("non-obf cls a", None, None, None, "a/.*"), ("non-obf mem b", None, None, None, "x\ty")]
    assert matchfile.parsed(frame).count() == 3


def test_one_very_long_range_makes_few_rows(spark):
    wanted = spark.createDataFrame([(1, 0, 2**40), (1, 2**39, 2**39 + 1), (2, 5, 6)], "slot int, start long, stop long")
    ranges = spark.createDataFrame([(1, 2**39, 2**39 + 5, 7), (1, 2**41, 2**42, 8), (2, 0, 2**45, 9)], "slot int, start long, stop long, entity int")
    assert [r.entity for r in lookups.overlapping(wanted, ranges, "slot", "entity").orderBy("slot", "start").collect()] == [7, 7, 9]


def test_sets_by_shared_tokens(spark):
    """A token of all sets gives one row for each; classes join through any shared token."""
    sets = {i: {f"t{i}", f"u{i // 2}"} | ({"hot"} if i < 20 else set()) for i in range(30)} | {40: {"alone"}, 41: set()}
    rows = [(i, t) for i, ts in sets.items() for t in ts] * 2 + [(None, "hot"), (5, None)]
    got = {(r.a, r.b): (r.common, r.similarity, r.class_id) for r in similarity.by_shared_tokens(spark.createDataFrame(rows, "id long, token string")).collect()}
    want = {}
    for token in {t for ts in sets.values() for t in ts}:
        held = sorted(i for i, ts in sets.items() if token in ts)
        for b in held[1:]:
            a = held[0]
            want[a, b] = (len(sets[a] & sets[b]), pytest.approx(len(sets[a] & sets[b]) / len(sets[a] | sets[b])), 0 if b < 20 else b - 1)
    assert got == want and len(got) == 19 + 9 + 5
