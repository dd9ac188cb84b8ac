"""Signatures, resolution of members, and the journal of matches, against plain versions."""

import random

import pytest

from kinweave.operators import journal, lookups, measures, signatures
from kinweave.sources import classfile, extraction


def plain_equal(a, b, same):
    """Asymmetric equality of parsed trees, node by node from the root."""
    left, right = ({p: (label, c) for p, label, c in nodes} for nodes in (a, b))

    def walk(path):
        label, known = left[path]
        if path not in right:
            return False
        if label == "T":
            return True
        if label != right[path][0] or (known is not None and not same(known, right[path][1])):
            return False
        return all(walk(p) for p in left if p != path and parent(p) == path)

    def parent(path):
        above = [p for p in left if path.startswith(f"{p}." if p else "") and p != path]
        return max(above, key=len, default=None)

    return walk("t" if "t" in left else "")


TEXTS = {
    "class": ["Ljava/lang/Object;", "<K:Ljava/lang/Object;V::Ljava/util/List<TK;>;:Lx/I;>Lx/P<TK;>;Lx/I;", "<Q:Ljava/lang/Object;R::Ljava/util/List<TQ;>;:Lx/I;>Lx/P<TQ;>;Lx/I;", "<K:>Lx/P<*>;", "Lx/P<*>;Lx/I;Lx/J;", "Lx/P<-TK;>.In<[I>.Deep;", "Lx/P<-TK;>.Other<[I>.Name;"],
    "method": ["()V", "<T:Ljava/lang/Object;>(TT;I)Lx/P<TT;>;^Lx/E;^TT;", "<U:Ljava/lang/Object;>(Lx/P<*>;I)Lx/P<TU;>;^Lx/E;^TU;", "(TT;[[J)V", "([TT;[[J)V", "(+)"],
    "field": ["TT;", "Lx/P<+Lx/A;>;", "Lx/P<+TT;>;", "Lx/P<Lx/A;>;", "[Lx/P<*>;", "[TT;", "Lx/P<", "Lx/P;"],
}


def test_signatures_are_read():
    assert signatures.nodes_of("Lx/P<-TK;>.In<[I>;", "field") == [("t", "L 1 1", "x/P"), ("t.a.0", "-", None), ("t.a.0.t", "T", None), ("t.s.0", ". 1", None), ("t.s.0.a.0", "=", None), ("t.s.0.a.0.t", "[", None), ("t.s.0.a.0.t.e", "I", None)]
    assert {(p, n) for p, n, _ in signatures.nodes_of("<K::Lx/I;>(TK;)V^Lx/E;", "method")} == {("", "method 1 1 1"), ("p.0", "P - 1"), ("p.0.i.0", "L - 0"), ("a.0", "T"), ("r", "V"), ("x.0", "L - 0")}
    assert signatures.nodes_of("Lx/P<", "field") == [("", "? Lx/P<", None)]


def test_signatures_equal_a_walk_of_the_trees(spark):
    """All pairs of texts of one kind; two classes of the left side are disguised, and one is matched with another name."""
    keys, disguised = {"x/A": "y/A", "y/A": "y/A"}, {"x/E"}
    same = lambda x, y: keys.get(x) == keys.get(y) if x in keys or y in keys else x in disguised or x == y
    ids = [(f"{kind}{i}", kind, t) for kind, texts in TEXTS.items() for i, t in enumerate(texts)]
    changed = lambda t: t.replace("x/A", "y/A").replace("x/E", "z/F")
    nodes = {i: signatures.nodes_of(t, k) for i, k, t in ids}
    others = {i: signatures.nodes_of(changed(t), k) for i, k, t in ids}
    told = lambda trees: [(i, p, label, keys.get(c), c, c in disguised) for i, ns in trees.items() for p, label, c in ns]
    left = spark.createDataFrame(told(nodes), "a string, path string, label string, key string, name string, disguised boolean")
    right = spark.createDataFrame(told(others), "b string, path string, label string, key string, name string, disguised boolean")
    pairs = [(i, j) for i, k, _ in ids for j, m, _ in ids if k == m]
    got = {(r.a, r.b): r.similarity == 1 for r in signatures.could_be(spark.createDataFrame(pairs, "a string, b string"), left, right).collect()}
    want = {(i, j): plain_equal(nodes[i], others[j], same) for i, j in pairs}
    assert got == want and 20 < sum(want.values()) < len(want)
    # a variable could be an array, not the other way round
    assert got["field0", "field5"] and not got["field5", "field0"]
    read = {tuple(r) for r in signatures.trees(spark.createDataFrame(ids, "owner string, kind string, text string")).collect()}
    assert read == {(i, *n) for i, ns in nodes.items() for n in ns}


def test_measure_of_signatures(spark):
    def side(text, prefix, *names):
        rows = [("x.jar", "class", None, n, n, "java/lang/Object", 1, None) for n in names] + [("x.jar", "signature", names[0], None, None, None, None, text)]
        return extraction.extract(spark.createDataFrame(rows, classfile.SCHEMA), prefix=prefix)

    a, b = side("Ljava/util/List<LH;>;", "a:", "A", "H"), side("Ljava/util/List<LZ;>;", "b:", "Q", "Z")
    declared = next(d for d in measures.REGISTRY["class"] if d.name == "signature")
    pairs = spark.createDataFrame([("a:A", "b:Q"), ("a:H", "b:Z"), ("a:A", "b:Z")], "a string, b string")
    none, other = spark.createDataFrame([], "x string, y string"), spark.createDataFrame([("a:H", "b:Q")], "x string, y string")
    score = lambda matches: {(r.a, r.b): r.similarity for r in measures.evaluate(declared, pairs, a, b, matches).collect()}
    assert score(none) == {("a:A", "b:Q"): 1, ("a:H", "b:Z"): 1, ("a:A", "b:Z"): 0} and score(other)["a:A", "b:Q"] == 0


WAYS = "sub string, sup string, distance int"


def test_methods_of_diamonds(spark):
    """C extends P; P implements I and J, which both extend K; L extends I."""
    classes = spark.createDataFrame([("C", "C", 0), ("C", "P", 1), ("P", "P", 0), ("I", "I", 0), ("M", "M", 0), ("L", "L", 0), ("L", "O", 1)], WAYS)
    above = {"C": "IJK", "P": "IJK", "I": "K", "J": "K", "L": "IK"}
    faces = spark.createDataFrame([(s, t) for s, ts in above.items() for t in ts], "sub string, sup string")
    row = lambda owner, name, abstract=True, private=False, static=False, public=True: (owner, name, f"{owner}.{name}", abstract, private, static, public)
    members = [
        row("K", "up"), row("I", "up"), row("J", "other"), row("K", "two", False), row("I", "two"), row("J", "two"), row("I", "low", False), row("J", "low", False), row("P", "mine", False), row("I", "mine", False),
        row("I", "hid", False, private=True), row("K", "hid"), row("I", "st", False, static=True), row("O", "toString", False), row("O", "clone", False, public=False), row("M", "invoke(x)", False), row("C", "up2"),
    ]
    members = spark.createDataFrame(members, "owner string, name string, member string, abstract boolean, private boolean, static boolean, public boolean")
    handles = spark.createDataFrame([("M", "invoke(y)", "M.invoke")], "owner string, name string, member string")
    want = {
        ("C", "up", False): "I.up", ("C", "other", False): "J.other", ("C", "two", False): "K.two", ("C", "low", False): "I.low", ("C", "mine", False): "P.mine", ("C", "hid", False): "K.hid", ("C", "st", False): None,
        ("L", "toString", True): "O.toString", ("L", "clone", True): None, ("L", "up", True): "I.up", ("M", "invoke(y)", False): "M.invoke", ("C", "none", False): None, ("C", "up2", False): "C.up2", ("I", "up", True): "I.up",
    }
    wanted = spark.createDataFrame([*want, ("C", "up", False)], "owner string, name string, faced boolean")
    got = lookups.specific_methods(wanted, classes, faces, members, handles).collect()
    assert {(r.owner, r.name, r.faced): r.member for r in got} == want and len(got) == len(want) + 1


def plain_field(owner, name, faces, parent, fields):
    if (owner, name) in fields:
        return f"{owner}.{name}"
    todo = list(faces.get(owner, []))
    while todo:
        at = todo.pop(0)
        if (at, name) in fields:
            return f"{at}.{name}"
        for face in faces.get(at, []):
            todo.insert(0, face)
    while owner := parent.get(owner):
        if (owner, name) in fields:
            return f"{owner}.{name}"
    return None


def test_fields_by_a_search_in_depth(spark):
    rng = random.Random(8)
    faces = {f"i{i}": [f"i{j}" for j in rng.sample(range(i), min(i, rng.randrange(4)))] for i in range(12)}
    parent = {f"c{i}": f"c{i - 1}" for i in range(1, 5)}
    faces |= {f"c{i}": [f"i{j}" for j in rng.sample(range(12), rng.randrange(4))] for i in range(5)}
    fields = {(o, f"f{rng.randrange(6)}") for o in faces for _ in range(rng.randrange(2))}
    ways = [(f"c{i}", f"c{j}", i - j) for i in range(5) for j in range(i + 1)] + [(f, f, 0) for f in faces if f[0] == "i"]
    paths = lookups.interface_paths(spark.createDataFrame([(s, t, n) for s, ts in faces.items() for n, t in enumerate(ts)], "sub string, sup string, ord int"))
    wanted = [(o, f"f{k}") for o in faces for k in range(6)]
    got = lookups.resolved_fields(spark.createDataFrame(wanted, "owner string, name string"), spark.createDataFrame(ways, WAYS), paths, spark.createDataFrame([(*f, ".".join(f)) for f in fields], "owner string, name string, member string"))
    want = {(o, n): plain_field(o, n, faces, parent, fields) for o, n in wanted}
    assert {(r.owner, r.name): r.member for r in got.collect()} == want and len({v for v in want.values() if v}) > 5


def pairs_of(spark, *pairs):
    return spark.createDataFrame(list(pairs), "a string, b string")


def state(rows, time=None):
    return {(r.a, r.b) for r in journal.state_at(rows, time).collect()}


def test_journal_of_matches(spark):
    loaded = [("c1", "d1"), ("m1", "n1"), ("v1", "w1"), ("c2", "d2"), ("c9", "d9")]
    rows = journal.started(spark, pairs_of(spark, *loaded))
    assert state(rows) == set(loaded)
    # a new match undoes those of its ends
    rows = rows.unionByName(journal.matched(rows, pairs_of(spark, ("c2", "d9"), ("c1", "d1")), 1))
    assert state(rows) == {*loaded[:3], ("c2", "d9")} and rows.where("time = 1 AND kind = 'unmatch' AND cause = 'c2'").count() == 2
    # class, method, variable, the method's hierarchy and an array go together; what isn't matched stops it
    follows = spark.createDataFrame([("c1", "m1"), ("m1", "v1"), ("m1", "h1"), ("h1", "m2"), ("c1", "[c1"), ("[c1", "c1")], "a string, then string")
    rows = rows.unionByName(journal.matched(rows, pairs_of(spark, ("m2", "n2"), ("[c1", "[d1")), 2))
    rows = rows.unionByName(journal.unmatched(rows, spark.createDataFrame([("c1",), ("unknown",)], "a string"), follows, 3))
    assert state(rows) == {("c2", "d9"), ("m2", "n2")}
    assert {(r.a, r.cause) for r in rows.where("time = 3").collect()} == {("c1", None), ("m1", "c1"), ("[c1", "c1"), ("v1", "m1")}
    # a change can be undone, and the past is still there
    rows = rows.unionByName(journal.undone(rows, 3, 4))
    assert state(rows) == state(rows, 2) and state(rows, 0) == set(loaded)
    # a reset to a file's matches is a fresh start with them
    again = rows.unionByName(journal.reset(rows, 5, pairs_of(spark, *loaded)))
    assert state(again) == state(journal.started(spark, pairs_of(spark, *loaded))) and state(rows.unionByName(journal.reset(rows, 5))) == set()
    assert [(r.time, r.kind) for r in journal.history(again).where("a = 'c2'").orderBy("place").collect()] == [(0, "load"), (1, "unmatch"), (1, "match"), (5, "load")]
    assert state(journal.started(spark)) == set()


def test_a_match_undone_and_made_at_one_time_stands(spark):
    rows = spark.createDataFrame([(1, "match", "a", "b", None), (1, "unmatch", "a", "b", None), (1, "match", "a", "b", None), (2, "unmatch", "c", "d", None)], journal.ENTRY)
    assert state(rows) == {("a", "b")}


@pytest.mark.parametrize("n", [1, 40])
def test_cascade_of_a_long_chain(spark, n):
    follows = spark.createDataFrame([(f"x{i}", f"x{i + 1}") for i in range(n)], "a string, then string")
    assert journal.cascade(spark.createDataFrame([("x0",)], "a string"), follows).count() == n + 1
