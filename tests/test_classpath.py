"""Class paths: an index of entries, classes read on demand, and the order of inputs."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from kinweave.operators import measures
from kinweave.sources import classfile, classpath, extraction


def tiny(name, parent, faces=(), field=None, flags=0x21):
    """Bytes of a class with a parent, interfaces, and maybe a field of a class."""
    names = [name, parent, *faces, *([f"L{field};", "f"] if field else [])]
    pool = b"".join(b"\x01" + struct.pack(">H", len(n.encode())) + n.encode() for n in names)
    refs = 2 + len(faces)
    pool += b"".join(b"\x07" + struct.pack(">H", i + 1) for i in range(refs))
    at = lambda i: len(names) + 1 + i
    body = struct.pack(">IHHH", 0xCAFEBABE, 0, 61, len(names) + refs + 1) + pool + struct.pack(">HHH", flags, at(0), at(1))
    body += struct.pack(">H", len(faces)) + b"".join(struct.pack(">H", at(2 + i)) for i in range(len(faces)))
    body += struct.pack(">HHHHH", 1, 2, len(names), len(names) - 1, 0) if field else struct.pack(">H", 0)
    return body + struct.pack(">HH", 0, 0)


def jar(path, *classes, broken=()):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for c in classes:
            z.writestr(f"{c[0]}.class", tiny(*c))
        for name in broken:
            z.writestr(f"{name}.class", b"not a class")
    path.write_bytes(buffer.getvalue())
    return f"file:{path}"


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    at = tmp_path_factory.mktemp("jars")
    lib = [("p/Base", "p/Root", ("p/Face",)), ("p/Root", "java/lang/Object"), ("p/Face", "java/lang/Object", ("p/Upper",)), ("p/Upper", "java/lang/Object"), ("p/Held", "p/Root"), *[(f"u/Unused{i}", "u/Unused0") for i in range(30)]]
    second = jar(at / "a-second.jar", ("p/Base", "p/Other"), ("p/Other", "java/lang/Object"), ("q/Late", "p/Held"))
    return {"app": jar(at / "app.jar", ("A", "p/Base", (), "q/Late"), ("B", "A")), "lib": jar(at / "z-first.jar", *lib, broken=["p/Broken"]), "second": second, "dir": at}


def test_only_the_closure_is_read(spark, paths):
    rows = classfile.read(spark, paths["app"])
    entries = classpath.index(spark, [paths["lib"], paths["second"]])
    assert entries.count() == 36 + 3 and entries.where("class = 'p/Base'").count() == 2
    found = classpath.catch_up(spark, rows, entries)
    got = {(r.id, r.archive.rsplit("/", 1)[1]) for r in found.where("kind = 'class'").collect()}
    # p/Base is the first input's, so p/Other, which only the second one's names, isn't needed
    assert got == {(f"p/{n}", "z-first.jar") for n in ("Base", "Root", "Face", "Upper", "Held")} | {("q/Late", "a-second.jar")}
    assert found.where("kind = 'rejected'").isEmpty()
    assert classpath.catch_up(spark, rows.where("id = 'nothing'"), entries).isEmpty()
    other = classpath.catch_up(spark, rows, classpath.index(spark, [paths["second"], paths["lib"]]))
    assert other.where("id = 'p/Other'").count() == 1 and other.where("id = 'p/Face'").isEmpty()


def test_a_broken_entry_is_rejected(spark, paths):
    wanted = classpath.index(spark, [paths["lib"]]).where("class IN ('p/Broken', 'p/Root')")
    assert sorted((r.kind, r.id) for r in classpath.read_entries(spark, wanted).collect()) == [("class", "p/Root"), ("rejected", "p/Broken.class")]


def test_a_models_path_is_given(spark, paths):
    rows = classfile.read(spark, paths["app"])
    path = classpath.catch_up(spark, rows, classpath.index(spark, [paths["lib"], paths["second"]]))
    model = extraction.extract(rows, prefix="a:", path=path)
    entity = {r.id: r for r in model.entity.collect()}
    assert entity["a:A"].disguised and entity["a:A"].depth == 3 and not entity["a:p/Base"].disguised and entity["a:p/Root"].kind == "class"
    assert entity["a:java/lang/Object"].kind == "placeholder" and "a:u/Unused0" not in entity
    assert model.edge.where("rel = 'implements' AND src = 'a:p/Base' AND dst = 'a:p/Face'").count() == 1


def test_the_first_input_wins_by_its_place(spark, paths):
    rows = classfile.read(spark, f"file:{paths['dir']}")
    by_name = extraction.first_wins(rows).where("kind = 'class' AND id = 'p/Base'").first()
    by_place = extraction.first_wins(rows, [paths["lib"], paths["second"]]).where("kind = 'class' AND id = 'p/Base'").first()
    assert by_name.archive.endswith("a-second.jar") and by_place.archive.endswith("z-first.jar")
    assert by_place.archive == rows.where("id = 'p/Root'").first().archive


def test_stages_lose_no_pair_within_the_limit(spark):
    """Scores by stages equal whole scores for all pairs that miss less than the limit."""
    entity = "id string, kind string, name string, disguised boolean, flags int, signature string, depth int, siblings int"

    def side(p):
        rows = [(f"{p}{i}", "class", f"n{i}", i % 2 == 0, (0, 0x200, 0x600)[i % 3], None, i % 4, i % 5) for i in range(12)]
        tokens = [(f"{p}{i}", "string", f"s{j}") for i in range(12) for j in range(i % 4)]
        edges = [("extends", f"{p}{i}", f"{p}{i // 2}") for i in range(1, 12)] + [("implements", f"{p}{i}", f"{p}{i // 3}") for i in range(1, 12)]
        return measures.Model(spark.createDataFrame(rows, entity), spark.createDataFrame(edges, "rel string, src string, dst string"), spark.createDataFrame(tokens, "owner string, sort string, value string"))

    a, b = side("a"), side("b")
    pairs = spark.createDataFrame([(f"a{i}", f"b{j}") for i in range(12) for j in range(12)], "a string, b string")
    matches = spark.createDataFrame([("a0", "b0"), ("a5", "b5")], "x string, y string")
    whole = {(r.a, r.b): (r.score, r.missed) for r in measures.scored("class", "initial", pairs, a, b, matches).collect()}
    staged = {(r.a, r.b): (r.score, r.missed) for r in measures.scored("class", "initial", pairs, a, b, matches, limit=11.0).where(F.col("missed") < 11.0).collect()}
    want = {k: pytest.approx(v, abs=1e-8) for k, v in whole.items() if v[1] < 11}
    assert staged == want and 12 <= len(want) < len(whole) / 2


def test_references_are_resolved_as_by_the_virtual_machine(spark):
    """C implements I and J, J extends K; D extends C. A handle's call has any descriptor."""
    row = lambda kind, own=None, i=None, name=None, other=None, flags=None, value=None: ("x.jar", kind, own, i, name, other, flags, value)
    method = lambda own, name, desc="()V", flags=1: row("method", own, name + desc, name, desc, flags, "0")
    field = lambda own, name: row("field", own, f"{name};;I", name, "I", 9, "0")
    obj, handle = "java/lang/Object", "java/lang/invoke/MethodHandle"
    rows = [row("class", None, n, n, p, f) for n, p, f in (("C", obj, 1), ("D", "C", 1), ("I", obj, 0x600), ("J", obj, 0x600), ("K", obj, 0x600), (obj, None, 1), (handle, obj, 1))]
    rows += [row("implements", "C", "0", other="I"), row("implements", "C", "1", other="J"), row("implements", "J", "0", other="K")]
    rows += [method("I", "m", flags=0x401), method("K", "m"), method("J", "n", flags=0x401), method("K", "n", flags=0x401), method(obj, "hash"), method(obj, "clone", flags=4), method("D", "use"), method(handle, "invoke", "([Ljava/lang/Object;)Ljava/lang/Object;", 0x181)]
    rows += [field("K", "f"), field("I", "f"), field("C", "g"), field("I", "g"), field(obj, "h"), field("J", "h")]
    calls = {"D/m()V": "K/m()V", "D/n()V": "J/n()V", "I/hash()V": f"{obj}/hash()V", "I/clone()V": "I/clone()V", f"{handle}/invoke(I)J": f"{handle}/invoke([Ljava/lang/Object;)Ljava/lang/Object;", "Z/m()V": "Z/m()V"}
    reads = {"C/f;;I": "I/f;;I", "C/g;;I": "C/g;;I", "D/g;;I": "C/g;;I", "C/h;;I": "J/h;;I", "D/h;;I": f"{obj}/h;;I"}
    rows += [row("calls", "D/use()V", other=o) for o in calls] + [row("reads", "D/use()V", other=o) for o in reads]
    model = extraction.extract(spark.createDataFrame(rows, classfile.SCHEMA))
    got = {(r.rel, r.dst) for r in model.edge.where("src = 'D/use()V' AND rel IN ('calls', 'reads')").collect()}
    assert got == {("calls", t) for t in calls.values()} | {("reads", t) for t in reads.values()}
