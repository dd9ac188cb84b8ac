"""Measures on a small graph, and class files written by hand."""

import io
import struct
import zipfile

import pytest

from kinweave.operators import measures
from kinweave.sources import classfile

ENTITY = "id string, name string, disguised boolean, flags int, signature string, depth int, siblings int"


def model(spark, side, disguised, edges, tokens):
    ids = sorted({e[i] for e in edges for i in (1, 2)} | {t[0] for t in tokens})
    rows = [(side + i, i, i in disguised, 1, None, 0, 0) for i in ids]
    return measures.Model(
        spark.createDataFrame(rows, ENTITY),
        spark.createDataFrame([(r, side + a, side + b) for r, a, b in edges], "rel string, src string, dst string"),
        spark.createDataFrame([(side + o, s, v) for o, s, v in tokens], "owner string, sort string, value string"),
    )


def test_weights_of_the_registry():
    sums = {kind: [measures.total(kind, level) for level in measures.LEVELS] for kind in measures.REGISTRY}
    assert sums == {"class": [93, 114, 124, 130], "method": [85, 85, 97, 103], "field": [59, 69, 69, 81], "variable": [23, 23, 23, 23]}
    assert [len(v) for v in measures.REGISTRY.values()] == [23, 17, 12, 4]


def test_measures_on_a_small_graph(spark):
    edges = [("extends", "c", "p"), ("implements", "c", "i"), ("implements", "c", "j"), ("method of", "m", "c"), ("calls", "m", "n")]
    a = model(spark, "a", {"c", "i", "m"}, edges, [("c", "string", "x"), ("c", "string", "y"), ("c", "int", "1")])
    b = model(spark, "b", {"c", "i", "m"}, [*edges[:2], *edges[3:], ("implements", "c", "k")], [("c", "string", "y")])
    pairs = spark.createDataFrame([("ac", "bc")], "a string, b string")
    matches = spark.createDataFrame([("ap", "bp"), ("ai", "bi")], "x string, y string")
    got = {}
    for d in measures.REGISTRY["class"]:
        found = measures.evaluate(d, pairs, a, b, matches)
        if found is not None:
            got[d.name] = found.first().similarity
    assert got["parent class"] == 1 and got["string constants"] == 0.5 and got["numeric constants"] == 0.75 and got["method count"] == 1
    assert got["interfaces"] == 0.5  # i is matched on both sides; j and k are plain names without a namesake
    assert got["outer class"] == 1 and got["method out references"] == 1 and got["class type check"] == 1
    row = measures.scored("class", "initial", pairs, a, b, matches).first()
    assert row.score + row.missed == pytest.approx(measures.total("class", "initial") - 10)  # similar methods need code


def test_unmatched_members_may_be_anything_disguised(spark):
    pairs = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "a long, b long")
    left = spark.createDataFrame([(1, "u", True, "u"), (1, "v", False, "v"), (2, "w", False, "w")], "a long, x string, disguised boolean, name string")
    right = spark.createDataFrame([(1, "r", False, "r"), (2, "s", False, "w"), (3, "t", True, "t")], "b long, y string, disguised boolean, name string")
    none = spark.createDataFrame([], "x string, y string")
    got = {r.a: r.similarity for r in measures.of_disguised_sets(pairs, left, right, none).collect()}
    assert got == {1: pytest.approx(2 / 3), 2: 1.0, 3: 0.0}


def tiny_class():
    """class T extends P implements I { static int f = 7; String g() { return "s"; } with a call of h() }"""
    utf = ["T", "P", "I", "f", "I", "ConstantValue", "g", "()Ljava/lang/String;", "Code", "s", "h", "()V", "long name é"]
    pool = b"".join(b"\x01" + struct.pack(">H", len(x.encode())) + x.encode() for x in utf)
    pool += b"\x07" + struct.pack(">H", 1) + b"\x07" + struct.pack(">H", 2) + b"\x07" + struct.pack(">H", 3)  # 14 T, 15 P, 16 I
    pool += b"\x03" + struct.pack(">i", 7) + b"\x08" + struct.pack(">H", 10)  # 17 int 7, 18 "s"
    pool += b"\x0c" + struct.pack(">HH", 11, 12) + b"\x0a" + struct.pack(">HH", 15, 19)  # 19 h()V, 20 P.h
    pool += b"\x05" + struct.pack(">q", 1 << 40)  # 21 takes two places
    code = bytes([184]) + struct.pack(">H", 20) + bytes([16, 251, 87, 20]) + struct.pack(">H", 21) + bytes([88, 18, 18, 176])
    attribute = struct.pack(">HI", 9, 12 + len(code)) + struct.pack(">HHI", 2, 1, len(code)) + code + struct.pack(">HH", 0, 0)
    body = struct.pack(">IHHH", 0xCAFEBABE, 0, 61, 23) + pool + struct.pack(">HHH", 0x21, 14, 15) + struct.pack(">HH", 1, 16)
    body += struct.pack(">HHHHH", 1, 9, 4, 5, 1) + struct.pack(">HIH", 6, 2, 17)
    return body + struct.pack(">HHHHH", 1, 1, 7, 8, 1) + attribute + struct.pack(">H", 0)


def test_class_files(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("T.class", tiny_class())
        z.writestr("bad.class", b"nothing")
        z.writestr("readme.txt", b"left out")
    (tmp_path / "a.jar").write_bytes(buffer.getvalue())
    rows = classfile.read(spark, f"file://{tmp_path}").drop("archive").collect()
    kinds = {}
    for r in rows:
        kinds.setdefault(r.kind, []).append(r)
    assert [(r.id, r.other, r.flags) for r in kinds["class"]] == [("T", "P", 0x21)] and [r.other for r in kinds["implements"]] == ["I"]
    assert [(r.id, r.other, r.flags) for r in kinds["field"]] == [("f;;I", "I", 9)] and [r.id for r in kinds["method"]] == ["g()Ljava/lang/String;"]
    assert [(r.owner, r.value) for r in kinds["int"]] == [("T/f;;I", "7"), ("T/g()Ljava/lang/String;", "-5")]
    assert [r.value for r in kinds["string"]] == ["s"] and [r.value for r in kinds["long"]] == [str(1 << 40)]
    assert [r.other for r in kinds["calls"]] == ["P/h()V"] and [r.flags for r in kinds["code"]] == [184, 16, 87, 20, 88, 18, 176]
    assert [r.id for r in kinds["rejected"]] == ["bad.class"]
