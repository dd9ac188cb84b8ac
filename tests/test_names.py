"""Name types, mapping files, class files' variables and storage scopes, on small inputs."""

import struct

import pytest
from pyspark.sql import functions as F

from kinweave.functions import descriptors
from kinweave.operators import cascade, equality, lookups, mapping
from kinweave.sources import classfile, extraction, mappingfile, matchfile
from kinweave.storage import fresh_path, scope, stored


def test_name_types_that_do_not_exist_are_errors():
    with pytest.raises(ValueError):
        cascade.with_plain(cascade.UID_PLAIN, False)
    with pytest.raises(ValueError):
        cascade.MAPPED_AUX2_PLAIN.space  # noqa: B018
    assert cascade.with_mapped(cascade.AUX2, True) == cascade.MAPPED_AUX2_PLAIN


def test_classes_nested_three_deep(spark):
    rows = [("a", None, "p/A", True, "x/New"), ("b", "a", "p/A$B", True, "Mid"), ("c", "b", "p/A$B$C", True, None), ("d", None, "p/D", False, None)]
    classes = spark.createDataFrame(rows, "id string, outer string, name string, disguised boolean, mapped string").withColumn("partner", F.lit(None).cast("string"))
    names = {r.id: r["full"] for r in cascade.class_names(classes, cascade.MAPPED_PLAIN).collect()}
    assert names == {"a": "x/New", "b": "x/New$Mid", "c": "x/New$Mid$C", "d": "p/D"}


def test_classes_nested_in_unknown_ones_and_in_themselves(spark):
    """These start with their own part; what is nested in them follows."""
    rows = [("b", "gone", "p/A$B", True, "Mid"), ("c", "b", "p/A$B$C", True, None), ("u", "v", "p/V$U", True, None), ("v", "u", "p/U$V", True, None), ("w", "v", "p/U$V$W", True, None), ("d", None, "p/D", False, None)]
    classes = spark.createDataFrame(rows, "id string, outer string, name string, disguised boolean, mapped string").withColumn("partner", F.lit(None).cast("string"))
    names = {r.id: r["full"] for r in cascade.class_names(classes, cascade.MAPPED_PLAIN).collect()}
    assert names == {"b": "Mid", "c": "Mid$C", "u": "U", "v": "V", "w": "W", "d": "p/D"}


def test_mapping_files_keep_what_they_hold(spark):
    text = ["tiny\t2\t0\tofficial\tinter\tnamed", "c\ta\tc1\tpkg/A", "\tc\tof the class\\nmore", "\tf\tI\tx\tf1\tcount", "\tm\t(I)V\ty\tm1\t", "\t\tp\t1\tz\t\tsize", "\t\tc\tof the method", "c\tb\t\t"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, line int, value string")
    got = [tuple(r)[2:] for r in mappingfile.parsed(lines, "official", "named").orderBy("line").collect()]
    assert got == [
        ("class", "a", None, None, None, "a", "pkg/A", None),
        ("comment", "a", None, None, None, None, None, "of the class\nmore"),
        ("field", "a", "I", "x", None, "x", "count", None),
        ("method", "a", "(I)V", "y", None, "y", "y", None),
        ("argument", "a", None, "y", 1, "z", "size", None),
        ("comment", "a", None, "y", None, None, None, "of the method"),
        ("class", "b", None, None, None, "b", "b", None),
    ]
    with pytest.raises(Exception, match="no name space other"):
        mappingfile.parsed(lines, "official", "other").collect()
    bad = lines.unionByName(spark.createDataFrame([("f", 99, "nonsense")], lines.schema))
    with pytest.raises(Exception, match="no mapping line"):
        mappingfile.parsed(bad, "official", "named").collect()


def test_export_once_for_each_hierarchy(spark):
    rows = [(1, 1, False, "a", ["n"]), (2, 1, True, "a", ["n"]), (3, 1, True, "a", ["n"]), (4, 2, False, "b", ["b"]), (5, 3, False, "c", ["d"])]
    methods = spark.createDataFrame(rows, "id int, grouped int, root boolean, src string, names array<string>").withColumns({"comment": F.lit(None).cast("string"), "n_variables": F.lit(0), "ord": F.col("id")})
    ids = lambda v: sorted(r.id for r in mapping.exported_methods(methods, v).collect())
    assert ids("minimal") == [2, 5] and ids("roots") == [2, 3, 5] and ids("full") == [1, 2, 3, 5]


def test_types_are_shown(spark):
    ids = ["I", "[[J", "La/b/C$D;", "[La/B;"]
    shown = spark.createDataFrame([(i,) for i in ids], "t string").select(descriptors.display(F.col("t")), descriptors.display(F.col("t"), False)).collect()
    assert [tuple(r) for r in shown] == [("int", "int"), ("long[][]", "long[][]"), ("a.b.C$D", "C$D"), ("a.B[]", "B[]")]


def test_arrays_of_matched_classes_need_potential_elements(spark):
    side = lambda rows: spark.createDataFrame(rows, "id string, name string, disguised boolean, matchable boolean, element string")
    a = side([("a", "n", True, True, None), ("b", "m", True, True, None), ("a[]", "", True, True, "a"), ("b[]", "", True, True, "b")])
    b = side([("x", "n", True, True, None), ("y", "m", True, True, None), ("x[]", "", True, True, "x"), ("y[]", "", True, True, "y")])
    pairs = spark.createDataFrame([("a[]", "x[]"), ("a[]", "y[]"), ("b[]", "y[]"), ("a", "x[]")], "a string, b string")
    found = equality.potential_classes(pairs, a, b, spark.createDataFrame([("a", "x")], "a string, b string"))
    assert {(r.a, r.b): r.potential for r in found.collect()} == {("a[]", "x[]"): True, ("a[]", "y[]"): False, ("b[]", "y[]"): True, ("a", "x[]"): False}


def test_variables_of_methods(spark):
    row = lambda kind, **v: tuple({"archive": "j", "kind": kind, **v}.get(c) for c in ("archive", "kind", "owner", "id", "name", "other", "flags", "value"))
    me, m = "C", "C/f(JLx/Y;)V"
    rows = [row("class", owner=None, id=me, name=me, other="java/lang/Object", flags=1), row("method", owner=me, id="f(JLx/Y;)V", name="f", other="(JLx/Y;)V", flags=9, value="0")]
    rows += [row("local", owner=m, id="0", name="first", other="J", flags=0, value="0"), row("local", owner=m, id="1", name="other", other="Lx/Y;", flags=2, value="0"), row("local", owner=m, id="2", name="i", other="I", flags=3, value="2")]
    rows += [row("code", owner=m, id="0", name="0", flags=22), row("code", owner=m, id="1", name="3", flags=54), row("code", owner=m, id="2", name="3", flags=21)]
    frame = spark.createDataFrame(rows, classfile.SCHEMA)
    model = extraction.extract(frame, plain_members=r"C/f\(.*", variables=True)
    got = {r.id: (r.kind, r.name, r.slot, r.ord, r.disguised) for r in model.entity.where("kind IN ('argument', 'variable')").collect()}
    assert got == {f"{m}/arg0": ("argument", "first", 0, 0, False), f"{m}/arg1": ("argument", "other", 2, 1, False), f"{m}/lv0": ("variable", "i", 3, 0, False)}
    uses = [(r.place, r.target) for r in model.seq.where("rel = 'uses'").orderBy("place").collect()]
    assert uses == [(0, f"{m}/arg0"), (1, f"{m}/lv0"), (2, f"{m}/lv0")]
    assert model.edge.where("rel = 'type'").select("src", "dst").collect() == [(f"{m}/arg1", "x/Y")]


def test_lambdas_are_calls_of_their_bodies(spark):
    from kinweave.operators.structure import LAMBDA_MAKERS, METAFACTORY

    row = lambda kind, **v: tuple({"archive": "j", "kind": kind, **v}.get(c) for c in ("archive", "kind", "owner", "id", "name", "other", "flags", "value"))
    rows = [row("class", id="C", name="C", other="java/lang/Object", flags=1)]
    rows += [row("method", owner="C", id=f"{n}()V", name=n, other="()V", flags=9, value="0") for n in ("f", "lam")]
    maker = f"{METAFACTORY}/metafactory{LAMBDA_MAKERS['metafactory']}"
    rows += [row("code", owner="C/f()V", id="0", name="C/lam()V", other=maker, flags=186, value="6 false"), row("code", owner="C/f()V", id="1", name="C/f()V", other="x/Y/make()V", flags=186, value="6 false")]
    model = extraction.extract(spark.createDataFrame(rows, classfile.SCHEMA))
    assert [tuple(r) for r in model.edge.where("rel = 'calls'").select("src", "dst").collect()] == [("C/f()V", "C/lam()V")]


def test_broken_archives_are_rejected(spark, tmp_path):
    (tmp_path / "x.jar").write_bytes(b"PK\x03\x04" + struct.pack(">I", 7) * 9)
    assert [r.kind for r in classfile.read(spark, f"file://{tmp_path}").collect()] == ["rejected"]


def test_at_or_after_in_one_large_slot(spark):
    n = 30_000
    wanted = spark.range(n).select(F.lit(1).alias("slot"), F.col("id").alias("at"))
    entries = spark.range(0, n, 7).select(F.lit(1).alias("slot"), F.col("id").alias("at"), F.col("id").alias("entity"))
    found = lookups.at_or_after(wanted, entries, "slot", "at", "entity")
    assert found.where("entity IS NULL OR entity < at OR entity - at >= 7").where("at <= 29995").count() == 0


def test_strict_match_files(spark, tmp_path):
    (tmp_path / "x").write_text("Matches saved\n\ta:\n\t\tone.jar\nc\tA\tB\n\tm\tx\ty\n")
    assert [r.tag for r in matchfile.read(spark, f"file://{tmp_path}/x", strict=True).orderBy("line").collect()] == ["c", "m"]
    (tmp_path / "x").write_text("Matches saved\nc\tA\tB\n\tm\tx\n")
    with pytest.raises(Exception, match="no line of a match file"):
        matchfile.read(spark, f"file://{tmp_path}/x", strict=True).collect()


def test_scopes_free_their_tables(spark):
    outside = fresh_path(spark, "kept")
    with scope(spark):
        inside = stored(spark.range(5), "inside")
        inside.write.parquet(outside)
    assert spark.read.parquet(outside).count() == 5
    spark.catalog.refreshByPath(inside.inputFiles()[0].rpartition("/")[0]) if inside.inputFiles() else None
    assert spark.read.parquet(outside).join(spark.range(9), "id").count() == 5


def test_scopes_leave_other_threads_tables_alone(spark):
    from threading import Thread

    held = []
    with scope(spark):
        inner = stored(spark.range(5), "inner")
        other = Thread(target=lambda: held.append(stored(spark.range(100), "other")))
        other.start()
        other.join()
        assert inner.count() == 5
    assert held[0].count() == 100 and spark.read.parquet(*inner.inputFiles()[0].rsplit("/", 1)[:1]).count() == 0
