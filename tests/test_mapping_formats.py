"""Mapping files of several formats, and lines of files that are read in ranges."""

import pytest
from pyspark.sql import functions as F

from kinweave.sources import lines, mappingformats

ROWS = "kind string, class string, descriptor string, member string, slot int, src string, dst string, comment string"
NAMES = [
    ("class", "p/A", None, None, None, "p/A", "q/Alpha", None),
    ("class", "p/A$B$C", None, None, None, "p/A$B$C", "q/Alpha$B$Gamma", None),
    ("field", "p/A", "[I", "f", None, "f", "count", None),
    ("method", "p/A", "(I)V", "m", None, "m", "run", None),
    ("method", "p/A", "()V", "m", None, "m", "stop", None),
    ("argument", "p/A", "(I)V", "m", 1, None, "times", None),
    ("comment", "p/A", "()V", "m", None, None, None, "two\nlines \\ and a tab\t."),
    ("comment", "p/A", None, None, None, None, None, "of the class"),
    ("method", "p/A$B$C", "(Lp/A;)J", "g", None, "g", "given", None),
]


def parsed(spark, form, text):
    rows = spark.createDataFrame([("x", i, v) for i, v in enumerate(text)], "file string, line long, value string")
    return [tuple(r)[2:] for r in mappingformats.FORMATS[form](rows).orderBy("line").collect()]


@pytest.mark.parametrize("form", ["tiny", "srg", "tsrg", "enigma"])
def test_written_and_read(spark, form, tmp_path):
    """What a format can tell comes back; an outer class without a name has a line of its own."""
    path = f"file://{tmp_path}/{form}"
    mappingformats.write(spark.createDataFrame(NAMES, ROWS), path, form)
    got = {tuple(r)[2:] for r in mappingformats.read(spark, path, form).collect()}
    want = {r for r in NAMES if form == "enigma" or r[0] in ("class", "field", "method")}
    if form in ("srg", "tsrg"):
        want = {r if r[0] != "field" else (*r[:2], None, *r[3:]) for r in want}
    if form == "enigma":
        want |= {("class", "p/A$B", None, None, None, "p/A$B", "p/A$B", None)}
        want = {r if r[1] != "p/A$B" else (*r[:6], "q/Alpha$B", None) for r in want}
    assert got == want


def test_lines_of_each_format(spark):
    none = None
    assert parsed(spark, "tiny", ["v1\ta\tb", "CLASS\tx\t", "METHOD\tx\t()V\tm\tn"]) == [("class", "x", none, none, none, "x", "x", none), ("method", "x", "()V", "m", none, "m", "n", none)]
    assert parsed(spark, "srg", ["PK: ./ p", "# no", "CL: p/x q/y", "MD: p/x/m ()V q/y/n ()V"]) == [("class", "p/x", none, none, none, "p/x", "q/y", none), ("method", "p/x", "()V", "m", none, "m", "n", none)]
    text = ["tsrg2 left right", "x y", "\tf g", "\th I i", "\tm (I)V n", "\t\tstatic", "\t\t0 o first", "z w", "\tf e"]
    assert parsed(spark, "tsrg", text) == [
        ("class", "x", none, none, none, "x", "y", none), ("field", "x", none, "f", none, "f", "g", none), ("field", "x", "I", "h", none, "h", "i", none), ("method", "x", "(I)V", "m", none, "m", "n", none),
        ("argument", "x", "(I)V", "m", 0, "o", "first", none), ("class", "z", none, none, none, "z", "w", none), ("field", "z", none, "f", none, "f", "e", none),
    ]
    text = ["CLASS a", "\tCOMMENT all", "\tCLASS b c", "\t\tMETHOD m ()V", "\t\t\tARG 0 it", "\t\tCLASS d", "\t\t\tFIELD f g I ACC:PUBLIC", "\tMETHOD k l ()V", "CLASS e"]
    assert parsed(spark, "enigma", text) == [
        ("class", "a", none, none, none, "a", "a", none), ("comment", "a", none, none, none, none, none, "all"), ("class", "a$b", none, none, none, "a$b", "a$c", none),
        ("method", "a$b", "()V", "m", none, "m", "m", none), ("argument", "a$b", "()V", "m", 0, none, "it", none), ("class", "a$b$d", none, none, none, "a$b$d", "a$c$d", none),
        ("field", "a$b$d", "I", "f", none, "f", "g", none), ("method", "a", "()V", "k", none, "k", "l", none), ("class", "e", none, none, none, "e", "e", none),
    ]
    text = ["# made", "p.A$B -> x:", "    int[] f -> a", "    1:2:p.C m(long,p.D[]) -> b", "    void <init>() -> <init>", "    3:3:void p.E.in() -> b"]
    assert parsed(spark, "proguard", text) == [
        ("class", "p/A$B", none, none, none, "p/A$B", "x", none), ("field", "p/A$B", "[I", "f", none, "f", "a", none), ("method", "p/A$B", "(J[Lp/D;)Lp/C;", "m", none, "m", "b", none),
        ("method", "p/A$B", "()V", "<init>", none, "<init>", "<init>", none),
    ]


@pytest.mark.parametrize("form", list(mappingformats.FORMATS))
def test_strays_and_empty_files(spark, form):
    assert parsed(spark, form, ["", "# "]) == []
    with pytest.raises(Exception, match="no mapping line"):
        parsed(spark, form, ["\t\tnothing"])


def test_lines_in_ranges(spark, tmp_path):
    """Lines keep their numbers when a file is read in many ranges; line ends of both kinds, and no line at all."""
    (tmp_path / "a.txt").write_bytes(b"".join(f"line {i}{'x' * (i % 50)}".encode() + (b"\r\n" if i % 2 else b"\n") for i in range(5000)))
    (tmp_path / "b.txt").write_bytes(b"only")
    (tmp_path / "c.txt").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = lines.numbered(spark, f"file://{tmp_path}")
        got = rows.withColumn("file", F.substring_index("file", "/", -1)).collect()
        assert rows.select("file").distinct().count() == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.line, r.value) for r in got if r.file == "a.txt") == [(i, f"line {i}{'x' * (i % 50)}") for i in range(5000)]
    assert [(r.line, r.value) for r in got if r.file == "b.txt"] == [(0, "only")]


def test_values_are_carried_over_blocks(spark):
    rows = spark.createDataFrame([(f, i, f"{f}{i}") for f in "pq" for i in range(40)], "file string, line long, value string")
    found = lines.carried(rows, {"last": F.when((F.col("line") % 13 == 5) & (F.col("file") == "p"), F.col("value"))}, block=4)
    for r in found.collect():
        at = max((i for i in range(r.line + 1) if i % 13 == 5), default=None)
        assert r.last == (f"p{at}" if r.file == "p" and at is not None else None)


def test_values_are_carried_over_blocks_without_gaps(spark):
    """The same with and without pairs of condition and value; blocks without any value pass on what came before, what is left out by ``made`` gives nothing."""
    rows = spark.createDataFrame([(f, i, str(i)) for f in "pq" for i in range(60)], "file string, line long, value string")
    here = (F.col("line") % 23 == 5) & (F.col("file") == "p")
    made = lambda rows: rows.where("line NOT BETWEEN 30 AND 40").withColumn("twice", F.concat("value", "value"))
    for last in ((here, F.col("twice")), F.when(here, F.col("twice"))):
        found = {(r.file, r.line): r["last"] for r in lines.carried(rows, {"last": last}, block=4, made=made, gaps=False).collect()}
        want = {("p", i): next((f"{j}{j}" for j in range(i, -1, -1) if j % 23 == 5), None) for i in range(60)} | {("q", i): None for i in range(60)}
        assert found == {k: v for k, v in want.items() if not 30 <= k[1] <= 40}


def test_lines_of_a_range_are_never_shuffled_to_their_range(spark, tmp_path):
    """Only names of classes meet others before lines are written, and only in the format that needs them; numbers come to lines without a shuffle of these."""
    (tmp_path / "x").write_text("a b\n\tf g\n" * 20)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "SortMergeJoin" not in lines.numbered(spark, f"file://{tmp_path}")._jdf.queryExecution().executedPlan().toString()
        names = spark.createDataFrame(NAMES, ROWS)
        joined = {form: "Join" in mappingformats.written(names, form)._jdf.queryExecution().executedPlan().toString() for form in ("tiny", "srg", "tsrg")}
        assert joined == {"tiny": False, "srg": True, "tsrg": False}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
