"""Queries about mapping rows and files, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators import mapping
from kinweave.sources import mappingfile, mappingformats, matchfile
from kinweave.storage import fresh_path, stored, tasks_for

from .tables import table

# Expressions that make the inputs; they serve both the queries and their SQL.
DST = "CASE WHEN l_tax < 0.02 THEN 'pkg/Out$In' || l_orderkey WHEN l_tax < 0.04 THEN 'class_' || l_orderkey WHEN l_tax < 0.06 THEN 'x/C$class_' || l_orderkey ELSE 'pkg/C' || l_orderkey END"
CLASS = {"src": "p_partkey", "mapped": "CASE WHEN p_size > 30 THEN p_name END", "known": "CASE WHEN p_size < 10 THEN p_type END", "uid": "CASE WHEN p_size > 20 THEN p_partkey ELSE -1 END"}
ROW = {"src": "l_partkey", "line": "l_orderkey * 8 + l_linenumber", "dst": DST}
MEMBER = {"id": "o_orderkey", "grouped": "o_custkey", "mapped": "CASE WHEN o_totalprice > 400000 THEN 'had' || o_orderpriority END"}
MEMBER_ROW = {"id": "l_orderkey", "line": "l_suppkey * 1000000 + l_orderkey * 8 + l_linenumber", "dst": "CASE WHEN l_discount > 0.07 THEN 'new' || l_suppkey END"}


def made(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    return frame.select(*[F.expr(e).alias(c) for c, e in columns.items()])


def sql_of(columns: dict[str, str], source: str) -> str:
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source}"


def mapping_classes(spark, sf_dir):
    """Names from lines for parts: those that have none, or all of them; and ids, of which the smaller one counts."""
    classes, rows = made(table(spark, sf_dir, "part"), CLASS), made(table(spark, sf_dir, "lineitem"), ROW)
    # several lines may have one place, so the smallest name of a place is its name
    rows = rows.groupBy("src", "line").agg(F.min("dst").alias("dst"))
    kept, replaced = (mapping.named_classes(classes, rows, replace=r).select("src", F.col("mapped").alias(n)) for r, n in ((False, "kept"), (True, "replaced")))
    numbers = mapping.numbered_classes(classes, rows, "class_").select("src", "uid")
    return kept.join(replaced, "src").join(numbers, "src")


MAPPING_CLASSES = f"""WITH c AS ({sql_of(CLASS, "part")}), r AS (SELECT src, line, min(dst) AS dst FROM ({sql_of(ROW, "lineitem")}) GROUP BY ALL),
n AS (SELECT src, line, CASE WHEN contains(dst, '$') THEN string_split(dst, '$')[-1] ELSE dst END AS name, CASE WHEN contains(dst, '$') THEN string_split(dst, '$')[-1] ELSE dst END AS tail FROM r),
g AS (SELECT src, arg_min(name, line) AS first, arg_max(name, line) AS last, min(CASE WHEN regexp_full_match(tail, 'class_[0-9]+') THEN substr(tail, 7)::BIGINT END) AS uid FROM n GROUP BY 1)
SELECT c.src, CASE WHEN mapped IS NULL AND known IS NULL THEN coalesce(first, mapped) ELSE mapped END AS kept, coalesce(last, mapped) AS replaced,
 CASE WHEN g.uid IS NOT NULL AND (c.uid < 0 OR c.uid > g.uid) THEN g.uid ELSE c.uid END AS uid FROM c LEFT JOIN g USING (src)"""


def mapping_members(spark, sf_dir):
    """Names from lines for orders, which go to all orders of the customer."""
    members = made(table(spark, sf_dir, "orders"), MEMBER)
    rows = made(table(spark, sf_dir, "lineitem"), MEMBER_ROW).groupBy("id", "line").agg(F.min("dst").alias("dst"))
    kept, replaced = (mapping.named_members(members, rows, replace=r).select("id", F.col("mapped").alias(n)) for r, n in ((False, "kept"), (True, "replaced")))
    return kept.join(replaced, "id")


MAPPING_MEMBERS = f"""WITH m AS ({sql_of(MEMBER, "orders")}), r AS (SELECT id, line, min(dst) AS dst FROM ({sql_of(MEMBER_ROW, "lineitem")}) GROUP BY ALL),
g AS (SELECT grouped, arg_min(dst, line) AS first, arg_max(dst, line) AS last FROM r JOIN m USING (id) WHERE dst IS NOT NULL GROUP BY 1), h AS (SELECT grouped, count(mapped) AS k FROM m GROUP BY 1)
SELECT id, CASE WHEN k = 0 THEN coalesce(first, mapped) ELSE mapped END AS kept, coalesce(last, mapped) AS replaced FROM m LEFT JOIN g USING (grouped) JOIN h USING (grouped)"""

STAT = {"kind": "event_type", "dst": "CASE WHEN value > 20 THEN 'n' || event_id END", "comment": "CASE WHEN value > 50 THEN props END"}


def mapping_statistics(spark, sf_dir):
    return mapping.statistics(made(table(spark, sf_dir, "events"), STAT))


MAPPING_STATISTICS = f"SELECT kind, count(dst) AS n_names, count(comment) AS n_comments FROM ({sql_of(STAT, 'events')}) GROUP BY 1"


def mapping_clear(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("mapped"), F.col("p_brand").alias("aux"), F.col("p_type").alias("comment"))
    return mapping.cleared(p)


MAPPING_CLEAR = "SELECT p_partkey AS id, NULL::VARCHAR AS mapped, p_brand AS aux, NULL::VARCHAR AS comment FROM part"

PAIR = {
    "id": "o_orderkey",
    "field_disguised": "o_totalprice < 250000",
    "field_mapped": "CASE WHEN o_orderpriority < '3' THEN 'f' || o_custkey END",
    "field_full": "CASE WHEN o_orderpriority < '3' THEN 'f' || o_custkey ELSE 'x' || o_orderstatus END",
    "method_disguised": "o_orderstatus <> 'O'",
    "method_mapped": "CASE WHEN o_orderpriority > '2' THEN 'm' || o_custkey END",
    "method_full": "CASE WHEN o_orderpriority > '2' THEN 'm' || o_custkey ELSE 'x' || o_orderstatus END",
}


def record_names(spark, sf_dir):
    return mapping.record_names(made(table(spark, sf_dir, "orders"), PAIR)).select("id", "field_mapped", "method_mapped")


RECORD_NAMES = f"""WITH p AS (SELECT *, field_full <> method_full AND (field_disguised OR method_disguised) AS differ FROM ({sql_of(PAIR, "orders")})),
q AS (SELECT *, differ AND method_disguised AND (NOT field_disguised OR method_mapped IS NULL OR field_mapped IS NOT NULL) AS down FROM p)
SELECT id, CASE WHEN differ AND NOT down THEN method_full ELSE field_mapped END AS field_mapped, CASE WHEN down THEN field_full ELSE method_mapped END AS method_mapped FROM q"""

ARGUMENT = {"id": "event_id", "grouped": "user_id", "index": "CAST(floor(value / 10) AS INT)", "mapped": "CASE WHEN event_type = 'click' THEN 'arg' || event_id END"}


def propagate_arguments(spark, sf_dir):
    return mapping.propagated_arguments(made(table(spark, sf_dir, "events"), ARGUMENT)).select("id", "mapped")


PROPAGATE_ARGUMENTS = f"""WITH a AS ({sql_of(ARGUMENT, "events")}), f AS (SELECT grouped, index, arg_min(mapped, id) AS first FROM a WHERE mapped IS NOT NULL GROUP BY 1, 2)
SELECT id, coalesce(mapped, first) AS mapped FROM a LEFT JOIN f USING (grouped, index)"""

METHOD = {
    "id": "o_orderkey",
    "grouped": "o_custkey",
    "root": "o_orderstatus <> 'P'",
    "src": "CASE WHEN o_totalprice > 5000 THEN 'm' || o_orderstatus END",
    "first_name": "CASE WHEN o_orderpriority < '4' THEN 'm' || CASE WHEN o_totalprice > 300000 THEN 'F' ELSE 'O' END END",
    "second_name": "CASE WHEN o_orderpriority < '3' THEN 'n' || o_custkey END",
    "comment": "CASE WHEN o_totalprice > 450000 THEN o_orderpriority END",
    "n_variables": "CASE WHEN o_totalprice > 440000 THEN 1 ELSE 0 END",
    "ord": "o_orderkey",
}


def export_methods(spark, sf_dir):
    """Orders as methods of their customers, as far as each verbosity writes them."""
    methods = made(table(spark, sf_dir, "orders"), METHOD).withColumn("names", F.array("first_name", "second_name")).drop("first_name", "second_name")
    rows = None
    for verbosity in ("minimal", "roots", "full"):
        found = mapping.exported_methods(methods, verbosity).select(F.lit(verbosity).alias("verbosity"), "id")
        rows = found if rows is None else rows.unionByName(found)
    return rows


EXPORT_METHODS = f"""WITH m AS (SELECT *, count(*) OVER (PARTITION BY grouped) AS size, coalesce(first_name <> src, false) OR coalesce(second_name <> src, false) AS named, comment IS NOT NULL OR n_variables > 0 AS forced FROM ({sql_of(METHOD, "orders")})),
f AS (SELECT grouped, min(ord) AS first FROM m WHERE src IS NOT NULL AND named AND NOT forced AND size > 1 AND root GROUP BY 1), j AS (SELECT * FROM m LEFT JOIN f USING (grouped) WHERE src IS NOT NULL)
SELECT 'minimal' AS verbosity, id FROM j WHERE forced OR named AND (size = 1 OR coalesce(ord = first, false)) UNION ALL SELECT 'roots', id FROM j WHERE forced OR named AND (size = 1 OR root) UNION ALL SELECT 'full', id FROM j WHERE forced OR named"""

VARIABLE = {"id": "event_id", "src": "event_type", "name": "CASE WHEN value < 50 THEN event_type WHEN value < 80 THEN 'v' || event_id END", "comment": "CASE WHEN value > 95 THEN props END"}


def export_variables(spark, sf_dir):
    v = made(table(spark, sf_dir, "events"), VARIABLE).withColumn("names", F.array("name"))
    return mapping.exported_variables(v).select("id", "name")


EXPORT_VARIABLES = f"SELECT id, name FROM ({sql_of(VARIABLE, 'events')}) WHERE comment IS NOT NULL OR name <> src"

SIGNATURE = "'(' || repeat('[', CAST(l_linenumber AS INT) - 1) || 'Lp' || l_partkey || ';I' || CASE WHEN l_tax < 0.04 THEN 'Lnone/X;' ELSE '' END || 'Lp' || l_suppkey || ';)' || CASE WHEN l_discount < 0.05 THEN 'V' ELSE '[Lp' || l_suppkey || ';' END"


def descriptor_names(spark, sf_dir):
    """Descriptors made of lines, with the names of parts: null where a class has none, or with such classes as they are."""
    lines = table(spark, sf_dir, "lineitem").select(F.expr(SIGNATURE).alias("descriptor")).distinct()
    names = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), F.when(F.col("p_size") > 5, F.concat(F.lit("q/"), F.translate("p_name", " ", "_"))).alias("full"))
    return mapping.descriptors_both(lines, names, "descriptor")


DESCRIPTOR_NAMES = f"""WITH d AS (SELECT DISTINCT l_linenumber, l_partkey, l_suppkey, l_tax < 0.04 AS odd, l_discount < 0.05 AS nothing, {SIGNATURE} AS descriptor FROM lineitem),
n AS (SELECT p_partkey AS k, CASE WHEN p_size > 5 THEN 'q/' || replace(p_name, ' ', '_') END AS f FROM part),
j AS (SELECT d.*, x.f AS a, y.f AS b FROM d LEFT JOIN n x ON l_partkey = x.k LEFT JOIN n y ON l_suppkey = y.k)
SELECT DISTINCT descriptor, CASE WHEN odd OR a IS NULL OR b IS NULL THEN NULL ELSE '(' || repeat('[', l_linenumber - 1) || 'L' || a || ';IL' || b || ';)' || CASE WHEN nothing THEN 'V' ELSE '[L' || b || ';' END END AS strict,
 '(' || repeat('[', l_linenumber - 1) || 'L' || coalesce(a, 'p' || l_partkey) || ';I' || CASE WHEN odd THEN 'Lnone/X;' ELSE '' END || 'L' || coalesce(b, 'p' || l_suppkey) || ';)' || CASE WHEN nothing THEN 'V' ELSE '[L' || coalesce(b, 'p' || l_suppkey) || ';' END AS view FROM j"""


def renamed_references(spark, sf_dir):
    """Lines that refer to parts of suppliers, in the names that some of both have."""
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("owner")).distinct()
    lines = lines.withColumns({"name": F.col("target"), "owner_name": F.col("owner")})
    p = table(spark, sf_dir, "part").where("p_size > 10").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("full"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("full"))
    return mapping.renamed_references(lines, p.unionByName(s)).select("target", "owner", "name", "owner_name")


RENAMED_REFERENCES = """SELECT DISTINCT 'p' || l_partkey AS target, 's' || l_suppkey AS owner, coalesce(CASE WHEN p_size > 10 THEN p_name END, 'p' || l_partkey) AS name, coalesce(CASE WHEN s_acctbal > 0 THEN s_name END, 's' || l_suppkey) AS owner_name
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey"""

HELD = {"id": "l_orderkey * 8 + l_linenumber", "owner": "l_orderkey", "argument": "l_linenumber <= 4", "slot": "l_linenumber * 2", "entry": "l_linenumber + 1"}
WANTED = {
    "line": "l_orderkey * 8 + l_linenumber",
    "owner": "l_orderkey",
    "argument": "l_linenumber <= 4",
    "index": "CASE WHEN l_linenumber = 1 THEN -1 WHEN l_linenumber = 2 THEN 0 WHEN l_linenumber = 3 THEN 1 WHEN l_linenumber = 4 THEN 5 ELSE -1 END",
    "slot": "CASE WHEN l_linenumber IN (1, 5) THEN l_linenumber * 2 WHEN l_linenumber = 2 THEN 2 WHEN l_linenumber = 7 THEN -2 ELSE -1 END",
    "entry": "CASE WHEN l_linenumber = 6 THEN 7 WHEN l_linenumber = 3 THEN 3 ELSE -1 END",
}


def variable_lookup(spark, sf_dir):
    """Lines as variables of orders, looked up by index, slot or entry."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    # dealt by order once, to tasks that hold no more where there are more lines
    tasks = tasks_for(spark, lines.count())
    lines = stored(lines.repartition(tasks, "l_orderkey").distinct(), "lines").repartition(tasks, "l_orderkey")
    place = F.row_number().over(Window.partitionBy("owner", "argument").orderBy("id")) - 1
    return mapping.variable_rows(made(lines, WANTED), made(lines, HELD).withColumn("index", place), tasks)


VARIABLE_LOOKUP = f"""WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), v AS (SELECT *, row_number() OVER (PARTITION BY owner, argument ORDER BY id) - 1 AS index FROM ({sql_of(HELD, "l")})),
w AS ({sql_of(WANTED, "l")}), c AS (SELECT owner, argument, count(*) AS n FROM v GROUP BY 1, 2),
x AS (SELECT w.*, coalesce(c.n, 0) AS n, coalesce(g.n, 0) AS na FROM w LEFT JOIN c ON c.owner = w.owner AND c.argument = w.argument LEFT JOIN c g ON g.owner = w.owner AND g.argument),
h AS (SELECT *, CASE WHEN index >= na OR (argument AND index < -1) OR slot < -1 OR slot >= 2 * n + 1 OR entry < -1 THEN NULL WHEN argument AND index <> -1 THEN 1 WHEN entry >= 0 THEN 2 WHEN slot >= 0 THEN 3 END AS how FROM x)
SELECT h.line, min(CASE WHEN (h.slot = -1 OR h.slot = v.slot) AND (h.entry = -1 OR h.entry = v.entry) THEN v.id END) AS id
FROM h LEFT JOIN v ON v.owner = h.owner AND v.argument = h.argument AND CASE how WHEN 1 THEN v.index = h.index WHEN 2 THEN v.entry = h.entry WHEN 3 THEN v.slot = h.slot ELSE false END GROUP BY 1"""

FILE_ROW = {
    "ord": "o_custkey * 100000000 + o_orderkey",
    "cls": "'c' || o_custkey",
    "kind": "CASE WHEN o_totalprice > 150000 THEN 'method' ELSE 'field' END",
    "descriptor": "CASE WHEN o_totalprice > 150000 THEN '(I)V' ELSE 'I' END",
    "src": "'m' || o_orderkey",
    "dst": "CASE WHEN o_orderstatus <> 'O' THEN 'n' || o_orderkey END",
    "comment": "CASE WHEN o_orderpriority < '2' THEN 'a' || chr(10) || o_orderpriority END",
}


def mapping_file(spark, sf_dir):
    """Customers and orders written as the lines of a mapping file, and read again."""
    o = made(table(spark, sf_dir, "orders"), FILE_ROW)
    none = F.lit(None).cast("string")
    member = o.select((F.col("ord") * 4 + 1).alias("order"), "kind", "descriptor", F.col("src").alias("member"), F.array("src", "dst").alias("names"), none.alias("comment"))
    notes = o.where("comment IS NOT NULL").select((F.col("ord") * 4 + 2).alias("order"), F.lit("comment").alias("kind"), none.alias("descriptor"), F.col("src").alias("member"), F.array(none, none).alias("names"), "comment")
    classes = o.groupBy("cls").agg((F.min("ord") * 4).alias("order")).select("order", F.lit("class").alias("kind"), none.alias("descriptor"), none.alias("member"), F.array("cls", F.concat(F.lit("Named$"), "cls")).alias("names"), none.alias("comment"))
    rows = member.unionByName(notes).unionByName(classes).withColumn("slot", F.lit(None).cast("int"))
    lines = mappingfile.lines_of(rows).select(F.lit("f").alias("file"), F.col("order").alias("line"), "value")
    first = spark.createDataFrame([("f", -1, "tiny\t2\t0\tofficial\tnamed")], "file string, line long, value string")
    found = mappingfile.parsed(lines.unionByName(first), "official", "named")
    return found.select("kind", F.col("class").alias("cls"), "descriptor", "member", "src", "dst", "comment")


MAPPING_FILE = f"""WITH o AS ({sql_of(FILE_ROW, "orders")})
SELECT kind, cls, descriptor, src AS member, src, coalesce(dst, src) AS dst, NULL::VARCHAR AS comment FROM o
UNION ALL SELECT 'comment', cls, NULL, src, NULL, NULL, comment FROM o WHERE comment IS NOT NULL
UNION ALL SELECT DISTINCT 'class', cls, NULL, NULL, cls, 'Named$' || cls, NULL FROM o"""

PAIR_LINE = {"line": "o_orderkey * 2", "kind": "'c'", "a": "'c' || o_custkey", "b": "'d' || o_orderkey", "side": "CAST(NULL AS VARCHAR(9))", "id": "CAST(NULL AS VARCHAR(20))"}
OFF_LINE = {"line": "o_orderkey * 2 - 7001", "kind": "'c'", "a": "CAST(NULL AS VARCHAR(20))", "b": "CAST(NULL AS VARCHAR(20))", "side": "CASE WHEN o_orderstatus = 'O' THEN 'a' ELSE 'b' END", "id": "CASE WHEN o_orderstatus = 'O' THEN 'c' || o_custkey ELSE 'd' || o_orderkey END"}


def match_resolution(spark, sf_dir):
    """Orders as lines of a match file, customers with a balance and large orders as what is known."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = made(o, PAIR_LINE).unionByName(made(o.where("o_orderpriority > '5'"), OFF_LINE))
    known = made(c.where("c_acctbal > 0"), {"side": "'a'", "kind": "'c'", "id": "'c' || c_custkey"}).unionByName(made(o.where("o_totalprice > 100000"), {"side": "'b'", "kind": "'c'", "id": "'d' || o_orderkey"}))
    return matchfile.resolved(rows, known)


MATCH_RESOLUTION = f"""WITH off AS (SELECT side, id, min(line) AS since FROM ({sql_of(OFF_LINE, "orders WHERE o_orderpriority > '5'")}) GROUP BY 1, 2)
SELECT o_orderkey * 2 AS line, 'c' AS kind, 'c' || o_custkey AS a, 'd' || o_orderkey AS b, CASE WHEN c_custkey IS NULL OR o_totalprice <= 100000 THEN 'unknown' WHEN x.since < o_orderkey * 2 OR y.since < o_orderkey * 2 THEN 'void' ELSE 'matched' END AS state
FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN off x ON x.side = 'a' AND x.id = 'c' || o_custkey LEFT JOIN off y ON y.side = 'b' AND y.id = 'd' || o_orderkey"""


def match_lines(spark, sf_dir):
    """Customers, orders and lines as content of a match file, with what can't be matched."""
    c, o, line = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    owners = made(c.where("c_acctbal > 0"), {"a": "'c' || c_custkey", "b": "'d' || c_custkey"})
    members = made(o.where("o_orderstatus <> 'F'"), {"owner": "'c' || o_custkey", "kind": "CASE WHEN o_totalprice > 100000 THEN 'm' ELSE 'f' END", "a": "'o' || o_orderkey", "b": "'p' || o_orderkey"})
    lines = line.select("l_orderkey", "l_linenumber", "l_suppkey").distinct()
    variables = made(lines, {"owner": "'s' || l_suppkey", "member": "'o' || l_orderkey", "kind": "CASE WHEN l_linenumber < 4 THEN 'ma' ELSE 'mv' END", "a": "l_linenumber", "b": "l_linenumber + 1"})
    shut = made(c.where("c_acctbal <= 0"), {"owner": "CAST(NULL AS STRING)", "member": "CAST(NULL AS STRING)", "kind": "'c'", "side": "'a'", "id": "'c' || c_custkey"})
    shut = shut.unionByName(made(o.where("o_orderstatus = 'F'"), {"owner": "'c' || o_custkey", "member": "CAST(NULL AS STRING)", "kind": "'m'", "side": "'b'", "id": "'p' || o_orderkey"}))
    return matchfile.all_lines(owners, members, variables, shut).select(F.array_join("sort", "|").alias("sort"), "value")


MATCH_LINES = """SELECT 'c' || c_custkey || '|||c' || c_custkey AS sort, concat_ws(chr(9), 'c', 'c' || c_custkey, 'd' || c_custkey) AS value FROM customer WHERE c_acctbal > 0
UNION ALL SELECT 'c' || c_custkey || '|||a', concat_ws(chr(9), 'cu', 'a', 'c' || c_custkey) FROM customer WHERE c_acctbal <= 0
UNION ALL SELECT 'c' || o_custkey || '|o' || o_orderkey || '||o' || o_orderkey, chr(9) || concat_ws(chr(9), CASE WHEN o_totalprice > 100000 THEN 'm' ELSE 'f' END, 'o' || o_orderkey, 'p' || o_orderkey) FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT 'c' || o_custkey || '|p' || o_orderkey || '||b', chr(9) || concat_ws(chr(9), 'mu', 'b', 'p' || o_orderkey) FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT DISTINCT 's' || l_suppkey || '|o' || l_orderkey || '|' || CASE WHEN l_linenumber < 4 THEN 'ma' ELSE 'mv' END || '|' || l_linenumber, chr(9) || chr(9) || concat_ws(chr(9), CASE WHEN l_linenumber < 4 THEN 'ma' ELSE 'mv' END, l_linenumber, l_linenumber + 1) FROM lineitem"""

NAMED = """c AS (SELECT c_custkey AS k, 'n' || CAST(c_nationkey AS STRING) || '/N' AS outside, c_mktsegment AS seg FROM {customer}),
r AS (SELECT 'class' AS kind, outside || '$C' || CAST(k AS STRING) AS class, CAST(NULL AS STRING) AS descriptor, CAST(NULL AS STRING) AS member, CAST(NULL AS INT) AS slot, outside || '$C' || CAST(k AS STRING) AS src, outside || '$' || seg || CAST(k AS STRING) AS dst FROM c
UNION ALL SELECT 'method', outside || '$C' || CAST(k AS STRING), CASE o_orderstatus WHEN 'F' THEN '(I)V' WHEN 'O' THEN '()V' ELSE '([IJ)I' END, 'm' || CAST(o_orderkey AS STRING), NULL, 'm' || CAST(o_orderkey AS STRING), 'on' || CAST(year(o_orderdate) AS STRING) FROM {orders} JOIN c ON k = o_custkey
UNION ALL SELECT DISTINCT 'field', outside || '$C' || CAST(k AS STRING), 'J', 'f' || substr(o_orderpriority, 1, 1), CAST(NULL AS INT), 'f' || substr(o_orderpriority, 1, 1), substr(o_orderpriority, 3, 3) FROM {orders} JOIN c ON k = o_custkey
UNION ALL SELECT DISTINCT 'argument', outside || '$C' || CAST(k AS STRING), CASE o_orderstatus WHEN 'F' THEN '(I)V' WHEN 'O' THEN '()V' ELSE '([IJ)I' END, 'm' || CAST(o_orderkey AS STRING), l_linenumber, NULL, 'a' || l_returnflag
  FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM {lineitem} GROUP BY 1, 2) x JOIN {orders} ON l_orderkey = o_orderkey JOIN c ON k = o_custkey)"""


def mapping_formats(spark, sf_dir):
    """Names of customers, orders and lines, written in four formats of mapping files and read from these."""
    views = {t: table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem")}
    rows = stored(spark.sql(f"WITH {NAMED} SELECT *, CAST(NULL AS STRING) AS comment FROM r", **views), "names")
    found = []
    for form in ("tiny", "srg", "tsrg", "enigma"):
        path = fresh_path(spark, f"mapping-{form}")
        mappingformats.write(rows, path, form)
        read = mappingformats.read(spark, path, form)
        found.append(read.select(F.lit(form).alias("form"), "kind", "class", "descriptor", "member", "slot", "src", "dst"))
    return reduce(DataFrame.unionByName, found)


MAPPING_FORMATS = f"""WITH {NAMED.format(customer="customer", orders="orders", lineitem="lineitem")}
SELECT 'tiny' AS form, * FROM r WHERE kind <> 'argument' UNION ALL SELECT form, r.* REPLACE (CASE WHEN kind = 'method' THEN descriptor END AS descriptor) FROM r, (VALUES ('srg'), ('tsrg')) f (form) WHERE kind <> 'argument'
UNION ALL SELECT 'enigma', * FROM r UNION ALL SELECT DISTINCT 'enigma', 'class', outside, NULL, NULL, NULL, outside, outside FROM c"""


QUERIES = {
    f.__name__: f
    for f in (mapping_classes, mapping_members, mapping_statistics, mapping_clear, record_names, propagate_arguments, export_methods, export_variables, descriptor_names, renamed_references, variable_lookup, mapping_file, mapping_formats, match_resolution, match_lines)
}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
