"""Queries about what could be equal and what follows from structure, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import equality, structure
from kinweave.storage import shuffled, stored

from .mappings import made, sql_of
from .tables import SHIFT, table

# Expressions that make the inputs; they serve both the queries and their SQL.
A_CLASS = {"id": "p_partkey", "name": "p_type", "disguised": "p_retailprice < 950", "matchable": "p_size <> 13", "element": "CASE WHEN p_size < 10 THEN p_partkey % 50 END"}
B_CLASS = {"id": f"p_partkey + {SHIFT}", "name": "CASE WHEN p_size < 30 THEN p_type ELSE 'ECONOMY' END", "disguised": "p_retailprice < 930", "matchable": "p_size <> 17", "element": f"CASE WHEN p_size < 12 THEN p_partkey % 40 + {SHIFT} END"}
CLASS_MATCH = {"a": "p_partkey", "b": f"p_partkey + {SHIFT}"}
A_OWNER = {"id": "c_custkey", "name": "c_mktsegment", "disguised": "c_acctbal < 2000", "matchable": "c_nationkey <> 3"}
B_OWNER = {"id": f"c_custkey + {SHIFT}", "name": "c_mktsegment", "disguised": "c_acctbal < 3000", "matchable": "c_nationkey <> 4"}
OWNER_MATCH = {"a": "c_custkey", "b": f"c_custkey + {SHIFT}"}
METHOD_NAME = "CASE WHEN o_orderpriority < '2' THEN '<init>' ELSE o_orderstatus END"
A_METHOD = {"id": "o_orderkey", "owner": "o_custkey", "grouped": "o_custkey", "name": METHOD_NAME, "disguised": "o_totalprice < 100000", "matchable": "o_totalprice < 480000"}
B_METHOD = {"id": f"o_orderkey + {SHIFT}", "owner": f"o_custkey + {SHIFT}", "grouped": f"o_custkey + {SHIFT}", "name": METHOD_NAME, "disguised": "o_totalprice < 150000", "matchable": "o_totalprice < 470000"}
METHOD_MATCH = {"a": "o_orderkey", "b": f"o_orderkey + {SHIFT}"}
GROUP_MATCH = {"a_group": "c_custkey", "b_group": f"c_custkey + {SHIFT}"}
A_VARIABLE = {"id": "event_id", "owner": "user_id", "name": "event_type", "disguised": "value < 40", "matchable": "value < 98", "argument": "value < 60"}
B_VARIABLE = {"id": f"event_id + {SHIFT}", "owner": f"user_id + {SHIFT}", "name": "event_type", "disguised": "value < 50", "matchable": "value > 1", "argument": "value < 70"}


def part(spark, sf_dir):
    return table(spark, sf_dir, "part")


def sides(spark, sf_dir, name: str, a: dict, b: dict) -> tuple[DataFrame, DataFrame]:
    frame = table(spark, sf_dir, name)
    return made(frame, a), made(frame, b)


def class_pairs(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + SHIFT).alias("b"))
    return lines.unionByName(made(part(spark, sf_dir), CLASS_MATCH)).distinct()


def potential_classes(spark, sf_dir):
    """Parts against parts, by lines: with names of one sort against the other, and without."""
    a, b = sides(spark, sf_dir, "part", A_CLASS, B_CLASS)
    pairs, matches = stored(class_pairs(spark, sf_dir), "pairs"), made(part(spark, sf_dir).where("p_size > 40"), CLASS_MATCH)
    return equality.class_verdicts(pairs, a, b, matches, {"potential": False, "strict": True})


def names_sql(both_or_none: bool) -> str:
    return f"CASE WHEN x.disguised AND y.disguised THEN true WHEN x.disguised OR y.disguised THEN {str(not both_or_none).lower()} ELSE x.name = y.name END"


def decided(condition: str) -> str:
    return f"CASE WHEN mx.b IS NOT NULL THEN mx.b = y.id WHEN my.a IS NOT NULL THEN my.a = x.id ELSE coalesce(x.matchable AND y.matchable AND ({condition}), false) END"


ENDS = "JOIN av x ON x.id = p.a JOIN bv y ON y.id = p.b LEFT JOIN mt mx ON mx.a = p.a LEFT JOIN mt my ON my.b = p.b"
CLASS_TABLES = f"""av AS ({sql_of(A_CLASS, "part")}), bv AS ({sql_of(B_CLASS, "part")}), mt AS ({sql_of(CLASS_MATCH, "part")} WHERE p_size > 40),
pr AS (SELECT l_partkey AS a, l_suppkey + {SHIFT} AS b FROM lineitem UNION {sql_of(CLASS_MATCH, "part")}),
ep AS (SELECT DISTINCT x.element AS a, y.element AS b FROM pr p JOIN av x ON x.id = p.a JOIN bv y ON y.id = p.b WHERE x.element IS NOT NULL AND y.element IS NOT NULL),
el AS (SELECT p.a, p.b, {decided(names_sql(False))} AS loose, {decided(names_sql(True))} AS tight FROM ep p {ENDS})"""
SHAPE = "CASE WHEN x.element IS NOT NULL AND y.element IS NOT NULL THEN coalesce(el.{0}, false) ELSE x.element IS NULL AND y.element IS NULL END"
POTENTIAL_CLASSES = f"""WITH {CLASS_TABLES} SELECT p.a, p.b, {decided(SHAPE.format("loose") + " AND " + names_sql(False))} AS potential, {decided(SHAPE.format("tight") + " AND " + names_sql(True))} AS strict
FROM pr p {ENDS} LEFT JOIN el ON el.a = x.element AND el.b = y.element"""


def method_parts(spark, sf_dir):
    a, b = sides(spark, sf_dir, "orders", A_METHOD, B_METHOD)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_suppkey") + SHIFT).alias("b"))
    pairs = lines.unionByName(made(table(spark, sf_dir, "orders"), METHOD_MATCH))
    matches = made(table(spark, sf_dir, "orders").where("o_totalprice > 400000"), METHOD_MATCH)
    owners_a, owners_b = sides(spark, sf_dir, "customer", A_OWNER, B_OWNER)
    met = made(table(spark, sf_dir, "customer").where("c_acctbal > 6000"), OWNER_MATCH)
    a, b = (equality.owned(side, owners, met, c) for side, owners, c in ((a, owners_a, "a"), (b, owners_b, "b")))
    groups = made(table(spark, sf_dir, "customer").where("c_acctbal > 4000"), GROUP_MATCH)
    return equality.potential_members(pairs, a, b, matches, None, groups), matches


def potential_methods(spark, sf_dir):
    """Orders against orders as methods of customers; those of the lowest priority are bodies of lambdas, called by other orders."""
    found, matches = method_parts(spark, sf_dir)
    found = stored(found.withColumn("plain", F.col("potential")), "found")
    low = table(spark, sf_dir, "orders").where("o_orderpriority > '5'")
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("caller"), F.col("l_orderkey").alias("callee")).distinct()
    far = calls.select((F.col("caller") + SHIFT).alias("caller"), (F.col("callee") + SHIFT).alias("callee"))
    return equality.potential_lambdas(found, low.select(F.col("o_orderkey").alias("id")), low.select((F.col("o_orderkey") + SHIFT).alias("id")), calls, far, matches)


METHOD_TABLES = f"""ao AS ({sql_of(A_OWNER, "customer")}), bo AS ({sql_of(B_OWNER, "customer")}), om AS ({sql_of(OWNER_MATCH, "customer")} WHERE c_acctbal > 6000),
gm AS ({sql_of(GROUP_MATCH, "customer")} WHERE c_acctbal > 4000), am AS ({sql_of(A_METHOD, "orders")}), bm AS ({sql_of(B_METHOD, "orders")}),
pr AS (SELECT l_orderkey AS a, l_suppkey + {SHIFT} AS b FROM lineitem UNION {sql_of(METHOD_MATCH, "orders")}),
op AS (SELECT DISTINCT am.owner AS a, bm.owner AS b FROM pr JOIN am ON am.id = pr.a JOIN bm ON bm.id = pr.b),
ow AS (SELECT p.a, p.b, {decided(names_sql(False))} AS ok FROM op p {ENDS.replace("av x", "ao x").replace("bv y", "bo y").replace("mt m", "om m")}), mt AS ({sql_of(METHOD_MATCH, "orders")} WHERE o_totalprice > 400000),
f AS MATERIALIZED (SELECT p.a, p.b, mx.b IS NULL AS loose, {decided("coalesce(ow.ok, false) AND " + names_sql(False) + " AND (NOT starts_with(x.name, '<') AND NOT starts_with(y.name, '<') OR x.name = y.name) AND (ga.b_group IS NULL AND gb.a_group IS NULL OR coalesce(ga.b_group = y.grouped, false))")} AS plain
 FROM pr p {ENDS.replace("av x", "am x").replace("bv y", "bm y")} LEFT JOIN ow ON ow.a = x.owner AND ow.b = y.owner LEFT JOIN gm ga ON ga.a_group = x.grouped LEFT JOIN gm gb ON gb.b_group = y.grouped)"""
POTENTIAL_METHODS = f"""WITH {METHOD_TABLES}, lo AS (SELECT o_orderkey AS k FROM orders WHERE o_orderpriority > '5'), cl AS (SELECT DISTINCT l_suppkey AS caller, l_orderkey AS callee FROM lineitem),
asked AS MATERIALIZED (SELECT f.a, f.b FROM f JOIN lo x ON x.k = f.a JOIN lo y ON y.k = f.b - {SHIFT} WHERE plain AND loose), met AS MATERIALIZED (SELECT asked.a, asked.b, ca.caller FROM asked JOIN cl ca ON ca.callee = asked.a),
far AS MATERIALIZED (SELECT met.a, met.b, g.b - {SHIFT} AS caller FROM met JOIN f g ON g.a = met.caller AND g.plain), kept AS MATERIALIZED (SELECT DISTINCT far.a, far.b FROM far JOIN cl cb ON cb.callee = far.b - {SHIFT} AND cb.caller = far.caller)
SELECT f.a, f.b, plain, plain AND NOT (loose AND f.a IN (SELECT k FROM lo) AND f.b - {SHIFT} IN (SELECT k FROM lo) AND kept.a IS NULL) AS potential FROM f LEFT JOIN kept ON kept.a = f.a AND kept.b = f.b"""


def potential_fields(spark, sf_dir):
    """Orders against orders as fields of customers."""
    a, b = sides(spark, sf_dir, "orders", A_METHOD, B_METHOD)
    pairs = made(table(spark, sf_dir, "orders"), METHOD_MATCH)
    owners_a, owners_b = sides(spark, sf_dir, "customer", A_OWNER, B_OWNER)
    c = table(spark, sf_dir, "customer")
    owners = equality.potential_classes(made(c, OWNER_MATCH), owners_a, owners_b, made(c.where("c_acctbal > 6000"), OWNER_MATCH), True)
    return equality.potential_members(pairs, a, b, made(table(spark, sf_dir, "orders").where("o_totalprice > 400000"), METHOD_MATCH), owners, both_or_none=True)


POTENTIAL_FIELDS = f"""WITH ao AS ({sql_of(A_OWNER, "customer")}), bo AS ({sql_of(B_OWNER, "customer")}), om AS ({sql_of(OWNER_MATCH, "customer")} WHERE c_acctbal > 6000), op AS ({sql_of(OWNER_MATCH, "customer")}),
ow AS (SELECT p.a, p.b, {decided(names_sql(True))} AS ok FROM op p {ENDS.replace("av x", "ao x").replace("bv y", "bo y").replace("mt m", "om m")}),
av AS ({sql_of(A_METHOD, "orders")}), bv AS ({sql_of(B_METHOD, "orders")}), mt AS ({sql_of(METHOD_MATCH, "orders")} WHERE o_totalprice > 400000), pr AS ({sql_of(METHOD_MATCH, "orders")})
SELECT p.a, p.b, {decided("coalesce(ow.ok, false) AND " + names_sql(True))} AS potential FROM pr p {ENDS} LEFT JOIN ow ON ow.a = x.owner AND ow.b = y.owner"""


def potential_variables(spark, sf_dir):
    """Events against events as variables of users; users of one number are potentially equal."""
    a, b = sides(spark, sf_dir, "events", A_VARIABLE, B_VARIABLE)
    e = table(spark, sf_dir, "events")
    pairs = e.select(F.col("event_id").alias("a"), (F.col("event_id") + SHIFT).alias("b")).unionByName(e.select(F.col("event_id").alias("a"), (F.col("user_id") + SHIFT).alias("b"))).distinct()
    users = e.select(F.col("user_id").alias("a"), (F.col("user_id") + SHIFT).alias("b")).distinct().withColumn("potential", F.lit(True))
    return equality.potential_variables(pairs, a, b, e.where("value > 90").select(F.col("event_id").alias("a"), (F.col("event_id") + SHIFT).alias("b")), users)


POTENTIAL_VARIABLES = f"""WITH av AS ({sql_of(A_VARIABLE, "events")}), bv AS ({sql_of(B_VARIABLE, "events")}), mt AS (SELECT event_id AS a, event_id + {SHIFT} AS b FROM events WHERE value > 90),
pr AS (SELECT event_id AS a, event_id + {SHIFT} AS b FROM events UNION SELECT event_id, user_id + {SHIFT} FROM events)
SELECT p.a, p.b, {decided(f"x.argument = y.argument AND x.owner + {SHIFT} = y.owner AND " + names_sql(False))} AS potential FROM pr p {ENDS}"""


def matchable_flags(spark, sf_dir):
    """Lines' orders as members of customers, and what becomes of wishes to change their flags."""
    members = made(table(spark, sf_dir, "orders"), {"id": "o_orderkey", "owner": "o_custkey", "own": "CASE WHEN o_orderpriority > '1' THEN o_totalprice < 300000 END"})
    owners = made(table(spark, sf_dir, "customer"), {"id": "c_custkey", "matchable": "c_acctbal > 1000"})
    return equality.matchable(members, owners).select("id", "matchable")


MATCHABLE_FLAGS = "SELECT o_orderkey AS id, coalesce(o_orderpriority > '1' AND o_totalprice < 300000 AND c_acctbal > 1000, false) AS matchable FROM orders LEFT JOIN customer ON o_custkey = c_custkey"


def toggle_matchable(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    members = made(o, {"id": "o_orderkey", "own": "o_totalprice < 300000", "above": "o_orderstatus <> 'F'"})
    wanted = made(o.where("o_orderpriority < '4'"), {"id": "o_orderkey", "value": "o_totalprice > 200000"})
    could = made(o, {"id": "o_orderkey", "potential": "o_orderpriority <> '2-HIGH'"})
    return equality.toggled(members, wanted, made(o.where("o_totalprice < 90000"), {"id": "o_orderkey"}), could).select("id", "own", "refused")


TOGGLE_MATCHABLE = """WITH w AS (SELECT *, o_orderpriority < '4' AS asked, o_totalprice > 200000 AS v FROM orders),
r AS (SELECT *, asked AND (NOT v AND o_totalprice < 90000 OR v AND o_orderstatus = 'F' OR o_orderpriority = '2-HIGH') AS refused FROM w)
SELECT o_orderkey AS id, CASE WHEN asked AND NOT refused THEN v ELSE o_totalprice < 300000 END AS own, refused FROM r"""


def method_candidates(spark, sf_dir):
    a, b = sides(spark, sf_dir, "orders", A_METHOD, B_METHOD)
    priority = lambda rows, shift: rows.drop("grouped").join(shuffled(table(spark, sf_dir, "orders").select((F.col("o_orderkey") + shift).alias("id"), F.concat("o_custkey", F.lit(" "), "o_orderpriority").alias("grouped"))), "id")
    owners = made(table(spark, sf_dir, "customer").where("c_acctbal > 0"), OWNER_MATCH)
    groups = table(spark, sf_dir, "orders").where("o_orderpriority < '3'").select(F.concat("o_custkey", F.lit(" "), "o_orderpriority").alias("a_group")).distinct().withColumn("b_group", F.col("a_group"))
    return equality.method_candidates(owners, priority(a, 0), priority(b, SHIFT), made(table(spark, sf_dir, "orders").where("o_totalprice > 400000"), METHOD_MATCH), groups)


METHOD_CANDIDATES = f"""SELECT x.o_orderkey AS a, y.o_orderkey + {SHIFT} AS b FROM orders x JOIN customer ON x.o_custkey = c_custkey AND c_acctbal > 0 JOIN orders y ON y.o_custkey = x.o_custkey
WHERE CASE WHEN x.o_totalprice > 400000 THEN x.o_orderkey = y.o_orderkey WHEN x.o_orderpriority < '3' THEN x.o_orderpriority = y.o_orderpriority ELSE true END"""


def array_matches(spark, sf_dir):
    """Orders as arrays of customers, by their priority as dimensions."""
    o = table(spark, sf_dir, "orders")
    dims = F.substring("o_orderpriority", 1, 1).alias("dims")
    a = o.where("o_orderstatus <> 'F'").select((F.col("o_orderkey") + 2 * SHIFT).alias("id"), F.col("o_custkey").alias("element"), dims)
    b = o.where("o_orderstatus <> 'P'").select((F.col("o_orderkey") + 3 * SHIFT).alias("id"), (F.col("o_custkey") + SHIFT).alias("element"), dims)
    taken = o.where("o_orderstatus = 'O' AND o_totalprice < 60000").select((F.col("o_orderkey") + 4 * SHIFT).alias("a"), (F.col("o_orderkey") + 3 * SHIFT).alias("b"))
    return equality.array_matches(made(table(spark, sf_dir, "customer").where("c_acctbal > 0"), OWNER_MATCH).unionByName(taken), a, b)


ARRAY_MATCHES = f"""WITH a AS (SELECT o_orderkey AS id, o_custkey AS e, left(o_orderpriority, 1) AS d FROM orders WHERE o_orderstatus <> 'F'),
b AS (SELECT o_orderkey AS id, o_custkey AS e, left(o_orderpriority, 1) AS d FROM orders WHERE o_orderstatus <> 'P' AND NOT (o_orderstatus = 'O' AND o_totalprice < 60000)),
x AS (SELECT *, row_number() OVER (PARTITION BY e, d ORDER BY id) AS n FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY e, d ORDER BY id) AS n FROM b)
SELECT x.id + {2 * SHIFT} AS a, y.id + {3 * SHIFT} AS b FROM x JOIN y USING (e, d, n) JOIN customer ON e = c_custkey AND c_acctbal > 0"""


def unobfuscated_members(spark, sf_dir):
    """Orders of matched customers with one priority and status, or else the only one of that priority."""
    o = table(spark, sf_dir, "orders")
    columns = {"full": "o_orderpriority || ' ' || o_orderstatus", "name": "o_orderpriority", "disguised": "o_totalprice < 50000"}
    a, b = made(o, {"id": "o_orderkey", "owner": "o_custkey", **columns}), made(o, {"id": f"o_orderkey + {SHIFT}", "owner": f"o_custkey + {SHIFT}", **columns, "full": "o_orderpriority || ' ' || CASE WHEN o_totalprice > 250000 THEN o_orderstatus ELSE '-' END"})
    return equality.unobfuscated_members(made(table(spark, sf_dir, "customer").where("c_acctbal > 0"), OWNER_MATCH), a, b)


UNOBFUSCATED_MEMBERS = f"""WITH b AS (SELECT *, CASE WHEN o_totalprice > 250000 THEN o_orderstatus ELSE '-' END AS st FROM orders),
f AS (SELECT o_custkey, o_orderpriority, st, min(o_orderkey) AS k FROM b GROUP BY ALL), u AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM b GROUP BY ALL HAVING count(*) = 1),
m AS (SELECT x.o_orderkey AS a, coalesce(f.k, u.k) AS k FROM orders x JOIN customer ON x.o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN f ON f.o_custkey = x.o_custkey AND f.o_orderpriority = x.o_orderpriority AND f.st = x.o_orderstatus
 LEFT JOIN u ON u.o_custkey = x.o_custkey AND u.o_orderpriority = x.o_orderpriority WHERE x.o_totalprice >= 50000)
SELECT a, k + {SHIFT} AS b FROM m JOIN orders o ON o.o_orderkey = k WHERE o.o_totalprice >= 50000"""


def input_problems(spark, sf_dir):
    """Nations as paths of roles: regions as such, the same again for small numbers, and roles without any."""
    n = table(spark, sf_dir, "nation")
    inputs = n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("role"), F.col("n_name").alias("path")).unionByName(n.where("n_nationkey < 8").select(F.lit("b").alias("role"), F.col("n_name").alias("path")))
    return equality.problems(inputs, ["b", "r0", "c", "d"], ["[a", "a+"])


INPUT_PROBLEMS = "SELECT 'shared ' || n_name AS problem FROM nation WHERE n_nationkey < 8 UNION ALL VALUES ('nothing for c'), ('nothing for d'), ('pattern [a')"

MAKER = {
    "id": "event_id",
    "tag": "CASE WHEN value > 5 THEN 6 ELSE 8 END",
    "owner": f"CASE WHEN value < 50 THEN '{structure.METAFACTORY}' WHEN value < 70 THEN '{structure.OF_NO_INTEREST[0]}' WHEN value < 80 THEN '{structure.OF_NO_INTEREST[1]}' ELSE 'x/Y' END",
    "name": "CASE WHEN event_type IN ('click', 'view') THEN 'metafactory' WHEN event_type = 'error' THEN 'altMetafactory' ELSE 'make' END",
    "descriptor": f"CASE WHEN value > 45 THEN '()V' WHEN event_type IN ('click', 'view') THEN '{structure.LAMBDA_MAKERS['metafactory']}' ELSE '{structure.LAMBDA_MAKERS['altMetafactory']}' END",
    "interface": "value > 40",
    "first": "'t' || user_id",
    "second": "'m' || event_id",
}


def dynamic_targets(spark, sf_dir):
    """Events as dynamic calls, and what those that make lambdas call."""
    e = made(table(spark, sf_dir, "events"), MAKER)
    target = structure.dynamic_target(F.col("tag"), F.col("owner"), F.col("name"), F.col("descriptor"), F.col("interface"), F.array("first", "second"))
    return e.select("id", target.alias("t")).select("id", "t.target", "t.known")


DYNAMIC_TARGETS = """WITH e AS (SELECT *, value > 5 AND value <= 40 AND event_type IN ('click', 'view', 'error') AS made FROM events)
SELECT event_id AS id, CASE WHEN made THEN 'm' || event_id END AS target, made OR (value >= 50 AND value < 80) AS known FROM e"""


def method_kinds(spark, sf_dir):
    """Orders as methods, called by their lines."""
    flags = {"id": "o_orderkey", "name": "CASE WHEN o_orderpriority < '2' THEN '<init>' WHEN o_orderpriority < '3' THEN '<clinit>' ELSE 'm' END", "flags": "CASE WHEN o_totalprice > 100000 THEN 4098 WHEN o_totalprice > 50000 THEN 4096 ELSE 2 END"}
    calls = made(table(spark, sf_dir, "lineitem"), {"callee": "l_orderkey", "by_lambda": "l_quantity > 15"})
    return structure.method_kinds(made(table(spark, sf_dir, "orders"), flags), calls).select("id", "kind")


METHOD_KINDS = """SELECT o_orderkey AS id, CASE WHEN o_orderpriority < '2' THEN 'constructor' WHEN o_orderpriority < '3' THEN 'class_init' WHEN o_totalprice > 100000 AND coalesce(low, 0) > 15 THEN 'lambda' ELSE 'other' END AS kind
FROM orders LEFT JOIN (SELECT l_orderkey, min(l_quantity) AS low FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"""

LINE_DESCRIPTOR = "'(' || repeat('J', CAST(l_linenumber AS INT) - 1) || '[D' || CASE WHEN l_tax < 0.04 THEN 'La/B;I' ELSE '' END || 'D)V'"


def argument_slots(spark, sf_dir):
    """Arguments of descriptors made of lines, with their slots."""
    rows = made(table(spark, sf_dir, "lineitem"), {"id": LINE_DESCRIPTOR, "descriptor": LINE_DESCRIPTOR, "static": "l_linenumber > 3"}).distinct()
    return structure.arguments_of(rows).select("id", "index", "type", F.col("slot").cast("int").alias("slot"))


ARGUMENT_SLOTS = f"""WITH d AS (SELECT DISTINCT {LINE_DESCRIPTOR} AS id, l_linenumber AS n, l_tax < 0.04 AS two FROM lineitem),
t AS (SELECT id, n, unnest(range(0, len(ts))) AS index, ts FROM (SELECT *, list_concat(list_transform(range(1, n), lambda x: 'J'), ['[D'], CASE WHEN two THEN ['La/B;', 'I'] ELSE [] END, ['D']) AS ts FROM d))
SELECT id, index, ts[index + 1] AS type, (CASE WHEN n > 3 THEN 0 ELSE 1 END + coalesce(list_sum(list_transform(ts[1:index], lambda x: CASE WHEN x IN ('J', 'D') THEN 2 ELSE 1 END)), 0))::INT AS slot FROM t"""


def group_flags(spark, sf_dir):
    return structure.group_flags(made(table(spark, sf_dir, "orders"), {"grouped": "o_custkey", "disguised": "o_totalprice < 300000"}))


GROUP_FLAGS = "SELECT o_custkey AS grouped, bool_and(o_totalprice < 300000) AS disguised FROM orders GROUP BY 1"


def input_roots(spark, sf_dir):
    """Parts as members supplied by lines' flags, below the parts of half and a quarter of their number."""
    members = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("origin"))
    p = part(spark, sf_dir).select(F.col("p_partkey").alias("sub"))
    paths = p.select("sub", F.floor(F.col("sub") / 2).alias("sup")).unionByName(p.select("sub", F.floor(F.col("sub") / 4).alias("sup")))
    return structure.input_roots(members, paths)


INPUT_ROOTS = """WITH m AS (SELECT DISTINCT l_partkey AS id, l_returnflag || l_linestatus AS origin FROM lineitem)
SELECT m.id, bool_or(up) AS has_parent, bool_or(NOT up) AS any_root FROM (SELECT m.id, m.origin, bool_or(u.id IS NOT NULL) AS up FROM m LEFT JOIN m u ON u.origin = m.origin AND u.id <> m.id AND u.id IN (m.id // 2, m.id // 4) GROUP BY 1, 2) m GROUP BY 1"""

TREE_NAME = "CASE WHEN p_size < 10 THEN '' ELSE lower(p_type) || '/' END || replace(p_name, ' ', '_') || CASE WHEN p_size > 25 THEN '$In' || p_size ELSE '' END || CASE WHEN p_size > 40 THEN '$1' ELSE '' END"


def package_tree(spark, sf_dir):
    return structure.package_tree(made(part(spark, sf_dir), {"name": TREE_NAME}))


PACKAGE_TREE = f"WITH t AS (SELECT string_split({TREE_NAME}, '$')[1] AS top FROM part) SELECT CASE WHEN contains(top, '/') THEN string_split(top, '/')[1] ELSE '' END AS package, top, count(*) AS n_classes FROM t GROUP BY 1, 2"


def class_path(spark, sf_dir):
    """Parts in the archives of their suppliers: where each is found first, and the archives of those that no supplier of the path has."""
    lines = table(spark, sf_dir, "lineitem")
    entries = lines.select(F.col("l_partkey").alias("name"), F.concat(F.lit("jar"), F.col("l_suppkey").cast("string")).alias("path"), F.col("l_suppkey").alias("ord"))
    inputs = lines.select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("ord"), F.concat(F.lit("jar"), F.col("l_suppkey").cast("string")).alias("origin"))
    known = lines.where("l_quantity = 50").select(F.col("l_partkey").alias("id"))
    merged = structure.merged_inputs(inputs, known).select(F.col("id").alias("name"), "origin", F.array_join("origins", " ").alias("origins"))
    return structure.path_index(entries).join(merged, "name", "left")


CLASS_PATH = """WITH e AS (SELECT DISTINCT l_partkey AS name, l_suppkey AS s FROM lineitem), k AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity = 50),
g AS (SELECT name, 'jar' || min(s) AS path, string_agg('jar' || s, ' ' ORDER BY s) AS origins FROM e GROUP BY 1)
SELECT name, path, CASE WHEN l_partkey IS NULL THEN path END AS origin, CASE WHEN l_partkey IS NULL THEN origins END AS origins FROM g LEFT JOIN k ON name = l_partkey"""


def member_similarity(spark, sf_dir):
    """Orders as matched methods with their lines as arguments and instructions, and customers as their classes."""
    o, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    met = o.where("o_orderstatus <> 'P'")
    code = {"a": "o_orderkey", "b": f"o_orderkey + {SHIFT}", "a_code": "CASE WHEN o_orderpriority > '2' THEN CAST(o_totalprice / 1000 AS INT) END", "b_code": "CASE WHEN o_orderpriority > '3' THEN CAST(o_totalprice / 900 AS INT) END", "same_result": "o_totalprice > 200000", "aligned": "CAST(o_totalprice / 2000 AS INT)"}
    similar = F.when(F.col("l_quantity") > 20, structure.type_similarity(F.col("l_tax") < 0.04))
    arguments = lines.select(F.col("l_orderkey").alias("a"), similar.alias("similarity"))
    methods = structure.method_similarity(made(met, code), arguments, lines.where("l_quantity < 10").select((F.col("l_orderkey") + SHIFT).alias("b")))
    owners = made(table(spark, sf_dir, "customer").where("c_acctbal > 0"), OWNER_MATCH)
    a = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"))
    b = o.select((F.col("o_orderkey") + SHIFT).alias("id"), (F.col("o_custkey") + SHIFT).alias("owner"))
    classes = structure.class_similarity(owners, a, b, methods)
    return methods.unionByName(classes).select("a", "b", F.round("similarity", 6).alias("similarity"))


MEMBER_SIMILARITY = f"""WITH l AS (SELECT l_orderkey, sum(CASE WHEN l_quantity > 20 THEN CASE WHEN l_tax < 0.04 THEN 1.0 ELSE 0.5 END END)::DOUBLE AS s, count(*) AS n, count(CASE WHEN l_quantity < 10 THEN 1 END) AS free FROM lineitem GROUP BY 1),
p AS (SELECT o_orderkey AS k, CASE WHEN o_orderpriority > '2' THEN trunc(o_totalprice / 1000)::INT END AS ca, CASE WHEN o_orderpriority > '3' THEN trunc(o_totalprice / 900)::INT END AS cb, o_totalprice > 200000 AS same, trunc(o_totalprice / 2000)::INT AS al FROM orders WHERE o_orderstatus <> 'P'),
m AS (SELECT k, CASE WHEN ca IS NULL AND cb IS NULL THEN 1.0::DOUBLE WHEN ca IS NULL OR cb IS NULL THEN 0.0 ELSE CASE WHEN same THEN 0.05::DOUBLE ELSE 0 END
 + 0.2::DOUBLE * CASE WHEN coalesce(n, 0) + coalesce(free, 0) > 0 THEN coalesce(s, 0) / (n + free) ELSE 1 END + 0.75::DOUBLE * CASE WHEN greatest(ca, cb) > 0 THEN al / greatest(ca, cb)::DOUBLE ELSE 1 END END AS sim FROM p LEFT JOIN l ON k = l_orderkey),
c AS (SELECT c_custkey, CASE WHEN count(o_orderkey) > 0 THEN coalesce(sum(sim), 0) / (count(o_orderkey) + count(CASE WHEN o_orderkey IS NOT NULL AND k IS NULL THEN 1 END)) ELSE 1 END AS sim FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN m ON k = o_orderkey WHERE c_acctbal > 0 GROUP BY 1)
SELECT k AS a, k + {SHIFT} AS b, round(sim, 6) AS similarity FROM m UNION ALL SELECT c_custkey, c_custkey + {SHIFT}, round(sim, 6) FROM c"""

OWNER_ID, FAR_ID = "'La/C' || o_custkey || ';'", "'Lb/D' || o_custkey || ';'"
METHOD_ID, FIELD_ID = "'m' || o_orderkey || '(ILx/Y;)[J'", "'f' || o_orderkey || ';;La/B;'"


def uid_exchange(spark, sf_dir):
    """Matches of customers and orders as the lines for a store of ids, and what is read from such lines."""
    o = table(spark, sf_dir, "orders")
    classes = made(o, {"a": OWNER_ID, "b": FAR_ID}).distinct()
    own = {"owner_a": OWNER_ID, "owner_b": FAR_ID}
    methods = made(o.where("o_orderstatus <> 'F'"), {**own, "a": METHOD_ID, "b": "'n' || o_orderkey || '()V'"})
    fields = made(o.where("o_orderstatus = 'F'"), {**own, "a": FIELD_ID, "b": FIELD_ID})
    arguments = made(o.where("o_orderstatus = 'O'"), {**own, "method_a": METHOD_ID, "method_b": METHOD_ID, "a": "'1'", "b": "'2'"})
    lines = structure.uid_lines(classes, methods, fields, arguments).withColumn("uid", F.length("a"))
    return structure.uid_rows(lines)


UID_EXCHANGE = f"""SELECT DISTINCT 'class' AS type, length({OWNER_ID}) AS uid, {OWNER_ID} AS owner_a, NULL::VARCHAR AS member_a, {FAR_ID} AS owner_b, NULL::VARCHAR AS member_b FROM orders
UNION ALL SELECT 'method', length({OWNER_ID} || {METHOD_ID}) + 1, {OWNER_ID}, {METHOD_ID}, {FAR_ID}, 'n' || o_orderkey || '()V' FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT 'field', length({OWNER_ID} || {FIELD_ID}) + 1, {OWNER_ID}, {FIELD_ID}, {FAR_ID}, {FIELD_ID} FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'argument', length({OWNER_ID} || {METHOD_ID}) + 2, {OWNER_ID}, {METHOD_ID}, {FAR_ID}, {METHOD_ID} FROM orders WHERE o_orderstatus = 'O'"""


def member_order(spark, sf_dir):
    o = made(table(spark, sf_dir, "orders"), {"id": "o_orderkey", "owner": "o_custkey", "name": "o_orderpriority", "descriptor": "o_orderstatus"})
    return structure.member_order(o).select("id", "place")


MEMBER_ORDER = "SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderstatus, o_orderkey) AS place FROM orders"

QUERIES = {
    f.__name__: f
    for f in (
        potential_classes, potential_methods, potential_fields, potential_variables, matchable_flags, toggle_matchable, method_candidates, array_matches, unobfuscated_members, input_problems,
        dynamic_targets, method_kinds, argument_slots, group_flags, input_roots, package_tree, class_path, member_similarity, uid_exchange, member_order,
    )
}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
