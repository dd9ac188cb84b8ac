"""Queries about name spaces, type names and flags over two sides made of parts, orders and events, and their SQL.

The expressions that make the sides are plain SQL and serve the query and its SQL alike; what is done with them is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import descriptors
from kinweave.operators import cascade

from .tables import SHIFT, table

PART_NAME = "replace(p_name, ' ', '_')"
CLASSES = {
    "A": {
        "id": "p_partkey",
        "partner": f"CASE WHEN p_size > 20 THEN p_partkey + {SHIFT} END",
        "outer_id": "CASE WHEN p_retailprice >= 950 THEN first_key END",
        "name": f"CASE WHEN p_retailprice >= 950 AND first_key IS NOT NULL THEN 'p/Outer$' || {PART_NAME} ELSE lower(p_type) || '/' || {PART_NAME} END",
        "disguised": "p_type IN ('ECONOMY', 'PROMO', 'LARGE')",
        "mapped": "CASE WHEN p_brand IN ('Brand#1', 'Brand#11', 'Brand#12') THEN 'Own' || p_size END",
        "tmp": "CASE WHEN p_size > 10 THEN 'c' || p_partkey END",
        "aux1": "CASE WHEN p_size < 40 THEN 'aux' || p_size END",
        "aux2": "CASE WHEN p_size < 30 THEN 'second' || p_size END",
        "uid": "CASE WHEN p_size < 45 THEN p_partkey * 2 ELSE -1 END",
    },
    "B": {
        "id": f"p_partkey + {SHIFT}",
        "partner": "CASE WHEN p_size > 20 THEN p_partkey END",
        "outer_id": f"CASE WHEN p_size > 35 THEN first_key + {SHIFT} END",
        "name": f"CASE WHEN p_size > 35 AND first_key IS NOT NULL THEN 'q/Other$' || {PART_NAME} ELSE 'q/' || {PART_NAME} END",
        "disguised": "p_retailprice < 930",
        "mapped": "CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#22') THEN CASE WHEN p_size < 30 THEN 'other/' ELSE '1' END || p_type END",
        "tmp": "CASE WHEN p_size < 30 THEN 'd' || p_partkey END",
        "aux1": "CASE WHEN p_size > 25 THEN 'far' || p_size END",
        "aux2": "CASE WHEN p_size > 15 THEN 'far2' || p_size END",
        "uid": "CASE WHEN p_size > 5 THEN p_partkey + 7 ELSE -1 END",
    },
}
MEMBERS = {
    "A": {
        "id": "o_orderkey",
        "owner": "o_custkey",
        "partner": f"CASE WHEN o_orderstatus <> 'F' THEN o_orderkey + {SHIFT} END",
        "name": "'m' || o_custkey",
        "disguised": "o_totalprice < 200000",
        "mapped": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' || o_custkey END",
        "tmp": "CASE WHEN o_totalprice > 50000 THEN 'vm' || o_orderkey END",
        "aux1": "CASE WHEN o_totalprice > 90000 THEN 'a' || o_orderkey END",
        "uid": "CASE WHEN o_totalprice > 100000 THEN o_orderkey ELSE -1 END",
        "input": "o_totalprice < 400000",
    },
    "B": {
        "id": f"o_orderkey + {SHIFT}",
        "owner": f"o_custkey + {SHIFT}",
        "partner": "CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END",
        "name": "'n' || o_orderstatus",
        "disguised": "o_totalprice > 150000",
        "mapped": "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' || o_orderkey END",
        "tmp": "CASE WHEN o_totalprice < 300000 THEN 'wm' || o_orderkey END",
        "aux1": "CASE WHEN o_totalprice > 60000 THEN 'b' || o_orderkey END",
        "uid": "CASE WHEN o_totalprice > 80000 THEN o_orderkey + 3 ELSE -1 END",
        "input": "true",
    },
}
EVENT_NAME = "CASE WHEN value < 5 THEN 'arg1' WHEN value < 10 THEN 'lv2x' WHEN value < 15 THEN '2bad' WHEN value < 40 THEN event_type || CAST(event_id AS VARCHAR(20)) WHEN value < 70 THEN event_type END"
VARIABLES = {
    "A": {
        "id": "event_id",
        "owner": "user_id",
        "partner": f"CASE WHEN value > 8 THEN event_id + {SHIFT} END",
        "name": EVENT_NAME,
        "argument": "event_type IN ('click', 'view')",
        "place": "CAST(floor(value) AS INT)",
        "disguised": "event_type = 'error'",
        "mapped": "CASE WHEN value > 60 THEN 'own' || event_type END",
        "tmp": "CASE WHEN value > 20 THEN 'tmp' || event_type END",
        "aux1": "CASE WHEN value > 30 THEN 'aux' || event_type END",
        "uid": "CASE WHEN value > 25 THEN event_id ELSE -1 END",
    },
    "B": {
        "id": f"event_id + {SHIFT}",
        "owner": f"user_id + {SHIFT}",
        "partner": "CASE WHEN value > 8 THEN event_id END",
        "name": f"CASE WHEN value < 30 THEN 'far' || event_type ELSE {EVENT_NAME} END",
        "argument": "event_type IN ('click', 'view')",
        "place": "CAST(floor(value) AS INT) + 1",
        "disguised": "event_type = 'click'",
        "mapped": "CASE WHEN value > 50 THEN 'far' || event_type END",
        "tmp": "CASE WHEN value < 50 THEN 'fartmp' || event_type END",
        "aux1": "CASE WHEN value < 45 THEN 'faraux' || event_type END",
        "uid": "CASE WHEN value > 12 THEN event_id + 1 ELSE -1 END",
    },
}
FIRST_KEYS = "SELECT p_brand AS first_brand, min(p_partkey) AS first_key FROM part WHERE p_size <= 20 AND p_retailprice < 950 GROUP BY p_brand"
SOURCES = {"class": f"part LEFT JOIN ({FIRST_KEYS}) ON p_brand = first_brand", "member": "orders", "variable": "events"}
SIDES = {"class": CLASSES, "member": MEMBERS, "variable": VARIABLES}


def model(spark, sf_dir, kind: str) -> DataFrame:
    """Both sides of one kind of element, as ``cascade`` takes them."""
    if kind == "class":
        p = table(spark, sf_dir, "part")
        firsts = p.where("p_size <= 20 AND p_retailprice < 950").groupBy(F.col("p_brand").alias("first_brand")).agg(F.min("p_partkey").alias("first_key"))
        source = p.join(firsts, F.col("p_brand") == F.col("first_brand"), "left")
    else:
        source = table(spark, sf_dir, SOURCES[kind])
    a, b = (source.select(*[F.expr(e).alias(c) for c, e in side.items()]) for side in SIDES[kind].values())
    rows = a.unionByName(b)
    rows = rows.withColumn("aux", F.array(*[F.col(c) for c in ("aux1", "aux2") if c in rows.columns]))
    return rows.withColumnRenamed("outer_id", "outer") if kind == "class" else rows


def model_sql(kind: str) -> str:
    """The same rows, as a common table expression m."""
    parts = [f"SELECT {', '.join(f'{e} AS {c}' for c, e in side.items())} FROM {SOURCES[kind]}" for side in SIDES[kind].values()]
    return "m AS (" + " UNION ALL ".join(parts) + ")"


def of_types(types, one) -> DataFrame:
    rows = None
    for t in types:
        found = one(t).select(F.lit(t.name).alias("type"), "id", "full")
        rows = found if rows is None else rows.unionByName(found)
    return rows


CLASS_TYPES = (cascade.MAPPED, cascade.MAPPED_AUX_PLAIN, cascade.MAPPED_TMP_PLAIN, cascade.LOCTMP_PLAIN, cascade.AUX2, cascade.UID_PLAIN)


def class_names(spark, sf_dir):
    """Names of classes in six name spaces, those of nested ones with their outer classes'."""
    rows = model(spark, sf_dir, "class")
    return of_types(CLASS_TYPES, lambda t: cascade.class_names(rows, t))


def class_names_sql(t: cascade.NameType) -> str:
    lend = "AND {0} <> '' AND (NOT i.disguised OR e.outer_id IS NOT NULL OR i.outer_id IS NULL OR regexp_matches({0}, '^[A-Za-z_$]'))"
    inner = "CASE WHEN {0}.outer_id IS NULL THEN {0}.name ELSE string_split({0}.name, '$')[-1] END"
    aux = f"aux{t.aux}"
    choices = [
        (t.mapped, "e.mapped", "", False),
        (t.mapped, "i.mapped", lend.format("i.mapped"), True),
        (t.mapped, inner.format("e"), "AND NOT e.disguised", False),
        (t.mapped, inner.format("i"), "AND NOT i.disguised", True),
        (t.aux, f"e.{aux}", "", False),
        (t.aux, f"i.{aux}", lend.format(f"i.{aux}"), True),
        (t.tmp, "i.tmp", "", True),
        (t.tmp or t.own_tmp, "e.tmp", "", False),
        (t.plain, inner.format("e"), "", False),
    ]
    used = [c for c in choices if c[0]]
    name = " ".join(f"WHEN {n} IS NOT NULL {c} THEN {n}" for _, n, c, _ in used)
    far = " ".join(f"WHEN {n} IS NOT NULL {c} THEN {str(f).lower()}" for _, n, c, f in used)
    low = "least(CASE WHEN e.uid >= 0 THEN e.uid END, CASE WHEN i.uid >= 0 THEN i.uid END)"
    uid = f"'class_' || {low}" if t.uid else "NULL::VARCHAR"
    return f"""c AS (SELECT e.id, e.outer_id, i.outer_id AS far_outer, {uid} AS whole, CASE {name} END AS name, CASE {far} ELSE false END AS far FROM m e LEFT JOIN m i ON e.partner = i.id),
s AS (SELECT *, CASE WHEN outer_id IS NOT NULL AND far AND far_outer IS NULL THEN string_split(name, '/')[-1] ELSE name END AS simple FROM c),
n AS (SELECT s.id, CASE WHEN s.whole IS NOT NULL THEN s.whole WHEN s.simple IS NULL THEN NULL WHEN s.outer_id IS NOT NULL THEN concat_ws('$', coalesce(o.whole, o.simple), s.simple)
 WHEN s.far AND s.far_outer IS NOT NULL THEN CASE WHEN contains(coalesce(f.whole, f.simple), '/') THEN regexp_extract(coalesce(f.whole, f.simple), '^(.*/)', 1) ELSE '' END || s.simple ELSE s.simple END AS full
 FROM s LEFT JOIN s o ON s.outer_id = o.id LEFT JOIN s f ON s.far_outer = f.id)"""


def per_type(kind: str, types, of_type) -> str:
    return " UNION ALL ".join(f"(WITH {model_sql(kind)}, {of_type(t)} SELECT '{t.name}' AS type, id, \"full\" FROM n)" for t in types)


MEMBER_TYPES = (cascade.MAPPED, cascade.MAPPED_AUX_PLAIN, cascade.TMP_PLAIN, cascade.MAPPED_LOCTMP_PLAIN, cascade.UID_PLAIN)


def member_names(spark, sf_dir):
    rows = model(spark, sf_dir, "member")
    return of_types(MEMBER_TYPES, lambda t: cascade.member_names(rows, t))


def first_of(choices) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN {c} THEN {n} END" for applies, n, c in choices if applies) + ")"


UID_LEAST = "least(CASE WHEN e.uid >= 0 THEN e.uid END, CASE WHEN i.uid >= 0 THEN i.uid END)"


def member_names_sql(t: cascade.NameType) -> str:
    name = first_of(
        [
            (t.uid, f"'method_' || {UID_LEAST}", "true"),
            (t.mapped, "coalesce(e.mapped, i.mapped)", "e.input"),
            (t.mapped, "e.name", "NOT e.disguised"),
            (t.mapped, "i.name", "NOT i.disguised"),
            (t.aux, f"coalesce(e.aux{t.aux}, i.aux{t.aux})", "e.input"),
            (t.tmp, "coalesce(e.tmp, i.tmp)", "e.input"),
            (t.tmp or t.own_tmp, "e.tmp", "true"),
            (t.plain, "e.name", "true"),
        ]
    )
    return f"n AS (SELECT e.id, {name} AS full FROM m e LEFT JOIN m i ON e.partner = i.id)"


VARIABLE_TYPES = (cascade.MAPPED, cascade.MAPPED_PLAIN, cascade.AUX_PLAIN, cascade.MAPPED_TMP_PLAIN, cascade.UID_PLAIN)


def variable_names(spark, sf_dir):
    rows = model(spark, sf_dir, "variable")
    return of_types(VARIABLE_TYPES, lambda t: cascade.variable_names(rows, t))


def variable_names_sql(t: cascade.NameType) -> str:
    name = first_of(
        [
            (t.uid, f"CASE WHEN e.argument THEN 'arg_' ELSE 'var_' END || {UID_LEAST}", "true"),
            (t.mapped, "e.mapped", "true"),
            (t.mapped, "i.mapped", "true"),
            (t.mapped, "e.own_name", "NOT e.disguised"),
            (t.mapped, "i.name", "NOT i.disguised"),
            (t.aux, f"e.aux{t.aux}", "true"),
            (t.aux, f"i.aux{t.aux}", "true"),
            (t.tmp, "i.tmp", "true"),
            (t.tmp or t.own_tmp, "e.tmp", "true"),
            (t.plain, "coalesce(e.own_name, e.typed)", "true"),
        ]
    )
    return f"""v AS (SELECT *, CASE WHEN regexp_matches(name, '^[A-Za-z_$][A-Za-z0-9_$]*$') AND NOT regexp_matches(name, '^(arg|lv)[0-9]') AND count(*) OVER (PARTITION BY owner, name) = 1 THEN name END AS own_name,
 CASE WHEN argument THEN 'arg' ELSE 'lv' END || place AS typed FROM m), n AS (SELECT e.id, {name} AS full FROM v e LEFT JOIN v i ON e.partner = i.id)"""


def mapped_state(spark, sf_dir):
    """Customers as classes, with names of their nation's sort, and whether their orders have names."""
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_acctbal") > 0, F.col("c_custkey") + SHIFT).alias("partner"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")).alias("mapped"),
    )
    far = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + SHIFT).alias("id"), F.lit(None).cast("long").alias("partner"), F.when(F.col("c_nationkey") > 15, F.col("c_name")).alias("mapped")
    )
    return cascade.mapped_state(c.unionByName(far), model(spark, sf_dir, "member"))


MAPPED_STATE = f"""WITH {model_sql("member")},
c AS (SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN c_custkey + {SHIFT} END AS partner, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name END AS mapped FROM customer
 UNION ALL SELECT c_custkey + {SHIFT}, NULL, CASE WHEN c_nationkey > 15 THEN c_name END FROM customer),
h AS (SELECT e.owner, bool_or(coalesce(e.mapped, i.mapped) IS NOT NULL) AS below FROM m e LEFT JOIN m i ON e.partner = i.id GROUP BY 1)
SELECT e.id, coalesce(e.mapped, i.mapped) IS NOT NULL AS has_mapped, coalesce(below, false) AS has_mapped_children FROM c e LEFT JOIN c i ON e.partner = i.id LEFT JOIN h ON h.owner = e.id"""

TYPE_ID = f"repeat('[', p_size // 20) || CASE WHEN p_type = 'ECONOMY' THEN 'J' WHEN p_type = 'PROMO' THEN 'Z' ELSE 'La/' || {PART_NAME} || '$In;' END"


def type_names(spark, sf_dir):
    """Ids of types made of parts: their names, dimensions, sizes and how they are shown."""
    p = table(spark, sf_dir, "part")
    id_ = F.expr(TYPE_ID.replace("//", " div ").replace("p_size  div  20", "CAST(p_size div 20 AS INT)"))
    rows = p.select(F.col("p_partkey").alias("part"), id_.alias("type"))
    name = descriptors.name_of(F.col("type"))
    return rows.select(
        "part",
        name.alias("name"),
        descriptors.id_of(name).alias("back"),
        descriptors.dimensions(F.col("type")).alias("dims"),
        descriptors.slot_size(F.col("type")).alias("slots"),
        descriptors.is_primitive(F.col("type")).alias("primitive"),
        descriptors.display(F.col("type")).alias("shown"),
        descriptors.display(F.col("type"), full=False).alias("short"),
        descriptors.is_identifier(F.col("type")).alias("identifier"),
    )


TYPE_NAMES = f"""WITH t AS (SELECT p_partkey AS part, {TYPE_ID} AS type FROM part),
e AS (SELECT *, ltrim(type, '[') AS el, length(type) - length(ltrim(type, '[')) AS dims, CASE WHEN type LIKE 'L%' THEN substr(type, 2, length(type) - 2) ELSE type END AS name FROM t),
s AS (SELECT *, CASE el WHEN 'J' THEN 'long' WHEN 'Z' THEN 'boolean' ELSE replace(substr(el, 2, length(el) - 2), '/', '.') END || repeat('[]', dims) AS shown FROM e)
SELECT part, name, CASE WHEN name LIKE '[%' THEN name ELSE 'L' || name || ';' END AS back, dims::INT AS dims, CASE WHEN type = 'J' THEN 2 ELSE 1 END AS slots, type NOT LIKE 'L%' AND type NOT LIKE '[%' AS primitive,
 shown, string_split(shown, '.')[-1] AS short, regexp_full_match(type, '[A-Za-z_$][A-Za-z0-9_$]*') AS identifier FROM s"""


def flag_formats(spark, sf_dir):
    """Flags made of lines' quantities, as those of each kind of element."""
    flags = (F.col("l_quantity").cast("int") * 1103 + F.col("l_linenumber") * 4097).bitwiseAND(F.lit(0x7FFFF))
    rows = table(spark, sf_dir, "lineitem").select(flags.alias("flags")).distinct()
    parent = F.when(F.col("flags") % 3 == 0, "java/lang/Record").otherwise("java/lang/Object")
    return rows.select("flags", *[descriptors.flags_of(F.col("flags"), kind).alias(kind) for kind in descriptors.KINDS], descriptors.effective_flags(F.col("flags"), parent).alias("effective"))


def flags_sql(kind: str) -> str:
    own = [(bit, name) for bit, name, kinds in descriptors.FLAGS if kinds & descriptors.KINDS[kind]]
    rest = f"(flags & {0x7FFFF & ~sum({bit for bit, _ in own})})"
    known = ", ".join(f"CASE WHEN flags & {bit} <> 0 THEN '{name}' END" for bit, name in own)
    return f"concat_ws(' ', {known}, CASE WHEN {rest} <> 0 THEN '0x' || lower(to_hex({rest})) END) AS \"{kind}\""


FLAG_FORMATS = f"""WITH f AS (SELECT DISTINCT (l_quantity::INT * 1103 + l_linenumber * 4097) & {0x7FFFF} AS flags FROM lineitem)
SELECT flags, {", ".join(map(flags_sql, descriptors.KINDS))}, flags | CASE WHEN flags % 3 = 0 THEN {descriptors.RECORD} ELSE 0 END AS effective FROM f"""


def name_types(spark, sf_dir):
    """Every name type, its name in a file, and the types it goes over to; an impossible one is null."""

    def tried(change, *args):
        try:
            return change(*args).name
        except ValueError:
            return None

    def space(t):
        try:
            return t.space
        except ValueError:
            return None

    rows = [
        (t.name, space(t), tried(cascade.with_plain, t, not t.plain), tried(cascade.with_mapped, t, not t.mapped), tried(cascade.with_aux, t, 1, True), tried(cascade.with_tmp, t, not t.tmp), tried(cascade.with_own_tmp, t, not t.own_tmp))
        for t in cascade.TYPES
    ]
    known = spark.createDataFrame(rows, "type string, space string, plain string, mapped string, second string, tmp string, own_tmp string")
    # each nation is shown in the type of its number
    n = table(spark, sf_dir, "nation").withColumn("type", F.get(F.array(*[F.lit(t.name) for t in cascade.TYPES]), F.col("n_nationkey") % len(cascade.TYPES)))
    return n.join(known, "type").select("n_nationkey", "type", "space", "plain", "mapped", "second", "tmp", "own_tmp")


NAME_TYPES = """WITH t(i, type, space, plain, mapped, second, tmp, own_tmp) AS (VALUES
 (0, 'PLAIN', 'official', NULL, 'MAPPED_PLAIN', 'AUX2_PLAIN', 'TMP_PLAIN', 'PLAIN'), (1, 'MAPPED', 'named', 'MAPPED_PLAIN', 'PLAIN', 'MAPPED_AUX2_PLAIN', 'MAPPED_TMP_PLAIN', 'MAPPED'),
 (2, 'AUX', 'aux', 'AUX_PLAIN', 'MAPPED_AUX_PLAIN', 'AUX2', 'TMP_PLAIN', 'AUX'), (3, 'AUX2', 'aux1', 'AUX2_PLAIN', 'MAPPED_AUX2_PLAIN', 'AUX2', 'TMP_PLAIN', 'AUX2'),
 (4, 'MAPPED_PLAIN', 'named', 'MAPPED', 'PLAIN', 'MAPPED_AUX2_PLAIN', 'MAPPED_TMP_PLAIN', 'MAPPED_PLAIN'), (5, 'MAPPED_AUX_PLAIN', 'named-aux', NULL, 'AUX_PLAIN', 'MAPPED_AUX2_PLAIN', 'MAPPED_TMP_PLAIN', 'MAPPED_AUX_PLAIN'),
 (6, 'MAPPED_AUX2_PLAIN', NULL, NULL, 'AUX2_PLAIN', 'MAPPED_AUX2_PLAIN', 'MAPPED_TMP_PLAIN', 'MAPPED_AUX2_PLAIN'), (7, 'MAPPED_TMP_PLAIN', 'named-tmp', NULL, 'TMP_PLAIN', 'MAPPED_AUX2_PLAIN', 'MAPPED_PLAIN', 'MAPPED_LOCTMP_PLAIN'),
 (8, 'MAPPED_LOCTMP_PLAIN', 'named-tmp', NULL, 'LOCTMP_PLAIN', 'MAPPED_AUX2_PLAIN', 'MAPPED_TMP_PLAIN', 'MAPPED_TMP_PLAIN'), (9, 'UID_PLAIN', 'intermediary', NULL, 'MAPPED_PLAIN', 'AUX2_PLAIN', 'TMP_PLAIN', 'UID_PLAIN'),
 (10, 'TMP_PLAIN', 'tmp', NULL, 'MAPPED_TMP_PLAIN', 'AUX2_PLAIN', 'PLAIN', 'LOCTMP_PLAIN'), (11, 'LOCTMP_PLAIN', 'tmp', NULL, 'MAPPED_PLAIN', 'AUX2_PLAIN', 'TMP_PLAIN', 'TMP_PLAIN'),
 (12, 'AUX_PLAIN', 'aux', 'AUX', 'MAPPED_AUX_PLAIN', 'AUX2_PLAIN', 'TMP_PLAIN', 'AUX_PLAIN'), (13, 'AUX2_PLAIN', 'aux1', 'AUX2', 'MAPPED_AUX2_PLAIN', 'AUX2_PLAIN', 'TMP_PLAIN', 'AUX2_PLAIN'))
SELECT n_nationkey, type, space, plain, mapped, second, tmp, own_tmp FROM nation JOIN t ON n_nationkey % 14 = i"""

QUERIES = {f.__name__: f for f in (class_names, member_names, variable_names, mapped_state, type_names, flag_formats, name_types)}
ORACLES = {
    "class_names": per_type("class", CLASS_TYPES, class_names_sql),
    "member_names": per_type("member", MEMBER_TYPES, member_names_sql),
    "variable_names": per_type("variable", VARIABLE_TYPES, variable_names_sql),
    "mapped_state": MAPPED_STATE,
    "type_names": TYPE_NAMES,
    "flag_formats": FLAG_FORMATS,
    "name_types": NAME_TYPES,
}
