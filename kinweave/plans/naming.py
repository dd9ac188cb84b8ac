"""Queries about names, ids, filters, sorting, sets, files and match files, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import filters, text
from kinweave.operators import names, similarity
from kinweave.sources import matchfile

from .tables import SHIFT, side, table


def parts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"))


def resolve_name(spark, sf_dir):
    """Own mapped name, the partner's, an auxiliary one, or the plain one."""
    p = parts(spark, sf_dir)
    chosen = names.resolved((p["id"] % 5 == 0, F.concat(F.lit("mapped "), p["name"])), (p["id"] % 3 == 0, F.concat(F.lit("partner "), p["brand"])), (p["size"] > 40, p["type"]), (F.lit(True), p["name"]))
    return p.select("id", chosen.alias("name"))


def uid_min(spark, sf_dir):
    p = parts(spark, sf_dir)
    own, other = F.when(p["id"] % 4 == 0, -1).otherwise(p["id"] * 2), F.when(p["id"] % 6 == 0, F.lit(None)).otherwise(p["id"] + 100)
    return p.select("id", names.least_uid(own.cast("long"), other.cast("long")).alias("uid"))


def uid_assign(spark, sf_dir):
    """Ids for parts without one, in the order of their names, a brand and type sharing one id."""
    missing = parts(spark, sf_dir).where("size > 15").groupBy("brand", "type").agg(F.min(F.struct("name", "id")).alias("first"))
    return names.numbered(missing.select("brand", "type", F.col("first.name").alias("name"), F.col("first.id").alias("id")), ["name", "id"], "uid", 1000).select("brand", "type", "uid")


def temp_names(spark, sf_dir):
    """Temporary names of the suppliers' disguised members: a counter in each nation."""
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 500").select("s_suppkey", "s_nationkey", "s_name")
    counted = names.numbered(s, ["s_name"], "counter", group="s_nationkey")
    return counted.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("m"), F.col("counter").cast("string")).alias("name"))


def slot_offsets(spark, sf_dir):
    """First slot of each line of an order, where lines of more than 25 take two slots."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, -1)
    size = F.when(F.col("l_quantity") > 25, 2).otherwise(1)
    rows = table(spark, sf_dir, "lineitem").withColumn("slot", F.coalesce(F.sum(size).over(order), F.lit(0)))
    return rows.groupBy("l_orderkey").agg(F.sum("slot").alias("slots"), F.max("slot").alias("last"))


def propagate_names(spark, sf_dir):
    p = parts(spark, sf_dir).withColumn("mapped", F.when(F.col("id") % 7 == 0, F.col("name")))
    return names.propagated(p, "brand", "id", "mapped").select("id", "mapped")


def mapping_upsert(spark, sf_dir):
    p = parts(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, F.col("name")).alias("name"))
    new = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.concat(F.lit("line "), F.col("l_orderkey").cast("string")).alias("name"))
    return names.upserted(p, new, "id", "name", False)


def mapping_export_once(spark, sf_dir):
    return names.once_per_group(parts(spark, sf_dir).select("brand", "id", "name"), "brand", "id").select("brand", "id", "name")


def link_components(spark, sf_dir):
    """A supplier's accessor among its lines: same nation's customer with equal balance sign, preferring one with orders."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    read = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("read", F.lit(1))
    # all suppliers of a nation and sign get the same customer, so that is chosen before the join
    best = c.join(read, "c_custkey", "left").groupBy("c_nationkey", (F.col("c_acctbal") < 0).alias("owing"))
    best = best.agg(F.min_by("c_custkey", F.struct(-F.coalesce("read", F.lit(0)), "c_custkey")).alias("linked"))
    return s.join(best, (F.col("s_nationkey") == F.col("c_nationkey")) & ((F.col("s_acctbal") < 0) == F.col("owing"))).select(F.col("s_suppkey").alias("id"), "linked")


def display_filter(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.where("s_acctbal > 0 AND s_nationkey < 20").select(F.col("s_suppkey").alias("id"), "s_name")


def text_filter(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    line = F.lower(F.concat_ws(" ", F.format_string("%.3f", F.col("p_retailprice")), "p_name"))
    return p.where(F.contains(line, F.lit("1"))).select(F.col("p_partkey").alias("id"), line.alias("line"))


def postfix_filter(spark, sf_dir):
    p = parts(spark, sf_dir)
    columns = {"name": p["name"], "brand": p["brand"], "type": p["type"]}
    kept = None
    for i, f in enumerate(("pop brand Brand#11 eq swap name 1 contains and", "brand Brand#11 startswith", "Brand#11 eq", "dup eq brand Brand#22 eq not and")):
        rows = p.where(filters.compiled(f, columns, p["brand"])).select(F.lit(i).alias("filter"), "id")
        kept = rows if kept is None else kept.unionByName(rows)
    return kept.groupBy("filter").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def _placed(rows: DataFrame, key, group: str = "brand") -> DataFrame:
    """Places in a group. There are few groups however many rows, so each is numbered by many tasks."""
    numbered = names.numbered(rows.select("id", group, key.alias("key")), ["key", "id"], "place", 1, group=group)
    return numbered.select("id", F.col("place").cast("int").alias("place"))


def short_first_sort(spark, sf_dir):
    p = parts(spark, sf_dir)
    return _placed(p, names.short_first(p["name"]))


def nest_aware_sort(spark, sf_dir):
    p = parts(spark, sf_dir).withColumn("nested", F.concat_ws("$", "type", "brand", "name"))
    return _placed(p, names.nest_aware(F.col("nested")))


def natural_sort(spark, sf_dir):
    p = parts(spark, sf_dir).withColumn("numbered", F.concat_ws(" ", "brand", "name", "size"))
    return _placed(p, names.natural(F.col("numbered")), "type")


PATH = "replace(type, ' ', CASE WHEN size < 20 THEN '/' WHEN size < 40 THEN '.' ELSE '$' END) || CAST(size AS STRING) || CASE WHEN size % 3 = 0 THEN '/' WHEN size % 3 = 1 THEN '$' ELSE '' END || name"


def natural_order(spark, sf_dir):
    """Places of parts by the natural order of paths made of their types, sizes and names; the key is sorted as bytes."""
    p = parts(spark, sf_dir)
    return _placed(p.withColumn("path", F.expr(PATH)), names.natural_key(F.col("path")))


def status_sort(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(status, F.desc("o_totalprice"), "o_orderkey"))
    return o.select(F.col("o_orderkey").alias("id"), place.alias("place"))


def set_ops(spark, sf_dir):
    a, b = (side(table(spark, sf_dir, "lineitem"), x).select("l_partkey") for x in (1, 0))
    sets = {"union": a.union(b).distinct(), "both": a.intersect(b), "only_a": a.subtract(b), "all": a.union(b), "rest": a.exceptAll(b)}
    out = None
    for name, frame in sets.items():
        row = frame.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum("l_partkey").alias("keys"))
        out = row if out is None else out.unionByName(row)
    return out


def name_parts(spark, sf_dir):
    n = parts(spark, sf_dir).withColumn("full", F.concat(F.regexp_replace("brand", "#", "/"), F.lit("/"), F.regexp_replace("type", " ", "$$")))
    return n.select("id", text.package_of(F.col("full")).alias("package"), text.outer_of(F.col("full")).alias("outer"), text.inner_of(F.col("full")).alias("inner"))


def flag_names(spark, sf_dir):
    return parts(spark, sf_dir).select("id", text.flag_names(F.col("size"), ("public", "private", "protected", "static")).alias("flags"))


def descriptor_names(spark, sf_dir):
    """Types of an order's lines as one descriptor; null if any part has none."""
    p = parts(spark, sf_dir).select(F.col("id").alias("l_partkey"), F.when(F.col("size") < 49, F.col("brand")).alias("t"))
    rows = table(spark, sf_dir, "lineitem").join(p, "l_partkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("t")).alias("known"), F.count("*").alias("n"))
    return rows.select("l_orderkey", F.when(F.size("known") == F.col("n"), F.concat(F.lit("("), F.array_join("known", ""), F.lit(")"))).alias("descriptor"))


def sorted_name_list(spark, sf_dir):
    """Suppliers of an order, by name."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(s, "l_suppkey")
    return rows.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list("s_name")), "\n").alias("names"))


def file_identity(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"), F.base64(F.unhex(F.md5(F.col("text").cast("binary")))).alias("hash"))


def jaccard_docs(spark, sf_dir):
    """Documents that share lines of 40 characters or more, each with the first document of every such line, their similarity over all such lines, and their class."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.split("text", "\n")).alias("token")).where(F.length("token") >= 40)
    return similarity.by_shared_tokens(lines).withColumn("similarity", F.round("similarity", 6))


def _match_lines(spark, sf_dir) -> DataFrame:
    owners = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("x"), F.col("n_nationkey") + 1).alias("b"))
    members = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("owner"), F.when(F.col("s_suppkey") % 2 == 0, "m").otherwise("f").alias("kind"),
                                                     F.concat(F.lit("s"), "s_suppkey").alias("a"), F.concat(F.lit("t"), F.col("s_suppkey") + SHIFT).alias("b"))
    return matchfile.lines(owners, members)


def matchfile_lines(spark, sf_dir):
    return _match_lines(spark, sf_dir).groupBy("value").agg(F.count("*").alias("n"))


def matchfile_parse(spark, sf_dir):
    """Parse the lines that were made, a file for each class with its members below it."""
    rows = _match_lines(spark, sf_dir)
    line = F.row_number().over(Window.partitionBy(F.get("sort", F.lit(0))).orderBy("sort"))
    parsed = matchfile.parsed(rows.select(F.get("sort", F.lit(0)).alias("file"), line.alias("line"), "value"))
    return parsed.groupBy("tag", "owner_a", "owner_b").agg(F.count("*").alias("n"), F.min("first").alias("first"))


PART = "p AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size FROM part)"
FULL = "n AS (SELECT id, replace(brand, '#', '/') || '/' || replace(type, ' ', '$$') AS f FROM p)"
MATCH_LINES = f"""o AS (SELECT 'n' || n_nationkey AS a, 'x' || (n_nationkey + 1) AS b FROM nation),
m AS (SELECT 'n' || s_nationkey AS owner, CASE WHEN s_suppkey % 2 = 0 THEN 'm' ELSE 'f' END AS kind, 's' || s_suppkey AS a, 't' || (s_suppkey + {SHIFT}) AS b FROM supplier)"""

ORACLES = {
    "resolve_name": f"WITH {PART} SELECT id, CASE WHEN id % 5 = 0 THEN 'mapped ' || name WHEN id % 3 = 0 THEN 'partner ' || brand WHEN size > 40 THEN type ELSE name END AS name FROM p",
    "uid_min": f"""WITH {PART}, u AS (SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE id * 2 END AS x, CASE WHEN id % 6 = 0 THEN NULL ELSE id + 100 END AS y FROM p)
SELECT id, coalesce(least(x, y), x, y, -1) AS uid FROM u""",
    "uid_assign": f"""WITH {PART}, f AS (SELECT brand, type, min({{'n': name, 'i': id}}) AS s FROM p WHERE size > 15 GROUP BY 1, 2) SELECT brand, type, row_number() OVER (ORDER BY s.n, s.i) + 999 AS uid FROM f""",
    "temp_names": "SELECT s_suppkey AS id, 'm' || (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) - 1) AS name FROM supplier WHERE s_acctbal > 500",
    "slot_offsets": """WITH r AS (SELECT l_orderkey, coalesce(sum(CASE WHEN l_quantity > 25 THEN 2 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice
ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS slot FROM lineitem) SELECT l_orderkey, sum(slot)::BIGINT AS slots, max(slot)::BIGINT AS last FROM r GROUP BY 1""",
    "propagate_names": f"WITH {PART}, f AS (SELECT brand, arg_min(name, id) AS first FROM p WHERE id % 7 = 0 GROUP BY 1) SELECT id, CASE WHEN id % 7 = 0 THEN name ELSE first END AS mapped FROM p LEFT JOIN f USING (brand)",
    "mapping_upsert": f"""WITH {PART}, n AS (SELECT l_partkey AS id, min('line ' || l_orderkey) AS v FROM lineitem GROUP BY 1)
SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN name END, v) AS name FROM p LEFT JOIN n USING (id)""",
    "mapping_export_once": f"WITH {PART} SELECT brand, min(id) AS id, arg_min(name, id) AS name FROM p GROUP BY 1",
    "link_components": """WITH b AS (SELECT s_suppkey AS id, c_custkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 0 ELSE 1 END, c_custkey) AS r
FROM supplier JOIN customer ON s_nationkey = c_nationkey AND (s_acctbal < 0) = (c_acctbal < 0)) SELECT id, c_custkey AS linked FROM b WHERE r = 1""",
    "display_filter": "SELECT s_suppkey AS id, s_name FROM supplier WHERE s_acctbal > 0 AND s_nationkey < 20",
    "text_filter": "WITH t AS (SELECT p_partkey AS id, lower(printf('%.3f', p_retailprice) || ' ' || p_name) AS line FROM part) SELECT * FROM t WHERE contains(line, '1')",
    "postfix_filter": f"""WITH {PART}, k AS (SELECT 0 AS f, id FROM p UNION ALL SELECT 1, id FROM p UNION ALL SELECT 2, id FROM p WHERE brand = 'Brand#11' UNION ALL SELECT 3, id FROM p WHERE brand <> 'Brand#22')
SELECT f AS filter, count(*) AS n, sum(id)::BIGINT AS ids FROM k GROUP BY 1""",
    "short_first_sort": f"WITH {PART} SELECT id, row_number() OVER (PARTITION BY brand ORDER BY name IS NULL, length(name), name, id)::INT AS place FROM p",
    "nest_aware_sort": f"""WITH {PART}, n AS (SELECT id, brand, list_transform(string_split(type || '$' || brand || '$' || name, '$'), lambda x: {{'l': length(x), 'x': x}}) AS k FROM p)
SELECT id, row_number() OVER (PARTITION BY brand ORDER BY k, id)::INT AS place FROM n""",
    "natural_sort": f"""WITH {PART}, n AS (SELECT id, type, list_transform(regexp_extract_all(brand || ' ' || name || ' ' || size, '[0-9]+|[^0-9]+'),
lambda x: {{'d': regexp_matches(x, '^[0-9]'), 'l': CASE WHEN regexp_matches(x, '^[0-9]') THEN length(x) ELSE 0 END, 'x': x}}) AS k FROM p)
SELECT id, row_number() OVER (PARTITION BY type ORDER BY k, id)::INT AS place FROM n""",
    "natural_order": f"""WITH {PART}, n AS (SELECT id, brand, regexp_extract_all({PATH}, '[./$]|[0-9]+|[^0-9./$]+') AS runs FROM p),
k AS (SELECT id, brand, list_transform(runs, lambda x, i: {{'inner': len(list_filter(runs[i:], lambda y: y IN ('.', '/'))) > 0, 'first': CASE WHEN regexp_matches(x, '^[0-9]') THEN '0' ELSE x END,
  'l': CASE WHEN regexp_matches(x, '^[0-9]') THEN length(x) ELSE 0 END, 'x': x}}) AS k FROM n)
SELECT id, row_number() OVER (PARTITION BY brand ORDER BY k, id)::INT AS place FROM k""",
    "status_sort": """SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey)::INT AS place FROM orders""",
    "set_ops": """WITH a AS (SELECT l_partkey AS k FROM lineitem WHERE l_linenumber % 2 = 1), b AS (SELECT l_partkey AS k FROM lineitem WHERE l_linenumber % 2 = 0),
s AS (SELECT 'union' AS name, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'both', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'only_a', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
UNION ALL SELECT 'all', k FROM (SELECT k FROM a UNION ALL SELECT k FROM b) UNION ALL SELECT 'rest', k FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b)), g AS (SELECT name, count(*) AS n, sum(k)::BIGINT AS keys FROM s GROUP BY 1)
SELECT names.name, coalesce(n, 0) AS n, keys FROM (VALUES ('union'), ('both'), ('only_a'), ('all'), ('rest')) names(name) LEFT JOIN g USING (name)""",
    "name_parts": f"""WITH {PART}, {FULL}, q AS (SELECT id, f, regexp_extract(f, '^(.*[^/$])\\$[^/$]+$', 1) AS o FROM n)
SELECT id, regexp_extract(f, '^(.*)/[^/]*$', 1) AS package, nullif(o, '') AS outer, CASE WHEN o <> '' THEN list_last(string_split(f, '$')) ELSE list_last(string_split(f, '/')) END AS inner FROM q""",
    "flag_names": f"""WITH {PART} SELECT id, array_to_string(list_filter([CASE WHEN size & 1 <> 0 THEN 'public' END, CASE WHEN size & 2 <> 0 THEN 'private' END, CASE WHEN size & 4 <> 0 THEN 'protected' END,
CASE WHEN size & 8 <> 0 THEN 'static' END, CASE WHEN size >= 16 THEN '0x' || lower(to_hex(size - size % 16)) END], lambda x: x IS NOT NULL), ' ') AS flags FROM p""",
    "descriptor_names": f"""WITH {PART} SELECT l_orderkey, CASE WHEN count(*) = count(CASE WHEN size < 49 THEN 1 END) THEN '(' || string_agg(brand, '' ORDER BY brand) || ')' END AS descriptor
FROM lineitem JOIN p ON l_partkey = id GROUP BY 1""",
    "sorted_name_list": "SELECT l_orderkey, string_agg(s_name, chr(10) ORDER BY s_name) AS names FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1",
    "file_identity": "SELECT doc_id, strlen(text)::BIGINT AS size, sha256(text) AS sha256, to_base64(unhex(md5(text))) AS hash FROM documents",
    "jaccard_docs": """WITH RECURSIVE t AS (SELECT DISTINCT doc_id AS id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 40),
p AS MATERIALIZED (SELECT DISTINCT f.a, t.id AS b FROM t JOIN (SELECT line, min(id) AS a FROM t GROUP BY 1) f USING (line) WHERE t.id <> f.a),
l AS (SELECT id, list(line) AS v FROM t GROUP BY 1), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a), g AS (SELECT a, min(least(a, b)) AS class_id FROM reach GROUP BY 1)
SELECT p.a, p.b, len(list_intersect(x.v, y.v)) AS common, round(len(list_intersect(x.v, y.v)) / (len(x.v) + len(y.v) - len(list_intersect(x.v, y.v)))::DOUBLE, 6) AS similarity, class_id
FROM p JOIN l x ON x.id = p.a JOIN l y ON y.id = p.b JOIN g ON g.a = p.b""",
    "matchfile_lines": f"WITH {MATCH_LINES}, l AS (SELECT 'c' || chr(9) || a || chr(9) || b AS value FROM o UNION ALL SELECT chr(9) || kind || chr(9) || a || chr(9) || b FROM m) SELECT value, count(*) AS n FROM l GROUP BY 1",
    "matchfile_parse": f"""WITH {MATCH_LINES}, l AS (SELECT 'c' AS tag, a AS owner_a, b AS owner_b, a AS f FROM o UNION ALL SELECT kind, m.owner, o.b, m.a FROM m JOIN o ON m.owner = o.a)
SELECT tag, owner_a, owner_b, count(*) AS n, min(f) AS first FROM l GROUP BY 1, 2, 3""",
}

QUERIES = {
    f.__name__: f
    for f in (
        resolve_name, uid_min, uid_assign, temp_names, slot_offsets, propagate_names, mapping_upsert, mapping_export_once, link_components, display_filter, text_filter, postfix_filter,
        short_first_sort, nest_aware_sort, natural_sort, natural_order, status_sort, set_ops, name_parts, flag_names, descriptor_names, sorted_name_list, file_identity, jaccard_docs, matchfile_lines, matchfile_parse,
    )
}
