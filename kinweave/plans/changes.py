"""Queries about signatures, the resolution of members and the journal of matches over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.operators import graph, journal, lookups, signatures

from kinweave.storage import stored

from .tables import table

#: A part's generic type on either side: what it is of, and its argument by size or price.
A_ARGUMENT = "CASE WHEN p_size < 10 THEN 'TK;' WHEN p_size < 25 THEN '+L' || p_brand || ';' WHEN p_size < 40 THEN '[I' ELSE '*' END"
B_ARGUMENT = "CASE WHEN p_retailprice < 920 THEN 'TOther;' WHEN p_retailprice < 950 THEN '+L' || p_brand || ';' WHEN p_retailprice < 1000 THEN '[I' ELSE '*' END"


def signature_equality(spark, sf_dir):
    """Parts of one brand and size: whether the type of the one, a class with an argument, could be that of the other. Three types are disguised on side A, brands are plain."""
    p = table(spark, sf_dir, "part")
    texts = [p.selectExpr("p_partkey AS key", "CAST(p_partkey AS STRING) AS owner", "'field' AS kind", f"'L' || p_type || '<' || {argument} || '>;' AS text") for argument in (A_ARGUMENT, B_ARGUMENT)]
    nodes = [signatures.trees(t.select("owner", "kind", "text")).withColumn("id", F.col("owner").cast("long")) for t in texts]
    left, right = (
        n.select(F.col("id").alias(letter), "path", "label", F.lit(None).cast("string").alias("key"), F.col("class").alias("name"), (F.lit(letter == "a") & F.coalesce(F.col("class").isin("ECONOMY", "PROMO", "LARGE"), F.lit(False))).alias("disguised"))
        for n, letter in zip(nodes, "ab", strict=True)
    )
    sides = [p.select(F.col("p_partkey").alias(letter), "p_brand", "p_size") for letter in "ab"]
    return signatures.could_be_within(["p_brand", "p_size"], *sides, left, right)


SIGNATURE_EQUALITY = f"""
WITH a AS (SELECT p_partkey AS k, p_type AS t, p_brand, p_size, {A_ARGUMENT} AS g FROM part), b AS (SELECT p_partkey AS k, p_type AS t, p_brand, p_size, {B_ARGUMENT} AS g FROM part)
SELECT a.k AS a, b.k AS b, CASE WHEN (a.t = b.t OR a.t IN ('ECONOMY', 'PROMO', 'LARGE')) AND ((a.g[1] = 'T' AND b.g[1] IN ('T', '[')) OR (a.g[1] = '[' AND b.g[1] = '[') OR (a.g[1] = '*' AND b.g[1] = '*') OR (a.g[1] = '+' AND a.g = b.g)) THEN 1e0 ELSE 0e0 END AS similarity
FROM a JOIN b USING (p_brand, p_size)"""

#: Parts as classes: the first of a brand is the parent of its other parts. A part has its type and its brand as interfaces, a brand the group of its first digit, a type and a group
#: the one interface above all. What they declare: a tenth of the sizes.
SUPERS = "SELECT p_partkey AS k, p_brand AS brand, p_type AS type, p_size // 10 AS q, p_retailprice AS price, min(p_partkey) OVER (PARTITION BY p_brand) AS first FROM part"
FACES = """SELECT 'p' || k AS sub, 't' || type AS sup, 0 AS ord FROM s UNION ALL SELECT 'p' || k, 'b' || brand, 1 FROM s
  UNION ALL SELECT DISTINCT 'b' || brand, 'g' || substr(brand, 7, 1), 0 FROM s UNION ALL SELECT DISTINCT 't' || type, 'all', 0 FROM s UNION ALL SELECT DISTINCT 'g' || substr(brand, 7, 1), 'all', 0 FROM s"""
MEMBERS = """SELECT 'p' || k AS owner, 'q' || q AS name, false AS abstract FROM s WHERE price > 1000 UNION ALL SELECT 'b' || brand, 'q' || q, min(price) < 930 FROM s WHERE price < 960 GROUP BY brand, q
  UNION ALL SELECT 't' || type, 'q' || q, min(price) < 910 FROM s WHERE price < 990 AND q <> 1 GROUP BY type, q UNION ALL SELECT DISTINCT 'g' || substr(brand, 7, 1), 'q' || q, true FROM s WHERE q <> 3 UNION ALL SELECT DISTINCT 'all', 'q' || q, q = 3 FROM s"""


def program(spark, sf_dir):
    """(wanted, ways up by parents, interfaces with their order, members)."""
    p = table(spark, sf_dir, "part")
    # the first of a brand by a join: a window would take all of a brand's parts into one task
    first = p.groupBy(F.col("p_brand").alias("of")).agg(F.min("p_partkey").alias("first"))
    s = p.join(first, p["p_brand"].eqNullSafe(first["of"])).selectExpr("p_partkey AS k", "p_brand AS brand", "p_type AS type", "p_size div 10 AS q", "p_retailprice AS price", "first")
    s = stored(s, "supers")
    run = lambda body: spark.sql(f"WITH s AS (SELECT * FROM {{supers}}) {body}", supers=s)
    wanted = run("SELECT 'p' || k AS owner, 'q' || n AS name FROM s LATERAL VIEW explode(sequence(0, 5)) AS n")
    classes = run("SELECT 'p' || k AS sub, 'p' || k AS sup, 0 AS distance FROM s UNION ALL SELECT 'p' || k, 'p' || first, 1 FROM s WHERE k <> first")
    members = run(f"SELECT *, owner || '.' || name AS member FROM ({MEMBERS})")
    return wanted, classes, run(FACES), members


def method_resolution(spark, sf_dir):
    """What a call of each name on each part means."""
    wanted, classes, faces, members = program(spark, sf_dir)
    up = classes.select("sub", F.col("sup").alias("via")).join(graph.closure(faces.select(F.col("sub").alias("src"), F.col("sup").alias("dst"))).select(F.col("sub").alias("via"), "sup"), "via").where("via <> sup").select("sub", "sup")
    faces_only = graph.closure(faces.where("sub NOT LIKE 'p%'").select(F.col("sub").alias("src"), F.col("sup").alias("dst"))).where("sub <> sup").select("sub", "sup")
    told = members.select("*", *[F.lit(v).alias(n) for n, v in (("private", False), ("static", False), ("public", True))])
    found = lookups.specific_methods(wanted.withColumn("faced", F.lit(False)), classes, up.unionByName(faces_only).distinct(), told)
    return found.select("owner", "name", "member")


def field_resolution(spark, sf_dir):
    """What an access to each name on each part means."""
    wanted, classes, faces, members = program(spark, sf_dir)
    return lookups.resolved_fields(wanted, classes, lookups.interface_paths(faces), members).select("owner", "name", "member")


PROGRAM = f"""
WITH RECURSIVE s AS ({SUPERS}), wanted AS (SELECT 'p' || k AS owner, 'p' || first AS parent, 'q' || n AS name FROM (SELECT *, unnest(range(0, 6)) AS n FROM s)), faces AS ({FACES}), members AS (SELECT *, owner || '.' || name AS member FROM ({MEMBERS})),
above AS (SELECT sub, sup, ord::VARCHAR AS way FROM faces UNION ALL SELECT above.sub, faces.sup, way || '.' || (9 - ord) FROM above JOIN faces ON above.sup = faces.sub)"""
METHOD_RESOLUTION = f"""{PROGRAM},
own AS (SELECT w.owner, w.name, coalesce(a.member, b.member) AS member FROM wanted w LEFT JOIN members a ON a.owner = w.owner AND a.name = w.name LEFT JOIN members b ON b.owner = w.parent AND b.name = w.name),
met AS (SELECT DISTINCT w.owner, w.name, sup, member, abstract FROM wanted w JOIN above ON sub IN (w.owner, w.parent) JOIN members m ON m.owner = sup AND m.name = w.name),
good AS (SELECT * FROM met WHERE NOT abstract OR (owner, name) NOT IN (SELECT (owner, name) FROM met WHERE NOT abstract)),
best AS (SELECT owner, name, min(member) AS face FROM good g WHERE NOT EXISTS (SELECT 1 FROM good h JOIN above ON sub = h.sup WHERE h.owner = g.owner AND h.name = g.name AND above.sup = g.sup) GROUP BY 1, 2)
SELECT owner, name, coalesce(member, face) AS member FROM own LEFT JOIN best USING (owner, name)"""
FIELD_RESOLUTION = f"""{PROGRAM},
far AS (SELECT w.owner, w.name, member, row_number() OVER (PARTITION BY w.owner, w.name ORDER BY way) AS r FROM wanted w JOIN above ON sub = w.owner JOIN members m ON m.owner = sup AND m.name = w.name)
SELECT w.owner, w.name, coalesce(a.member, far.member, b.member) AS member FROM wanted w LEFT JOIN members a ON a.owner = w.owner AND a.name = w.name LEFT JOIN far ON far.owner = w.owner AND far.name = w.name AND r = 1 LEFT JOIN members b ON b.owner = w.parent AND b.name = w.name"""

#: Orders as changes of their day: of a customer and a priority; a finished one undoes what others did, a very dear one is a reset.
DAY = "CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT)"
DEAR = 499_000


def changes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("time", F.unix_date(F.col("o_orderdate").cast("date")).cast("long"))
    done = F.col("o_orderstatus") == "F"
    rows = o.select("time", F.when(done, "unmatch").otherwise("match").alias("kind"), F.col("o_custkey").cast("string").alias("a"), F.col("o_orderpriority").alias("b"), F.lit(None).cast("string").alias("cause"))
    resets = o.where(F.col("o_totalprice") > DEAR).select("time", F.lit("reset").alias("kind"), *[F.lit(None).cast("string").alias(c) for c in ("a", "b", "cause")])
    return rows.unionByName(resets)


def journal_state(spark, sf_dir):
    return journal.state_at(changes(spark, sf_dir))


JOURNAL_STATE = f"""
WITH o AS (SELECT *, {DAY} AS t FROM orders), r AS (SELECT coalesce(max(t), -1) AS begun FROM o WHERE o_totalprice > {DEAR}),
x AS (SELECT o_custkey::VARCHAR AS a, o_orderpriority AS b, o_orderstatus = 'F' AS gone, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY t DESC, o_orderstatus = 'F') AS k FROM o, r WHERE t > begun)
SELECT a, b FROM x WHERE k = 1 AND NOT gone"""


def unmatch_closure(spark, sf_dir):
    """What goes when customers in debt do: their orders, the orders' lines by part and supplier, and all other orders of one day."""
    customer, o, line = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    name = lambda kind, *keys: F.concat_ws("-", F.lit(kind), *keys)
    gone = customer.where("c_acctbal < 0").select(name("c", "c_custkey").alias("a"))
    # those of one day by its first order, so a day gives rows in proportion to its orders
    day = o.groupBy("o_orderdate").agg(F.min("o_orderkey").alias("first"))
    tied = o.join(day, "o_orderdate").where("o_orderkey <> first").select(name("o", "o_orderkey").alias("a"), name("o", "first").alias("then"))
    twins = tied.unionByName(tied.select(F.col("then").alias("a"), F.col("a").alias("then")))
    owned = o.select(name("c", "o_custkey").alias("a"), name("o", "o_orderkey").alias("then"))
    lines = line.select(name("o", "l_orderkey").alias("a"), name("l", "l_orderkey", "l_partkey", "l_suppkey").alias("then"))
    return journal.cascade(gone, owned.unionByName(lines).unionByName(twins)).select("a", F.col("cause").isNull().alias("first"))


UNMATCH_CLOSURE = """
WITH RECURSIVE f AS (SELECT 'c-' || o_custkey AS a, 'o-' || o_orderkey AS t FROM orders UNION SELECT 'o-' || l_orderkey, 'l-' || l_orderkey || '-' || l_partkey || '-' || l_suppkey FROM lineitem
  UNION SELECT 'o-' || x.o_orderkey, 'o-' || y.o_orderkey FROM orders x JOIN orders y ON x.o_orderdate = y.o_orderdate AND x.o_orderkey <> y.o_orderkey),
g AS (SELECT 'c-' || c_custkey AS a FROM customer WHERE c_acctbal < 0), w AS (SELECT a FROM g UNION SELECT f.t FROM w JOIN f USING (a))
SELECT a, a IN (SELECT a FROM g) AS first FROM w"""

QUERIES = {f.__name__: f for f in (signature_equality, method_resolution, field_resolution, journal_state, unmatch_closure)}
ORACLES = {"signature_equality": SIGNATURE_EQUALITY, "method_resolution": METHOD_RESOLUTION, "field_resolution": FIELD_RESOLUTION, "journal_state": JOURNAL_STATE, "unmatch_closure": UNMATCH_CLOSURE}
