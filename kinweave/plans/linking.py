"""Queries that link the two sides, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.functions.text import bucket
from kinweave.operators import assignment, positions, ranking, sequences, similarity, state
from kinweave.operators.ranking import Measure

from .tables import SHIFT, orders, side, suppliers, table

def supplier_measures() -> list[Measure]:
    return [
        Measure("nation", 20, F.col("a_nation") == F.col("b_nation")),
        Measure("flags", 10, similarity.of_counts(F.col("a_flags"), F.col("b_flags"))),
        Measure("balance", 8, F.col("a_balance") == F.col("b_balance")),
        Measure("lines", 3, similarity.of_counts(F.col("a_lines"), F.col("b_lines"))),
        Measure("orders", 3, similarity.of_counts(F.col("a_orders"), F.col("b_orders"))),
        Measure("parts", 2, similarity.of_sets(F.col("a_parts"), F.col("b_parts"))),
    ]


def order_measures() -> list[Measure]:
    return [
        Measure("status", 10, F.col("a_status") == F.col("b_status")),
        Measure("priority", 10, F.col("a_priority") == F.col("b_priority")),
        Measure("price", 8, F.col("a_price") == F.col("b_price")),
        Measure("lines", 3, similarity.of_counts(F.col("a_lines"), F.col("b_lines"))),
    ]


def named(frame: DataFrame, letter: str) -> DataFrame:
    return frame.select(F.col("id").alias(letter), *[F.col(c).alias(f"{letter}_{c}") for c in frame.columns if c != "id"])


def supplier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates: a pair that differs in nation or balance misses the cutoff by that alone, so both are join keys."""
    a, b = named(suppliers(spark, sf_dir, 1), "a"), named(suppliers(spark, sf_dir, 0), "b")
    return a.join(b, (F.col("a_nation") == F.col("b_nation")) & (F.col("a_balance") == F.col("b_balance")))


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates: members of matched owners."""
    a, b = named(orders(spark, sf_dir, 1), "a"), named(orders(spark, sf_dir, 0), "b")
    return a.join(b, F.col("a_owner") + SHIFT == F.col("b_owner"))


def link_suppliers(spark, sf_dir):
    return ranking.link(supplier_pairs(spark, sf_dir), supplier_measures()).withColumn("score", F.round("score", 6))


def order_scores(spark, sf_dir):
    return ranking.score(order_pairs(spark, sf_dir), order_measures())


def member_candidates(spark, sf_dir):
    return order_pairs(spark, sf_dir).groupBy("a").agg(F.count("*").alias("candidates"))


def rank_members(spark, sf_dir):
    scored = ranking.score(order_pairs(spark, sf_dir), order_measures(), limit=ranking.cutoff(31.0))
    return ranking.ranked(scored).select("a", "b", F.round("score", 6).alias("score"), "place")


def score_parts(spark, sf_dir):
    scored = ranking.score(order_pairs(spark, sf_dir), order_measures(), limit=ranking.cutoff(31.0))
    return scored.select("a", "b", F.explode("parts").alias("p")).select("a", "b", "p.name", F.round("p.similarity", 6).alias("similarity"), "p.weight", F.round(F.col("p.similarity") * F.col("p.weight"), 6).alias("weighted"))


def accept_margin(spark, sf_dir):
    return ranking.accepted(order_scores(spark, sf_dir), 31.0).select("a", "b", F.round("score", 6).alias("score"))


def deconflict(spark, sf_dir):
    loose = order_pairs(spark, sf_dir).where("a_status = b_status AND a_lines = b_lines").groupBy("a").agg(F.min("b").alias("b"))
    return ranking.one_to_one(loose).select("a", "b")


def perfect_members(spark, sf_dir):
    return ranking.perfect(order_scores(spark, sf_dir), 31.0)


def best_match(spark, sf_dir):
    return order_scores(spark, sf_dir).groupBy("a").agg(F.max_by("b", F.struct("score", -F.col("b"))).alias("b"), F.round(F.max("score"), 6).alias("score"))


def count_similarity(spark, sf_dir):
    p = supplier_pairs(spark, sf_dir)
    return p.select("a", "b", F.round(similarity.of_counts(F.col("a_lines"), F.col("b_lines")), 6).alias("similarity"))


def flag_similarity(spark, sf_dir):
    p = order_pairs(spark, sf_dir)
    bits = lambda s: F.when(F.col(s) == "F", 1).when(F.col(s) == "O", 2).otherwise(4)
    return p.select("a", "b", F.round(similarity.of_flags(bits("a_status"), bits("b_status"), 7, 3), 6).alias("similarity"))


def numeric_constants(spark, sf_dir):
    quantities = lambda parity, name: side(table(spark, sf_dir, "lineitem"), parity).groupBy(F.col("l_orderkey").alias("order")).agg(F.collect_set("l_quantity").alias(name))
    return quantities(1, "x").join(quantities(0, "y"), "order").select("order", F.round(similarity.of_sets(F.col("x"), F.col("y")), 6).alias("similarity"))


def identity_set_similarity(spark, sf_dir):
    """Nations as sets of customers: a customer is matched if its key divides by 3, and a candidate for those in its segment."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    a = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_nationkey").alias("a"), F.col("c_custkey").alias("x"))
    b = c.where("c_acctbal > 500").select(F.col("c_nationkey").alias("b"), F.col("c_custkey").alias("y"))
    pairs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_nationkey").alias("b"))
    matches = c.where("c_acctbal > 4000").select(F.col("c_custkey").alias("x"), F.col("c_custkey").alias("y"))
    free = c.where("c_acctbal <= 4000 AND c_mktsegment <> 'MACHINERY'")
    candidates = free.select(F.col("c_custkey").alias("x"), F.col("c_custkey").alias("y"))
    return similarity.of_identities(pairs, a, b, matches, candidates).withColumn("similarity", F.round("similarity", 6))


def identity_prematch(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_acctbal") < 1000).alias("disguised"), F.col("s_nationkey").alias("nation"))
    other = s.select((F.col("id") + SHIFT).alias("id"), "name", (F.col("nation") > 18).alias("disguised"))
    return state.prematch(s, other, "name")


def match_status(spark, sf_dir):
    linked = ranking.link(order_pairs(spark, sf_dir), order_measures()).select(F.col("a").alias("id"), F.lit(True).alias("matched"))
    members = orders(spark, sf_dir, 1).join(linked, "id", "left")
    return members.groupBy("status").agg(F.count("*").alias("total"), F.count_if(F.coalesce("matched", F.lit(False))).alias("matched"))


def fully_matched(spark, sf_dir):
    members = orders(spark, sf_dir, 1).select("id", "owner", (F.col("price") > 40000).alias("matchable"))
    linked = ranking.link(order_pairs(spark, sf_dir), order_measures())
    return state.fully_matched(members.select(F.col("owner").alias("id")).distinct(), members, linked)


def unmatch_cascade(spark, sf_dir):
    a = orders(spark, sf_dir, 1)
    owners = a.select(F.col("owner").alias("a")).distinct().withColumn("b", F.col("a") + SHIFT)
    member_pairs = a.select(F.col("id").alias("a"), (F.col("id") + SHIFT).alias("b"))
    kept, members = state.unmatched(owners, table(spark, sf_dir, "customer").where("c_acctbal < 2500").select(F.col("c_custkey").alias("a")), member_pairs, a)
    return kept.withColumn("kind", F.lit("owner")).unionByName(members.withColumn("kind", F.lit("member")))


def match_fanout(spark, sf_dir):
    """Orders of one day and priority are a group; groups of equal names are matched, and so are their members in matched owners."""
    a, b = (orders(spark, sf_dir, p).withColumn("grouped", F.concat_ws("|", "priority", F.date_format("day", "yyyy-MM"))) for p in (1, 0))
    groups = a.select(F.col("grouped").alias("a_group"), F.col("grouped").alias("b_group")).distinct()
    owners = a.select(F.col("owner").alias("a")).distinct().withColumn("b", F.col("a") + SHIFT)
    return state.fan_out(groups, a, b, owners)


def member_name_match(spark, sf_dir):
    a, b = (orders(spark, sf_dir, p) for p in (1, 0))
    owners = a.select(F.col("owner").alias("a")).distinct().withColumn("b", F.col("a") + SHIFT)
    return state.member_matches(owners, a, b, "priority")


def members_full(spark, sf_dir):
    """How well a customer's orders on one side are found on the other."""
    sizes = orders(spark, sf_dir, 1).groupBy("owner").agg(F.count("*").alias("n")).unionByName(orders(spark, sf_dir, 0).groupBy((F.col("owner") - SHIFT).alias("owner")).agg(F.count("*").alias("n")))
    counts = sizes.groupBy("owner").agg(F.max("n").alias("n"))
    found = ranking.members_full(order_scores(spark, sf_dir).withColumn("owner", F.col("a_owner")), counts, 31.0)
    return found.withColumn("similarity", F.round("similarity", 6))


def fixpoint_link(spark, sf_dir):
    """Link orders of already linked customers, and customers all of whose orders but one are linked, until nothing changes."""
    pairs = order_pairs(spark, sf_dir)
    seeds = ranking.link(pairs, order_measures()).select("a", "b")
    open_pairs = pairs.where("a_status = b_status AND a_priority = b_priority").select("a", "b")

    def step(matches: DataFrame) -> DataFrame:
        left = open_pairs.join(matches.select("a"), "a", "left_anti").join(matches.select("b"), "b", "left_anti")
        single = left.groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("n")).where("n = 1").select("a", "b")
        return ranking.one_to_one(single)

    return state.fixpoint(seeds, step)


def position_similarity(spark, sf_dir):
    """Relative place of an order among its customer's orders, between the nearest linked neighbours: open orders on both sides."""

    def placed(parity: int) -> DataFrame:
        by_day = Window.partitionBy("owner").orderBy("day", "id")
        return orders(spark, sf_dir, parity).withColumn("place", F.row_number().over(by_day) - 1).select("id", "owner", "place", "status")

    a, b = placed(1), placed(0)
    pairs = a.select(F.col("id").alias("a"), "status", (F.col("id") + SHIFT).alias("b")).join(b.select(F.col("id").alias("b")), "b")
    linked = pairs.where("status = 'O'").select(F.col("a").alias("x"), F.col("b").alias("y"))
    found = positions.of_places(pairs, a.drop("status"), b.drop("status"), linked)
    return found.select(F.col("a").alias("key"), F.round("similarity", 6).alias("similarity"))


def user_letters(spark, sf_dir) -> DataFrame:
    """(user_id, letters): a user's events in order, one letter each."""
    events = table(spark, sf_dir, "events")
    rows = events.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", F.substring("event_type", 1, 1).alias("letter")))).alias("x"))
    return rows.select("user_id", F.array_join(F.transform("x", lambda e: e["letter"]), "").alias("letters"))


def sequence_similarity(spark, sf_dir):
    s = user_letters(spark, sf_dir)
    a, b = s.select(F.col("user_id").alias("a"), F.col("letters").alias("x")), s.select((F.col("user_id") - 1).alias("a"), F.col("letters").alias("y"))
    return a.join(b, "a").select("a", F.round(sequences.of_letters(F.col("x"), F.col("y")), 6).alias("similarity"))


def sequence_alignment(spark, sf_dir):
    s = user_letters(spark, sf_dir).withColumn("letters", F.split("letters", ""))
    pairs = s.select(F.col("user_id").alias("a"), F.col("letters").alias("x")).join(s.select((F.col("user_id") - 1).alias("a"), F.col("letters").alias("y")), "a")
    return sequences.aligned(pairs, "x", "y").select("a", F.posexplode("places").alias("place", "partner"))


def aligned_ratio(spark, sf_dir):
    places_ = sequence_alignment(spark, sf_dir)
    counted = places_.groupBy("a").agg(F.count_if(F.col("partner") >= 0).alias("kept"), F.count_if(F.col("partner") < 0).alias("lost"))
    return counted.select("a", F.round(similarity.ratio(F.col("kept"), F.col("lost")), 6).alias("ratio"))


def aligned_reference_ratio(spark, sf_dir):
    """Users as callers, each matched with the next one, and steps of fifty of an event's value as what it refers to."""
    events = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", F.floor(F.col("value") / 50).alias("target")))).alias("x"))
    refs = events.select(F.col("user_id").alias("caller"), F.posexplode("x").alias("place", "e")).select("caller", "place", "e.target").where("target IS NOT NULL")
    pairs = refs.select(F.col("target").alias("a"), F.col("target").alias("b")).distinct()
    places_ = sequence_alignment(spark, sf_dir).select(F.col("a").alias("caller"), "place", F.col("partner").alias("partner_place"))
    matches = places_.select("caller").distinct().withColumn("partner", F.col("caller") + 1)
    return sequences.reference_ratio(pairs, refs, refs, places_, matches).withColumn("ratio", F.round("ratio", 6))


def greedy_member_similarity(spark, sf_dir):
    """Orders as methods of customers: priority and status are their shape, the number of lines their size."""
    shaped = lambda parity: orders(spark, sf_dir, parity).select("owner", "day", "id", F.concat_ws("|", "priority", "status").alias("shape"), F.col("lines").alias("size"))
    a, b = shaped(1), shaped(0)
    pairs = a.select(F.col("owner").alias("a")).distinct().withColumn("b", F.col("a") + SHIFT)
    return assignment.greedy_similarity(pairs, a, b, ["day", "id"]).withColumn("similarity", F.round("similarity", 6))


def potential_match(spark, sf_dir):
    """Orders of one customer could be each other if their priorities agree, or one is disguised (urgent and high ones are)."""
    told = lambda parity, shift: orders(spark, sf_dir, parity).select("id", (F.col("owner") - shift).alias("scope"), F.col("priority").alias("name"), F.col("priority").isin("1-URGENT", "2-HIGH").alias("disguised"))
    linked = ranking.link(order_pairs(spark, sf_dir), order_measures()).select("a", "b")
    return state.potential(told(1, 0), told(0, SHIFT), linked)


def similarity_report(spark, sf_dir):
    """Share of linked orders of a customer, in steps of a twentieth."""
    linked = ranking.link(order_pairs(spark, sf_dir), order_measures()).select(F.col("a").alias("id"), (F.col("score") / 31.0).alias("s"))
    rows = orders(spark, sf_dir, 1).join(linked, "id", "left").groupBy("owner").agg(F.round(F.sum(F.coalesce("s", F.lit(0.0))) / F.count("*"), 6).alias("similarity"))
    return rows.withColumn("step", bucket(F.col("similarity")))


A_SUP = f"""
sup AS (SELECT s_suppkey + CASE WHEN odd = 1 THEN 0 ELSE {SHIFT} END AS id, odd, s_nationkey AS nation, s_acctbal AS balance, lines, orders, flags, parts
  FROM supplier JOIN (SELECT l_suppkey, l_linenumber % 2 AS odd, count(*) AS lines, count(DISTINCT l_orderkey) AS orders,
    count(DISTINCT l_returnflag || l_linestatus) AS flags, list_distinct(list(l_partkey)) AS parts FROM lineitem GROUP BY 1, 2) ON s_suppkey = l_suppkey)"""
A_ORD = f"""
ord AS (SELECT o_orderkey + CASE WHEN odd = 1 THEN 0 ELSE {SHIFT} END AS id, o_custkey + CASE WHEN odd = 1 THEN 0 ELSE {SHIFT} END AS owner, odd, o_orderstatus AS status,
    o_orderpriority AS priority, o_totalprice AS price, o_orderdate AS day, lines
  FROM orders JOIN (SELECT l_orderkey, l_linenumber % 2 AS odd, count(*) AS lines FROM lineitem GROUP BY 1, 2) ON o_orderkey = l_orderkey),
opair AS (SELECT a.id AS a, b.id AS b, a.status AS ast, b.status AS bst, a.priority AS apr, b.priority AS bpr, a.price AS ap, b.price AS bp, a.lines AS al, b.lines AS bl
  FROM ord a JOIN ord b ON a.odd = 1 AND b.odd = 0 AND a.owner + {SHIFT} = b.owner),
parts AS (SELECT *, CASE WHEN ast = bst THEN 1e0 ELSE 0e0 END AS s1, CASE WHEN apr = bpr THEN 1e0 ELSE 0e0 END AS s2, CASE WHEN ap = bp THEN 1e0 ELSE 0e0 END AS s3,
  CASE WHEN al = bl THEN 1e0 ELSE 1e0 - abs(al - bl) / greatest(al, bl)::DOUBLE END AS s4 FROM opair),
scored AS (SELECT *, round(10 * s1 + 10 * s2 + 8 * s3 + 3 * s4, 9) AS score FROM parts)"""
CUT = "31e0 - (31e0 - sqrt(0.85e0 * (1 - 0.085e0)) * 31e0)"


def accepted_sql(scored: str, top: str) -> str:
    return f"""
best AS (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r, lead(score) OVER (PARTITION BY a ORDER BY score DESC, b) AS nxt FROM {scored}),
acc AS (SELECT a, b, score FROM best WHERE r = 1 AND pow(score / {top}, 2) >= 0.85 AND (nxt IS NULL OR pow(nxt / {top}, 2) < pow(score / {top}, 2) * (1 - 0.085e0))),
one AS (SELECT * FROM acc WHERE b IN (SELECT b FROM acc GROUP BY b HAVING count(*) = 1))"""


#: Passes that the SQL of ``fixpoint_link`` spells out; it is right if the last ones find nothing, which it checks.
UNROLLED = 24


def unrolled_sql() -> str:
    """Passes of the only candidates left, one after another; an error if the last pass still finds a pair."""
    ctes, known = [], "one0"
    for i in range(UNROLLED):
        ctes.append(f"""l{i} AS MATERIALIZED (SELECT a, min(b) AS b FROM opx WHERE a NOT IN (SELECT a FROM {known}) AND b NOT IN (SELECT b FROM {known}) GROUP BY a HAVING count(*) = 1),
n{i} AS MATERIALIZED (SELECT a, b FROM l{i} WHERE b IN (SELECT b FROM l{i} GROUP BY b HAVING count(*) = 1)), one{i + 1} AS MATERIALIZED (SELECT * FROM {known} UNION ALL SELECT * FROM n{i})""")
        known = f"one{i + 1}"
    return ", ".join(ctes) + f" SELECT a, b FROM {known} WHERE CASE WHEN (SELECT count(*) FROM n{UNROLLED - 1}) > 0 THEN error('more passes are needed') ELSE true END"


#: Costs row by row, each a list, and the way back through them, cell by cell.
ALIGNED = """WITH RECURSIVE s AS (SELECT user_id, list(substr(event_type, 1, 1) ORDER BY ts, event_id) AS x FROM events GROUP BY 1),
pr AS (SELECT p.user_id AS a, p.x AS x, q.x AS y FROM s p JOIN s q ON p.user_id = q.user_id - 1),
fwd AS (SELECT a, x, y, 0 AS i, list_transform(range(0, len(y) + 1), lambda j: 2 * j) AS r FROM pr
  UNION ALL SELECT a, x, y, i + 1, list_transform(range(1, len(d) + 1), lambda j: list_min(d[1:j]) + 2 * (j - 1)) FROM
  (SELECT *, list_transform(range(0, len(y) + 1), lambda j: CASE WHEN j = 0 THEN 2 * (i + 1) ELSE least(r[j] + CASE WHEN x[i + 1] = y[j] THEN 0 ELSE 2 END, r[j + 1] + 2) - 2 * j END) AS d FROM fwd WHERE i < len(x))),
cells AS MATERIALIZED (SELECT a, i, r FROM fwd),
back AS (SELECT a, len(x) AS i, len(y) AS j, -1 AS place, -1 AS partner FROM pr
  UNION ALL SELECT a, CASE WHEN diagonal OR dropped < added THEN i - 1 ELSE i END, CASE WHEN diagonal OR dropped >= added THEN j - 1 ELSE j END,
    CASE WHEN diagonal OR dropped < added THEN i - 1 ELSE -1 END, CASE WHEN diagonal AND here - kept < 2 THEN j - 1 ELSE -1 END
  FROM (SELECT *, kept <= dropped AND kept <= added AS diagonal FROM (SELECT b.a, b.i, b.j, h.r[b.j + 1] AS here, coalesce(u.r[b.j + 1], 1000000000) AS dropped, CASE WHEN b.j > 0 THEN h.r[b.j] ELSE 1000000000 END AS added,
    CASE WHEN b.j > 0 THEN coalesce(u.r[b.j], 1000000000) ELSE 1000000000 END AS kept FROM back b JOIN cells h ON h.a = b.a AND h.i = b.i LEFT JOIN cells u ON u.a = b.a AND u.i = b.i - 1 WHERE b.i > 0))),
places AS (SELECT a, place::INT AS place, partner::INT AS partner FROM back WHERE place >= 0)"""

ORACLES = {
    "sequence_alignment": f"{ALIGNED} SELECT a, place, partner FROM places",
    "aligned_ratio": f"{ALIGNED} SELECT a, round(count(CASE WHEN partner >= 0 THEN 1 END) / count(*)::DOUBLE, 6) AS ratio FROM places GROUP BY a",
    "aligned_reference_ratio": f"""{ALIGNED}, refs AS (SELECT user_id AS caller, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, floor(value / 50) AS target FROM events),
known AS (SELECT * FROM refs WHERE target IS NOT NULL), pairs AS (SELECT DISTINCT target AS t FROM known), callers AS (SELECT DISTINCT target AS t, caller FROM known),
met AS (SELECT c.t, c.caller, p.a IS NOT NULL AND o.t IS NOT NULL AS met FROM callers c LEFT JOIN (SELECT DISTINCT a FROM places) p ON p.a = c.caller LEFT JOIN callers o ON o.caller = c.caller + 1 AND o.t = c.t),
at_ AS (SELECT m.t, coalesce(r.target = m.t, false) AS same FROM met m JOIN known k ON k.caller = m.caller AND k.target = m.t JOIN places p ON p.a = k.caller AND p.place = k.place AND p.partner >= 0 LEFT JOIN known r ON r.caller = m.caller + 1 AND r.place = p.partner WHERE m.met),
n AS (SELECT t, count(CASE WHEN same THEN 1 END) AS kept, count(CASE WHEN NOT same THEN 1 END) AS lost FROM at_ GROUP BY 1), al AS (SELECT t, count(CASE WHEN NOT met THEN 1 END) AS alone FROM met GROUP BY 1)
SELECT t::BIGINT AS a, t::BIGINT AS b, round(CASE WHEN coalesce(kept, 0) + coalesce(lost, 0) + coalesce(alone, 0) = 0 THEN 1e0 ELSE coalesce(kept, 0) / (coalesce(kept, 0) + coalesce(lost, 0) + coalesce(alone, 0))::DOUBLE END, 6) AS ratio
FROM pairs LEFT JOIN n USING (t) LEFT JOIN al USING (t)""",
    "link_suppliers": f"""WITH {A_SUP},
sp AS (SELECT a.id AS a, b.id AS b, 20 * (a.nation = b.nation)::INT + 8 * (a.balance = b.balance)::INT
  + 10 * (1e0 - abs(a.flags - b.flags) / greatest(a.flags, b.flags)::DOUBLE) + 3 * (1e0 - abs(a.lines - b.lines) / greatest(a.lines, b.lines)::DOUBLE)
  + 3 * (1e0 - abs(a.orders - b.orders) / greatest(a.orders, b.orders)::DOUBLE)
  + 2 * len(list_intersect(a.parts, b.parts)) / len(list_distinct(list_concat(a.parts, b.parts)))::DOUBLE AS score FROM sup a JOIN sup b ON a.odd = 1 AND b.odd = 0),
cut AS (SELECT a, b, round(score, 9) AS score FROM sp WHERE 46 - score < 46e0 - sqrt(0.85e0 * (1 - 0.085e0)) * 46e0), {accepted_sql("cut", "46e0")}
SELECT a, b, round(score, 6) AS score FROM one""",
    "member_candidates": f"WITH {A_ORD} SELECT a, count(*) AS candidates FROM opair GROUP BY a",
    "rank_members": f"WITH {A_ORD} SELECT a, b, round(score, 6) AS score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b)::INT AS place FROM scored WHERE score > {CUT}",
    "score_parts": f"""WITH {A_ORD}, c AS (SELECT * FROM scored WHERE score > {CUT}), p AS (SELECT a, b, 'status' AS name, s1 AS s, 10e0 AS weight FROM c UNION ALL SELECT a, b, 'priority', s2, 10e0 FROM c
UNION ALL SELECT a, b, 'price', s3, 8e0 FROM c UNION ALL SELECT a, b, 'lines', s4, 3e0 FROM c) SELECT a, b, name, round(s, 6) AS similarity, weight, round(s * weight, 6) AS weighted FROM p""",
    "accept_margin": f"WITH {A_ORD}, {accepted_sql('scored', '31e0')} SELECT a, b, round(score, 6) AS score FROM acc",
    "deconflict": f"WITH {A_ORD}, l AS (SELECT a, min(b) AS b FROM opair WHERE ast = bst AND al = bl GROUP BY a) SELECT a, b FROM (SELECT *, count(*) OVER (PARTITION BY b) AS n FROM l) WHERE n = 1",
    "perfect_members": f"""WITH {A_ORD}, f AS (SELECT a, min(b) AS b FROM scored WHERE score >= 31 - 1e-6 GROUP BY a HAVING count(*) = 1)
SELECT a, b FROM f WHERE b IN (SELECT b FROM f GROUP BY b HAVING count(*) = 1)""",
    "best_match": f"WITH {A_ORD} SELECT a, b, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM scored) WHERE r = 1",
    "count_similarity": f"""WITH {A_SUP} SELECT a.id AS a, b.id AS b, round(1e0 - abs(a.lines - b.lines) / greatest(a.lines, b.lines)::DOUBLE, 6) AS similarity
FROM sup a JOIN sup b ON a.odd = 1 AND b.odd = 0 AND a.nation = b.nation AND a.balance = b.balance""",
    "flag_similarity": f"""WITH {A_ORD}, f AS (SELECT a, b, CASE ast WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END AS x, CASE bst WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END AS y FROM opair)
SELECT a, b, round(1 - bit_count(xor(x, y) & 7) / 3e0, 6) AS similarity FROM f""",
    "numeric_constants": """WITH q AS (SELECT l_orderkey, l_linenumber % 2 AS odd, list_distinct(list(l_quantity)) AS s FROM lineitem GROUP BY 1, 2)
SELECT x.l_orderkey AS "order", round(len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s)))::DOUBLE, 6) AS similarity FROM q x JOIN q y ON x.l_orderkey = y.l_orderkey AND x.odd = 1 AND y.odd = 0""",
    "identity_set_similarity": """WITH a AS (SELECT c_nationkey AS n, c_custkey AS k, c_acctbal <= 4000 AND c_mktsegment = 'MACHINERY' AS never FROM customer WHERE c_mktsegment <> 'BUILDING'), b AS (SELECT c_nationkey AS n, c_custkey AS k, c_acctbal <= 4000 AND c_mktsegment = 'MACHINERY' AS never FROM customer WHERE c_acctbal > 500),
la AS (SELECT a.n, count(*) AS na, sum(CASE WHEN a.never THEN 1 WHEN b.k IS NULL THEN 1 ELSE 0 END) AS lost FROM a LEFT JOIN b ON a.n = b.n AND a.k = b.k GROUP BY 1),
lb AS (SELECT b.n, count(*) AS nb, sum(CASE WHEN b.never THEN 1 WHEN a.k IS NULL THEN 1 ELSE 0 END) AS lost FROM b LEFT JOIN a ON a.n = b.n AND a.k = b.k GROUP BY 1)
SELECT n_nationkey AS a, n_nationkey AS b, CASE WHEN na IS NULL AND nb IS NULL THEN 1e0 WHEN na IS NULL OR nb IS NULL THEN 0e0 ELSE round((na + nb - la.lost - lb.lost) / (na + nb)::DOUBLE, 6) END AS similarity
FROM nation LEFT JOIN la ON n_nationkey = la.n LEFT JOIN lb ON n_nationkey = lb.n""",
    "identity_prematch": f"SELECT s_suppkey AS a, s_suppkey + {SHIFT} AS b FROM supplier WHERE s_acctbal >= 1000 AND s_nationkey <= 18",
    "match_status": f"""WITH {A_ORD}, c AS (SELECT * FROM scored WHERE score > {CUT}), {accepted_sql("c", "31e0")}
SELECT status, count(*) AS total, count(one.a) AS matched FROM ord LEFT JOIN one ON ord.id = one.a WHERE odd = 1 GROUP BY status""",
    "fully_matched": f"""WITH {A_ORD}, c AS (SELECT * FROM scored WHERE score > {CUT}), {accepted_sql("c", "31e0")}
SELECT owner AS id, bool_and(price <= 40000 OR one.a IS NOT NULL) AS fully FROM ord LEFT JOIN one ON ord.id = one.a WHERE odd = 1 GROUP BY owner""",
    "potential_match": f"""WITH {A_ORD}, c AS (SELECT * FROM scored WHERE score > {CUT}), {accepted_sql("c", "31e0")},
n AS (SELECT *, priority IN ('1-URGENT', '2-HIGH') AS disguised FROM ord), f AS (SELECT * FROM n WHERE odd = 0 AND id NOT IN (SELECT b FROM one))
SELECT id, id IN (SELECT a FROM one) OR EXISTS (SELECT 1 FROM f WHERE f.owner = n.owner + {SHIFT} AND (f.disguised OR n.disguised OR f.priority = n.priority)) AS potential FROM n WHERE odd = 1""",
    "unmatch_cascade": f"""WITH {A_ORD} SELECT DISTINCT owner AS a, owner + {SHIFT} AS b, 'owner' AS kind FROM ord WHERE odd = 1 AND owner NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 2500)
UNION ALL SELECT id, id + {SHIFT}, 'member' FROM ord WHERE odd = 1 AND owner NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 2500)""",
    "match_fanout": f"""WITH {A_ORD} SELECT a.id AS a, b.id AS b FROM ord a JOIN ord b ON a.odd = 1 AND b.odd = 0 AND a.owner + {SHIFT} = b.owner AND a.priority = b.priority AND strftime(a.day, '%Y-%m') = strftime(b.day, '%Y-%m')""",
    "member_name_match": f"""WITH {A_ORD}, u AS (SELECT odd, owner, priority, min(id) AS id FROM ord GROUP BY 1, 2, 3 HAVING count(*) = 1)
SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON x.odd = 1 AND y.odd = 0 AND x.owner + {SHIFT} = y.owner AND x.priority = y.priority""",
    "members_full": f"""WITH {A_ORD}, {accepted_sql("scored", "31e0").replace("0.85", "0.8").replace("0.085e0", "0.08e0")},
t AS (SELECT owner, sum(pow(score / 31e0, 2)) AS s FROM acc JOIN ord ON acc.a = ord.id GROUP BY 1),
c AS (SELECT owner, max(n) AS n FROM (SELECT CASE WHEN odd = 1 THEN owner ELSE owner - {SHIFT} END AS owner, odd, count(*) AS n FROM ord GROUP BY 1, 2) GROUP BY 1)
SELECT owner, round(coalesce(s, 0) / n, 6) AS similarity FROM c LEFT JOIN t USING (owner)""",
    "position_similarity": f"""WITH {A_ORD}, p AS (SELECT id % {SHIFT} AS key, odd, owner, status, row_number() OVER (PARTITION BY owner ORDER BY day, id) - 1 AS place, count(*) OVER (PARTITION BY owner) AS n FROM ord),
x AS (SELECT a.key, a.owner, a.place, a.n, b.place AS b_place, b.n AS b_n, CASE WHEN a.status = 'O' THEN b.place END AS met FROM p a LEFT JOIN p b ON a.key = b.key AND b.odd = 0 WHERE a.odd = 1),
y AS (SELECT *, coalesce(last_value(CASE WHEN met IS NOT NULL THEN place END IGNORE NULLS) OVER up + 1, 0) AS low, coalesce(last_value(met IGNORE NULLS) OVER up + 1, 0) AS low_b,
  coalesce(first_value(CASE WHEN met IS NOT NULL THEN place END IGNORE NULLS) OVER down, n) AS high, coalesce(first_value(met IGNORE NULLS) OVER down, b_n) AS high_b FROM x
  WINDOW up AS (PARTITION BY owner ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), down AS (PARTITION BY owner ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
z AS (SELECT *, low_b >= high_b OR low_b > b_place OR high_b <= b_place AS whole FROM y WHERE b_place IS NOT NULL),
r AS (SELECT *, CASE WHEN whole THEN 0 ELSE low END AS s, CASE WHEN whole THEN n ELSE high END AS e, CASE WHEN whole THEN 0 ELSE low_b END AS sb, CASE WHEN whole THEN b_n ELSE high_b END AS eb FROM z)
SELECT key, round(CASE WHEN place = b_place AND n = b_n THEN 1e0 ELSE 1 - abs(CASE WHEN e - s <= 1 THEN 0.5e0 ELSE (place - s) / (e - s - 1)::DOUBLE END - CASE WHEN eb - sb <= 1 THEN 0.5e0 ELSE (b_place - sb) / (eb - sb - 1)::DOUBLE END) END, 6) AS similarity FROM r""",
    "fixpoint_link": f"""WITH {A_ORD}, c AS (SELECT * FROM scored WHERE score > {CUT}), {accepted_sql("c", "31e0")}, opx AS MATERIALIZED (SELECT a, b FROM opair WHERE ast = bst AND apr = bpr),
one0 AS MATERIALIZED (SELECT a, b FROM one), {unrolled_sql()}""",
    "sequence_similarity": """WITH s AS (SELECT user_id, string_agg(substr(event_type, 1, 1), '' ORDER BY ts, event_id) AS x FROM events GROUP BY 1)
SELECT a.user_id AS a, round(1 - levenshtein(a.x, b.x) / greatest(len(a.x), len(b.x))::DOUBLE, 6) AS similarity FROM s a JOIN s b ON a.user_id = b.user_id - 1""",
    "similarity_report": f"""WITH {A_ORD}, c AS (SELECT * FROM scored WHERE score > {CUT}), {accepted_sql("c", "31e0")},
t AS (SELECT owner, round(sum(coalesce(score / 31e0, 0)) / count(*), 6) AS similarity FROM ord LEFT JOIN one ON ord.id = one.a WHERE odd = 1 GROUP BY owner) SELECT owner, similarity, round(similarity * 20) / 20 AS step FROM t""",
}

QUERIES = {
    f.__name__: f
    for f in (
        link_suppliers, member_candidates, rank_members, score_parts, accept_margin, deconflict, perfect_members, best_match, count_similarity, flag_similarity, numeric_constants,
        identity_set_similarity, identity_prematch, match_status, fully_matched, unmatch_cascade, match_fanout, member_name_match, members_full, fixpoint_link, position_similarity, sequence_similarity,
        sequence_alignment, aligned_ratio, aligned_reference_ratio, greedy_member_similarity, potential_match, similarity_report,
    )
}
