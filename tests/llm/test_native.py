"""The operators that are DataFrame operations throughout, against plain Python."""

import random
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

from kinweave.llm import linededup, pii, rules, sharding, urlrules

from . import brute

LONG = "word@x " + "9" * 40_000 + " " + "a" * 40_000 + " 1.2.3." * 3000 + "@b.c_d@e.f"
EDGE_TEXTS = [
    None,
    "",
    " \n\t\n ",
    "é 4111 1111 1111 1111 x@y.z_q@r.s +1 (555) 123-4567. 1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.255",
    "+49 30 1234567+33 1 23 45 67 89 12-34 5 4111-1111-1111-1112",
    LONG,
    "iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 bad DE88370400440532013000",
    "my ssn: 123-45-6789, not 123-45-6789; call (555) 123-4567 or phone 555-123-4567",
    "Same line here that is quite long, longer than forty characters\n" * 4,
    "Same line here that is quite long, longer than forty characters\n" * 4,
]
DOC = "doc_id long, text string, lang string, source string, n_chars long, id string, h1 int, key string, row string"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    real = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    shared = "  A LINE That Every Document Holds, AND it is long ÉÀ enough to count "
    rows = [(1000 + i, t, None, None, None) for i, t in enumerate(EDGE_TEXTS)]
    rows += [(2000 + i, f"{shared}{' ' * (i % 3)}\nown line {i} of this document, also over forty characters\n{shared.replace('LINE', 'line') if i % 2 else shared}", "en", "s", 1) for i in range(7)]
    rows += [(None, shared + "\nx", None, "s", 0), (2001, "other\n" + shared, None, "s", 0), (2006, shared, None, "s", 0), (2006, shared, None, "s", 0)]
    return spark.createDataFrame([(*r, "c", 1, "k", "r") for r in real[:60] + rows], DOC)


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def by_id(rows):
    return sorted(map(tuple, rows), key=repr)


def test_pii_base_spans(docs, plain):
    got = by_id(pii.digest(pii.find_pii(docs)).drop("spans").collect())
    assert got == by_id((i, *n, s) for i, t in plain for n, s, _ in [brute.pii(t)])


def test_pii_spans_keep_the_base_ones_and_add_confirmed_ones(docs, plain):
    spans = {r.doc_id: r.spans for r in pii.digest(pii.find_pii(docs.where("doc_id >= 1000 and doc_id < 2000"))).collect()}
    for i, t in plain:
        if i in spans:
            assert spans[i].startswith(brute.pii(t)[2])
    text = EDGE_TEXTS[6]
    assert spans[1006] == "iban:5:32,iban:37:59" and text[37:59] == "GB82WEST12345698765432"
    found = [x.split(":") for x in spans[1007].split(",")]
    assert [(k, EDGE_TEXTS[7][int(a) : int(b)]) for k, a, b in found] == [("ssn", "123-45-6789"), ("localphone", "(555) 123-4567"), ("localphone", "555-123-4567")]


def test_pii_finds_secrets_by_their_context(spark):
    key = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    texts = [f'token = "{key}"', f"just {key}", "my api key: " + "x" * 30, "secret " + "a1" * 9]
    found = pii.digest(pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).orderBy("doc_id").collect()
    assert [r.spans for r in found] == ["secret:9:49", "", "", ""]


def test_pii_in_a_text_with_very_many_matches(spark):
    one = "call +49 30 1234567, "
    n = 400_000
    row = pii.find_pii(spark.createDataFrame([(1, one * n)], "doc_id long, text string")).select(F.size("phone").alias("n"), F.get("phone", F.lit(n - 1)).alias("last")).first()
    assert row.n == n and (row["last"].start, row["last"].end) == (len(one) * (n - 1) + 5, len(one) * n - 2)


def test_line_dedup(docs, plain):
    assert by_id(linededup.dedup_report(docs).collect()) == by_id(brute.line_dedup(plain))


def test_line_dedup_by_any_number_of_batches(docs):
    one, two, seven = (by_id(linededup.dedup_report(docs, batches=n).collect()) for n in (1, 2, 7))
    assert one == two == seven


def test_runs_are_never_shuffled(spark, docs):
    lines = linededup.line_table(docs, 3, 40)
    runs = linededup.LineRuns(spark, 4)
    for batch in range(3):
        runs.add(lines.where(F.col("batch") == batch))
    assert len(runs.runs()) == 2
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    joined = runs.unsettled(runs.runs()[0])
    assert "SortMergeJoin" in plan(joined) and "Bucketed: true" in plan(joined) and "Exchange" not in plan(joined)
    assert "FullOuter" in plan(runs.merged(*runs.runs())) and "Exchange" not in plan(runs.merged(*runs.runs()))
    runs.close()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_line_dedup_keeps_columns_and_untouched_texts(docs, plain):
    out = linededup.dedup_texts(docs)
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text) for r in out.collect() if r.doc_id is not None and 1000 <= r.doc_id < 2000} == {(i, t) for i, t in plain if i is not None and 1000 <= i < 2000}
    assert sum(r.text.lower().count("every document holds") for r in out.where("doc_id >= 2000 or doc_id is null").collect()) == 4


def test_rules_statistics(docs, plain):
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert by_id(rules.report(docs).select(*cols).collect()) == by_id((i, *brute.statistics(t)) for i, t in plain)


def test_rules_order_changes_no_verdict(spark, sf_dir):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    measured = rules.measured(real)
    verdicts = [{r[0] for r in measured.where(rules.cascade(order).isNull()).select("doc_id").collect()} for order in (list(rules.RULES), list(rules.RULES)[::-1])]
    assert verdicts[0] == verdicts[1] and verdicts[0]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = rules.report(real).join(labels, "doc_id").where("not base_failed")
    assert judged.where("kept and quality = 0").count() <= 0.05 * judged.where("quality = 0").count() + 1
    assert judged.where("not kept and quality = 1").count() <= 0.02 * judged.where("quality = 1").count()


def test_rules_are_ordered_by_rejection_per_cost(spark, sf_dir):
    """A dear rule and a cheap one that reject the same, and one that rejects nothing."""
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    short = lambda: F.col("n_words") < 100
    dear = lambda: short() & (F.length(F.regexp_replace(F.repeat("text", F.lit(20)), "[^a-z]", "")) >= 0)
    found = rules.ordered(real, (rules.Rule("none", lambda: F.col("n_words") < 0), rules.Rule("dear", dear), rules.Rule("cheap", short)))
    assert [rule.name for rule, _, _ in found] == ["cheap", "dear", "none"]
    assert found[0][2] == found[1][2] > 0 and found[1][1] > found[0][1]


def test_rules_sample_is_bounded(docs):
    assert rules.sample_of(docs, 10).count() <= 20


def best_capacity(sizes, shards):
    """By trying every set of cuts: (smallest largest shard, smallest largest one of several groups)."""

    def search(cost):
        best = {(0, 0): 0}
        for k in range(1, shards + 1):
            for end in range(len(sizes) + 1):
                best[k, end] = min((max(best[k - 1, cut], cost(sizes[cut:end])) for cut in range(end + 1) if (k - 1, cut) in best), default=10**9)
        return best[shards, len(sizes)]

    return search(sum), search(lambda own: sum(own) if len(own) > 1 else 0)


def loads_of(sizes, places):
    return [sizes[a:b] for a, b in zip([0, *places], [*places, len(sizes)], strict=True)]


def test_minimax_capacity():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.choice([1, 2, 3, 40, rng.randrange(1, 30)]) for _ in range(rng.randrange(1, 14))]
        shards = rng.randrange(1, 6)
        _, cuts = sharding.minimax([("", size, 1) for size in sizes], shards)
        parts = loads_of(sizes, [place for place, _ in cuts])
        largest, several = best_capacity(sizes, shards)
        assert max(map(sum, parts)) == largest and len(parts) <= shards
        assert max((sum(p) for p in parts if len(p) > 1), default=0) == several


@pytest.mark.parametrize("giants", [(), (40_000,), (9_000, 60_000, 70_000)])
def test_contiguous_cuts_are_exact_though_ranges_start_coarse(spark, monkeypatch, giants):
    monkeypatch.setattr(sharding, "FIRST_DIGITS", 1)
    monkeypatch.setattr(sharding, "MAX_RANGES", 64)
    rng = random.Random(5)
    groups = sorted({f"{rng.randrange(16**6):06x}" + "0" * 26: size for size in [*giants, *(rng.randrange(16, 400) for _ in range(700))]}.items())
    cuts = sharding.contiguous_cuts(spark.createDataFrame(groups, "key string, size long"), 9)
    _, exact = sharding.minimax([(k, s, 1) for k, s in groups], 9)
    assert [bisect_left(groups, (cut,)) for cut in cuts] == [place for place, _ in exact]


def test_equal_rows_spread_over_bins(spark):
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    out = sharding.assign(rows, 4).collect()
    assert len({r.shard for r in out}) == 1 and sorted(r.slot for r in out) == list(range(3000))


def test_sharding(docs, plain):
    out = sharding.report(docs).collect()
    assert by_id((r.doc_id, r.size, r.text_crc32) for r in out) == by_id((i, len((t or "").encode()) + 16, brute.crc((t or "").encode())) for i, t in plain)
    shards = {}
    for r in out:
        shards.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and 0 <= r.shard < 40 and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_sharding_sizes_are_near_equal_and_groups_whole(spark):
    texts = ["hot text " * 50] * 400 + [f"text {i} " * (1 + i % 60) for i in range(1500)]
    out = sharding.assign(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, shard int")).collect()
    where, load = {}, [0] * 40
    for r in out:
        load[r.shard] += r.size
        assert where.setdefault(texts[r.doc_id], r.shard) == r.shard
    load.remove(max(load))
    assert max(load) - min(load) < 3 * 60 * 12


def test_urls(spark):
    urls = [None, "", "no scheme.org/x", "HTTP://Sub.Example.ORG/es/1", "http://example.org/en/12?a=1", "http://example.org/en/2", "x://a.com/fr/é#y/z", "x://notexample.org", "x://a.com/de/",
            "x://example.org/es", "x://ÉA.org/", "a://b://c.com/de/x", "x://com/de/"]
    out = {r.page_id: tuple(r)[1:4] for r in urlrules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert list(out[i] for i in range(len(urls))) == [
        ("", "", None), ("", "", None), ("", "", None), ("sub.example.org", "/es/1", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("example.org", "/en/2", "org/"),
        ("a.com", "/fr/é", "com/fr/"), ("notexample.org", "", None), ("a.com", "/de/", "com/de/"), ("example.org", "/es", "org/"), ("Éa.org", "/", "org/"), ("b:", "//c.com/de/x", None), ("com", "/de/", "com/de/"),
    ]


def test_mined_rules(spark, sf_dir):
    rows = [(["host=a", "dir=x"], "block")] * 6 + [(["host=a", "dir=y"], "allow")] * 6 + [(["host=b", "dir=x"], "allow")] * 5
    labelled = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    mined = {(tuple(r.antecedent), r.verdict) for r in urlrules.mine(labelled, 0.05, 0.9).collect()}
    assert mined == {(("dir=x", "host=a"), "block"), (("dir=y",), "allow"), (("host=b",), "allow"), (("dir=y", "host=a"), "allow"), (("dir=x", "host=b"), "allow")}
    urls = spark.createDataFrame([("u1", ["host=a", "dir=x", "z"]), ("u2", ["host=c"]), ("u3", ["host=a", "dir=y"])], "url string, tokens array<string>")
    index = urlrules.indexed(urlrules.mine(labelled, 0.05, 0.9), labelled)
    assert {tuple(r) for r in urlrules.match(urls, index).collect()} == {("u1", "block"), ("u3", "allow")}
    few = urlrules.pruned(index)
    assert {tuple(r.antecedent) for r in few.collect()} == {("dir=x", "host=a"), ("dir=y",), ("host=b",)}
    assert {tuple(r) for r in urlrules.match(urls, few).collect()} == {("u1", "block"), ("u3", "allow")}


def test_rules_of_three_tokens_decide(spark):
    """Any two of the three tokens say little; all of them say block."""
    rows = [(["a", "b", "c"], "block")] * 20 + [(t, "allow") for t in (["a", "b"], ["a", "c"], ["b", "c"]) for _ in range(20)]
    labelled = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    few = urlrules.pruned(urlrules.indexed(urlrules.mine(labelled, 0.05, 0.9), labelled))
    assert {(tuple(r.antecedent), r.verdict) for r in few.collect()} == {(("a", "b", "c"), "block")}


def test_url_edge_rows(spark):
    long = "https://x.org.net/" + "/".join(f"d{i}" for i in range(3000)) + "/p?" + "&".join(f"k{i}=1" for i in range(3000))
    rows = [(None, "http://a.example.org/es/1"), (1, "http://a.example.org/es/1"), (1, "http://a.example.org/es/1"), (2, long), (3, None), (None, None)]
    rows += [(10 + i, f"http://a.example.org/{'/'.join(f'e{j}' for j in range(40))}/{i}") for i in range(5)]  # labelled, and of 40 directories each
    pages = spark.createDataFrame([(*r, "h", "r", "v", 1) for r in rows], "page_id long, url string, host string, rule string, verdict string, salt int")
    out = urlrules.judge(pages).collect()
    assert len(out) == 11 and sum(r.host == "" and r.verdict == "allow" for r in out) == 2
    assert sorted((r.page_id is None, r.rule) for r in out if r.rule and r.rule != "org/") == [(False, "example.org/es/")] * 2 + [(True, "example.org/es/")]
    split = urlrules.host_and_path(F.col("url"))
    found = pages.where("page_id = 2").select(urlrules.tokens(F.col("url"), *split).alias("t")).first().t
    assert len(found) == 3 + 3000 + 3000 + 1 and found[-1] == "depth=3000"


def test_equal_rules_tie_by_length_then_verdict(spark):
    index = spark.createDataFrame([(["a", "c"], "block", 1.0, 0.5, "a"), (["b"], "allow", 1.0, 0.5, "b"), (["d"], "block", 1.0, 0.5, "d")], "antecedent array<string>, verdict string, confidence double, support double, token string")
    urls = spark.createDataFrame([("u", ["a", "b", "c", "d"])], "url string, tokens array<string>")
    assert urlrules.match(urls, index).first().mined == "allow"


def test_empty_tables(spark, empty):
    assert pii.digest(pii.find_pii(empty)).count() == 0
    assert linededup.dedup_report(empty).count() == 0 and linededup.dedup_texts(empty).columns == empty.columns
    assert rules.report(empty).count() == 0
    assert sharding.report(empty).count() == 0
    assert urlrules.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_null_ids_pass(spark):
    one = spark.createDataFrame([(None, None, None)], "doc_id long, text string, size string")
    assert [r.n_words for r in rules.report(one).collect()] == [0]
    assert [r.slot for r in sharding.report(one).collect()] == [0]
    assert linededup.dedup_texts(one).select(F.col("text")).first()[0] is None


@pytest.mark.parametrize("n", [12, 48])
def test_parameters_that_nearly_always_come_together(spark, n):
    """Each of the tracking parameters of one host is on 97 % of its URLs; all of them are blocked, so each decides alone."""
    rng = random.Random(2)
    urls = [f"http://a.example.org/en/2?{'&'.join(f'o{j}=1' for j in range(3) if rng.random() < 0.5)}" for _ in range(1500)]
    urls += [f"http://b.com/de/x?{'&'.join(f'p{j}=1' for j in range(n) if rng.random() < 0.97)}" for _ in range(60)]
    urls += [f"http://c.net/x?p{j}=2" for j in range(n)] + ["http://c.net/x?o1=2"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlrules.judge(pages).where("rule IS NULL").collect()}
    assert got == {1560 + j: "block" for j in range(n)} | {1560 + n: "allow"}
