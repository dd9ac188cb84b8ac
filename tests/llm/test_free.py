"""The operators with Python inside tasks, and the pipeline, against plain Python."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from kinweave.llm import classifier, decontam, jaccard, packing, warc, words

from . import brute

DOC = "doc_id long, text string, lang string, source string, n_chars long, body string, row string"
EDGE = [None, "", " .\n", "one", "Two words", "ÀÉ À a-b A_b 12é" * 3, "x " * 5000]


@pytest.fixture(scope="module")
def near(spark, sf_dir):
    """Real documents, edge cases, and groups of near copies around the threshold."""
    rng = random.Random(7)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    rows += [(1000 + i, t, None, None, None) for i, t in enumerate(EDGE + EDGE[:3])]
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 120, 300]))]
        for k in range(8):
            own = [w if rng.random() > 0.012 * (g % 4) else f"n{rng.randrange(5000)}" for w in base]
            rows.append((2000 + 10 * g + k, " ".join(own) if k % 2 else ", ".join(own).upper(), "en", "s", 1))
    rows += [(None, "null id text of its own " * 20, None, None, None), (2000, "same id, other text " * 30, None, None, None), rows[-1]]
    return spark.createDataFrame([(*r, "b", "r") for r in rows], DOC)


def plain(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAzZ09éÀ \n-_~\x7f\x80", max_size=30)), max_size=8), st.integers(1, 40))
def test_words(texts, size):
    known = {}
    array = pa.array(texts, pa.string())
    for first, last, data, offsets in words.chunks(array, size):
        hashes, firsts = words.word_hashes(data, offsets)
        for i in range(first, last):
            own = brute.low_words(texts[i])
            got = hashes[firsts[i - first] : firsts[i - first + 1]]
            assert len(own) == len(got)
            for w, h in zip(own, got.tolist(), strict=True):
                assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def items_of(spark, docs, rng):
    texts = [brute.low_words(t) for _, t in docs if t and len(t) > 300][:12]
    rows = [(i, "lead in " * 6 + " ".join(t[20:60]).upper() + " tail") for i, t in enumerate(texts[:6])]
    rows += [(10 + i, " ".join(t[3:10])) for i, t in enumerate(texts[6:9])]
    rows += [(30, " ".join(texts[0][5:18])), (31, None), (32, ""), (33, "x " * 40), (34, "zzzz qqqq unseen words"), (None, " ".join(texts[1][40:70])), (0, rows[0][1]), (35, " ".join(texts[2][30:42]))]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_contamination(spark, near):
    docs = plain(near)
    items = items_of(spark, docs, random.Random(1))
    expected = brute.contamination(docs, [(r.item_id, r.text) for r in items.where("item_id is not null").collect()])
    null_item = [r.text for r in items.where("item_id is null").collect()]
    hits = {i: r for i, r in enumerate(brute.contamination(docs, [(r.item_id, r.text) for r in items.collect()]))}
    expected = [(e[0], e[1], hits[i][2], e[3], e[4], hits[i][5]) for i, e in enumerate(expected)]
    got = decontam.report(near, items).collect()
    assert null_item and sorted((tuple(r)[:6] for r in got), key=repr) == sorted(expected, key=repr)
    assert sum(r.contaminated for r in got) >= 5 and all(r.n_near >= r.n_items for r in got)
    kept = decontam.clean(near, items)
    assert kept.columns == near.columns
    assert sorted(map(repr, plain(kept))) == sorted(repr(d) for d, e in zip(docs, expected, strict=True) if not e[5])


def test_contamination_by_blocks_is_the_same(spark, near, monkeypatch):
    items = items_of(spark, plain(near), random.Random(1))
    whole = sorted(map(repr, decontam.report(near, items).collect()))
    monkeypatch.setattr(decontam, "MAX_TERMS", 150)
    assert sorted(map(repr, decontam.report(near, items).collect())) == whole


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta " + "filler " * 5 + "gamma delta"), (2, "alpha " + "filler " * 60 + "delta")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha delta")], "item_id long, text string")
    assert {r.doc_id: (r.n_hit, r.n_near) for r in decontam.report(docs, items).collect()} == {1: (0, 1), 2: (0, 0)}


def brute_near(docs, items, slop=10):
    """Items whose windows' two rarest places come near their own distance, by document."""
    count = Counter(w for _, t in docs for w in brute.low_words(t))
    out = []
    for _, text in docs:
        at = {}
        for q, w in enumerate(brute.low_words(text)):
            at.setdefault(w, []).append(q)
        near = set()
        for item, t in items:
            w = brute.low_words(t)
            n = min(13, len(w))
            for start in range(len(w) - n + 1 if w else 0):
                two = sorted((count[w[p]], p) for p in range(start, start + n))[:2]
                (c, p1), (_, p2) = two[0], two[-1]
                if c and any(abs((x - p1) - (y - p2)) <= slop for x in at.get(w[p1], ()) for y in at.get(w[p2], ())):
                    near.add(item)
                    break
        out.append(len(near - {None}))
    return out


def test_near_items_equal_a_plain_count(spark, near):
    some = near.where("length(text) < 3000 or text is null")
    docs = plain(some)
    items = items_of(spark, plain(near), random.Random(1))
    expected = brute_near(docs, [(r.item_id, r.text) for r in items.collect()])
    got = decontam.report(some, items).select("doc_id", "n_words", "n_near").collect()
    assert sum(expected) > 10
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, len(brute.low_words(t)), n)) for (i, t), n in zip(docs, expected, strict=True))


def test_many_repeated_rows(spark):
    item = " ".join(f"word{i}" for i in range(30))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("before " + item).alias("text"))
    assert [tuple(r) for r in decontam.report(docs, items).groupBy("n_words", "n_hit", "n_items", "n_near").count().collect()] == [(31, 30, 1, 1, 40_000)]


def brute_groups(docs):
    sets = [brute.shingles(t) for _, t in docs]
    keys = [tuple(brute.low_words(t)) for _, t in docs]
    classes = sorted(set(keys))
    of = {k: brute.shingles(" ".join(k)) for k in classes}
    root = {k: k for k in classes}
    degree = Counter()

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(classes):
        for b in classes[:i]:
            both = len(of[a] & of[b])
            if of[a] and of[b] and both >= 0.8 * (len(of[a]) + len(of[b]) - both) - 1e-9:
                degree[a] += 1
                degree[b] += 1
                root[top(a)] = top(b)
    lowest, copy = {}, {}
    for (i, _), k in zip(docs, keys, strict=True):
        if i is not None:
            lowest[top(k)] = min(i, lowest.get(top(k), i))
            copy[k] = min(i, copy.get(k, i))
    assert len(sets) == len(docs)
    return [(i, lowest.get(top(k)), copy.get(k), degree[k]) for (i, _), k in zip(docs, keys, strict=True)]


@pytest.mark.parametrize("block", [128, 3])
def test_jaccard(near, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = plain(near)
    got = sorted(map(tuple, jaccard.report(near).collect()), key=repr)
    expected = sorted(brute_groups(docs), key=repr)
    assert got == expected and sum(x[3] for x in expected) > 50


def test_jaccard_rounds_count_no_pair_twice(near, monkeypatch):
    once = sorted(map(repr, jaccard.report(near).collect()))
    monkeypatch.setattr(jaccard, "recall", lambda bins, depth: 0.0)
    assert sorted(map(repr, jaccard.report(near).collect())) == once


def test_borderline_links_are_found_beside_a_hot_group(spark):
    """Pairs at 0.8 that share no whole label, beside near-identical copies that bring the bulk of all links."""
    rng = random.Random(9)
    sign = lambda text: jaccard.signature(words.shingle_hashes(words.word_hashes(*words.bytes_of(pa.array([text])))[0], jaccard.SHINGLE))
    labels = lambda sig: {(t, sig[t * jaccard.DEPTH : (t + 1) * jaccard.DEPTH]) for t in range(jaccard.TREES)}
    docs = []
    while len(docs) < 8:
        start = " ".join(f"w{rng.randrange(10**6)}" for _ in range(12))
        a, b = start + " one", start + " two"
        if not labels(sign(a)) & labels(sign(b)):
            docs += [(len(docs), a), (len(docs) + 1, b)]
    long = [f"v{i}" for i in range(300)]
    docs += [(100 + i, " ".join(long[: 7 * i] + [f"x{i}"] + long[7 * i + 1 :])) for i in range(30)]
    got = sorted(map(tuple, jaccard.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    assert got == sorted(brute_groups(docs)) and [x[3] for x in got[:8]] == [1] * 8


def test_one_of_each_group_stays(near):
    kept = jaccard.keep_one(near)
    # two texts share the id 2000, so the id of a group alone doesn't tell those groups apart
    groups = {repr((i, t)): (g[1], (t or "").startswith("same id")) for (i, t), g in zip(plain(near), brute_groups(plain(near)), strict=True)}
    assert kept.columns == near.columns
    left = [groups[repr(x)] for x in plain(kept)]
    assert sorted(map(repr, left)) == sorted(map(repr, set(groups.values())))


def test_pack():
    rng = random.Random(2)
    for n in [0, 1, 2, 3, 17, 200]:
        sizes = [rng.randrange(1, 1024) for _ in range(n)]
        out = packing.pack(sizes)
        pieces = sorted(p for w in out for p in w)
        for i, size in enumerate(sizes):
            own = [(s, length) for j, s, length in pieces if j == i]
            assert sum(length for _, length in own) == size and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
        assert all(0 < sum(p[2] for p in w) <= 1024 for w in out)
        assert len(out) == -(-sum(sizes) // 1024)


def test_pack_of_whole_rests_raises_the_windows():
    rng = random.Random(2)
    for n in [0, 1, 2, 17, 200]:
        sizes = [rng.randrange(1, 1025) for _ in range(n)]
        out = packing.pack(sizes, whole=True)
        assert sorted((i, length) for w in out for i, s, length in w if s == 0) == list(enumerate(sizes))
        assert all(sum(p[2] for p in w) <= 1024 for w in out)
    assert len(packing.pack([600] * 10, whole=True)) == 10 > -(-6000 // 1024)


def test_both_tokenizers_give_the_same_ids():
    """Every code point, alone and beside letters, digits, spaces and others."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    exact, encode = Tokenizer.from_file(path(packing.VOCABULARY)), packing.encoder(packing.VOCABULARY, packing.RANKS)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for step in range(0, len(points), 4096):
        own = points[step : step + 4096]
        texts = [" ".join(own), "".join(f"a{c}1{c}\n" for c in own)]
        for text, found in zip(texts, exact.encode_batch(texts, add_special_tokens=False), strict=True):
            assert found.ids == encode(text)


def test_packing_of_repeated_rows_and_long_texts(spark):
    long = "some words of a very long text " * 200_000
    rows = [(None, "same")] * 3000 + [(1, long), (1, long), (2, None), (2, "")]
    out = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).toPandas()
    whole = len(packing.encoder(packing.VOCABULARY, packing.RANKS)(long)) + 1
    n = len(packing.encoder(packing.VOCABULARY, packing.RANKS)("same")) + 1
    assert out.length.sum() == 3000 * n + 2 * whole + 2 and (out.doc_id.isna() & (out.start == 0)).sum() == 3000
    loads = out.groupby("sequence_id").length.sum()
    assert loads.max() <= 1024 and len(loads) * 1024 - loads.sum() < 3 * 2 * 1024
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own.offset == own.length.cumsum() - own.length).all()


def test_differencing_is_near_equal():
    rng = random.Random(4)
    sizes = [rng.randrange(1, 200) for _ in range(600)]
    parts = packing.differencing(sizes, 20)
    loads = [sum(sizes[i] for i in p) for p in parts]
    assert sorted(i for p in parts for i in p) == list(range(600)) and max(loads) - min(loads) <= 2


def test_packing(spark, near):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    extra = spark.createDataFrame([(5000, "a <|endoftext|> b　中文\u0085 ½²  \n\n 'S's", *[None] * 5)], near.schema)
    docs = near.where("doc_id is null or doc_id <> 2000").dropDuplicates().unionByName(extra)
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4") for r in docs.collect()}
    rows = packing.packed(docs).collect()
    assert rows == packing.packed(docs).collect()
    sequences, pieces = {}, {}
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == brute.crc(own[r.start : r.start + r.length].tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for parts in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)])]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024
    for doc, parts in pieces.items():
        if doc is not None:
            assert sum(n for _, n in parts) == len(ids[doc])


def test_classifier(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = classifier.report(docs, labels).where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").toPandas()
    assert len(held) > 500
    good, bad = held.score[held.quality == 1], held.score[held.quality == 0]
    auc = np.mean(np.searchsorted(np.sort(bad.values), good.values) / len(bad))
    print("held-out auc", auc, "accuracy", (held.predicted == held.quality).mean(), "good kept", (good >= 0.3).mean(), "bad kept", (bad >= 0.3).mean())
    assert auc > 0.97 and (good >= 0.3).mean() > 0.99


def test_classifier_edges(spark, near):
    labels = spark.createDataFrame([(None, 1, 0), (1000, None, 0), (2001, 1, 0), (2001, 0, 0), (2002, 1, None)], "doc_id long, quality int, toxic int")
    out = classifier.report(near, labels).collect()
    assert len(out) == near.count() and all(0 <= r.score <= 1 for r in out)
    none = labels.limit(0)
    assert {r.score for r in classifier.report(near, none).collect()} == {0.5}
    assert classifier.keep_good(near, none).columns == near.columns
    assert all(r.held_out == (brute.crc(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)


def plain_best_split(x, g, h, edges):
    """The best (gain, feature, limit) by trying all of them."""
    best = (1e-9, None, None)
    total = g.sum() ** 2 / (h.sum() + classifier.RIDGE)
    for f in range(x.shape[1]):
        for limit in edges[f]:
            low = x[:, f] <= limit
            if min(low.sum(), (~low).sum()) >= classifier.LEAST_ROWS:
                gain = g[low].sum() ** 2 / (h[low].sum() + classifier.RIDGE) + g[~low].sum() ** 2 / (h[~low].sum() + classifier.RIDGE) - total
                if gain > best[0] + 1e-9:
                    best = (gain, f, limit)
    return best


def test_splits_are_the_best_ones_and_leaves_their_newton_steps():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(400, 4)), 1)
    y = ((x[:, 1] > 0.3) & (x[:, 2] < 0.5) | (rng.random(400) < 0.1)).astype(float)
    forest = classifier.fit(x, y)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, classifier.BINS + 1)[1:-1])) for f in range(4)]
    raw = np.full(400, np.log(y.mean() / (1 - y.mean())))
    for t in range(3):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(400, dtype=int)
        for k in range(2**classifier.DEPTH - 1):
            inside = node == k
            gain, feature, limit = plain_best_split(x[inside], g[inside], h[inside], edges) if inside.any() else (0, None, None)
            if feature is None:
                assert forest.limit[t, k] == np.inf
                node[inside] = 2 * k + 1
            else:
                low = x[:, forest.feature[t, k]] <= forest.limit[t, k]
                a, b = inside & low, inside & ~low
                own = g[a].sum() ** 2 / (h[a].sum() + 1) + g[b].sum() ** 2 / (h[b].sum() + 1) - g[inside].sum() ** 2 / (h[inside].sum() + 1)
                assert abs(own - gain) < 1e-6
                node[a], node[b] = 2 * k + 1, 2 * k + 2
        for leaf in range(2**classifier.DEPTH):
            own = node == leaf + 2**classifier.DEPTH - 1
            if own.any():
                assert abs(forest.leaf[t, leaf] - classifier.RATE * g[own].sum() / (h[own].sum() + classifier.RIDGE)) < 1e-9
                raw[own] += forest.leaf[t, leaf]


def test_flat_traversal_equals_a_walk_from_node_to_node():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(500, 6)), 1)
    forest = classifier.fit(x, ((x[:, 0] > 0) ^ (x[:, 5] > 0.2)).astype(float))
    for row, got in zip(x, forest.raw(x), strict=True):
        total = forest.start
        for features, limits, leaves in zip(forest.feature, forest.limit, forest.leaf, strict=True):
            node = 0
            while node < len(features):
                node = 2 * node + (2 if row[features[node]] > limits[node] else 1)
            total += leaves[node - len(features)]
        assert abs(total - got) < 1e-9


def test_statistics_of_a_very_long_text():
    text = "Some words, and others: 12! " * 100_000
    one, many = classifier.statistics(pa.array([text, None, "x"])), classifier.statistics(pa.array([text]))
    assert (one[0] == many[0]).all() and not one[1].any() and abs(one[0][STAT["words"]] - np.log1p(500_000)) < 1e-9


STAT = {name: i for i, name in enumerate(classifier.STATISTICS)}


def test_forest_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    assert ((classifier.fit(x, y).score(x) > 0.5) == y).mean() > 0.97


PAGES = [(3, "u3", "é" * 60), (1, "u\r\n1", "é" * 60), (2, None, "é" * 60), (4, "u4", "short"), (5, "u5", "short"), (6, "u6", None), (7, "u7", ""), (8, "u8", "a\r\n\r\nb" * 40), (9, "u9", "a\r\n\r\nb" * 40), (None, "n", "é" * 60), (1, "again", "é" * 60)]


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "d") for p in PAGES], "page_id long, url string, html string, digest string")
    out = sorted((tuple(r) for r in warc.report(pages).collect()), key=repr)
    expected = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        revisit = len(data) >= 100 and i != min(same)
        expected.append((i, len(data), brute.hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None))
    assert out == sorted(expected, key=repr)
    records = warc.read(spark, warc.write(pages))
    warc.export(records, f"file://{tmp_path}/warc", 4)
    back = {(r.header, bytes(r.block).decode()) for r in warc.read_warc(spark, f"file://{tmp_path}/warc").collect()}
    assert back == {(r.header, "" if "revisit" in r.header.split("\r\n")[1] else r.payload) for r in records.collect()}


def test_warc_by_classes_of_size(spark, monkeypatch):
    """Files of few records, of all classes, with very long payloads and ids of all signs."""
    monkeypatch.setattr(warc, "SIZES", (100, 10_000))
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    monkeypatch.setattr(warc, "BATCH_BYTES", 5_000)
    long = "WARC/1.1\r\n\r\n\r\n" * 300_000
    rows = [(i, "u", t) for i, t in [(-(2**63), "x" * 99), (2**63 - 1, "y" * 5000), (-5, "y" * 5000), (7, long), (8, long), (0, "é\r\n" * 40), *((100 + k, f"{k} " * (k % 90)) for k in range(400))]]
    out = {tuple(r) for r in warc.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    first = {}
    for i, _, t in sorted(rows):
        first.setdefault(t, i)
    assert out == {
        (i, len(t.encode()), brute.sha(t), *(("revisit", first[t]) if len(t.encode()) >= 100 and first[t] != i else ("response", None))) for i, _, t in rows
    }


def test_warc_finds_broken_payloads(spark):
    pages = spark.createDataFrame([(1, "u", "payload")], "page_id long, url string, html string")
    path = warc.write(pages)
    spark.createDataFrame([(brute.sha("payload"), "changed")], "digest string, payload string").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="filed under"):
        warc.read(spark, path).collect()


def test_empty_tables(spark, near):
    none = near.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.report(none, items).count() == 0 and decontam.report(near, items).where("n_hit > 0").count() == 0
    assert jaccard.report(none).count() == 0 and jaccard.keep_one(none).columns == none.columns
    assert packing.packed(none).count() == 0
    assert classifier.report(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert warc.report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_stages_equal_plain_versions(spark, sf_dir, near, tmp_path):
    """Each stage on rows with null and repeated ids, null, empty and repeated texts, and clashing columns."""
    docs = near.where("length(text) < 3000 or text is null")
    rows = plain(docs)
    rng = random.Random(1)
    items = items_of(spark, plain(near), rng)
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)

    scores = [(r.doc_id, r.score) for r in classifier.report(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()]
    kept = stages["quality"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(i for i, score in scores if score >= 0.3)

    lined = stages["lines"](spark, docs, str(tmp_path))
    expected = Counter((i, digest) for i, _, _, digest in brute.line_dedup(rows))
    assert lined.columns == docs.columns and Counter((r.doc_id, brute.sha(r.text or "")) for r in lined.collect()) == expected
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lined.collect())

    one = stages["near copies"](spark, docs, str(tmp_path))
    groups = {g[1] for g in brute_groups(rows)}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} >= groups - {None} and one.count() < len(rows)

    clean = stages["benchmark"](spark, docs, str(tmp_path))
    hit = brute.contamination(rows, [(r.item_id, r.text) for r in items.collect()])
    assert clean.columns == docs.columns and Counter(plain(clean)) == Counter(d for d, h in zip(rows, hit, strict=True) if not h[5])

    pieces = stages["sequences"](spark, docs, str(tmp_path)).toPandas()
    encode = packing.encoder(packing.VOCABULARY, packing.RANKS)
    assert pieces.length.sum() == sum(len(encode(t or "")) + 1 for _, t in rows) and pieces.groupby("sequence_id").length.sum().max() <= 1024


def test_stages_take_empty_tables(spark, near, tmp_path):
    none = near.limit(0)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0 and (name == "sequences" or out.columns == none.columns)
    assert stage and corpus_pipeline.STAGES[0][1](spark, near, str(tmp_path)).count() == near.count()


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        assert out.columns == docs.columns
        counts.append(len(rows))
        docs = spark.createDataFrame(rows, docs.schema)
    assert counts[0] > counts[1] >= counts[2] > counts[3] > counts[4] > 100
    staged = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    total = lambda df: tuple(df.agg(F.sum("length"), F.countDistinct("doc_id")).first())
    assert total(corpus_pipeline.run(spark, sf_dir)) == total(staged)


@pytest.mark.parametrize("end", ["\u0085", "\u2028", "\u2029", "\x0b", "\x0c"])
def test_warc_headers_end_lines_with_cr_lf_only(spark, end):
    """What looks like a header line of its own in a URL is a part of the URL."""
    extra = ["WARC-Payload-Digest: sha256:00", "WARC-Refers-To: <urn:uuid:00000000-0000-8000-8200-000000000000>", "WARC-Type: revisit", "Content-Length: 7"]
    rows = [(i, f"http://a/{end}{x}", "long enough " * 20 + x) for i, x in enumerate(extra)] + [(9, f"http://b/{end}", "long enough " * 20 + extra[0]), (10, f"http://c/\r\n{extra[2]}", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_digest) for r in warc.report(pages).collect()}
    assert got == {i: ("revisit" if i == 9 else "response", 0 if i == 9 else None, brute.sha(t)) for i, _, t in rows}
