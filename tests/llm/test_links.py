"""Min-max near copies, spelling variants and hard negatives against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from kinweave.llm import minmax, negatives, spelling

DOCS = "doc_id long, text string, set_id string, label string, row string, band int"
BLANK = [None, "", " \n\t", "\x0b\x0c\r"]


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def plain_sets(texts, n=5):
    out = []
    for t in texts:
        words = re.findall("[^\x20\x09-\x0d]+", low(t))
        out.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    return out


def plain_components(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def expected_near(rows):
    sets = plain_sets([r[1] for r in rows])
    roots = plain_components(sets)
    out = []
    for i, r in enumerate(rows):
        known = [rows[j][0] for j in range(len(rows)) if roots[j] == roots[i] and rows[j][0] is not None]
        least = min(known, default=None)
        out.append((r[0], len(sets[i]), least, r[0] == least))
    return out


def varied(rng, base, share):
    return [w if rng.random() > share else f"n{rng.randrange(9000)}" for w in base]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    rows = [(i, t) for i, t in enumerate(BLANK + ["one", "ONE", "two words", "a b c d e", "x " * 9000])]
    for g in range(10):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([8, 30, 150]))]
        rows += [(100 + 20 * g + k, " ".join(varied(rng, base, 0.008 * (g % 4)))) for k in range(12)]
    # a chain: each text is near the next one only
    chain = [f"c{i}" for i in range(160)]
    for k in range(12):
        rows.append((900 - k, " ".join(chain[4 * k : 4 * k + 110])))
    rows += [(None, "no id here " * 30), (None, "only null ids of these words " * 9), (None, "only null ids of these words " * 9), (7, "no id here " * 30), (100, rows[20][1]), rows[20]]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", "l", "r", 3) for r in rows], DOCS)


def test_near_copies_equal_plain_components(spark, texts):
    got = [tuple(r) for r in minmax.report(frame(spark, texts)).collect()]
    want = expected_near(texts)
    assert Counter(got) == Counter((*w[:3], w[2] is None if w[0] is None else w[3]) for w in want)
    assert len({w[2] for w in want}) < len(want) - 60


def test_buckets_of_several_components_are_compared_in_blocks(spark, texts, monkeypatch):
    want = Counter(tuple(r) for r in minmax.report(frame(spark, texts)).collect())
    monkeypatch.setattr(minmax, "BLOCK", 3)
    monkeypatch.setattr(minmax, "STAR", 2)
    assert Counter(tuple(r) for r in minmax.report(frame(spark, texts)).collect()) == want
    # without stars every link has to come from the blocks
    monkeypatch.setattr(minmax, "stars", lambda pairs, sets: pairs.select(F.col("pivot").alias("a"), F.col("set_id").alias("b")).where("false"))
    assert Counter(tuple(r) for r in minmax.report(frame(spark, texts)).collect()) == want


def test_both_ends_are_unbiased_and_vary_less():
    rng = np.random.default_rng(3)
    shares, single = [], []
    for _ in range(300):
        union = rng.integers(0, 1 << 63, 40, dtype=np.int64).astype(np.uint64)
        a, b = union[:37], union[3:]  # 34 of 40
        (low_a, high_a), (low_b, high_b) = minmax.ends_of(a), minmax.ends_of(b)
        shares.append(((low_a == low_b).mean() + (high_a == high_b).mean()) / 2)
        single.append((low_a == low_b).mean())
    assert abs(np.mean(shares) - 0.85) < 0.006
    assert np.var(shares) < 0.65 * np.var(single)


def test_links_at_the_threshold_are_found():
    rng = np.random.default_rng(5)
    found = 0
    for _ in range(400):
        union = rng.integers(0, 1 << 63, 200, dtype=np.int64).astype(np.uint64)
        a, b = (np.frombuffer(minmax.signature(np.sort(s)), np.uint8).reshape(minmax.BANDS, minmax.ROWS) for s in (union[:185], union[15:]))
        found += bool((a == b).all(axis=1).any())
    assert found == 400
    assert 1 - (1 - 0.85**minmax.ROWS) ** minmax.BANDS > 0.999999


def test_one_document_of_each_component_stays(spark, texts):
    docs = frame(spark, texts)
    kept = minmax.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    roots = plain_components(plain_sets([t for _, t in texts]))
    assert len(rows) == len(set(roots))
    assert sum(not re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows) == len(BLANK)


def plain_words(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    n = plain_words(rows)
    near = {w: [o for o in n if o != w and one_apart(w, o)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.fixture(scope="module")
def spelt():
    rng = random.Random(5)
    letters = "abcdeé"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 12))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "abababab", "bababab", "straÃŸe×÷", "ÀÉÎÕÜà"]
    rows = []
    for doc in range(490):
        own = []
        for s in rng.choices(stems, k=30):
            roll = rng.random()
            i = rng.randrange(len(s))
            if roll < 0.1:
                s = s[:i] + rng.choice(letters) + s[i + (roll < 0.05) :]
            elif roll < 0.13:
                s = s[:i] + s[i + 1 :]
            own.append(s.upper() if roll > 0.95 else s)
        rows.append((doc, rng.choice([" ", "\n", "1", "-", "ß_"]).join(own)))
    chain = ["zzzzzzzz" + "q" * k for k in range(4)]
    rows.append((500, " ".join([chain[0]] * 700 + [chain[1]] * 130 + [chain[2]] * 25 + [chain[3]] * 5)))
    return [*rows, rows[3], rows[3], (None, rows[4][1]), (None, None), (501, ""), (502, "y" * 40000 + " " + "long words " * 20000), (501, "twice here " * 9)]


def test_spelling_variants_equal_all_pairs(spark, spelt):
    got = [tuple(r) for r in spelling.report(frame(spark, spelt)).collect()]
    want = plain_variants(spelt)
    assert Counter(got) == Counter(want) and sum(w[1] is not None for w in want) > 20
    assert ("zzzzzzzzqqq", "zzzzzzzzqq", "zzzzzzzz") in {w[:3] for w in want}
    members = {(r.word, r.root) for r in spelling.grouped(frame(spark, spelt)).collect()}
    assert members == {(w[0], w[2]) for w in want}


def test_three_rarest_bigrams_lose_no_pair(spark):
    rng = random.Random(9)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(6, 10))) for _ in range(250)}
    vocabulary = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    pairs = {(r.word, r.other) for r in spelling.near_pairs(vocabulary).collect()}
    assert pairs == {(a, b) for a in words for b in words if one_apart(a, b)}


VECTORS = StructType().add("vec_id", LongType()).add("embedding", ArrayType(DoubleType())).add("label", LongType()).add("row", StringType()).add("cell", StringType())


def plain_negatives(rows):
    known = []
    for place, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        known.append((place, i, label, [int(np.floor(256 * x)) for x in v]))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for place, i, label, v in known:
        if i is None or i % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=False)), j, lab == label) for p, j, lab, w in known if p != place]
        for score, j, _ in sorted((s for s in scored if s[2]), key=order)[:5]:
            fits = sorted((s for s in scored if not s[2] and 30 * score <= 100 * s[0] <= 90 * score), key=order)
            out += [(i, j, rank + 1, s[1], score, s[0]) for rank, s in enumerate(fits[:10])]
    return Counter(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8)) * 2
    rows = []
    for i in range(700):
        v = (centres[i % 6] + rng.normal(size=8) * rng.choice([0.1, 0.5, 1.5])).tolist()
        rows.append((i, v, int(rng.integers(0, 4))))
    rows += [(1000 + i, rows[5][1], i % 3) for i in range(60)]  # one vector many times
    rows += [(2000, None, 1), (2001, rows[0][1], None), (2002, [1.0, None], 1), (2003, [float("nan")] * 8, 1), (2004, [float("inf")] * 8, 2), (2100, [], 2), (2200, rows[0][1][:3], 0), (2201, rows[0][1] + [3.0], 0)]
    rows += [(None, rows[0][1], 0), (None, rows[6][1], 1), rows[100], rows[100], (100, rows[3][1], 3), (-100, rows[9][1], 2), (2300, [0.0] * 8, 1)]
    return rows


def vector_frame(spark, rows):
    return spark.createDataFrame([(*r, "r", "c") for r in rows], VECTORS)


@pytest.mark.parametrize("cells, chunk", [(4, 1 << 18), (7, 100)])
def test_negatives_equal_a_plain_search(spark, vectors, monkeypatch, cells, chunk):
    monkeypatch.setattr(negatives, "MIN_CELLS", cells)
    monkeypatch.setattr(negatives, "CHUNK", chunk)
    if chunk == 100:
        monkeypatch.setattr(negatives, "CELL_ANCHORS", 2)
        monkeypatch.setattr(negatives, "MAX_CELLS", 5)
        monkeypatch.setattr(negatives, "BLOCK_CELLS", 64)
    got = Counter(tuple(r) for r in negatives.mined(vector_frame(spark, vectors)).collect())
    assert got == plain_negatives(vectors) and len(got) > 100


def test_rows_go_only_where_they_may_serve(spark):
    rng = np.random.default_rng(4)
    centres = np.eye(8) * 8
    rows = [(i, (centres[i // 50 % 8] + rng.normal(size=8) * 0.05).tolist(), i % 5) for i in range(1600)]
    packed = negatives.quantised(vector_frame(spark, rows)).withColumn("row", F.col("ord"))
    anchors = packed.where("ord % 50 = 0")
    top, dim = packed.agg(F.max("norm2")).first()[0], 8
    sample = np.array([[int(np.floor(256 * x)) for x in rows[i][1]] for i in range(0, 1600, 50)], float)
    cells = negatives.Cells(negatives.pivots_of(sample, 8), top, dim)
    placed = negatives.placed(anchors, cells, False).withColumn("low", F.lit(3_500_000)).withColumn("high", F.lit(1 << 40))
    need = negatives.needs(placed, len(cells.pivots))
    everywhere = negatives.placed(packed, cells, True)
    assert negatives.served(everywhere, cells, need, True, False).count() == 0
    assert negatives.served(everywhere, cells, need, False, True).count() == 1600
    # rows of labels that no anchor of the cell has serve nobody there
    wanted = placed.select("cell", "label").distinct()
    assert negatives.served(everywhere, cells, need, True, True).count() == everywhere.join(wanted, ["cell", "label"]).count() < 1600


def test_large_components_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-(10**6), 10**6, 4) * 3.7).tolist(), i % 3) for i in range(300)]
    want = plain_negatives(rows)
    assert Counter(tuple(r) for r in negatives.mined(vector_frame(spark, rows)).collect()) == want
    monkeypatch.setattr(negatives, "EXACT", 0)
    assert Counter(tuple(r) for r in negatives.mined(vector_frame(spark, rows)).collect()) == want


def test_empty_tables_give_no_rows(spark):
    docs = frame(spark, [(1, "a b")]).where("false")
    assert minmax.report(docs).count() == minmax.keep_one(docs).count() == spelling.report(docs).count() == 0
    assert negatives.mined(vector_frame(spark, [(1, [1.0], 1)]).where("false")).count() == 0
    assert negatives.mined(vector_frame(spark, [(1, [1.0], 1)])).count() == 0
