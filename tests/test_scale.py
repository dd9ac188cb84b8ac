"""Plans of joins between tables that grow with the input: none of them is broadcast because its size is judged too low."""

import re

from pyspark.sql import functions as F

from kinweave import storage
from kinweave.llm import spelling
from kinweave.operators import cascade, equality, journal, lookups, mapping, measures, signatures, slices
from kinweave.plans import equality as plans
from kinweave.plans import changes, mappings
from kinweave.sources import lines, mappingfile


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_and_their_keys_are_never_broadcast(spark):
    vocabulary = spark.createDataFrame([("spelling", 9), ("speling", 5), ("another", 7)], "word string, n long")
    pairs = spelling.near_pairs(vocabulary)
    assert "Broadcast" not in plan(pairs)
    assert {tuple(r) for r in pairs.collect()} == {("spelling", "speling"), ("speling", "spelling")}
    docs = spark.createDataFrame([(i, "spelling speling") for i in range(5)], "doc_id long, text string")
    assert "Broadcast" not in plan(spelling.variants(docs))


def test_sides_of_potential_pairs_are_never_broadcast(spark, sf_dir):
    a = spark.createDataFrame([(1, "n", True, True, None), (2, "m", False, True, 1)], "id long, name string, disguised boolean, matchable boolean, element long")
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "a long, b long")
    found = equality.class_verdicts(pairs, a, a, pairs.where("a = 3"), {"loose": False, "strict": True})
    assert "Broadcast" not in plan(found)
    assert {tuple(r) for r in found.collect()} == {(1, 1, True, True), (1, 2, False, False), (2, 2, True, True)}


def test_pairs_of_methods_meet_before_no_shuffle_but_their_own(spark, sf_dir):
    """Matches and hierarchies are met by methods: after the join that makes pairs, nothing is shuffled."""
    text = plan(plans.method_candidates(spark, sf_dir)).split("== Initial Plan ==")[0]
    assert "Broadcast" not in text
    above = text[: text.index("SortMergeJoin")]
    assert "Exchange" not in above and "[_ob" in text[text.index("SortMergeJoin") :].split("\n")[0]


def test_sets_of_pairs_are_never_broadcast(spark):
    pairs = spark.createDataFrame([("a1", "b1")], "a string, b string")
    sets = [spark.createDataFrame([(f"{s}1", f"{s}2", False, "n")], f"{s} string, {i} string, disguised boolean, name string") for s, i in (("a", "x"), ("b", "y"))]
    found = measures.of_disguised_sets(pairs, *sets, spark.createDataFrame([], "x string, y string"))
    assert "Broadcast" not in plan(found)
    assert found.first().similarity == 1.0


def test_nodes_of_signatures_are_never_broadcast(spark):
    node = "path string, label string, key string, name string, disguised boolean"
    left, right = (spark.createDataFrame([(1, "t", "I", None, None, False)], f"{c} long, {node}") for c in "ab")
    found = signatures.could_be(spark.createDataFrame([(1, 1)], "a long, b long"), left, right)
    assert "Broadcast" not in plan(found)
    assert found.first().similarity == 1.0


def test_descriptors_meet_names_by_shuffles_and_are_never_collected_piece_by_piece(spark):
    rows = spark.createDataFrame([(1, "([[Lx;ILy;Lx;)V"), (2, "(Lx;Ly;)[Lx;"), (3, "(IJ)V"), (4, "")], "id long, descriptor string")
    names = spark.createDataFrame([("x", "q/X"), ("y", None), ("z", "q/Z")], "name string, full string")
    found = mapping.descriptors_both(rows, names, "id")
    assert "Broadcast" not in plan(found) and "ObjectHashAggregate" not in plan(found)
    assert {tuple(r) for r in found.collect()} == {(1, None, "([[Lq/X;ILy;Lq/X;)V"), (2, None, "(Lq/X;Ly;)[Lq/X;"), (3, "(IJ)V", "(IJ)V")}
    strict = mapping.descriptors_in(rows, names.unionByName(names.selectExpr("name", "'r/Y' AS full").where("name = 'y'")), "id")
    assert "Broadcast" not in plan(strict) and {tuple(r) for r in strict.collect()} == {(1, "([[Lq/X;ILr/Y;Lq/X;)V"), (2, "(Lq/X;Lr/Y;)[Lq/X;"), (3, "(IJ)V")}


def test_passes_of_slices_shuffle_only_what_the_last_one_found(spark, monkeypatch):
    """Edges and what is seen are read in buckets: a pass has the two exchanges of its front."""
    plans, write = [], slices.bucketed
    monkeypatch.setattr(slices, "bucketed", lambda rows, *rest: plans.append(plan(rows)) or write(rows, *rest))
    insns = spark.range(4).selectExpr(
        "1 AS method", "id AS place", "CAST(id > 0 AS INT) AS height", "CAST(id > 0 AS INT) AS pops", "1 AS pushes", "CAST(NULL AS ARRAY<INT>) AS moves",
        "CAST(NULL AS INT) AS load", "CAST(ARRAY() AS ARRAY<INT>) AS stores", "CAST(ARRAY() AS ARRAY<INT>) AS jumps", "TRUE AS falls",
    )
    found = slices.Graph(insns).slices(spark.createDataFrame([(7, 1, 3)], "item int, method int, place long"))
    assert sorted(r.place for r in found.collect()) == [0, 1, 2, 3]
    assert len(plans) == 6
    for text in plans[2:]:
        assert text.count("Bucketed: true") == 2 and text.count("Exchange") == 2 and "Broadcast" not in text


def test_lines_with_gaps_are_tied_by_windows_of_a_block_at_most(spark, monkeypatch):
    """Each line is a block of its own here: no window of blocks holds all of them."""
    sizes, tie = [], lines.before_blocks
    monkeypatch.setattr(lines, "before_blocks", lambda ends, *rest: sizes.append(ends.count()) or tie(ends, *rest))
    rows = spark.range(30).selectExpr("'f' AS file", "id * id * 100 - 5000 AS line", "id")
    found = lines.carried(rows, {"last": F.when(F.col("id") % 7 == 3, F.col("id"))}, block=10)
    assert {r.id: r.last for r in found.collect()} == {i: max((j for j in range(i + 1) if j % 7 == 3), default=None) for i in range(30)}
    assert sizes[0] == 30 and len(sizes) > 3 and sizes[-1] < 10


def test_a_files_header_meets_its_lines_where_they_are(spark):
    rows = spark.createDataFrame([("f", -1, "tiny\t2\t0\ta\tb"), ("f", 1, "c\tx\ty"), ("f", 5 * 10**13, "\tf\tI\tm\tn")], "file string, line long, value string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = mappingfile.parsed(rows, "a", "b")
        assert "BroadcastHashJoin [file" in plan(found)
        assert {(r.kind, r["class"], r.member, r.src, r.dst) for r in found.collect()} == {("class", "x", None, "x", "y"), ("field", "x", "m", "m", "n")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_passes_of_a_cascade_shuffle_only_what_they_find(spark, monkeypatch):
    plans, write = [], journal.bucketed
    monkeypatch.setattr(journal, "bucketed", lambda rows, *rest: plans.append(plan(rows)) or write(rows, *rest))
    follows = spark.createDataFrame([("c", "m"), ("m", "v"), ("v", "c"), ("x", "y"), ("d", "m")], "a string, then string")
    found = journal.cascade(spark.createDataFrame([("c",), ("d",)], "a string"), follows)
    assert {tuple(r) for r in found.collect()} == {("c", None), ("d", None), ("m", "c"), ("v", "m")}
    assert len(plans) == 5
    for text in plans[2:]:
        assert text.count("Bucketed: true") == 3 and text.count("Exchange") == 1 and "Broadcast" not in text


def test_variables_are_looked_up_in_more_tasks_where_there_are_more(spark, sf_dir, monkeypatch):
    """No exchange has the session's number of partitions, whatever the rows, and none is broadcast; contradictions and places out of range find nothing."""
    assert storage.tasks_for(spark, 0) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(storage, "TASK_ROWS", 2)
    columns = "owner long, argument boolean, index int, slot int, entry int"
    variables = spark.createDataFrame([(i, i // 4, i % 4 < 2, i % 2, i % 4, i % 4 + 1) for i in range(40)], f"id long, {columns}")
    rows = spark.createDataFrame([(1, 0, True, 1, -1, -1), (2, 1, False, -1, 2, -1), (3, 2, False, -1, -1, 4), (4, 3, True, 2, -1, -1), (5, 4, True, 0, 3, -1), (6, 99, False, -1, 0, -1), (7, 5, None, -1, 0, -1)], f"line long, {columns}")
    found = mapping.variable_rows(rows, variables)
    assert {r.line: r.id for r in found.collect()} == {1: 1, 2: 6, 3: 11, 4: None, 5: None, 6: None, 7: None}
    assert "Broadcast" not in plan(found)
    monkeypatch.setattr(storage, "TASK_ROWS", 200)
    query = plan(mappings.variable_lookup(spark, sf_dir))
    tasks = storage.tasks_for(spark, spark.read.parquet(f"{sf_dir}/lineitem.parquet").count())
    dealt = re.findall(r"Exchange hashpartitioning\(.*, (\d+)\), (\w+)", query)
    assert dealt and {(int(n), origin) for n, origin in dealt} == {(tasks, "REPARTITION_BY_NUM")}


def test_owners_with_the_same_interfaces_are_one(spark, sf_dir):
    """Only one of them meets members, and a brand's parts aren't gathered for its first one."""
    faces = spark.createDataFrame([(o, s) for o, all_ in {"a": "xy", "b": "yx", "c": "x", "d": "xyz"}.items() for s in all_], "sub string, sup string")
    assert {tuple(r) for r in lookups.alike(faces, "sub").collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")}
    wanted, classes, faces, members = changes.program(spark, sf_dir)
    assert not any("Window" in plan(df) for df in (wanted, classes, faces, members))


def test_methods_are_written_inside_the_tasks_of_their_hierarchies(spark, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 1)
    columns = "id long, grouped long, root boolean, src string, names array<string>, comment string, n_variables int, ord long"
    methods = spark.createDataFrame([(i, i // 3, i % 3 > 0, "m", ["n" if i % 2 else "m"], None, 0, i) for i in range(12)], columns)
    found = {v: mapping.exported_methods(methods, v) for v in ("minimal", "roots", "full")}
    assert {v: sorted(r.id for r in f.collect()) for v, f in found.items()} == {"minimal": [1, 5, 7, 11], "roots": [1, 5, 7, 11], "full": [1, 3, 5, 7, 9, 11]}
    for f in found.values():
        assert "Broadcast" not in plan(f) and set(re.findall(r"hashpartitioning\(grouped#\d+L, (\d+)\)", plan(f))) == {"13"}


def test_partners_and_outer_classes_are_never_broadcast(spark):
    classes = spark.createDataFrame([(1, 3, "p/A", False, None, "a"), (2, None, "p/A$B", True, 1, "b"), (3, 1, "q/C", True, None, "c")], "id long, partner long, name string, disguised boolean, outer long, mapped string")
    assert "Broadcast" not in plan(cascade.beside_partner(classes))
    found = cascade.class_names(classes, cascade.MAPPED)
    assert {r.id: r.full for r in found.collect()} == {1: "a", 2: "a$b", 3: "c"}


def test_shared_features_meet_by_the_cheaper_way_and_pairs_never_copy_sets(spark, monkeypatch):
    """A hub's own members tie their few owners directly, what all owners have is listed in their rows, and long lists meet as rows; the result is that of comparing all."""
    members = [(f"a{i}", f"x{j}", j % 3 == 0, f"n{j}") for i in range(12) for j in ([900 + i, 0, 1, i % 4] if i else [*range(100, 160), 0])]
    left, right = sorted(set(members)), sorted({(o.replace("a", "b"), x.replace("x", "y"), d, n) for o, x, d, n in members if (len(o) + len(x)) % 5})
    met = [(f"x{j}", f"y{j}") for j in [0, 1, *range(100, 140), *range(900, 906)]]
    pairs = [(f"a{i}", f"b{j % 12}") for i in range(12) for j in (i, i + 1)]

    def score(a, b):
        mine, other = [r for r in left if r[0] == a], [r for r in right if r[0] == b]
        to, back = dict(met), {y: x for x, y in met}

        def found(m, others, way, back):
            if m[1] in way:
                return any(r[1] == way[m[1]] for r in others)
            return any(r[1] not in back and (m[2] or r[2] or m[3] == r[3]) for r in others)

        if not mine or not other:
            return float(mine == other)
        return (sum(found(m, other, to, back) for m in mine) + sum(found(m, mine, back, to) for m in other)) / (len(mine) + len(other))

    frames = [spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame(left, "a string, x string, disguised boolean, name string"), spark.createDataFrame(right, "b string, y string, disguised boolean, name string"), spark.createDataFrame(met, "x string, y string")]
    seen, deal = [], measures.dealt_features
    monkeypatch.setattr(measures, "dealt_features", lambda *rest: seen.append(deal(*rest)) or seen[-1])
    for most in (64, 1):
        monkeypatch.setattr(measures, "LISTED", most)
        got = {(r.a, r.b): round(r.similarity, 9) for r in measures.of_disguised_sets(*frames).collect()}
        assert got == {p: round(score(*p), 9) for p in pairs}
        assert "set =" in seen[-1][3] and "set =" in seen[-1][2]
        # what is met as rows is less than all members in all pairs
        assert seen[-1][0].count() <= len(pairs)


def test_pairs_of_methods_decide_about_their_owners_without_a_table_of_owner_pairs(spark, sf_dir):
    found, _ = plans.method_parts(spark, sf_dir)
    text = plan(found).split("== Initial Plan ==")[0]
    # pairs move to their a and to their b, and methods, matches, groups and owners to each other on each side; owner pairs would be joined again
    assert "Broadcast" not in text and "_oa" not in text and text.count("SortMergeJoin") == 10
    kept = {(r.a, r.b): r.potential for r in found.collect()}
    assert any(kept.values()) and not all(kept.values())


def test_trees_are_compared_once_for_all_owners_that_have_them(spark, monkeypatch):
    node = "path string, label string, key string, name string, disguised boolean"
    tree = lambda i: [] if i == 9 else [("", "L", None, f"n{i % 3}", False), ("a", "*" if i % 2 else "T", None, None, False)]
    left, right = ([(i, *t) for i in range(10) for t in tree(i + n)] for n in (0, 1))
    sides = [spark.createDataFrame(rows, f"{c} long, {node}") for rows, c in ((left, "a"), (right, "b"))]
    owners = [spark.createDataFrame([(i, i % 2) for i in range(10)], f"{c} long, g long") for c in "ab"]
    want = {tuple(r) for r in signatures.could_be(owners[0].join(owners[1], "g").select("a", "b"), *sides).collect()}
    compared, compare = [], signatures.could_be
    monkeypatch.setattr(signatures, "could_be", lambda pairs, *rest: compared.append(pairs.count()) or compare(pairs, *rest))
    found = signatures.could_be_within(["g"], *owners, *sides)
    assert {tuple(r) for r in found.collect()} == want and len(want) == 50
    assert compared[0] < 50 and "Broadcast" not in plan(found)
