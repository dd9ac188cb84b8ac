"""Slices against a plain interpreter that keeps a frame of sources for each place, and initialisers from class-file rows."""

import random
import struct

import pytest

from kinweave.operators import measures, slices
from kinweave.sources import classfile, extraction, initialisers

INSN = "method string, place int, pops int, pushes int, moves array<int>, load int, stores array<int>, jumps array<int>, falls boolean"
RANGE = "method string, start int, stop int, handler int"


def random_program(rng, n):
    """Instructions whose stack is never too short and equally high on all ways, and ranges with handlers."""
    out, height, at = [], 0, []
    for place in range(n):
        at.append(height)
        kind = rng.choice(["push", "push", "load", "store", "iinc", "join", "dup", "dup_x1", "dup2_x1", "swap", "pop", "jump", "goto", "wide"])
        need = {"store": 1, "join": 2, "dup": 1, "dup_x1": 2, "dup2_x1": 3, "swap": 2, "pop": 1, "jump": 1}.get(kind, 0)
        if need > height or (kind == "goto" and height):
            kind, need = "push", 0
        slot = rng.randrange(3)
        pops, pushes, moves, load, stores, jump, falls = need, 0, None, None, [], False, True
        if kind in ("push", "load", "wide"):
            pushes, load, stores = 1, slot if kind == "load" else None, [slot, slot + 1] if kind == "wide" else []
        elif kind in ("store", "iinc"):
            stores = [slot]
        elif kind == "join":
            pushes = 1
        elif kind in ("dup", "dup_x1", "dup2_x1", "swap"):
            moves = {"dup": [0, -1], "dup_x1": [-1, 0, 1], "dup2_x1": [-1, -1, 0, 1, 2], "swap": [-1, -1]}[kind]
            pushes = len(moves)
        elif kind in ("jump", "goto"):
            jump, falls = True, kind == "jump"
        height += pushes - pops
        out.append([pops, pushes, moves, load, stores, jump, falls, height])
    for place, row in enumerate(out):
        ends = [p for p in range(n) if at[p] == row[7]]
        row[5] = [rng.choice(ends)] if row[5] and ends else []
        row[6] = row[6] or not row[5]
    ranges = []
    caught = [p for p in range(1, n) if at[p] == 1]
    for _ in range(rng.randrange(3) if caught else 0):
        start = rng.randrange(n - 1)
        ranges.append((start, rng.randrange(start + 1, n), rng.choice(caught)))
    return out, ranges


def plain_slices(program, ranges):
    """{start: places} by frames: the sources of each stack cell and slot before each place, until nothing changes."""
    n = len(program)
    frames = [None] * n
    frames[0] = ([], {})
    todo = [0]

    def merge(place, stack, local):
        if place >= n:
            return
        old = frames[place]
        if old is None:
            frames[place] = (list(stack), dict(local))
            todo.append(place)
            return
        new_stack = [a | b for a, b in zip(old[0], stack, strict=True)]
        # a slot that is known on one way only has what is known
        new_local = {k: old[1].get(k, frozenset()) | local.get(k, frozenset()) for k in old[1] | local}
        if new_stack != old[0] or new_local != old[1]:
            frames[place] = (new_stack, new_local)
            todo.append(place)

    while todo:
        place = todo.pop()
        stack, local = list(frames[place][0]), dict(frames[place][1])
        for start, stop, handler in ranges:
            if start <= place < stop:
                merge(handler, [frozenset()], local)
        pops, pushes, moves, _, stores, jumps, falls, _ = program[place]
        taken = stack[len(stack) - pops :]
        del stack[len(stack) - pops :]
        me = frozenset([place])
        stack += [me if moves is None or moves[i] < 0 else taken[moves[i]] for i in range(pushes)]
        for s in stores:
            local[s] = me
        for t in [*jumps, *([place + 1] if falls else [])]:
            merge(t, stack, local)
    out = {}
    for start in range(n):
        seen, todo = {start}, [start]
        while todo:
            place = todo.pop()
            if frames[place] is None:
                continue
            stack, local = frames[place]
            pops, load = program[place][0], program[place][3]
            asked = stack[len(stack) - pops :] + ([local.get(load, frozenset())] if load is not None else [])
            for p in {p for a in asked for p in a} - seen:
                seen.add(p)
                todo.append(p)
        out[start] = seen
    return out, [None if f is None else len(f[0]) for f in frames]


def test_slices_equal_frames_of_sources(spark):
    rng = random.Random(6)
    insns, ranges, want, heights = [], [], {}, {}
    dead = [[0, 1, None, None, [0, 1], [], True, 1], [1, 0, None, None, [], [], True, 0], [0, 0, None, None, [], [5], False, 0], [0, 1, None, None, [0, 1], [], True, 1], [1, 0, None, None, [], [], True, 0], [0, 1, None, 0, [], [], True, 1]]
    for m in range(15):
        program, own = random_program(rng, rng.choice([6, 14, 30])) if m else (dead, [])
        found, high = plain_slices(program, own)
        insns += [(f"m{m}", p, *row[:5], row[5], row[6]) for p, row in enumerate(program)]
        ranges += [(f"m{m}", *r) for r in own]
        want |= {(f"m{m}", s): places for s, places in found.items() if high[s] is not None}
        heights |= {(f"m{m}", p): h for p, h in enumerate(high)}
    rows, caught = spark.createDataFrame(insns, INSN), spark.createDataFrame(ranges, RANGE)
    high = slices.heights(rows, caught)
    got = {(r.method, r.place): r.height for r in high.collect()}
    assert got == heights and any(h is None for h in heights.values()) and len(ranges) > 4
    starts = spark.createDataFrame([(f"{m} {s}", m, s) for m, s in want], "item string, method string, place int")
    traced = {}
    for r in slices.Graph(high, caught).slices(starts).collect():
        traced.setdefault((r.method, int(r.item.split()[1])), set()).add(r.place)
    # frames leave out unreached places, rows of these have no way in
    assert traced == want and max(map(len, want.values())) > 8


def test_a_long_chain_of_blocks_takes_few_passes(spark):
    """A variable that is written once and read after 200 blocks that leave it alone."""
    n = 200
    rows = [("m", 0, 0, 0, None, None, [1], [], True)] + [("m", p, 0, 0, None, None, [], [p + 1], True) for p in range(1, n)] + [("m", n, 0, 1, None, 1, [], [], True)]
    graph = slices.Graph(slices.heights(spark.createDataFrame(rows, INSN)))
    starts = spark.createDataFrame([(0, "m", n)], "item int, method string, place int")
    assert sorted(r.place for r in graph.slices(starts).collect()) == [0, n]


def constructor(me, helper, text, field="f", second=False):
    """Rows of a class with this.f = flag ? new Helper("text") : null, and with g = "plain" written twice."""
    owner = f"{me}/<init>()V"
    row = lambda kind, own=None, i=None, name=None, other=None, flags=None, value=None: ("x.jar", kind, own, i, name, other, flags, value)
    put, made = f"{me}/{field};;L{helper};", f"{helper}/<init>(Ljava/lang/String;)V"
    code = [
        (42, None, None, "0"), (3, None, None, None), (153, None, "1", None), (187, helper, None, None), (89, None, None, None), (18, None, f"string {text}", None), (183, made, None, None), (167, None, "1", None), (1, None, None, None),
        (181, put, None, None), (42, None, None, "0"), (18, None, "string plain", None), (181, f"{me}/g;;Ljava/lang/String;", None, None), (177, None, None, None),
    ]
    rows = [row("class", None, me, me, "java/lang/Object", 33), row("class", None, helper, helper, "java/lang/Object", 33), row("method", helper, "<init>(Ljava/lang/String;)V", "<init>", "(Ljava/lang/String;)V", 1, "0")]
    rows += [row("field", me, f"{field};;L{helper};", field, f"L{helper};", 2, "0"), row("field", me, "g;;Ljava/lang/String;", "g", "Ljava/lang/String;", 2, "1"), row("method", me, "<init>()V", "<init>", "()V", 1, "0")]
    rows += [row("code", owner, str(p), slot, other, op, value) for p, (op, other, value, slot) in enumerate(code)]
    rows += [row("jump", owner, "2", value="8"), row("jump", owner, "7", value="9")]
    rows += [row("writes", owner, other=put), row("writes", owner, other=f"{me}/g;;Ljava/lang/String;"), row("calls", owner, other=made)]
    if second:
        rows += [row("method", me, "again()V", "again", "()V", 1, "1")]
        rows += [row("code", f"{me}/again()V", str(p), None, other, op, None) for p, (op, other) in enumerate([(42, None), (1, None), (181, f"{me}/g;;Ljava/lang/String;"), (177, None)])]
        rows += [row("writes", f"{me}/again()V", other=f"{me}/g;;Ljava/lang/String;")]
    return rows


@pytest.fixture(scope="module")
def models(spark):
    make = lambda rows, side: extraction.extract(spark.createDataFrame(rows, classfile.SCHEMA), prefix=side)
    return make(constructor("A", "H", "told"), "a:"), make(constructor("Q", "Z", "told", "x"), "b:"), make(constructor("R", "Y", "other", "x", second=True), "c:")


def test_initialisers_are_traced(models):
    a, _, c = models
    got = [(r.owner, r.place) for r in a.seq.where("sort = 'init'").orderBy("owner", "place").collect()]
    assert [p for o, p in got if o == "a:A/f;;LH;"] == [0, 3, 4, 5, 6, 8, 9] and [p for o, p in got if "g;;" in o] == [10, 11, 12]
    assert {(r.owner, r.value) for r in a.token.where("sort = 'init string'").collect()} == {("a:A/f;;LH;", "told"), ("a:A/g;;Ljava/lang/String;", "plain")}
    # two methods write it
    assert c.seq.where("sort = 'init' AND owner LIKE '%/g;;%'").isEmpty()


def test_measures_of_initialisers(spark, models):
    a, b, c = models
    none = spark.createDataFrame([], "x string, y string")
    declared = {d.name: d for d in measures.REGISTRY["field"]}

    def score(name, other, x, y):
        pairs = spark.createDataFrame([(x, y)], "a string, b string")
        return measures.evaluate(declared[name], pairs, a, other, none).first().similarity

    assert score("init code", b, "a:A/f;;LH;", "b:Q/x;;LZ;") == 1 and score("init strings", b, "a:A/f;;LH;", "b:Q/x;;LZ;") == 1
    assert score("init code", c, "a:A/f;;LH;", "c:R/x;;LY;") == pytest.approx(1 - 1 / 7) and score("init strings", c, "a:A/f;;LH;", "c:R/x;;LY;") == 0
    # one of them has no initialiser
    assert score("init code", c, "a:A/g;;Ljava/lang/String;", "c:R/g;;Ljava/lang/String;") == score("init strings", c, "a:A/g;;Ljava/lang/String;", "c:R/g;;Ljava/lang/String;") == 0
    assert measures.usable_total("field", "intermediate", a, b) == measures.total("field", "intermediate")


def test_jumps_switches_and_wide_forms():
    wide = bytes([196, 132]) + struct.pack(">Hh", 300, -7)
    jump = bytes([167]) + struct.pack(">h", -6)
    at = len(wide + jump)
    table = bytes([170]) + b"\0" * (-(at + 1) % 4)
    table += struct.pack(">iii", -at, 5, 6) + struct.pack(">ii", -at, 6 - at)
    at += len(table)
    lookup = bytes([171]) + b"\0" * (-(at + 1) % 4)
    lookup += struct.pack(">ii", -at, 2) + struct.pack(">iiii", -3, -at, 9, 6 - at)
    code = wide + jump + table + lookup + bytes([132, 2, 255, 28, 177])
    rows = classfile.code_rows("x", "o", code, [], None, None)
    told = [(r[3], r[6], r[7], r[4]) for r in rows if r[1] == "code"]
    assert told == [("0", 132, "-7", "300"), ("1", 167, "-1", None), ("2", 170, "5 6", None), ("3", 171, "-3 9", None), ("4", 132, "-1", "2"), ("5", 28, None, "2"), ("6", 177, None, None)]
    assert [(r[3], r[7]) for r in rows if r[1] == "jump"] == [("1", "0"), ("2", "0"), ("2", "0"), ("2", "1"), ("3", "0"), ("3", "0"), ("3", "1")]
    handlers = classfile.handler_rows("x", "o", code, struct.pack(">HHHHH", 1, 0, 6, 9, 0))
    assert [(r[3], r[6], r[7]) for r in handlers] == [("0", 1, "2")]


def test_every_opcode_has_its_slots():
    known = {op for first, last, _, _ in initialisers.STACK for op in range(first, last + 1)}
    assert {*range(202)} - known == {*range(178, 187), 196, 197}
    left = {op: n for first, last, _, n in initialisers.STACK for op in range(first, last + 1)}
    assert all(len(m) == left[op] for op, m in initialisers.MOVES.items())
