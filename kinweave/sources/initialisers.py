"""What fields are initialised by: instructions as rows of a def-use graph, and a slice back from the one write of a field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators import slices
from kinweave.storage import stored

# Stack slots that instructions take and leave, as (first opcode, last opcode, taken, left), by the order of opcodes.
# Those of fields, calls and arrays of several dimensions follow from their descriptors.
STACK = [
    (0, 0, 0, 0), (1, 8, 0, 1), (9, 10, 0, 2), (11, 13, 0, 1), (14, 15, 0, 2), (16, 19, 0, 1), (20, 20, 0, 2),
    (21, 21, 0, 1), (22, 22, 0, 2), (23, 23, 0, 1), (24, 24, 0, 2), (25, 29, 0, 1), (30, 33, 0, 2), (34, 37, 0, 1), (38, 41, 0, 2), (42, 45, 0, 1),
    (46, 46, 2, 1), (47, 47, 2, 2), (48, 48, 2, 1), (49, 49, 2, 2), (50, 53, 2, 1),
    (54, 54, 1, 0), (55, 55, 2, 0), (56, 56, 1, 0), (57, 57, 2, 0), (58, 62, 1, 0), (63, 66, 2, 0), (67, 70, 1, 0), (71, 74, 2, 0), (75, 78, 1, 0),
    (79, 79, 3, 0), (80, 80, 4, 0), (81, 81, 3, 0), (82, 82, 4, 0), (83, 86, 3, 0),
    (87, 87, 1, 0), (88, 88, 2, 0), (89, 89, 1, 2), (90, 90, 2, 3), (91, 91, 3, 4), (92, 92, 2, 4), (93, 93, 3, 5), (94, 94, 4, 6), (95, 95, 2, 2),
    *[(op, op, *((4, 2) if op % 2 else (2, 1))) for op in range(96, 116)],
    *[(op, op, *((2, 2) if op % 2 else (1, 1))) for op in range(116, 120)],
    *[(op, op, *((3, 2) if op % 2 else (2, 1))) for op in range(120, 126)],
    *[(op, op, *((4, 2) if op % 2 else (2, 1))) for op in range(126, 132)],
    (132, 132, 0, 0), (133, 133, 1, 2), (134, 134, 1, 1), (135, 135, 1, 2), (136, 137, 2, 1), (138, 138, 2, 2), (139, 139, 1, 1), (140, 141, 1, 2), (142, 142, 2, 1), (143, 143, 2, 2), (144, 144, 2, 1), (145, 147, 1, 1),
    (148, 148, 4, 1), (149, 150, 2, 1), (151, 152, 4, 1), (153, 158, 1, 0), (159, 166, 2, 0), (167, 167, 0, 0), (168, 168, 0, 1), (169, 169, 0, 0), (170, 171, 1, 0),
    (172, 172, 1, 0), (173, 173, 2, 0), (174, 174, 1, 0), (175, 175, 2, 0), (176, 176, 1, 0), (177, 177, 0, 0),
    (187, 187, 0, 1), (188, 190, 1, 1), (191, 191, 1, 0), (192, 193, 1, 1), (194, 195, 1, 0), (198, 199, 1, 0), (200, 200, 0, 0), (201, 201, 0, 1),
]
# Which taken slot each left one is, -1 for a copy; a swap's are both new.
MOVES = {89: [0, -1], 90: [-1, 0, 1], 91: [-1, 0, 1, 2], 92: [0, 1, -1, -1], 93: [-1, -1, 0, 1, 2], 94: [-1, -1, 0, 1, 2, 3]}
# Opcodes after which the next place doesn't follow, and those that read, write and widely write a variable.
ENDS = [167, 169, 170, 171, 172, 173, 174, 175, 176, 177, 191, 200]
READS = [*range(21, 26), *range(26, 46)]
WRITES, WIDE_WRITES = [*range(54, 59), *range(59, 79), 132], [55, 57, *range(63, 67), *range(71, 75)]
NEW, SPECIAL, PUTS = 187, 183, (179, 181)


def normal(op: Column) -> Column:
    """One opcode for the forms of an instruction: with the slot in itself or behind it, with a short or a wide index."""
    inside = F.when(op.between(26, 45), 21 + F.floor((op - 26) / 4)).when(op.between(59, 78), 54 + F.floor((op - 59) / 4))
    return F.coalesce(inside, F.when(op.isin(19, 20), 18).when(op == 200, 167).when(op == 201, 168), op).cast("int")


def slots(types: Column) -> Column:
    """Slots of an array of types: two for long and double, none for void."""
    return F.aggregate(types, F.lit(0), lambda n, t: n + F.when(t.isin("J", "D"), 2).when(t == "V", 0).otherwise(1))


def instructions(rows: DataFrame, types_of) -> DataFrame:
    """Instructions as ``slices`` takes them, without heights, from the rows of class files."""
    stack = [(op, taken, left, MOVES.get(op)) for first, last, taken, left in STACK for op in range(first, last + 1)]
    known = F.broadcast(rows.sparkSession.createDataFrame(stack, "op int, taken int, left int, moves array<int>"))
    place = F.col("id").cast("int").alias("place")
    code = rows.where("kind = 'code'").select(F.col("owner").alias("method"), place, F.col("flags").alias("op"), "other", "value", F.col("name").alias("slot"))
    sites = rows.where("kind = 'site'").select(F.col("owner").alias("method"), place, F.col("value").alias("site"))
    jumps = rows.where("kind = 'jump'").groupBy(F.col("owner").alias("method"), place).agg(F.sort_array(F.collect_set(F.col("value").cast("int"))).alias("jumps"))
    code = code.dropDuplicates(["method", "place"]).join(known, "op", "left").join(sites, ["method", "place"], "left").join(jumps, ["method", "place"], "left")
    op, field, call = F.col("op"), types_of(F.regexp_extract("other", ";;(.*)$", 1)), types_of(F.coalesce("site", F.regexp_extract("other", r"(\(.*)$", 1)))
    arguments, result = slots(F.slice(call, 1, F.greatest(F.size(call) - 1, F.lit(0)))), slots(F.slice(call, F.greatest(F.size(call), F.lit(1)), 1))
    taken = F.when(op == 178, 0).when(op == 179, slots(field)).when(op == 180, 1).when(op == 181, 1 + slots(field)).when(op.isin(182, 183, 185), 1 + arguments).when(op.isin(184, 186), arguments)
    left = F.when(op.isin(178, 180), slots(field)).when(op.isin(*PUTS), 0).when(op.between(182, 186), result)
    number = F.col("slot").cast("int")
    none = F.array().cast("array<int>")
    return code.select(
        "method", "place", "op", "other",
        F.coalesce(F.when(op == 197, F.col("value").try_cast("int")), taken, "taken", F.lit(0)).cast("int").alias("pops"), F.coalesce(F.when(op == 197, 1), left, "left", F.lit(0)).cast("int").alias("pushes"), "moves",
        F.when(op.isin(*READS), number).alias("load"), F.when(op.isin(*WIDE_WRITES), F.array(number, number + 1)).when(op.isin(*WRITES), F.array(number)).otherwise(none).alias("stores"),
        F.coalesce("jumps", none).alias("jumps"), (~op.isin(*ENDS)).alias("falls"),
    )


def initialisers(rows: DataFrame, writes: DataFrame, types_of) -> DataFrame:
    """(field, method, place): the instructions that the value of each field comes from, if just one method writes it.

    ``writes`` has (field, method, place) of all writes of the fields that count; the first one in the method is traced. An object's making
    brings the call of its constructor along.
    """
    one = writes.groupBy("field").agg(F.min(F.struct("method", "place")).alias("first"), F.count_distinct("method").alias("n")).where("n = 1")
    starts = stored(one.select(F.col("field").alias("item"), "first.method", "first.place"), "starts")
    if starts.isEmpty():
        return starts.withColumnRenamed("item", "field")
    own = rows.join(starts.select(F.col("method").alias("owner")).distinct(), "owner", "left_semi")
    insns = instructions(own, types_of)
    ranges = own.where("kind = 'handler'").select(F.col("owner").alias("method"), F.col("id").cast("int").alias("start"), F.col("flags").alias("stop"), F.col("value").cast("int").alias("handler"))
    made = insns.where(F.col("op") == NEW).select("method", "place", F.col("other").alias("class"))
    calls = insns.where((F.col("op") == SPECIAL) & F.col("other").contains("/<init>(")).select("method", F.col("place").alias("to"), F.regexp_extract("other", r"^(.*)/<init>\(", 1).alias("class"))
    built = made.join(calls, ["method", "class"]).where("to > place").groupBy("method", "place").agg(F.min("to").alias("to"))
    graph = slices.Graph(slices.heights(insns.drop("op", "other"), ranges), ranges, built)
    return graph.slices(starts).withColumnRenamed("item", "field")
