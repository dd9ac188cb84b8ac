"""Backward slices over a def-use graph of instructions.

Instructions are rows (method, place, height, pops, pushes, moves, load, stores, jumps, falls): ``height`` is the number of stack cells before
the instruction (see ``heights``); it takes the ``pops`` topmost ones and leaves ``pushes`` in their place. ``moves``, null for most, says for each pushed cell which taken
one (from 0) it is, or -1 for a new one. ``load`` is a variable's slot that is read, ``stores`` are slots that are written. ``jumps`` are places
that may come next, and so is the next place if it ``falls``. Ranges (method, start, stop, handler) lead to a handler from all their places.

Nothing is simulated. What a place defines and uses are rows; within a basic block a window finds the last definition before a use; a use without one
asks the block's entry. A slice is a fixpoint over (item, node): instructions ask the definitions of what they use, entries ask the ends of the blocks before
them. Only nodes found in the last pass are joined again. So passes grow with the longest chain of definitions, not with the instructions, and
all items advance together. Windows are by method and place; class files bound a method by 65,535 bytes.

Defined cases: what nothing defines (arguments, a handler's exception) ends the search; unreachable instructions have the null height, use and define nothing
and lead nowhere; a null method is none; repeated rows of one place count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.storage import bucketed, buckets_for, emptied, fresh_path, shuffled, stored, unregistered

NODE = ["method", "at_entry", "p", "q"]


def cell(number: Column) -> Column:
    """A stack cell as a location."""
    return (number * 2).cast("long")


def slot(number: Column) -> Column:
    """A variable's slot as a location."""
    return (number * 2 + 1).cast("long")


def blocks(insns: DataFrame, ranges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(``insns`` with ``block``, flow): flow has (method, src, dst, thrown) between blocks, which are numbered from 1."""
    places = Window.partitionBy("method").orderBy("place")
    starts = insns.select("method", F.explode("jumps").alias("place"))
    if ranges is not None:
        starts = reduce(DataFrame.unionByName, [starts, *[ranges.select("method", F.col(c).cast("int").alias("place")) for c in ("start", "stop", "handler")]])
    starts = starts.distinct().withColumn("_start", F.lit(True))
    broken = ~F.col("falls") | (F.size("jumps") > 0)
    rows = insns.join(starts, ["method", "place"], "left").withColumn("_after", F.coalesce(F.lag(broken).over(places), F.lit(True)))
    rows = rows.withColumn("block", F.sum((F.coalesce("_start", F.lit(False)) | F.col("_after")).cast("int")).over(places)).drop("_start", "_after")
    rows = stored(rows, "blocks")
    at = rows.select("method", F.col("place").alias("to"), F.col("block").alias("dst"))
    last = rows.groupBy("method", F.col("block").alias("src")).agg(F.max_by(F.struct("jumps", "falls"), "place").alias("end"))
    falls = last.where("end.falls").select("method", "src", (F.col("src") + 1).alias("dst")).join(at.select("method", "dst").distinct(), ["method", "dst"], "left_semi")
    jumps = last.select("method", "src", F.explode("end.jumps").alias("to")).join(at, ["method", "to"]).select("method", "src", "dst")
    flow = falls.select("method", "src", "dst").unionByName(jumps).withColumn("thrown", F.lit(False))
    if ranges is not None:
        inside = ranges.join(rows.select("method", "place", F.col("block").alias("src")), "method").where("place >= start AND place < stop")
        thrown = inside.select("method", "src", F.col("handler").cast("int").alias("to")).join(at, ["method", "to"]).select("method", "src", "dst", F.lit(True).alias("thrown"))
        flow = flow.unionByName(thrown)
    return rows, stored(flow.distinct(), "flow")


def heights(insns: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """``insns`` with ``height``. All ways to a place agree on it; where they don't, the way by the first block before counts.

    A block's height is that of the block it follows and what that one adds. Pointers to the blocks before are doubled until they
    end at an entry or a handler; blocks that only follow each other are then reached from those that are known.
    """
    rows, flow = blocks(insns.withColumn("_net", F.col("pushes") - F.col("pops")), ranges)
    net = rows.groupBy("method", "block").agg(F.sum("_net").alias("net"))
    roots = rows.select("method", "block").where("block = 1").distinct().withColumn("base", F.lit(0).cast("long"))
    caught = flow.where("thrown").select("method", F.col("dst").alias("block"), F.lit(1).cast("long").alias("base"))
    roots = stored(roots.unionByName(caught).groupBy("method", "block").agg(F.max("base").alias("base")), "roots")
    steps = flow.where("NOT thrown").join(net.withColumnRenamed("block", "src"), ["method", "src"]).join(roots.withColumnRenamed("block", "dst"), ["method", "dst"], "left_anti")
    steps = stored(steps, "steps")
    first = steps.groupBy("method", F.col("dst").alias("block")).agg(F.min(F.struct("src", "net")).alias("s")).select("method", "block", F.col("s.src").alias("to"), F.col("s.net").alias("add"))
    open_ = stored(first, "pointers")
    known = stored(roots.select("method", "block", F.col("base").alias("height")), "heights")
    while not open_.isEmpty():
        ends = known.select("method", F.col("block").alias("to"), "height")
        done = open_.join(ends, ["method", "to"]).select("method", "block", (F.col("height") + F.col("add")).alias("height"))
        rest = open_.join(ends.select("method", "to"), ["method", "to"], "left_anti")
        jump = open_.select("method", F.col("block").alias("to"), F.col("to").alias("beyond"), F.col("add").alias("more"))
        rest = stored(rest.join(jump, ["method", "to"]).select("method", "block", F.col("beyond").alias("to"), (F.col("add") + F.col("more")).alias("add")), "pointers")
        new = stored(done, "heights")
        if new.isEmpty():
            break
        known, open_ = stored(known.unionByName(new), "heights"), rest
    while True:
        ends = known.select("method", F.col("block").alias("src"), "height")
        new = steps.join(ends, ["method", "src"]).select("method", F.col("dst").alias("block"), (F.col("height") + F.col("net")).alias("height"), "src")
        new = new.join(known.select("method", "block"), ["method", "block"], "left_anti").groupBy("method", "block").agg(F.min_by("height", "src").alias("height"))
        new = stored(new, "heights")
        if new.isEmpty():
            break
        known = stored(known.unionByName(new), "heights")
    before = Window.partitionBy("method", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("_in", F.coalesce(F.sum("_net").over(before), F.lit(0)))
    return own.join(known, ["method", "block"], "left").withColumn("height", (F.col("height") + F.col("_in")).cast("int")).drop("_in", "_net", "block")


class Graph:
    """The def-use graph of instructions: edges within blocks, and what blocks define at their ends. Nodes are (entry, p, q).

    An instruction is (false, place, -1); a cell that an instruction moves is (false, place, cell); a block's entry is (true, block, location).
    """

    def __init__(self, insns: DataFrame, ranges: DataFrame | None = None, more: DataFrame | None = None) -> None:
        """``more`` has further edges (method, place, to) between instructions."""
        # what can't be reached leads nowhere
        rows, flow = blocks(insns.where("height IS NOT NULL"), ranges)
        base = F.col("height") - F.col("pops")
        taken = rows.where("pops > 0").select("method", "block", "place", F.explode(F.sequence(F.lit(0), F.col("pops") - 1)).alias("i"), base.alias("base"))
        left = rows.where("pushes > 0").select("method", "block", "place", "moves", F.explode(F.sequence(F.lit(0), F.col("pushes") - 1)).alias("i"), base.alias("base"))
        left = left.withColumn("from", F.coalesce(F.get("moves", F.col("i")), F.lit(-1)))
        location, own = cell(F.col("base") + F.col("i")), F.lit(-1).cast("long")
        moved = left.where("from >= 0 AND from <> i").select("method", "block", "place", location.alias("via"), cell(F.col("base") + F.col("from")).alias("loc"))
        uses = reduce(
            DataFrame.unionByName,
            [
                taken.select("method", "block", "place", own.alias("via"), location.alias("loc")),
                rows.where("load IS NOT NULL").select("method", "block", "place", own.alias("via"), slot(F.col("load")).alias("loc")),
                moved,
            ],
        ).distinct()
        # a cell that stays where it was isn't defined anew
        defs = reduce(
            DataFrame.unionByName,
            [
                left.where("from < 0").select("method", "block", "place", own.alias("via"), location.alias("loc")),
                left.where("from >= 0 AND from <> i").select("method", "block", "place", location.alias("via"), location.alias("loc")),
                rows.select("method", "block", "place", F.explode("stores").alias("slot")).select("method", "block", "place", own.alias("via"), slot(F.col("slot")).alias("loc")),
            ],
        ).distinct()
        none = F.lit(None).cast(defs.select(F.struct("place", "via").alias("d")).schema["d"].dataType)
        events = uses.select("method", "block", "loc", "place", F.lit(0).alias("later"), "via", none.alias("d"))
        events = events.unionByName(defs.select("method", "block", "loc", "place", F.lit(1).alias("later"), "via", F.struct("place", "via").alias("d")))
        so_far = Window.partitionBy("method", "block", "loc").orderBy("place", "later").rowsBetween(Window.unboundedPreceding, -1)
        met = events.withColumn("d", F.when(F.col("later") == 0, F.last("d", ignorenulls=True).over(so_far))).where("later = 0")
        here = F.col("d").isNotNull()
        edges = met.select(
            "method", F.lit(False).alias("at_entry"), F.col("place").alias("p"), F.col("via").alias("q"), (~here).alias("entry"),
            F.when(here, F.col("d.place")).otherwise(F.col("block")).cast("long").alias("to_p"), F.when(here, F.col("d.via")).otherwise(F.col("loc")).alias("to_q"),
        )
        if more is not None:
            edges = edges.unionByName(more.select("method", F.lit(False).alias("at_entry"), F.col("place").alias("p"), own.alias("q"), F.lit(False).alias("entry"), F.col("to").cast("long").alias("to_p"), own.alias("to_q")))
        edges = stored(edges, "edges")
        self.edges = stored(edges.unionByName(shortened(self.entries(edges, flow, rows, defs))), "edges")

    @staticmethod
    def entries(edges: DataFrame, flow: DataFrame, rows: DataFrame, defs: DataFrame) -> DataFrame:
        """Edges from the entries of blocks to the definitions at the ends of the blocks before them, or to the entries of these. A handler can be
        reached from all places of a range: with any definition there but that of the last place, and with what holds at the block's entry."""
        defs = stored(defs, "definitions")
        asked = edges.where("entry").select("method", F.col("to_q").alias("loc")).distinct()
        # a handler's stack is its exception only
        before = flow.join(asked, "method").where("NOT thrown OR loc % 2 <> 0").withColumnRenamed("src", "block")
        outs = defs.groupBy("method", "block", "loc").agg(F.max_by(F.struct("place", "via"), "place").alias("out"))
        last = rows.groupBy("method", "block").agg(F.max("place").alias("last"))
        inner = defs.join(last, ["method", "block"]).where("place < last")
        ends = before.join(outs, ["method", "block", "loc"], "left")
        passed = F.col("thrown") | F.col("out").isNull()
        node = ["method", F.lit(True).alias("at_entry"), F.col("dst").cast("long").alias("p"), F.col("loc").alias("q")]
        whole = ends.select(*node, passed.alias("entry"), F.when(passed, F.col("block")).otherwise(F.col("out.place")).cast("long").alias("to_p"), F.when(passed, F.col("loc")).otherwise(F.col("out.via")).alias("to_q"))
        inside = before.where("thrown").join(inner, ["method", "block", "loc"]).select(*node, F.lit(False).alias("entry"), F.col("place").cast("long").alias("to_p"), F.col("via").alias("to_q"))
        return whole.unionByName(inside).distinct()

    def slices(self, starts: DataFrame) -> DataFrame:
        """(item, method, place) of all instructions that those of ``starts`` (item, method, place) come from, and of these themselves."""
        spark = starts.sparkSession
        buckets = buckets_for(self.edges)
        walked, asked = ["item", *NODE], fresh_path(spark, "bucketed_edges")
        path = fresh_path(spark, "slices")
        front = starts.select("item", "method", F.lit(False).alias("at_entry"), F.col("place").cast("long").alias("p"), F.lit(-1).cast("long").alias("q")).distinct()
        schema = front.withColumn("pass", F.lit(0)).schema
        try:
            edges = bucketed(self.edges.repartition(buckets, *NODE), asked, NODE, buckets)
            seen = bucketed(front.repartition(buckets, *walked).withColumn("pass", F.lit(0)), path, walked, buckets)
            last = 0
            while True:
                # only what the last pass found moves, once to its edges and once to what is seen
                front = seen.where(F.col("pass") == last).select(*walked).repartition(buckets, *NODE).hint("shuffle_hash")
                found = edges.join(front, NODE).select("item", "method", F.col("entry").alias("at_entry"), F.col("to_p").alias("p"), F.col("to_q").alias("q"))
                new = found.repartition(buckets, *walked).distinct().join(shuffled(seen), walked, "left_anti")
                last += 1
                seen = bucketed(new.withColumn("pass", F.lit(last)), path, walked, buckets)
                if seen.where(F.col("pass") == last).isEmpty():
                    break
        finally:
            unregistered(spark, asked, path)
        emptied(spark, asked)
        return spark.read.schema(schema).parquet(path).where("NOT at_entry AND q = -1").select("item", "method", F.col("p").alias("place"))


def shortened(edges: DataFrame) -> DataFrame:
    """Edges of entries, where a chain of entries that each ask just one other is one edge. Its inner entries are in no slice, so none is lost."""
    edges = stored(edges, "edges")
    node = ["method", "p", "q"]
    ways = edges.groupBy(*node).agg(F.count("*").alias("n"), F.min(F.struct("entry", "to_p", "to_q")).alias("t")).where("n = 1 AND t.entry")
    ways = stored(ways.select("method", F.col("p"), F.col("q"), F.col("t.to_p").alias("to_p")), "ways")
    # a chain is of one location, and one of blocks that only follow each other has no end: its length bounds the doublings
    for _ in range(32):
        on = ways.select("method", F.col("p").alias("to_p"), "q", F.col("to_p").alias("beyond"))
        more = ways.join(on, ["method", "to_p", "q"], "left").select("method", "p", "q", F.coalesce("beyond", "to_p").alias("to_p"), (F.col("beyond").isNotNull() & (F.col("beyond") != F.col("to_p"))).alias("moved"))
        more = stored(more, "ways")
        ways = more.drop("moved")
        if more.where("moved").isEmpty():
            break
    far = ways.select("method", F.col("p").alias("to_p"), F.col("q").alias("to_q"), F.col("to_p").alias("far"))
    joined = edges.join(far, ["method", "to_p", "to_q"], "left").withColumn("to_p", F.when(F.col("entry"), F.coalesce("far", "to_p")).otherwise(F.col("to_p")))
    return joined.select(*edges.columns).distinct()
