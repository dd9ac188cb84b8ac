"""Shards of near-equal size: a minimax partition of ordered, atomic groups of equal texts.

Groups are ordered by the binary digits of their size, long ones first, and then by the checksum of their text: small groups come last, where they
even out what larger ones leave. A shard is one group, whatever its size, or several that follow each other and have
no more than the capacity together. A capacity is feasible if walking the groups in order, and starting a new shard
whenever the next group doesn't fit, needs no more shards than there are. The smallest feasible capacity is found by
binary search, and the groups are cut there. As no shard can be smaller than its largest group, the largest shard is as small
as in any contiguous partition; a group above an equal share fills a shard where it stands, by the same rule as all
others, and the rest stay near-equal.

The driver never sees the groups, only sums over ranges of checksums: at first 256 for each number of digits, then finer ones
only where a cut may fall. A walk that takes ranges whole gives a feasible capacity; a walk that may cut ranges anywhere
shows that no smaller one is. Ranges in which either walk cuts are refined until both agree, so the result is the
exact minimax partition of the groups. The number of ranges added at a time is bounded by ``MAX_RANGES``, whatever the size of the input.

Slots are dealt without gathering a shard in one task: rows are counted in small bins, the bins' counts are
summed up in order, and rows are numbered within their bin.

Defined cases: a null text is an empty one; null doc_ids and repeated rows get slots like others; an empty table
gives an empty result; with fewer groups than shards, some shards stay empty; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.storage import stored

MAX_RANGES = 65_536
FIRST_DIGITS = 4
ALL_DIGITS = 34
SALTS = 64
ROW_BYTES = 16
BIN_ROWS = 20_000


def sized(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, key): what is needed of each row; texts stay where they are."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(t) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.md5(t.cast("binary")).alias("key"),
    )


def ranges(groups: DataFrame, digits: int) -> list[tuple[str, int, int]]:
    """(prefix, size, groups) of the checksum ranges with ``digits`` hexadecimal digits, in order."""
    found = groups.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    return sorted(tuple(row) for row in found.collect())


Atom = tuple[str, int, int]


def walk(atoms: list[Atom], capacity: int, shards: int, fluid: bool = False) -> list[tuple[int, int]] | None:
    """(place, part) at which each shard but the first begins, or None if ``capacity`` isn't feasible.

    ``atoms`` are (prefix, size, groups). One group may exceed the capacity, alone in its shard. Ranges of several groups are taken
    whole, and then must not exceed the capacity, or may be cut at any ``part`` of their size if ``fluid``.
    """
    cuts: list[tuple[int, int]] = []
    load, full = 0, False
    for place, (_, size, n) in enumerate(atoms):
        part = 0
        if n > 1 and size > capacity and not fluid:
            return None
        while True:
            whole = n == 1 or not fluid
            room = 0 if full else capacity - load
            if size - part <= room or (whole and load == 0 and not full):
                load += size - part
                full = load >= capacity
                break
            taken = 0 if whole else max(0, room)
            part += taken
            cuts.append((place, part))
            load, full = 0, False
            if len(cuts) == shards:
                return None
    return cuts


def minimax(atoms: list[Atom], shards: int, fluid: bool = False) -> tuple[int, list[tuple[int, int]]]:
    """The smallest feasible capacity and its cuts."""
    low, high = 1, max(1, sum(size for _, size, _ in atoms))
    while low < high:
        middle = (low + high) // 2
        if walk(atoms, middle, shards, fluid) is None:
            low = middle + 1
        else:
            high = middle
    return high, walk(atoms, high, shards, fluid)


def doubtful(atoms: list[Atom], capacity: int, cuts: list[tuple[int, int]], shards: int) -> set[int]:
    """Places of ranges to refine; none if ``capacity`` and ``cuts`` are those of the single groups.

    A cut is certain if the range after it is one group. The capacity is if even a walk that may cut ranges needs it; a
    walk with less that is feasible cuts inside a range, or it would have been feasible with whole ranges too.
    """
    found = {place for place, _ in cuts if atoms[place][2] > 1}
    smaller = walk(atoms, capacity - 1, shards, fluid=True)
    if smaller is not None:
        least = minimax(atoms, shards, fluid=True)[1]
        for few in (smaller, least):
            found |= {place for place, _ in few if atoms[place][2] > 1}
    return found


def contiguous_cuts(groups: DataFrame, shards: int) -> list[str]:
    """Key prefixes at which shards begin, from the exact minimax partition of ``groups`` (key, size)."""
    atoms = ranges(groups, FIRST_DIGITS)
    while True:
        capacity, cuts = minimax(atoms, shards)
        open_ranges = [atoms[place][0] for place in sorted(doubtful(atoms, capacity, cuts, shards))]
        if not open_ranges:
            return [atoms[place][0] for place, _ in cuts]
        more = 1
        while len(open_ranges) * 16 ** (more + 1) <= MAX_RANGES and max(map(len, open_ranges)) + more < ALL_DIGITS:
            more += 1
        shut = set(open_ranges)
        atoms = [a for a in atoms if a[0] not in shut]
        for length in sorted({len(p) for p in open_ranges}):  # ranges of several levels may be open
            inside = groups.where(F.substring("key", 1, length).isin([p for p in open_ranges if len(p) == length]))
            atoms += ranges(inside, min(ALL_DIGITS, length + more))
        atoms.sort()


def assign(docs: DataFrame, shards: int = 40, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``.

    Groups are summed up in ``SALTS`` parts, and rows learn their group's size from their own part, so that a group with
    most rows isn't a single join key.
    """
    spread = F.xxhash64(F.monotonically_increasing_id())
    rows = sized(docs, text, doc_id).withColumn("spread", spread).withColumn("salt", F.pmod("spread", F.lit(SALTS)).cast("int"))
    rows = stored(rows, "shard_rows")
    parts = stored(rows.groupBy("key", "salt").agg(F.sum("size").alias("size")), "shard_parts")
    groups = parts.groupBy("key").agg(F.sum("size").alias("size"))
    digits = F.lpad(F.hex(64 - F.length(F.bin("size"))), 2, "0")
    groups = stored(groups.select("key", F.concat(digits, "key").alias("place"), "size"), "shard_groups")
    cuts = contiguous_cuts(groups.select(F.col("place").alias("key"), "size"), shards)
    shard: Column = F.lit(0)
    if cuts:
        shard = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("place")))
    # one way at every size: parts and groups grow with the corpus
    of_part = parts.drop("size").join(groups.select("key", shard.cast("int").alias("shard")).hint("merge"), "key")
    return slotted(rows.join(of_part.hint("merge"), ["key", "salt"]), shards)


def slotted(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with a slot, gapless from 0 in each shard. Bins go by each row's place in the stored table, so equal rows spread too."""
    rows = stored(rows, "sharded")
    bins = max(1, -(-rows.count() // (shards * BIN_ROWS))) * 4
    rows = rows.withColumn("bin", F.pmod("spread", F.lit(bins)).cast("int"))
    counts = rows.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    in_order = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("shard", "bin", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "bin").orderBy("key", "doc_id", "spread")
    numbered = rows.withColumn("at", F.row_number().over(within))
    return numbered.join(before, ["shard", "bin"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("at") - 1).cast("long").alias("slot")
    )


def report(docs: DataFrame, shards: int = 40) -> DataFrame:
    return assign(docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
