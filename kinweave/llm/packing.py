"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Each task tokenizes its documents; a document's full windows are sequences of their own, and its rest waits. A block of
rests is packed: every rest starts as a partial partition (one filled window and empty others), and the two partial
partitions with the largest imbalance are merged again and again, the fullest window of one with the emptiest of the
other, until one partition with near-equal windows is left.

There are as many windows as the tokens need. Where rests are kept whole, the number of windows rises, and differencing
begins again, as long as a window exceeds the capacity. Where rests may be cut, which pads least and is what the query does, a window
beyond the capacity is cut there and its excess goes into windows with room; there always is some, so the number never has to rise.

A block has ``BLOCK_RESTS`` rests at most, so a task's memory is bounded, and the padding is less than a window for each block.
Sequence ids hold the task's number and a counter: blocks of different tasks never meet, and a task that is run again
gives the same ids.

Defined cases: a null or empty text is the end id alone; null doc_ids and repeated rows are packed like others; an empty
table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import base64
import heapq
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CAPACITY = 1024
END_ID = 0
BLOCK_RESTS = 512
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str):
    """A function from texts to lists of ids. Both files hold one vocabulary; the second one's library is faster.

    The first one's reads its special token's name as that token, so texts with it are left to it.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    place = lambda name: name if os.path.isabs(name) else public_tokenizers.path(name)
    with open(place(ranks), "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    exact = Tokenizer.from_file(place(vocabulary))

    def encode(text: str) -> list[int]:
        return exact.encode(text, add_special_tokens=False).ids if SPECIAL in text else fast.encode_ordinary(text)

    return encode


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Places of ``sizes`` dealt into ``windows`` near-equal lists."""
    # a partial partition: loads in falling order, less the smallest one, and who is in each window
    heap: list[tuple] = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, [size], [[i]]))
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, loads, members = heapq.heappop(heap)
        _, _, other_loads, other_members = heapq.heappop(heap)
        # windows that aren't listed are empty; the fullest of one side meet the emptiest of the other
        n, m = len(loads), len(other_loads)
        shared = max(0, n + m - windows)
        merged = [(load, own) for load, own in zip(loads[: n - shared], members[: n - shared], strict=True)]
        merged += [(load, own) for load, own in zip(other_loads[: m - shared], other_members[: m - shared], strict=True)]
        for k in range(shared):
            a, b = n - shared + k, m - 1 - k
            merged.append((loads[a] + other_loads[b], members[a] + other_members[b]))
        merged.sort(key=lambda x: -x[0])
        least = merged[-1][0] if len(merged) == windows else 0
        count += 1
        heapq.heappush(heap, (-(merged[0][0] - least), count, [load - least for load, _ in merged], [own for _, own in merged]))
    return heap[0][3] if heap else []


def pack(sizes: list[int], capacity: int = CAPACITY, whole: bool = False) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (place, start, length) of ``sizes``, none above ``capacity``; a size is cut unless ``whole``."""
    windows = -(-sum(sizes) // capacity)
    parts = differencing(sizes, windows)
    while whole and max((sum(sizes[i] for i in members) for members in parts), default=0) > capacity:
        windows += 1
        parts = differencing(sizes, windows)
    packed, loads, spare = [], [], []
    for members in parts:
        pieces, room = [], capacity
        for i in sorted(members, key=lambda i: -sizes[i]):
            if room:
                pieces.append((i, 0, min(room, sizes[i])))
            if sizes[i] > room:
                spare.append((i, room, sizes[i] - room))
            room = max(0, room - sizes[i])
        packed.append(pieces)
        loads.append(room)
    for w in np.argsort(loads, kind="stable"):
        while spare and loads[w]:
            i, start, length = spare.pop()
            taken = min(length, loads[w])
            packed[w].append((i, start, taken))
            loads[w] -= taken
            if taken < length:
                spare.append((i, start + taken, length - taken))
    return packed


def packed(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, ranks: str = RANKS, text: str = "text", whole: bool = False) -> DataFrame:
    """The pieces of all documents: see ``SCHEMA``. ``whole`` cuts documents at full windows only, for more padding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        sequence = TaskContext.get().partitionId() << 32
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        rests: list[tuple] = []
        out: list[tuple] = []

        def piece(doc: int | None, ids: np.ndarray, at: int, length: int, total: int, sequence: int, offset: int) -> None:
            out.append((doc, at, length, zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset))

        def flush() -> pa.RecordBatch:
            nonlocal out
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            out = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        def close_block() -> None:
            nonlocal sequence, rests
            for window in pack([len(ids) for _, ids, _, _ in rests], capacity, whole):
                offset = 0
                for i, start, length in window:
                    doc, ids, begin, total = rests[i]
                    piece(doc, ids[start : start + length], begin + start, length, total, sequence, offset)
                    offset += length
                sequence += 1
            rests = []

        for batch in batches:
            for doc, body in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.array([*encode(body.as_py() or ""), END_ID], dtype=np.uint32)
                full = len(ids) // capacity * capacity
                for at in range(0, full, capacity):
                    piece(doc, ids[at : at + capacity], at, capacity, len(ids), sequence, 0)
                    sequence += 1
                if full < len(ids):
                    rests.append((doc, ids[full:].copy(), full, len(ids)))
                if len(rests) == BLOCK_RESTS:
                    close_block()
                if len(out) >= 10_000:
                    yield flush()
        close_block()
        yield flush()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, SCHEMA)
