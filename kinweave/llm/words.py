"""Words of many texts at once, as numpy arrays over Arrow's own buffers.

Words are runs of digits, letters a-z (A-Z lowered) and characters beyond ASCII. A word is known by a 64-bit hash: a
polynomial over its bytes, taken from running sums, and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
CHUNK_BYTES = 1 << 20

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


@lru_cache(maxsize=4)
def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string array and the offsets of its texts; a null is an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of successive texts that have about ``size`` bytes together; at least one text."""
    data, offsets = bytes_of(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lowered bytes, starts, ends, place of each text's first word, with the end)."""
    low = LOWERED[data]
    inside = IN_WORD[low]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    # no word crosses from one text to the next
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return low, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, place of each text's first word, with the end)."""
    low, starts, ends, firsts = word_bounds(data, offsets)
    n = 1 << max(12, int(len(low)).bit_length())
    sums = np.zeros(len(low) + 1, dtype=U)
    np.cumsum((low.astype(U) + U(1)) * powers(n, BASE)[: len(low)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(n, pow(BASE, -1, 1 << 64))[starts]), firsts


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words; of all words together if there are fewer, and none if there are none."""
    n = min(n, len(words))
    if n == 0:
        return words
    total = np.zeros(len(words) - n + 1, dtype=U)
    for j in range(n):
        total = total * U(BASE) + words[j : len(words) - n + 1 + j]
    return mix(total + U(n))
