"""Sets of word shingles as sorted 64-bit hashes, for many texts at once.

Words are runs of anything but ASCII white space, with A-Z in lower case. A set has the distinct
shingles of ``width`` words; a text with fewer words has its whole sequence as the only one, and
a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from surveyloom.llm.common import worker_store
from surveyloom.llm.sketches import mix

WIDTH = 5
#: Bytes of text that are hashed in one go (a longer text is one go by itself).
GO = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _tables(n: int) -> tuple[np.ndarray, ...]:
    """Byte values, the white space bytes, and powers of an odd base with their inverses."""
    store = worker_store("sets")
    if "shingle_bytes" not in store:
        lower = np.arange(256)
        lower[65:91] += 32
        blank = np.zeros(256, bool)
        blank[[32, 9, 10, 11, 12, 13]] = True
        store["shingle_bytes"] = mix((lower.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)), blank
    if len(store.get("shingle_powers", ((), ()))[0]) < n:
        size = max(n, GO + GO // 8)
        powers, inverse = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        powers[0] = inverse[0] = 1
        powers, inverse = np.cumprod(powers), np.cumprod(inverse)
        kept = powers, inverse
        if size <= 4 * GO:
            store["shingle_powers"] = kept
        return *store["shingle_bytes"], *kept
    return *store["shingle_bytes"], *store["shingle_powers"]


def _sets(data: np.ndarray, starts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sets of texts that lie one after the other in ``data`` from ``starts`` on."""
    values, blank, powers, inverse = _tables(len(data) + 1)
    gap, size = blank[data], len(data)
    first, final = np.ones(size, bool), np.ones(size, bool)
    first[1:], final[:-1] = gap[:-1], gap[1:]
    edges = starts[(starts > 0) & (starts < size)]
    first[edges], final[edges - 1] = True, True  # no word reaches over the end of its text
    begin, end = np.flatnonzero(first & ~gap), np.flatnonzero(final & ~gap) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers[: len(data)], out=total[1:])
    words = mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64) * _STEP)
    bounds = np.append(np.searchsorted(begin, starts), len(begin))
    block = words
    for i in range(1, width):
        block = mix(block[: len(words) - i] * _STEP + words[i:]) if len(words) > i else words[:0]
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= width:
            yield np.unique(block[a : b - width + 1])
        elif b > a:
            whole = np.uint64(b - a)
            for w in words[a:b]:
                whole = mix(whole * _STEP + w)
            yield np.array([whole], np.uint64)
        else:
            yield words[:0]


def shingle_sets(texts, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The set of each text of an Arrow string array without nulls, in order."""
    import pyarrow as pa

    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + GO, "right")) - 1)
        stop = min(stop, len(texts))
        with np.errstate(over="ignore"):
            yield from _sets(data[ends[at] : ends[stop]], ends[at:stop] - ends[at], width)
        at = stop
