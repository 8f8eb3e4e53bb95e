"""Words of whole batches of texts as 64-bit hashes, by array operations on the bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tidelog.llm.common import mix64

#: Bytes of text that are hashed at once; a longer text is hashed alone.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Words:
    """Words of the rows ``first`` to ``first + len(count)`` of a batch, one row after another."""

    first: int
    count: np.ndarray  # words of each row
    hashes: np.ndarray  # uint64
    starts: np.ndarray  # byte places in ``data``
    ends: np.ndarray
    data: np.ndarray  # the bytes of these rows

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    @property
    def base(self) -> np.ndarray:
        """The number of the first word of each row."""
        return np.cumsum(self.count) - self.count


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words are taken eight bytes at a time; each eight are mixed with their place before they are added, so that no
    exchange of letters between places cancels out (as it can in a polynomial)."""
    size = ends - starts
    if not len(size):
        return np.zeros(0, np.uint64)
    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    many = (size + 7) >> 3
    begin = np.cumsum(many) - many
    place = np.arange(int(many.sum())) - np.repeat(begin, many)
    x = eights[np.repeat(starts, many) + 8 * place]
    left = np.repeat(size, many) - 8 * place
    short = np.flatnonzero(left < 8)
    x[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
    x += (place + 1).astype(np.uint64) * np.uint64(_BASE)
    return mix64(np.add.reduceat(mix64(x), begin) + size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def hashed(column: pa.Array, lower: bool = False) -> Iterator[Words]:
    """Words (runs of bytes other than 20 and 09 to 0D) of a binary column, chunk by chunk. Null rows have none."""
    column = column.cast(pa.large_binary())
    n = len(column)
    _, at, raw = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        j = min(j, n)
        part = data[offsets[i] : offsets[j]]
        if lower:
            part = _LOWER[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[offsets[i:j] - offsets[i]] = True  # a row's first byte begins a word
        solid = ~_BLANK[part]
        before = np.concatenate([[False], solid[:-1]]) if len(part) else solid
        begins = solid & (~before | edge[:-1])
        starts = np.flatnonzero(begins)
        after = np.concatenate([solid[1:], [False]]) if len(part) else solid
        ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        count = np.diff(np.searchsorted(starts, offsets[i : j + 1] - offsets[i]))
        yield Words(i, count, _word_hashes(part, starts, ends), starts, ends, part)
        i = j


def grams(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of ``n`` neighbouring values at each place where that many are left."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    p = powers(base | 1, n)
    m = len(h) - n + 1
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out += h[k : k + m] * p[k]
    return mix64(out)
