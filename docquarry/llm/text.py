"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: [\x20\x09-\x0D]: what parts words for most operators.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: [\x00-\x2F\x3A-\x60\x7B-\x7F]: what parts words once A-Z are lower-cased.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: A-Z to a-z; every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Base of the rolling hash over words, and its inverse modulo 2**64.
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose low bits depend on all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * _C1
    h ^= h >> np.uint64(29)
    h *= _C2
    h ^= h >> np.uint64(32)
    return h


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as the empty text."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = pc.fill_null(array, "").cast(pa.large_binary())
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.large_binary())
    n = len(array)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64, n + 1 + array.offset)[array.offset :]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Spans of the words of a batch: ``start``, ``end`` in ``data``; words of document i are
    first[i]:first[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, parts: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        apart = parts[data]
        edge = np.ones(len(data) + 1, bool)
        edge[1:] = np.append(apart[:-1], True) if len(data) else True
        edge[offsets[offsets < len(data)]] = True
        self.start = np.flatnonzero(edge[: len(data)] & ~apart)
        after = np.ones(len(data), bool)
        after[: max(len(data) - 1, 0)] = apart[1:]
        after[offsets[(offsets > 0)] - 1] = True
        self.end = np.flatnonzero(after & ~apart) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, folded over its 8-byte lanes."""
        return span_hashes(self.data, self.start, self.end)

    def windows(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, Rabin-Karp hash) of every run of n words inside one document."""
        total = len(hashes)
        if total < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        up, down = powers(total)
        sums = np.zeros(total + 1, np.uint64)
        np.cumsum(hashes * up[:total], out=sums[1:])
        at = np.arange(total - n + 1)
        last = np.repeat(self.first[1:], self.counts)[: total - n + 1]
        at = at[at + n <= last]
        return at, mixed((sums[at + n] - sums[at]) * down[at])


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, x in enumerate((BASE, INVERSE)):
            steps = np.full(size, x, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    room = np.zeros(len(data) + 8, np.uint8)
    room[: len(data)] = data
    lanes = np.ndarray(len(data) + 1, "<u8", room, 0, (1,))
    left = (end - start).astype(np.int64)
    h = left.astype(np.uint64) * _C3
    at, who = start, None
    while True:
        part = lanes[at]
        short = left < 8
        part[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        old = h if who is None else h[who]
        new = (old ^ (part * _C2)) * _C1
        new ^= new >> np.uint64(31)
        if who is None:
            h = new
        else:
            h[who] = new
        more = np.flatnonzero(left > 8)
        if not len(more):
            return mixed(h)
        at, left = at[more] + 8, left[more] - 8
        who = more if who is None else who[more]


def batches_of(data: np.ndarray, offsets: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Runs of documents [a, b) of about ``size`` bytes; a longer document is alone."""
    runs, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1
        b = min(max(b, a + 1), n)
        runs.append((a, b))
        a = b
    return runs


def joined(words: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets of documents, starts of words): the kept words of each document with one space
    between them."""
    start, n = words.start, words.counts
    of = np.repeat(np.arange(len(n)), n)
    length = words.end - words.start
    if keep is not None:
        start, of, length = start[keep], of[keep], length[keep]
    final = np.ones(len(of), bool)
    final[:-1] = of[1:] != of[:-1]
    size = length + ~final
    at = np.cumsum(size) - size
    source = np.arange(size.sum()) + np.repeat(start - at, size)
    line = words.data[np.minimum(source, max(len(words.data) - 1, 0))]
    line[(at + length)[~final]] = 0x20
    return line, np.append(0, np.cumsum(np.bincount(of, size, len(n)))).astype(np.int64), at
