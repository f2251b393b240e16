"""Vectorised byte kernels over Arrow text columns.

A text column is viewed as one UTF-8 byte buffer plus row offsets; words, word
hashes and rolling window hashes are then a handful of numpy passes, without one
Python object per word.  All functions are pure and deterministic, so a lost
task gives the same rows when it runs again.

Words are runs of bytes other than 0x20 and 0x09-0x0D.  UTF-8 continuation
bytes never fall in that range, so byte runs are exactly character runs.
Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from hashlib import blake2b

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    x = np.array(x, np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_LANE = (np.uint64(0x632BE59BD9B4E019), np.uint64(0xD1342543DE82EF95))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LONG = 16  # bytes from which a span's keys are a digest


def chunks(column: pa.Array, size: int = CHUNK_BYTES):
    """(first row, bytes, offsets from 0) for runs of whole rows of about `size` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset:]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last
    trim()


def trim() -> None:
    """Give freed memory back to the system, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        return


def spread(batch: pa.RecordBatch, rows: int = 8):
    """A batch of large blobs as batches of a few rows: its reader holds one at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


class Words:
    """The words of a run of rows: byte spans, and for each row its span of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        rows = offsets[:-1][offsets[1:] > offsets[:-1]]
        ends = offsets[1:][offsets[1:] > offsets[:-1]]
        sep = SEPARATOR[data]
        if len(data):
            before = np.empty(len(data), bool)
            before[0] = True
            before[1:] = sep[:-1]
            before[rows] = True
            after = np.empty(len(data), bool)
            after[-1] = True
            after[:-1] = sep[1:]
            after[ends - 1] = True
            self.start = np.flatnonzero(~sep & before)
            self.end = np.flatnonzero(~sep & after) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.of_row = np.searchsorted(self.start, offsets)

    def keys(self, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit keys for each word, as `span_keys`; with `fold`, A-Z count as a-z."""
        return span_keys(_FOLD[self.data] if fold else self.data, self.start, self.end)

    def hashes(self, lane: int = 0, fold: bool = False) -> np.ndarray:
        """One 64-bit hash for each word."""
        return hash_keys(*self.keys(fold), lane)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.of_row))


def span_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each byte span.

    Spans of up to 15 bytes *are* their keys (bytes and length), so different ones never
    agree; longer ones have 120 bits of a BLAKE2b digest.
    """
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    size = end - start
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    eight = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))  # the eight bytes from each position on
    one = eight[start] & _MASK[np.minimum(size, 8)]
    two = eight[np.minimum(start + 8, len(data))] & _MASK[np.clip(size - 8, 0, 8)] | size.astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(size >= _LONG)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        digests = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)])
        found = np.frombuffer(digests, "<u8").reshape(-1, 2)
        one[long], two[long] = found[:, 0], found[:, 1] | np.uint64(0xFF << 56)
    return one, two


def hash_keys(one: np.ndarray, two: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of pairs of keys; the lanes mix them differently."""
    if lane:
        one, two = two, one
    return mix(mix(two + _LANE[lane]) ^ one)


def distinct_keys(one: np.ndarray, two: np.ndarray):
    """(hash, first index) of each distinct pair of keys, by hash, and the place of every pair among them."""
    hashed = hash_keys(one, two)
    value, at, back = np.unique(hashed, return_index=True, return_inverse=True)
    if len(hashed) and ((one[at][back] != one) | (two[at][back] != two)).any():  # a hash that different keys share
        order = np.lexsort((two, one, hashed))
        a, b, h = one[order], two[order], hashed[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (h[1:] != h[:-1])))
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        at, value = order[new], h[new]
    return value, at, back


def window_hashes(words: np.ndarray, of_row: np.ndarray, k: int):
    """Hashes of every window of k words inside a row: (first word's index, hash).

    Spans of 1, 2, 4, ... words are mixed pairwise; two of them that overlap make the window.
    """
    n = len(words)
    last = np.repeat(of_row[1:], np.diff(of_row))
    at = np.flatnonzero(np.arange(n) + k <= last)
    value, span = mix(words), 1
    while span * 2 <= k:
        value = mix(value[:-span] * _M1 + value[span:]) if len(value) > span else value[:0]
        span *= 2
    if span < k:
        value = value[at] * _M2 + value[at + k - span]
    else:
        value = value[at]
    return at, mix(value + np.uint64(k * int(_GOLD) % (1 << 64)))


def shingle_sets(column: pa.Array, k: int):
    """For each row, in order: the sorted distinct hashes of its k-word shingles.

    Words are compared with A-Z as a-z.  A row with 1 to k-1 words has one
    shingle, the whole sequence; a row without words has none.
    """
    for _, data, offsets in chunks(column):
        words = Words(data, offsets)
        hashed = words.hashes(fold=True)
        at, value = window_hashes(hashed, words.of_row, k)
        span = np.searchsorted(at, words.of_row)
        for row in range(len(offsets) - 1):
            a, b = words.of_row[row], words.of_row[row + 1]
            if b - a >= k:
                one = np.sort(value[span[row]:span[row + 1]])
                if len(one) > 1:
                    one = one[np.concatenate(([True], one[1:] != one[:-1]))]
                yield one
            elif b > a:
                _, short = window_hashes(hashed[a:b], np.array([0, b - a]), int(b - a))
                yield short
            else:
                yield value[:0]


def set_digest(values: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of an ascending array of hashes (as signed integers)."""
    return tuple(np.frombuffer(blake2b(values.tobytes(), digest_size=16).digest(), "<i8").tolist())


def text_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow string column over UTF-8 bytes."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def joined_words(words: Words, keep: np.ndarray) -> pa.Array:
    """For each row, its kept words joined by one space."""
    start, end = words.start[keep], words.end[keep]
    of_row = np.concatenate(([0], np.cumsum(keep)))[words.of_row]
    size = end - start + 1
    to = np.cumsum(size) - size
    total = int(size.sum())
    source = np.repeat(start - to, size) + np.arange(total)
    out = words.data[np.minimum(source, max(0, len(words.data) - 1))] if total else np.zeros(0, np.uint8)
    out[to + size - 1] = 0x20
    edge = np.append(to, total)[of_row]
    full = np.flatnonzero(edge[1:] > edge[:-1])
    stay = np.ones(total, bool)
    stay[edge[full + 1] - 1] = False
    dropped = np.zeros(len(edge), np.int64)
    dropped[full + 1] = 1
    return text_array(out[stay], edge - np.cumsum(dropped))
