"""Packing by power-of-two decomposition.

A document's tokens (with an end id) are cut from the start into pieces of the
longest length, then into pieces whose lengths are the binary digits of the rest,
descending.  Each piece is a sequence of its own, so no sequence crosses documents and
none is padded.  Sequences of equal length share a bucket: pieces shuffle by bucket and
one of 65,536 slots of a hash of their place and ids, and a sequence's id is its bucket,
slot and rank there, the same under any partitioning of the input.

Tokenising: the byte-level BPE of the tokenizer file splits a text at ASCII white
space into units that do not depend on their neighbours: a run followed by a word
gives the word its last blank, and the rest of the run is a unit.  Each task encodes
a unit once and gathers ids by position.  Texts with other white space or with the
string of a special token are encoded whole.

Null and empty texts hold the end id alone.  Repeated rows are packed one by one.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .common import small_batches

CACHE = 1_200_000
SLOTS = 1 << 16

# The first bytes of white space beyond ASCII and of separators that engines treat differently.
_ODD = np.zeros(256, bool)
_ODD[[0xC2, 0xE1, 0xE2, 0xE3, 0x1C, 0x1D, 0x1E, 0x1F, 0x3C]] = True


class UnitEncoder:
    """Encodes runs of texts, each distinct unit once while it is remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._forget()

    def _forget(self) -> None:
        self.known, self.index = np.zeros((0, 3), np.uint64), np.zeros(0, np.int64)  # hash and both keys of each unit, by hash
        self.flat, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, texts: list[str]):
        found = []
        for at in range(0, len(texts), 4000):  # encodings are large, ids small
            found += [x.ids for x in self.tokenizer.encode_batch_fast(texts[at:at + 4000], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(size.sum())), size

    def _lookup(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each span, the index of its ids."""
        one, two = K.span_keys(data, start, end)
        value, at, back = K.distinct_keys(one, two)
        keys = np.stack((value, one[at], two[at]), axis=1)
        place = np.searchsorted(self.known[:, 0], value)
        hit = place < len(self.known)
        hit[hit] = (self.known[place[hit]] == keys[hit]).all(axis=1)
        if len(self.known) > CACHE and not hit.all():
            self._forget()
            place, hit = np.zeros(len(value), np.int64), np.zeros(len(value), bool)
        found = np.empty(len(value), np.int64)
        found[hit] = self.index[place[hit]]
        if not hit.all():
            new = at[~hit]
            raw = data.tobytes()
            flat, size = self._encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
            found[~hit] = len(self.size) + np.arange(len(new))
            self.first = np.concatenate((self.first, len(self.flat) + np.cumsum(size) - size))
            self.flat, self.size = np.concatenate((self.flat, flat)), np.concatenate((self.size, size))
            # a hash is remembered for one unit: another one with that hash is encoded each time it comes
            free = ~hit & ((place == len(self.known)) | (self.known[np.minimum(place, len(self.known) - 1), 0] != value if len(self.known) else True))
            free[1:] &= value[1:] != value[:-1]
            self.known = np.insert(self.known, place[free], keys[free], axis=0)
            self.index = np.insert(self.index, place[free], found[free])
        return found[back]

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """(ids, row offsets) of a run of texts."""
        start, end = units(data, offsets)
        n = len(offsets) - 1
        index = self._lookup(data, start, end) if len(start) else np.zeros(0, np.int64)
        size = self.size[index]
        to = np.cumsum(size) - size
        total = int(size.sum())
        ids = self.flat[np.repeat(self.first[index] - to, size) + np.arange(total)]
        edge = np.append(to, total)[np.searchsorted(start, offsets)]
        whole = odd_rows(data, offsets)
        if not len(whole):
            return ids, edge
        parts, raw = [ids[edge[r]:edge[r + 1]] for r in range(n)], data.tobytes()
        for r in whole:
            parts[r] = np.array(self.tokenizer.encode(raw[offsets[r]:offsets[r + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))


def units(data: np.ndarray, offsets: np.ndarray):
    """Start and end of each unit, row by row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = K.SEPARATOR[data]
    edge = np.zeros(n + 1, bool)  # a row begins here
    edge[offsets[:-1]] = True
    edge[n] = True
    previous = np.concatenate(([False], blank[:-1])) & ~edge[:-1]
    begins = edge[:-1].copy()
    run = np.flatnonzero(blank & ~previous)  # first blank of a run
    begins[run] = True
    word = np.flatnonzero(~blank & previous)  # a word after a run
    begins[word[data[word - 1] != 0x20]] = True
    begins[word - 1] = True
    start = np.flatnonzero(begins)
    return start, np.append(start[1:], n)


def odd_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that hold white space beyond ASCII, separators 1C-1F, or `<|`."""
    at = np.flatnonzero(_ODD[data])
    if not len(at):
        return at
    padded = np.concatenate((data, np.zeros(2, np.uint8)))
    a, b, c = padded[at], padded[at + 1], padded[at + 2]
    odd = (a < 0x20) | (a == 0x3C) & (b == 0x7C) | (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) | (a == 0xE2) & ((b == 0x80) | (b == 0x81)) & ((c <= 0x8A) | (c >= 0x9F)) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return np.unique(np.searchsorted(offsets, at[odd], "right") - 1)


def pieces(n: int, longest: int) -> list[int]:
    """Lengths: whole runs of `longest`, then the binary digits of the rest, descending."""
    out, rest = [longest] * (n // longest), n % longest
    while rest:
        out.append(1 << rest.bit_length() - 1)
        rest -= out[-1]
    return out


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def pack(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", longest: int = 2048, end_id: int = 1) -> DataFrame:
    """One row for each piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, bucket, sequence_id, offset."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def cut(batches):
        at = encoder(tokenizer_path)
        for batch in batches:
            for first, data, offsets in K.chunks(batch.column(1), 1 << 20):
                ids, edge = at.encode(data, offsets)
                n = len(offsets) - 1
                all_ids = np.empty(len(ids) + n, np.uint32)  # every row's end id added
                ends = edge[1:] + np.arange(n)
                all_ids[ends] = end_id
                keep = np.ones(len(all_ids), bool)
                keep[ends] = False
                all_ids[keep] = ids
                tokens = np.diff(edge) + 1
                lengths = [pieces(x, longest) for x in tokens.tolist()]
                count = np.fromiter(map(len, lengths), np.int64, n)
                row = np.repeat(np.arange(n), count)
                length = np.fromiter((x for one in lengths for x in one), np.int64, len(row))
                place = np.cumsum(length) - length
                cuts = np.append(place, place[-1] + length[-1]) * 4
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(cuts), pa.py_buffer(all_ids)]).cast(pa.binary())
                begin = edge[:-1] + np.arange(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n).take(pa.array(row)), pa.array(place - begin[row]), pa.array(length), blob, pa.array(tokens[row])],
                                                 ["id", "start", "length", "ids", "doc_tokens"])

    base = small_batches(docs).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    cut_ = (base.mapInArrow(cut, "id long, start long, length long, ids binary, doc_tokens long")
            .withColumn("bucket", F.log2("length").cast("int")).withColumn("crc", F.crc32("ids")).withColumn("slot", F.pmod(F.xxhash64("id", "start", "crc"), F.lit(SLOTS))))
    place = F.row_number().over(Window.partitionBy("bucket", "slot").orderBy("id", "start", "crc", "doc_tokens")).cast("long") - 1
    number = F.shiftleft(F.col("bucket").cast("long"), 57) + F.shiftleft("slot", 41) + place
    return cut_.select(F.col("id").alias(id_column), "start", "length", "ids", "doc_tokens", "bucket", number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
