"""Substring dedup by difference-cover anchors.

A word is removed when a window of `window` consecutive words that covers it also
starts anywhere else in the table, the same row included.  Windows are judged on
the input.

Anchors: with a difference cover D modulo a period P, any two positions i, j have
a shift d < P with (i + d) mod P and (j + d) mod P both in D.  So two equal
windows share a hash of window - P + 1 words at positions that lie in D in both
rows: hashing |D| / P of the positions (5 of 21 for 35 words) finds every match.

0. Texts are written down in *bundles* of 12 MB, or more where there are many blocks;
   a word's place is its number in its bundle.
1. Each bundle sends its anchor hashes to blocks by hash; a block answers each bundle
   with those that occur twice or more (a partitioned semi join: no filter to broadcast).
2. Each anchor that came back extends to the whole windows around it; their 96-bit
   hashes meet in blocks, which answer each bundle with the places of windows that
   occur twice.
3. The bundles' rows meet these places and lose the covered words.

Hashes are mixed from words' bytes (see `textkernel`); 1.6 * 10**13 windows, 100 TB of
prose, make a chance of 0.2 % that any two different ones agree.  A group of copies of any
size costs one entry for each window of each row; no pairs are formed.  Null and empty
texts have no words.  Rows with equal id and text repeat each other and lose the same
words.  `carry` columns pass through as they are.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import block_count, block_of, bundle_bytes, compress, decompress, pack_sorted, planes, small_batches, unpack_sorted, unplanes, written

# Perfect difference sets, by period.
COVERS = {1: (0,), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
PART_BYTES = 4 << 20


def cover(window: int) -> tuple[int, np.ndarray]:
    """The longest period that leaves anchors of at least two fifths of a window."""
    period = max(p for p in COVERS if p == 1 or window - p + 1 >= 0.4 * window)
    inside = np.zeros(period, bool)
    inside[list(COVERS[period])] = True
    return period, inside


def _anchors(words: K.Words, hashed: np.ndarray, window: int):
    """(word index, hash) of the anchors of rows that hold a window."""
    period, inside = cover(window)
    at, value = K.window_hashes(hashed, words.of_row, window - period + 1)
    row = np.repeat(np.arange(len(words.of_row) - 1), np.diff(words.of_row))[at]
    first = words.of_row[row]
    keep = inside[(at - first) % period] & (words.of_row[row + 1] - first >= window)
    return at[keep], value[keep]


def _candidates(words: K.Words, hashed: np.ndarray, window: int, shared: np.ndarray) -> np.ndarray:
    """First words of the windows around anchors in `shared`, an ascending array."""
    period, _ = cover(window)
    at, value = _anchors(words, hashed, window)
    place = np.searchsorted(shared, value)
    at = at[shared[np.minimum(place, len(shared) - 1)] == value]
    if not len(at):
        return at
    hits = np.zeros(len(hashed) + period + 1, np.int64)
    hits[at + 1] = 1
    hits = np.cumsum(hits)
    start = np.arange(len(hashed))
    row_end = np.repeat(words.of_row[1:], np.diff(words.of_row))
    return np.flatnonzero((hits[start + period] > hits[start]) & (start + window <= row_end))


def _bundled(base: DataFrame, share: int) -> DataFrame:
    """Rows of `base` (id, text, carry) as a written table (bundle, part, rows) of Arrow streams."""
    def gather(batches):
        bundle, part, held, size = uuid.uuid4().bytes, 0, [], 0

        def close():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as to:
                for one in held:
                    to.write_batch(one)
            return pa.RecordBatch.from_arrays([pa.array([bundle], pa.binary()), pa.array([part], pa.int32()), pa.array([compress(sink.getvalue())], pa.binary())], ["bundle", "part", "rows"])

        total = 0
        for batch in batches:
            at = 0
            for first, data, offsets in K.chunks(batch.column(1), 1 << 20):
                at = first + len(offsets) - 1
                held.append(batch.slice(first, len(offsets) - 1))
                size += len(data)
                if size >= PART_BYTES:
                    yield close()
                    total, part, held, size = total + size, part + 1, [], 0
                    if total >= share:
                        bundle, part, total = uuid.uuid4().bytes, 0, 0
            assert at == batch.num_rows
        if held:
            yield close()

    return written(base.mapInArrow(gather, "bundle binary, part int, rows binary"), "bundles")


def _rows(blob: pa.Scalar):
    """(batch, first row, bytes, offsets) of the runs of rows in a stream."""
    for batch in pa.ipc.open_stream(decompress(blob.as_buffer())):
        for first, data, offsets in K.chunks(batch.column(1)):
            yield batch, first, data, offsets


def _in_blocks(value: np.ndarray, blocks: int):
    """(block, slice) of the runs of an ascending array of hashes."""
    cut = np.searchsorted(block_of(value, blocks), np.arange(blocks + 1))
    return [(b, slice(cut[b], cut[b + 1])) for b in np.flatnonzero(np.diff(cut)).tolist()]


def _shared_anchors(texts: DataFrame, window: int, blocks: int) -> DataFrame:
    """(bundle, keys): for each bundle, its anchors that occur at least twice in the table."""
    def emit(batches):
        for batch in batches:
            for bundle, blob in zip(batch.column(0), batch.column(1), strict=True):
                found = [np.zeros(0, np.uint64)]
                for _, _, data, offsets in _rows(blob):
                    words = K.Words(data, offsets)
                    found.append(_anchors(words, words.hashes(), window)[1])
                keys, n = np.unique(np.concatenate(found), return_counts=True)
                parts = _in_blocks(keys, blocks)
                if parts:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([b for b, _ in parts], pa.int32()), pa.array([bundle.as_py()] * len(parts), pa.binary()), pa.array([pack_sorted(keys[p]) for _, p in parts], pa.binary()),
                        pa.array([planes((n[p] > 1).astype(np.uint8)) for _, p in parts], pa.binary())], ["block", "bundle", "keys", "twice"])

    def meet(table: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x.as_buffer()) for x in table["keys"]]
        twice = np.concatenate([unplanes(x.as_buffer(), np.uint8) for x in table["twice"]]).astype(bool)
        size = np.array([len(x) for x in keys])
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        same = ordered[1:] == ordered[:-1]
        often = np.zeros(len(flat), bool)
        often[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
        often |= twice
        edge = np.concatenate(([0], np.cumsum(size)))
        count = np.concatenate(([0], np.cumsum(often)))[edge]
        some = np.flatnonzero(np.diff(count))
        return pa.table([table["bundle"].take(pa.array(some)), pa.array([pack_sorted(flat[edge[i]:edge[i + 1]][often[edge[i]:edge[i + 1]]]) for i in some], pa.binary())], names=["bundle", "keys"])

    asked = texts.select("bundle", "rows").mapInArrow(emit, "block int, bundle binary, keys binary, twice binary")
    return written(asked.groupBy("block").applyInArrow(meet, "bundle binary, keys binary"), "anchors")


def _repeated_windows(texts: DataFrame, shared: DataFrame, window: int, blocks: int) -> DataFrame:
    """(bundle, at): for each bundle, the first words of windows that occur at least twice in the table."""
    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["block", "bundle", "value", "check", "at"]
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        if not right.num_rows or not left.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        keys = np.unique(np.concatenate([unpack_sorted(x.as_buffer()) for x in right["keys"]]))
        held, base = [], 0
        for i in np.argsort(left["part"].to_numpy()).tolist():
            for _, _, data, offsets in _rows(left["rows"][i]):
                words = K.Words(data, offsets)
                one, two = words.keys()
                hashed = K.hash_keys(one, two)
                start = _candidates(words, hashed, window, keys)
                if len(start):
                    at, value = K.window_hashes(hashed, words.of_row, window)
                    _, check = K.window_hashes(K.hash_keys(one, two, 1), words.of_row, window)
                    pick = np.searchsorted(at, start)
                    held.append((value[pick], (check[pick] >> np.uint64(32)).astype(np.uint32), (start + base).astype(np.uint32)))
                base += len(hashed)
        if not held:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        value, check, at = (np.concatenate([x[i] for x in held]) for i in range(3))
        order = np.argsort(value, kind="stable")
        value, check, at = value[order], check[order], at[order]
        bundle, out = left["bundle"][0].as_py(), []
        for b, part in _in_blocks(value, blocks):
            out.append((b, bundle, pack_sorted(value[part]), planes(check[part]), planes(at[part])))
        return pa.table([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)

    def meet(table: pa.Table) -> pa.Table:
        value = [unpack_sorted(x.as_buffer()) for x in table["value"]]
        edge = np.concatenate(([0], np.cumsum([len(x) for x in value])))
        value = np.concatenate(value)
        check = np.concatenate([unplanes(x.as_buffer(), np.uint32) for x in table["check"]])
        order = np.lexsort((check, value))
        value, check = value[order], check[order]
        same = (value[1:] == value[:-1]) & (check[1:] == check[:-1])
        often = np.zeros(len(value), bool)
        often[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
        count = np.concatenate(([0], np.cumsum(often)))[edge]
        some = np.flatnonzero(np.diff(count))
        places = [planes(np.sort(unplanes(table["at"][int(i)].as_buffer(), np.uint32)[often[edge[i]:edge[i + 1]]])) for i in some]
        return pa.table([table["bundle"].take(pa.array(some)), pa.array(places, pa.binary())], names=["bundle", "at"])

    found = (texts.groupBy("bundle").cogroup(shared.groupBy("bundle"))
             .applyInArrow(windows, "block int, bundle binary, value binary, check binary, at binary"))
    return found.groupBy("block").applyInArrow(meet, "bundle binary, at binary")


def _less(words: K.Words, keep: np.ndarray) -> pa.Array:
    """The texts less their dropped words and the white space that follows each."""
    gone = np.flatnonzero(~keep)
    ends = np.append(words.start, len(words.data))[1:]
    last = words.of_row[1:][np.diff(words.of_row) > 0] - 1
    ends[last] = words.offsets[1:][np.diff(words.of_row) > 0]
    step = np.zeros(len(words.data) + 1, np.int32)
    step[words.start[gone]] += 1
    step[ends[gone]] -= 1
    stay = np.cumsum(step)[:-1] == 0
    return K.text_array(words.data[stay], np.concatenate(([0], np.cumsum(stay)))[words.offsets])


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 35, carry: tuple[str, ...] = (), layout: bool = False) -> DataFrame:
    """One row for each row of `docs`: id, n_words, n_removed, text, and `carry` as one struct of that name if any.

    The text is the kept words joined by one space; with `layout`, it is the text as it was less the
    removed words and the white space after each, null for null.
    """
    base = small_batches(docs).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), (F.struct(*carry) if carry else F.lit(0)).alias("carry"))
    blocks = block_count(base)
    texts = _bundled(base, bundle_bytes(blocks))
    found = _repeated_windows(texts, _shared_anchors(texts, window, blocks), window, blocks)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        at = np.sort(np.concatenate([np.zeros(0, np.uint32), *(unplanes(x.as_buffer(), np.uint32) for x in right["at"])])).astype(np.int64)
        out, seen = [], 0
        for i in np.argsort(left["part"].to_numpy()).tolist():
            for batch, first, data, offsets in _rows(left["rows"][i]):
                words = K.Words(data, offsets)
                n, m = len(offsets) - 1, len(words.start)
                begin = at[np.searchsorted(at, seen):np.searchsorted(at, seen + m)] - seen
                seen += m
                step = np.zeros(m + window + 1, np.int64)
                step[begin] += 1
                np.add.at(step, begin + window, -1)
                keep = np.cumsum(step)[:m] == 0
                gone = np.diff(np.concatenate(([0], np.cumsum(~keep)))[words.of_row])
                rest = batch.slice(first, n)
                if layout:
                    kept = rest.column(1) if not len(begin) else pc.if_else(rest.column(1).is_valid(), _less(words, keep), pa.scalar(None, pa.string()))
                else:
                    kept = K.joined_words(words, keep)
                out.append(pa.RecordBatch.from_arrays([rest.column(0), pa.array(np.diff(words.of_row)), pa.array(gone.astype(np.int64)), kept, rest.column(2)], ["id", "n_words", "n_removed", "text", "carry"]))
        return pa.Table.from_batches(out)

    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType()),
                         T.StructField("carry", base.schema["carry"].dataType)])
    rows = texts.groupBy("bundle").cogroup(found.groupBy("bundle")).applyInArrow(cut, kind)
    return rows.select(F.col("id").alias(id_column), "n_words", "n_removed", F.col("text").alias(text_column), *(["carry"] if carry else []))
