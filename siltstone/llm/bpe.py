"""BPE encoding and decoding by a distinct-word table.

Words (runs without ASCII white space) are split on the executors.  The tokenizer
drops white space and never merges across it, so a text's ids are the ids of its
words, one after the other.

A *bundle* is what one task holds of 12 MB of texts, or more where there are many
blocks.  Each bundle sends out its distinct words, in blocks by word hash, and a
skeleton: the place of every word in the bundle's word list.  A block's task encodes
each distinct word once, whatever the number of bundles that ask, and answers them one
after the other.  A bundle's answers join its skeleton by position and give the ids of
every row; ids become pieces by a join with the id-to-piece table, which is as large as
the vocabulary.  Words are told apart by their bytes (long ones by a digest, see
`textkernel.span_keys`); their hashes only order them.

Bundles are named by a digest of their ids and words, so the two sides agree when
a task runs again.  A frequent word costs one entry in each bundle.  Null counts as
the empty text; empty texts have no ids.  Repeated rows each come back.
"""

from __future__ import annotations

import os
from hashlib import blake2b
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import block_count, block_of, bundle_bytes, compress, decompress, planes, small_batches, unplanes

#: Words that a block's task remembers; beyond, it starts anew.
REMEMBERED = 3_000_000


def _gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[first : first + size], one after the other."""
    to = np.cumsum(size) - size
    return flat[np.repeat(first - to, size) + np.arange(int(size.sum()))]


class PieceTable:
    """id to piece, as bytes with a space before each."""

    def __init__(self, path: str):
        tokenizer = load(path)
        pieces = [b" " + (tokenizer.id_to_token(i) or "").encode() for i in range(tokenizer.get_vocab_size())]
        self.size = np.array([len(x) for x in pieces])
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)

    def join(self, ids: np.ndarray, edge: np.ndarray) -> pa.Array:
        """The pieces of each row's ids, with one space between."""
        size = self.size[ids]
        data = _gather(self.flat, self.first[ids], size)
        cut = np.concatenate(([0], np.cumsum(size)))[edge]
        full = np.flatnonzero(cut[1:] > cut[:-1])
        keep = np.ones(len(data), bool)
        keep[cut[full]] = False
        gone = np.zeros(len(cut), np.int64)
        gone[full + 1] = 1
        return K.text_array(data[keep], cut - np.cumsum(gone))


_LOADED: dict[tuple, object] = {}


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if ("tokenizer", path) not in _LOADED:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        if tokenizer.decoder is not None:
            raise ValueError("pieces are joined by spaces only where the tokenizer has no decoder")
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _LOADED["tokenizer", path] = tokenizer
    return _LOADED["tokenizer", path]


def piece_table(path: str) -> PieceTable:
    if ("pieces", path) not in _LOADED:
        _LOADED["pieces", path] = PieceTable(path)
    return _LOADED["pieces", path]


class Bundle:
    """Rows gathered by a task: ids, word counts, and the words' places among the distinct ones."""

    def __init__(self):
        self.ids, self.counts, self.keys, self.places, self.words, self.bytes = [], [], [], [], [], 0

    def add(self, ids: pa.Array, words: K.Words) -> None:
        one, two = words.keys()
        _, at, back = K.distinct_keys(one, two)
        size = (words.end - words.start)[at]
        self.ids.append(ids)
        self.counts.append(np.diff(words.of_row))
        self.keys.append((one[at], two[at]))
        self.places.append(back)
        self.words.append((_gather(words.data, words.start[at], size), size))
        self.bytes += len(words.data)

    def close(self):
        """name, ids, word counts, distinct hashes ascending, their words, places of all words."""
        one, two = (np.concatenate([x[i] for x in self.keys]) for i in (0, 1))
        value, at, back = K.distinct_keys(one, two)
        shift = np.cumsum([0, *(len(x) for x, _ in self.keys)])
        places = np.concatenate([back[shift[i]:shift[i + 1]][b] for i, b in enumerate(self.places)])
        flat, size = np.concatenate([f for f, _ in self.words]), np.concatenate([s for _, s in self.words])
        ids = pa.concat_arrays(self.ids)
        counts = np.concatenate(self.counts)
        name = blake2b(np.asarray(ids.fill_null(0), np.int64).tobytes(), digest_size=16)
        for part in (counts, places, one[at], two[at]):
            name.update(np.ascontiguousarray(part).tobytes())
        first = np.cumsum(size) - size
        return name.digest(), ids, counts, value, flat, first[at], size[at], places


def _bundles(batches, size: int):
    bundle = Bundle()
    for batch in batches:
        for first, data, offsets in K.chunks(batch.column(1), 1 << 20):
            bundle.add(batch.column(0).slice(first, len(offsets) - 1), K.Words(data, offsets))
            if bundle.bytes >= size:
                yield bundle.close()
                bundle = Bundle()
    if bundle.ids:
        yield bundle.close()


def encode_decode(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row: id, n_tokens, ids (little-endian unsigned 32-bit), decoded."""
    base = small_batches(docs).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    blocks = block_count(base, 24 << 20, 12, 1 << 12)
    share = bundle_bytes(blocks, share=16 << 10)

    def ask(batches):
        for name, _, _, value, flat, first, size, _ in _bundles(batches, share):
            cut = np.searchsorted(block_of(value, blocks), np.arange(blocks + 1))
            rows, blobs = [], []
            for b in range(blocks):
                part = slice(cut[b], cut[b + 1])
                if cut[b] < cut[b + 1]:
                    rows.append(b)
                    spans = zip(first[part].tolist(), size[part].tolist(), strict=True)
                    raw = flat
                    blobs.append(compress(b" ".join([raw[a:a + n].tobytes() for a, n in spans])))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.binary()), pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())], ["bundle", "block", "words"])

    def answer(batches):
        tokenizer = load(tokenizer_path)
        place: dict[bytes, int] = {}
        flat, size = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for batch in batches:
            if len(place) > REMEMBERED:
                place.clear()
                flat, size = flat[:0], size[:0]
            known = len(place)
            asked = [np.fromiter((place.setdefault(w, len(place)) for w in decompress(x.as_py()).split(b" ")), np.int64) for x in batch.column(2)]
            words, flats, sizes = list(islice(place, known, None)), [flat], [size]
            for at in range(0, len(words), 4000):
                found = [x.ids for x in tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words[at:at + 4000]], add_special_tokens=False)]
                sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
                flats.append(np.fromiter((i for x in found for i in x), np.uint32))
            flat, size = np.concatenate(flats), np.concatenate(sizes)
            first = np.cumsum(size) - size
            for i, x in enumerate(asked):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([planes(size[x].astype(np.uint32))], pa.binary()),
                                                  pa.array([planes(_gather(flat, first[x], size[x]))], pa.binary())], ["bundle", "block", "sizes", "ids"])

    # a task streams through the asks of its blocks and holds only its dictionary
    answers = (base.mapInArrow(ask, "bundle binary, block int, words binary").repartition("block")
               .mapInArrow(answer, "bundle binary, block int, sizes binary, ids binary"))

    def skeleton(batches):
        for name, ids, counts, value, _, _, _, places in _bundles(batches, share):
            # frequent words get small numbers, so that the numbers compress
            often = np.argsort(-np.bincount(places, minlength=len(value)), kind="stable")
            rank = np.empty(len(often), np.uint32)
            rank[often] = np.arange(len(often))
            known = compress(np.packbits(np.asarray(ids.is_valid())).tobytes())
            numbers = compress(np.asarray(ids.fill_null(0), np.int64).tobytes())
            blob = [known, numbers, planes(counts.astype(np.uint32)), planes(rank[places]), planes(often.astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), *(pa.array([x], pa.binary()) for x in blob)], ["bundle", "known", "numbers", "counts", "places", "often"])

    skeletons = base.mapInArrow(skeleton, "bundle binary, known binary, numbers binary, counts binary, places binary, often binary")

    def meet(left: pa.Table, right: pa.Table):
        # bundles of one name hold the same rows: their answers are alike
        order = np.unique(right["block"].to_numpy(), return_index=True)[1] if right.num_rows else []
        parts = [(unplanes(right["sizes"][int(i)].as_py(), np.uint32).astype(np.int64), unplanes(right["ids"][int(i)].as_py(), np.uint32)) for i in order]
        size = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, np.int64)
        flat = np.concatenate([x for _, x in parts]) if parts else np.zeros(0, np.uint32)
        first = np.cumsum(size) - size
        pieces = piece_table(tokenizer_path)
        tables = []
        for row in left.to_pylist():
            numbers = np.frombuffer(decompress(row["numbers"]), np.int64)
            known = np.unpackbits(np.frombuffer(decompress(row["known"]), np.uint8), count=len(numbers)).astype(bool)
            ids = pa.array(numbers, mask=~known)
            counts = unplanes(row["counts"], np.uint32).astype(np.int64)
            often, places = unplanes(row["often"], np.uint32), unplanes(row["places"], np.uint32)
            if len(often) != len(size):
                raise RuntimeError("a bundle and its answers differ: the input gives other rows when it is read again")
            edge = np.concatenate(([0], np.cumsum(counts)))
            at = 0
            while at < len(numbers):
                last = max(at + 1, int(np.searchsorted(edge, edge[at] + 200_000, "right")) - 1)
                last = min(last, len(numbers))
                words = often[places[edge[at]:edge[last]]]
                tokens = _gather(flat, first[words], size[words])
                ends = np.concatenate(([0], np.cumsum(size[words])))[edge[at:last + 1] - edge[at]]
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), last - at, [None, pa.py_buffer(ends * 4), pa.py_buffer(tokens)]).cast(pa.binary())
                tables.append(pa.RecordBatch.from_arrays([ids.slice(at, last - at), pa.array(np.diff(ends)), blob, pieces.join(tokens, ends)], ["id", "n_tokens", "ids", "decoded"]))
                at = last
        return pa.Table.from_batches(tables)

    out = (skeletons.groupBy("bundle").cogroup(answers.groupBy("bundle"))
           .applyInArrow(meet, "id long, n_tokens long, ids binary, decoded string"))
    return out.withColumnRenamed("id", id_column)
