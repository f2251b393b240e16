"""Cross-tokenizer alignment by byte-owner arrays.

Tokenizer A (byte-level BPE) reads a space and the text; tokenizer B (pieces) reads the
text and adds that space itself, so both cut the same bytes.  `np.repeat` of token
indices by token lengths says for each byte which token of A and which of B owns it.
Where the pair of owners changes a *link* begins: two tokens whose bytes overlap.  Where
both owners change at once there is a *cut*, and the tokens between two cuts are a group.

1. Each task gathers 12 MB of texts or more into a *bundle*: what is told of each row, its
   links as places in the bundle's list of distinct id pairs, and that list with counts.
   Bundles are written down once.
2. Pairs of all bundles are summed by (A id, B id), and each B id's highest count is
   found.  A frequent pair sends one row a bundle.
3. The counts return to the bundles by an equal join, and each bundle sums over its rows.

Both encoders remember units between white space, which do not depend on their
neighbours (`packing.units` for A, runs before a space for B).

Null and empty texts, and texts whose joined token bytes differ from a space and the text
(for B: those with U+2581), have no tokens: zeros and an empty `groups`.  Repeated rows
each count and come back; null ids come back; an empty table gives no rows; other
columns are not read.  Texts of any length are read whole; owner arrays span 4 MB at a time.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .bpe import _gather
from .common import block_count, bundle_bytes, compress, decompress, planes, small_batches, unplanes, written
from .packing import UnitEncoder

#: Bytes that the owner arrays span at a time.
WINDOW = 1 << 22


class ByteEncoder(UnitEncoder):
    """Tokenizer A; strings of special tokens are plain text.  `table`: each id's bytes.

    Units of characters below U+0250 are encoded by the same vocabulary's ranks, which is
    faster; others by the tokenizer itself, as letters of later Unicode versions may differ.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        decoded, size = _byte_alphabet(), self.tokenizer.get_vocab_size(with_added_tokens=False)
        self.table = [bytes(decoded.get(c, 0x3F) for c in self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())]
        self.ranks = None
        special = {x.content for x in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {x: i for i, x in enumerate(self.table[:size]) if self.tokenizer.id_to_token(i) not in special}
        if _in_order(path, self.table):
            import tiktoken

            self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _encode(self, texts: list[str]):
        if self.ranks is None:
            return super()._encode(texts)
        found, rest, encode = [], [], self.ranks.encode_ordinary
        for at, text in enumerate(texts):
            if text.isascii() or max(text) < "\u0250":
                found.append(encode(text))
            else:
                rest.append(at)
                found.append(None)
        if rest:
            for at, x in zip(rest, self.tokenizer.encode_batch_fast([texts[at] for at in rest], add_special_tokens=False), strict=True):
                found[at] = x.ids
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(size.sum())), size


# Fixed value: how byte-level vocabularies of this kind split a text before they merge.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _in_order(path: str, table: list[bytes]) -> bool:
    """Whether ids rank the merges, so that ranks and merges say the same."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    made = [model["vocab"].get(a + b) for a, b in merges]
    return spec["normalizer"] is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and made == list(range(256, 256 + len(made))) and all(len(x) == 1 for x in table[:256])


class PieceEncoder(UnitEncoder):
    """Tokenizer B over bytes that begin each row with the space that it adds itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.table = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # no piece goes on into a space, so what stands before one never merges with what follows
        self.split = not any("▁" in p.lstrip("▁") for p in pieces)
        self.blank = self.model.piece_to_id("▁")
        self._forget()

    def _encode(self, texts: list[str]):
        found = [ids or [self.blank] for ids in self.model.encode([t[1:] for t in texts], num_threads=1)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(size.sum())), size

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        blank = data == 0x20
        begins = np.zeros(len(data), bool)
        if self.split:
            begins[1:] = blank[1:] & ~blank[:-1]
        begins[offsets[:-1]] = True
        start = np.flatnonzero(begins)
        index = self._lookup(data, start, np.append(start[1:], len(data)))
        size = self.size[index]
        return _gather(self.flat, self.first[index], size), np.append(np.cumsum(size) - size, size.sum())[np.searchsorted(start, offsets)]


def _byte_alphabet() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer with its tables of token bytes."""

    def __init__(self, encoder: UnitEncoder):
        self.encoder = encoder
        self.size = np.array([len(x) for x in encoder.table])
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(encoder.table), np.uint8)

    def tokens(self, data: np.ndarray, offsets: np.ndarray):
        """ids, tokens of each row, and whether the row's joined tokens are its bytes."""
        ids, edge = self.encoder.encode(data, offsets)
        size = self.size[ids]
        total = np.concatenate(([0], np.cumsum(size)))[edge]
        good = (np.diff(total) == np.diff(offsets)) & np.logical_and.reduceat(np.append(size > 0, True), np.minimum(edge[:-1], len(size)))
        joined = _gather(self.flat, self.first[ids], size)
        if not good.all():
            joined = joined[np.repeat(good, np.diff(total))]
        wrong = np.flatnonzero(joined != data[np.repeat(good, np.diff(offsets))])
        if len(wrong):
            rows = np.flatnonzero(good)
            good[rows[np.searchsorted(np.cumsum(np.diff(offsets)[rows]), wrong, "right")]] = False
        return ids, np.diff(edge), good


def overlaps(size_a: np.ndarray, size_b: np.ndarray, window: int = WINDOW):
    """Token indices of A and B of each link, in order, and whether a cut stands before it.

    Both cut the same bytes; `size_*` are token lengths, none of them 0.
    """
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    total = int(end_a[-1]) if len(end_a) else 0
    found, last = [], (-1, -1)
    for s in range(0, total, window):
        e = min(total, s + window)
        owners = []
        for end, size in ((end_a, size_a), (end_b, size_b)):
            a, b = np.searchsorted(end, s, "right"), np.searchsorted(end, e - 1, "right") + 1
            here = np.minimum(end[a:b], e) - np.maximum(end[a:b] - size[a:b], s)
            owners.append(np.repeat(np.arange(a, b), here))
        new = [np.concatenate(([own[0] != before], own[1:] != own[:-1])) for own, before in zip(owners, last, strict=True)]
        at = np.flatnonzero(new[0] | new[1])
        found.append((owners[0][at], owners[1][at], new[0][at] & new[1][at]))
        last = owners[0][-1], owners[1][-1]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Decimals:
    """Ids as decimal digits with room for a separator, eight bytes each."""

    def __init__(self, n: int):
        if n > 10**7:
            raise ValueError("ids of more than seven digits")
        digits = [str(i).encode() for i in range(n)]
        self.size = np.array([len(x) for x in digits])
        self.bytes = np.frombuffer(b"".join(x.ljust(8, b",") for x in digits), np.uint64)
        self.used = np.ascontiguousarray(np.arange(8) <= self.size[:, None]).view(np.uint64).ravel()

    def texts(self, a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, edge: np.ndarray):
        """Bytes and row offsets of `a1,a2|b1;a3|b2,b3`; `edge`: symbols before each row."""
        before_b = np.concatenate(([0], np.cumsum(np.bincount(group_b))))
        before_a = np.cumsum(np.bincount(group_a))
        at_a = np.arange(len(a)) + before_b[group_a]
        at_b = np.arange(len(b)) + before_a[group_b]
        ids = np.empty(len(a) + len(b), np.int64)
        ids[at_a], ids[at_b] = a, b
        out, used, size = self.bytes[ids].view(np.uint8), self.used[ids].view(bool), self.size[ids]
        end = np.arange(len(ids)) * 8 + size
        out[end[at_a[np.append(group_a[1:] != group_a[:-1], True)]]] = ord("|")
        out[end[at_b[np.append(group_b[1:] != group_b[:-1], True)]]] = ord(";")
        size += 1
        last = edge[1:][edge[1:] > edge[:-1]] - 1  # no separator ends a row
        used[end[last]] = False
        size[last] -= 1
        return out[used], np.concatenate(([0], np.cumsum(size)))[edge]


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Side(ByteEncoder(path_a)), Side(PieceEncoder(path_b))
        self.decimals = Decimals(max(len(self.a.size), len(self.b.size)))

    def rows(self, data: np.ndarray, offsets: np.ndarray):
        """Of a run of texts: n_a, n_b, n_groups, n_links of each row; row and pair of each link; bytes and offsets of the groups' texts."""
        n = len(offsets) - 1
        full = np.flatnonzero(np.diff(offsets) > 0)
        told = np.zeros((4, n), np.int64)
        # the rows' bytes with a space before each
        length = np.diff(offsets)[full] + 1
        edge = np.concatenate(([0], np.cumsum(length)))
        spaced = np.full(int(edge[-1]), 0x20, np.uint8)
        keep = np.ones(len(spaced), bool)
        keep[edge[:-1]] = False
        spaced[keep] = data
        empty = np.zeros(0, np.int64)
        if not len(full):
            return told, empty, empty, np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
        (ids_a, count_a, good_a), (ids_b, count_b, good_b) = self.a.tokens(spaced, edge), self.b.tokens(spaced, edge)
        good = good_a & good_b
        if not good.all():
            ids_a, ids_b = ids_a[np.repeat(good, count_a)], ids_b[np.repeat(good, count_b)]
            full, count_a, count_b = full[good], count_a[good], count_b[good]
        i, j, cut = overlaps(self.a.size[ids_a], self.b.size[ids_b])
        group = np.cumsum(cut) - 1
        row_a = np.repeat(full, count_a)
        first_a = np.flatnonzero(np.append(True, i[1:] != i[:-1])[:len(i)])
        first_b = np.flatnonzero(np.append(True, j[1:] != j[:-1])[:len(j)])
        row = row_a[i]
        told[0, full], told[1, full] = count_a, count_b
        told[2], told[3] = np.bincount(row[cut], minlength=n), np.bincount(row, minlength=n)
        symbols = np.concatenate(([0], np.cumsum(told[0] + told[1])))
        text, ends = self.decimals.texts(ids_a, group[first_a], ids_b, group[first_b], symbols) if len(i) else (np.zeros(0, np.uint8), np.zeros(n + 1, np.int64))
        return told, row, ids_a[i].astype(np.int64) << 32 | ids_b[j].astype(np.int64), text, ends


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _runs(row: np.ndarray, value: np.ndarray):
    """(row, value, count) of each distinct (row, value), by row and value."""
    width = int(value.max()) + 1 if len(value) else 1
    both, count = np.unique(row * width + value, return_counts=True)
    return both // width, both % width, count


class _Bundle:
    def __init__(self):
        self.ids, self.told, self.groups, self.links, self.rows, self.bytes = [], [], [], [], 0, 0

    def add(self, ids: pa.Array, told: np.ndarray, row: np.ndarray, pair: np.ndarray, groups: list, size: int) -> None:
        known, place = np.unique(pair, return_inverse=True)
        row, place, count = _runs(row, place)
        self.ids.append(ids)
        self.told.append(told)
        self.groups += groups
        self.links.append((self.rows + row, known, place, count))
        self.rows += len(ids)
        self.bytes += size

    def close(self, bundle: int, kind: pa.DataType):
        """The bundle's own row, then its pairs."""
        row, count = (np.concatenate([x[i] for x in self.links]) for i in (0, 3))
        known, back = np.unique(np.concatenate([x[1] for x in self.links]), return_inverse=True)
        shift = np.cumsum([0, *(len(x[1]) for x in self.links)])
        place = np.concatenate([back[shift[i] + x[2]] for i, x in enumerate(self.links)])
        ids = pa.concat_arrays(self.ids)
        total = np.zeros(len(known), np.int64)
        np.add.at(total, place, count)
        own = [compress(np.packbits(np.asarray(ids.is_valid())).tobytes()), planes(np.asarray(ids.fill_null(0), np.int64)), planes(np.concatenate(self.told, axis=1)),
               planes(np.bincount(row, minlength=self.rows).astype(np.uint32)), planes(place.astype(np.uint32)), planes(count.astype(np.uint32))]
        names = ["bundle", "slot", "a", "b", "n", *OWN, "groups"]
        yield pa.RecordBatch.from_arrays([pa.array([bundle]), *(pa.nulls(1, k) for k in (pa.int32(), pa.int32(), pa.int32(), pa.int64())), *(pa.array([x], pa.binary()) for x in own), pa.array([self.groups], pa.list_(kind))], names)
        for at in range(0, len(known), 8192):
            some = known[at:at + 8192]
            m = len(some)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, bundle)), pa.array(np.arange(at, at + m, dtype=np.int32)), pa.array((some >> 32).astype(np.int32)), pa.array((some & 0xFFFFFFFF).astype(np.int32)), pa.array(total[at:at + m]),
                                              *(pa.nulls(m, pa.binary()) for _ in own), pa.nulls(m, pa.list_(kind))], names)


OWN = ["known", "numbers", "told", "links", "places", "times"]


def align(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text", groups: str = "text") -> DataFrame:
    """One row for each row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    `groups`: "text" returns the groups' ids (`a1,a2|b1;a3|b2,b3`); "sha256" the lower-case
    hex digest of that text, made where the text is, and '' for rows without tokens.
    """
    if groups not in ("text", "sha256"):
        raise ValueError("groups: text or sha256")
    base = small_batches(docs).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    share = bundle_bytes(block_count(base))

    def tell(text: np.ndarray, ends: np.ndarray) -> list[str]:
        raw = memoryview(np.ascontiguousarray(text))
        parts = (raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        if groups == "text":
            return [bytes(x).decode() for x in parts]
        return [hashlib.sha256(x).hexdigest() if len(x) else "" for x in parts]

    def gather(batches):
        at, part, number, bundle = aligner(path_a, path_b), TaskContext.get().partitionId(), 0, _Bundle()
        for batch in batches:
            for first, data, offsets in K.chunks(batch.column(1), 1 << 19):
                told, row, pair, text, ends = at.rows(data, offsets)
                bundle.add(batch.column(0).slice(first, len(offsets) - 1), told, row, pair, tell(text, ends), len(data))
                if bundle.bytes >= share:
                    yield from bundle.close(part << 32 | number, pa.string())
                    number, bundle = number + 1, _Bundle()
        if bundle.rows:
            yield from bundle.close(part << 32 | number, pa.string())

    schema = "bundle long, slot int, a int, b int, n long, " + ", ".join(f"{x} binary" for x in OWN) + ", groups array<string>"
    bundles = written(base.mapInArrow(gather, schema), "alignment")
    pairs = bundles.where("slot is not null").select(F.col("bundle").alias("of"), "slot", "a", "b", "n")
    counts = written(pairs.groupBy("a", "b").agg(F.sum("n").alias("total")), "pairs")
    highest = counts.groupBy("b").agg(F.max("total").alias("most"))
    judged = counts.join(highest, "b").select("a", "b", "total", (F.col("total") == F.col("most")).alias("best"))
    answers = pairs.drop("n").join(judged, ["a", "b"]).select("of", "slot", "total", "best")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        slot = right["slot"].to_numpy()
        total, best = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
        total[slot], best[slot] = right["total"].to_numpy(), np.asarray(right["best"]).astype(np.int64)
        own = {x: left[x][0].as_py() for x in OWN}
        numbers = unplanes(own["numbers"], np.int64)
        known = np.unpackbits(np.frombuffer(decompress(own["known"]), np.uint8), count=len(numbers)).astype(bool)
        told = unplanes(own["told"], np.int64).reshape(4, -1)
        edge = np.concatenate(([0], np.cumsum(unplanes(own["links"], np.uint32).astype(np.int64))))
        place, times = unplanes(own["places"], np.uint32), unplanes(own["times"], np.uint32).astype(np.int64)
        sums = [np.diff(np.concatenate(([0], np.cumsum(x[place] * times)))[edge]) for x in (best, total)]
        return pa.table([pa.array(numbers, mask=~known), *(pa.array(x) for x in (*told, *sums)), left["groups"].combine_chunks().flatten()], names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    own = bundles.where("slot is null").select("bundle", *OWN, "groups")
    out = own.groupBy("bundle").cogroup(answers.groupBy("of")).applyInArrow(meet, "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
    return out.withColumnRenamed("id", id_column)
