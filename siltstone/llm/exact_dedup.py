"""Exact dedup with Patricia-trie owners.

Texts are equal when their bytes are.

1. Each task inserts its rows into a compressed radix trie, so that of a group of copies one
   entry leaves a *bundle* of rows (12 MB of different texts, or more where there are many
   owners).  Bundles are written down: their entries, and which entry each row is.
2. Entries shuffle by (length, content hash).  The owner of such a partition inserts the full
   byte strings into one trie; a terminal node stores the smallest and the largest identifier,
   the number of rows, and which entries of which bundles it answers.
3. The answers return to the bundles, which give each row its own.  So no row is ever
   dealt out by its text, and a group of copies of any size costs one entry a bundle.

An owner over its budget spills the largest subtree below the trie's first fork to a file of
the task's own (it goes with the task); keys that belong there follow it.  After the rest each
spilled subtree is read into a trie of the same budget, which may spill in turn.

Null counts as the empty text.  Null ids count in the group's size; such a row stays only where
its group has no other id.  Of rows that repeat both text and id one stays.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import block_count, bundle_bytes, compress, decompress, planes, small_batches, unplanes, written

NODE_BYTES = 200


class Node:
    __slots__ = ("label", "children", "entry", "spilled")

    def __init__(self, label: bytes):
        self.label, self.children, self.entry, self.spilled = label, {}, None, None


def merge(one: tuple | None, other: tuple) -> tuple:
    """(smallest id, largest id, rows, askers) of two entries; None is no id."""
    if one is None:
        return other
    lows, highs = [x for x in (one[0], other[0]) if x is not None], [x for x in (one[1], other[1]) if x is not None]
    one[3].extend(other[3])
    return min(lows, default=None), max(highs, default=None), one[2] + other[2], one[3]


def common_prefix(a: bytes, b: bytes) -> int:
    """Bytes that a and b share at the start, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """Byte strings to entries (smallest id, largest id, rows, list of askers); edges hold whole runs of bytes."""

    def __init__(self, budget: int = 64 << 20, prefix: bytes = b""):
        self.root, self.bytes, self.budget, self.prefix, self.spills = Node(b""), 0, budget, prefix, 0

    def insert(self, key: bytes, entry: tuple) -> None:
        node, at = self.root, 0
        while at < len(key):
            if node.spilled and key[at] in node.spilled:
                pickle.dump((key[at:], entry), node.spilled[key[at]])
                return
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.bytes += len(child.label) + NODE_BYTES
                node = child
                break
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            n = common_prefix(child.label, key[at:at + len(child.label)])
            upper = Node(child.label[:n])
            child.label = child.label[n:]
            upper.children[child.label[0]] = child
            node.children[upper.label[0]] = upper
            self.bytes += NODE_BYTES
            node, at = upper, at + n
        node.entry = merge(node.entry, entry)
        self.bytes += NODE_BYTES // 2 * len(entry[3])
        if self.bytes > self.budget:
            self._spill()

    def _spill(self) -> None:
        """Write the largest subtree below the first fork to a file; a trie without a fork holds one string and its beginnings."""
        node = self.root
        while len(node.children) == 1 and not node.spilled:
            (node,) = node.children.values()
        if not node.children:
            return
        sizes = {first: weight(child) for first, child in node.children.items()}
        first = max(sizes, key=sizes.get)
        node.spilled = node.spilled or {}
        file = node.spilled[first] = tempfile.TemporaryFile()
        inner: list = []
        for item in walk(node.children.pop(first), b"", inner):
            pickle.dump(item, file)
        for path, older in inner:  # spilled before the trie forked above
            for key, entry in _pickled(older):
                pickle.dump((path + key, entry), file)
        self.bytes -= min(self.bytes, sizes[first])
        self.spills += 1

    def entries(self):
        """(key, entry) of every terminal node, once; spilled subtrees come last, one at a time."""
        spilled = []
        yield from walk(self.root, self.prefix, spilled)
        self.root, self.bytes = Node(b""), 0
        for prefix, file in spilled:
            rest = PatriciaTrie(self.budget, prefix)
            for item in _pickled(file):
                rest.insert(*item)
            yield from rest.entries()
            self.spills += rest.spills


def _pickled(file):
    """The items of a file, which is closed after the last."""
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            file.close()
            return


def walk(node: Node, prefix: bytes, spilled: list | None = None):
    """(key, entry) below a node; (path, file) of spilled subtrees go to `spilled`."""
    stack = [(node, prefix)]
    while stack:
        node, prefix = stack.pop()
        key = prefix + node.label
        if node.entry is not None:
            yield key, node.entry
        if node.spilled and spilled is not None:
            spilled.extend((key, file) for file in node.spilled.values())
        stack.extend((x, key) for x in node.children.values())


def weight(node: Node) -> int:
    """What a subtree counts against the budget."""
    total, stack = 0, [node]
    while stack:
        node = stack.pop()
        total += len(node.label) + NODE_BYTES + (NODE_BYTES // 2 * len(node.entry[3]) if node.entry else 0)
        stack.extend(node.children.values())
    return total


def _bundled(base: DataFrame, share: int) -> DataFrame:
    """(bundle, slot, size, key, least, most, rows) of each bundle's different texts, and a row with the bundle's ids and slots."""
    def combine(batches):
        trie, ids = PatriciaTrie(1 << 62), []

        def flush():
            bundle, m = uuid.uuid4().bytes, len(ids)
            keys, entries = zip(*trie.entries(), strict=True)
            n = len(keys)
            where = np.empty(m, np.int32)  # a row's slot is the number of its entry here
            for i, e in enumerate(entries):
                where[e[3]] = i
            known = np.array([x is not None for x in ids])
            numbers = np.array([x or 0 for x in ids], np.int64)
            names = ["bundle", "slot", "size", "key", "least", "most", "rows", "known", "numbers", "slots"]
            yield pa.RecordBatch.from_arrays([pa.array([bundle], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *(pa.nulls(1, pa.int64()) for _ in range(3)),
                                              pa.array([compress(np.packbits(known).tobytes())], pa.binary()), pa.array([planes(numbers)], pa.binary()), pa.array([planes(where)], pa.binary())], names)
            for a in range(0, n, 512):
                some = entries[a:a + 512]
                k = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([bundle] * k, pa.binary()), pa.array(range(a, a + k), pa.int32()), pa.array([len(x) for x in keys[a:a + k]], pa.int64()), pa.array(keys[a:a + k], pa.binary()),
                                                  *(pa.array([e[i] for e in some], pa.int64()) for i in range(3)), *(pa.nulls(k, pa.binary()) for _ in range(3))], names)

        for batch in batches:
            for first, data, offsets in K.chunks(batch.column(1)):
                raw = data.tobytes()
                for i, id_ in enumerate(batch.column(0).slice(first, len(offsets) - 1).to_pylist()):
                    trie.insert(raw[offsets[i]:offsets[i + 1]], (id_, id_, 1, [len(ids)]))
                    ids.append(id_)
                if trie.bytes > share:
                    yield from flush()
                    trie, ids = PatriciaTrie(1 << 62), []
        if ids:
            yield from flush()

    schema = "bundle binary, slot int, size long, key binary, least long, most long, rows long, known binary, numbers binary, slots binary"
    return written(base.mapInArrow(combine, schema), "texts")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "largest", budget: int = 64 << 20) -> DataFrame:
    """One row for each row: id, keep_id, group_size, kept, text_sha256. `keep`: largest or smallest id; `budget`: bytes of an owner's trie."""
    base = small_batches(docs).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    bundles = _bundled(base, bundle_bytes(block_count(base)))
    side = 1 if keep == "largest" else 0

    def own(batches):
        trie = PatriciaTrie(budget)
        for batch in batches:
            for bundle, slot, key, least, most, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                trie.insert(key, (least, most, n, [(bundle, slot, (least, most)[side])]))
        out = []

        def table():
            kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["bundle", "slot", "keep_id", "group_size", "here", "sha"])

        for key, entry in trie.entries():
            sha, stays = hashlib.sha256(key).digest(), entry[side]
            here = min((x[0], x[1]) for x in entry[3] if x[2] == stays)  # one bundle holds the row that stays
            for bundle, slot, _ in entry[3]:
                out.append((bundle, slot, stays, entry[2], (bundle, slot) == here, sha))
                if len(out) >= 4096:
                    yield table()
                    out = []
        if out:
            yield table()

    entries = bundles.where("slot is not null").select("bundle", "slot", "size", "key", "least", "most", "rows")
    answers = (entries.repartition("size", F.xxhash64("key")).select("bundle", "slot", "key", "least", "most", "rows")
               .mapInArrow(own, "bundle binary, slot int, keep_id long, group_size long, here boolean, sha binary"))

    def give(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pa.array(np.argsort(right["slot"].to_numpy())))
        numbers, slots = unplanes(left["numbers"][0].as_py(), np.int64), unplanes(left["slots"][0].as_py(), np.int32)
        known = np.unpackbits(np.frombuffer(decompress(left["known"][0].as_py()), np.uint8), count=len(numbers)).astype(bool)
        own_id, rows = pa.array(numbers, mask=~known), right.take(pa.array(slots))
        stays = rows["keep_id"].combine_chunks()
        some, stays = np.asarray(stays.is_valid()), np.asarray(stays.fill_null(0))
        matches = np.asarray(rows["here"]) & np.where(some, known & (numbers == stays), ~known)
        kept = np.zeros(len(numbers), bool)
        at = np.flatnonzero(matches)
        kept[at[np.unique(slots[at], return_index=True)[1]]] = True
        return pa.table([own_id, rows["keep_id"], rows["group_size"], pa.array(kept), pa.array([x.hex() for x in rows["sha"].to_pylist()], pa.string())], names=["id", "keep_id", "group_size", "kept", "text_sha256"])

    rows = bundles.where("slot is null").select("bundle", "known", "numbers", "slots")
    return (rows.groupBy("bundle").cogroup(answers.groupBy("bundle"))
            .applyInArrow(give, "id long, keep_id long, group_size long, kept boolean, text_sha256 string").withColumnRenamed("id", id_column))
