"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

The incidence matrix A has a row for each distinct shingle set and a column for
each shingle.  A pair links when its Jaccard similarity is at least
`num / den`.  The steps:

1. *Classes.*  Rows with equal sets collapse into one node, so copies never meet
   as pairs.  A node is 64 bits of its set's digest; where sets that differ in 128 bits
   share these (some 300 nodes at 10**11 documents), the other 64 bits take their place.
2. *Column order.*  How often each column is filled is counted in blocks; the
   most frequent ones (at most 2**20) get a level in a fixed 16 MiB table.  Rows
   order their columns by (level, hash).  Any order gives right results; this
   one keeps passages that many documents share out of the prefixes.
3. *Incidence blocks.*  Two sets of sizes n <= m that link share a column among
   the first n - ceil(n * num / den) + 1 of each (size-derived bound), so only
   these entries go to the column blocks; columns with one row are dropped there.
4. *Product.*  First each row is multiplied with one leader row in each of its
   first columns, then with one row of every component that meets it; links found
   become components.  Then the blocks multiply all remaining entries between
   different components where enough columns follow; overlap counts on the
   prefixes discard pairs that the suffixes could not lift to the bound.  A column of
   many open rows is dealt out in tiles, a block for each two tiles.
5. *Check.*  Pairs left are compared on their whole sets.  Pairs inside one
   component are never multiplied: they cannot change a component.

Every text counts in full.  Nulls and texts without words have an empty set and
link with nothing.  Rows may repeat and ids may be null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import block_count, block_of, bloom_of, compress, decompress, discard, join_counted, pack_sorted, planes, small_batches, unpack_sorted, unplanes, written
from .components import components

LEVEL_BITS = 24
LEVEL_KEYS = 1 << 20
#: Entries that a task gathers before it sends them to the blocks; more where there are many blocks.
FLUSH = 1 << 20
#: Rows of a tile of a column.
TILE = 2048
#: Pairs that a block looks at in one go, and rows whose prefixes it keeps at hand.
PAIRS, ROWS_HELD = 1 << 18, 4000
#: Columns of the longest prefix that goes with each of its entries.
SHIPPED = 1024


def _digests(docs: DataFrame, k: int) -> DataFrame:
    def digest(batches):
        for batch in batches:
            found = [(len(s), *K.set_digest(s)) for s in K.shingle_sets(batch.column(1), k)]
            columns = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in columns)], ["id", "n", "node", "other"])

    return docs.mapInArrow(digest, "id long, n long, node long, other long")


def _node(s: np.ndarray, shared: frozenset) -> int:
    """The node of a set; `shared` are digests that different sets share."""
    node, other = K.set_digest(s)
    return other if node in shared else node


def _fresh_sets(batches, k: int, shared: frozenset):
    """(node, set) of each batch's non-empty sets; copies inside a task come once."""
    seen: set[int] = set()
    for batch in batches:
        for s in K.shingle_sets(batch.column(0), k):
            if len(s):
                node = _node(s, shared)
                if node not in seen:
                    seen.add(node)
                    yield node, s


def _level_table(texts: DataFrame, k: int, blocks: int, shared: frozenset):
    """A broadcast table of 2**24 bytes: log2 of how often a slot's columns are filled, 0 for rare ones."""
    flush_at = max(FLUSH, blocks * 32)

    def count(batches):
        held, size = [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(block_of(keys << np.uint64(24), blocks), np.arange(blocks + 1))
            rows = [b for b in range(blocks) if cut[b] < cut[b + 1]]
            return pa.RecordBatch.from_arrays([
                pa.array(rows, pa.int32()),
                pa.array([pack_sorted(keys[cut[b]:cut[b + 1]]) for b in rows], pa.binary()),
                pa.array([planes(n[cut[b]:cut[b + 1]].astype(np.uint32)) for b in rows], pa.binary())], ["block", "keys", "n"])

        for _, s in _fresh_sets(batches, k, shared):
            held.append(s >> np.uint64(24))
            size += len(s)
            if size >= flush_at:
                yield from K.spread(flush())
                held, size = [], 0
        if held:
            yield from K.spread(flush())

    def total(table: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack_sorted(x.as_py()) for x in table["keys"]])
        n = np.concatenate([unplanes(x.as_py(), np.uint32) for x in table["n"]]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        n = np.add.reduceat(n, first)
        keep = n >= 4
        level = np.log2(n[keep]).astype(np.int8)
        slot = (keys[first][keep] >> np.uint64(40 - LEVEL_BITS)).astype(np.int32)
        return pa.table([pa.array(slot, pa.int32()), pa.array(level, pa.int8())], names=["slot", "level"])

    counted = written(texts.mapInArrow(count, "block int, keys binary, n binary")
                      .groupBy("block").applyInArrow(total, "slot int, level byte"), "levels")
    least, keys = 64, 0
    for level, n in sorted(((r[0], r[1]) for r in counted.groupBy("level").count().collect()), reverse=True):
        keys += n
        if keys > LEVEL_KEYS:
            break
        least = level
    table = np.zeros(1 << LEVEL_BITS, np.uint8)
    if keys:
        for batch in counted.where(F.col("level") >= least).groupBy("slot").agg(F.max("level").alias("level")).toArrow().to_batches():
            table[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    discard(counted)
    return texts.sparkSession.sparkContext.broadcast(table)


def _postings(texts: DataFrame, k: int, num: int, den: int, blocks: int, levels, shared: frozenset) -> DataFrame:
    """Prefix entries of columns that at least two nodes fill: (column, node, n, rank)."""
    flush_at = max(FLUSH, blocks * 32)

    def emit(batches):
        table = levels.value
        held, size = [], 0

        def flush():
            columns = np.concatenate([x[1] for x in held])
            lengths = np.array([len(x[1]) for x in held])
            owner = np.repeat(np.arange(len(held), dtype=np.uint32), lengths)
            rank = np.arange(len(columns), dtype=np.uint32) - np.repeat(np.cumsum(lengths) - lengths, lengths).astype(np.uint32)
            nodes = np.array([x[0] for x in held], np.int64)
            sizes = np.array([x[2] for x in held], np.uint32)
            order = np.argsort(columns, kind="stable")
            columns, owner, rank = columns[order], owner[order], rank[order]
            cut = np.searchsorted(block_of(columns, blocks), np.arange(blocks + 1))
            rows, out = [], []
            for b in range(blocks):
                part = slice(cut[b], cut[b + 1])
                if cut[b] < cut[b + 1]:
                    used, local = np.unique(owner[part], return_inverse=True)
                    rows.append(b)
                    out.append((pack_sorted(columns[part]), planes(local.astype(np.uint32)), planes(rank[part]), compress(nodes[used].tobytes()), planes(sizes[used])))
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array(list(x), pa.binary()) for x in zip(*out, strict=True))],
                                              ["block", "columns", "local", "rank", "nodes", "sizes"])

        for node, s in _fresh_sets(batches, k, shared):
            n = len(s)
            p = n - -(-n * num // den) + 1
            level = table[s >> np.uint64(64 - LEVEL_BITS)]
            first = s[np.argsort(level, kind="stable")[:p]] if level.any() else s[:p]
            held.append((node, first, n))
            size += p
            if size >= flush_at:
                yield from K.spread(flush())
                held, size = [], 0
        if held:
            yield from K.spread(flush())

    def meet(table: pa.Table) -> pa.Table:
        parts = [[], [], [], []]
        for row in table.to_pylist():
            local = unplanes(row["local"], np.uint32)
            parts[0].append(unpack_sorted(row["columns"]))
            parts[1].append(np.frombuffer(decompress(row["nodes"]), np.int64)[local])
            parts[2].append(unplanes(row["sizes"], np.uint32)[local])
            parts[3].append(unplanes(row["rank"], np.uint32))
        columns, nodes, sizes, rank = (np.concatenate(x) for x in parts)
        once, again = np.concatenate(([False], np.zeros(max(0, len(columns) - 1), bool))), np.argsort(columns, kind="stable")
        ordered = columns[again]
        same = ordered[1:] == ordered[:-1]
        once = np.concatenate((same, [False])) | np.concatenate(([False], same))
        again = again[once]
        columns, nodes, sizes, rank = columns[again], nodes[again], sizes[again], rank[again]
        order = np.lexsort((nodes, columns))
        columns, nodes, sizes, rank = columns[order], nodes[order], sizes[order], rank[order]
        if len(columns):
            new = np.concatenate(([True], (columns[1:] != columns[:-1]) | (nodes[1:] != nodes[:-1])))
            columns, nodes, sizes, rank = columns[new], nodes[new], sizes[new], rank[new]
            start = np.concatenate(([True], columns[1:] != columns[:-1]))
            alone = start & np.concatenate((start[1:], [True]))
            columns, nodes, sizes, rank = columns[~alone], nodes[~alone], sizes[~alone], rank[~alone]
        return pa.table([pa.array(columns.view(np.int64)), pa.array(nodes), pa.array(sizes.astype(np.int64)), pa.array(rank.astype(np.int64))], names=["col", "node", "n", "rank"])

    blobs = texts.mapInArrow(emit, "block int, columns binary, local binary, rank binary, nodes binary, sizes binary")
    return written(blobs.groupBy("block").applyInArrow(meet, "col long, node long, n long, rank long"), "entries")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int, shared: frozenset) -> DataFrame:
    """The pairs (a, b), a written table that goes, whose whole sets reach the similarity."""
    ends = written(pairs.select(F.col("a").alias("node")).distinct().union(pairs.select(F.col("b").alias("node")).distinct()).distinct(), "ends")
    keys = ends.count()
    if not keys:
        return pairs
    bloom, field = bloom_of(ends, "node", keys)

    def fetch(batches):
        for batch in batches:
            rows = [(node, s.tobytes()) for node, s in _fresh_sets([batch], k, shared)]
            if rows:
                hit = bloom.test(field.value, np.array([x[0] for x in rows], np.int64).view(np.uint64))
                rows = [x for x, h in zip(rows, hit, strict=True) if h]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.binary())], ["node", "set"])

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(shared * den >= num * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = texts.mapInArrow(fetch, "node long, set binary").join(ends, "node", "left_semi").groupBy("node").agg(F.first("set").alias("set"))
    sets = written(sets, "sets")
    both = (pairs.join(sets.withColumnsRenamed({"node": "a", "set": "x"}), "a")
            .join(sets.withColumnsRenamed({"node": "b", "set": "y"}), "b").select("a", "b", "x", "y"))
    links = written(both.mapInArrow(compare, "a long, b long"), "links")
    discard(pairs, ends, sets)
    return links


def _sizes_fit(num: int, den: int):
    return (F.col("na") * num <= F.col("nb") * den) & (F.col("nb") * num <= F.col("na") * den)


def _product(entries: DataFrame, blocks: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of different components in entries(col, node, n, rank, label, least) that can reach the bound, each once.

    The first column that a linked pair shares, at ranks i and j, leaves enough
    columns on both sides: n - i and m - j are at least num * (n + m) / (num + den).
    Only such products are formed.  Rows carry the columns of their prefix, so that a
    block counts a pair's whole overlap there at the pair's first shared column, and
    discards it where the suffixes cannot lift the count to the bound.  Prefixes of more
    than SHIPPED columns stay behind: what an entry carries is bounded, and pairs
    with such a row are left to the check.
    """
    def multiply(table: pa.Table) -> pa.Table:
        columns, nodes, n, rank, label, tile, other = (table[c].to_numpy() for c in ("col", "node", "n", "rank", "label", "tile", "other"))
        prefix = table["cols"].combine_chunks()
        low, high = np.minimum(tile, other), np.maximum(tile, other)
        order = np.lexsort((nodes, n, high, low, columns))
        columns, nodes, n, rank, label, tile, low, high = (x[order] for x in (columns, nodes, n, rank, label, tile, low, high))
        # the rows after row i of the same column and tiles, up to the largest size that can link with it
        start = np.flatnonzero(np.concatenate(([True], (columns[1:] != columns[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))))
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(columns))))
        wide = np.int64(n.max()) * den // num + 2 if len(n) else 1
        reach = np.searchsorted(group * wide + n, group * wide + n * den // num, "right")
        spans = np.where((n - rank) * (num + den) >= num * 2 * n, reach - np.arange(len(n)) - 1, 0)
        ends = np.cumsum(spans)
        held: dict[int, tuple] = {}

        def row(i: int) -> tuple:
            found = held.get(int(nodes[i]))
            if found is None:
                if len(held) >= ROWS_HELD:
                    held.clear()
                ordered = prefix[int(order[i])].as_py()
                found = held[int(nodes[i])] = (ordered, frozenset(ordered or ()))
            return found

        out, at = {}, 0
        while at < len(n):
            last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            span = spans[at:last]
            left = np.repeat(np.arange(at, last), span)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(span) - span, span)
            least = num * (n[left] + n[right])
            keep = (label[left] != label[right]) & ((low[left] == high[left]) | (tile[left] != tile[right])) & ((n[left] - rank[left]) * (num + den) >= least) & ((n[right] - rank[right]) * (num + den) >= least)
            for i, j in zip(left[keep].tolist(), right[keep].tolist(), strict=True):
                (ordered, one), (_, other) = row(i), row(j)
                if one and other:
                    if next(c for c in ordered if c in other) != columns[i]:
                        continue  # the pair belongs to an earlier column
                    # beyond what the prefixes share, the larger suffix can add ceil(n * num / den) - 1 columns
                    most = len(one & other) + -(-int(n[j]) * num // den) - 1
                    if most * (num + den) < num * int(n[i] + n[j]):
                        continue
                out[int(nodes[i]), int(nodes[j])] = None
            at = last
        return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    short = F.col("n") - F.ceil(F.col("n") * num / den) + 1 <= SHIPPED
    prefixes = entries.where(short).groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "col"))), lambda x: x["col"]).alias("cols"))  # SHIPPED at most
    # an entry takes part only if enough columns follow it for the smallest partner that its column may hold
    partner = F.greatest(F.col("least"), F.floor((F.col("n") * num + den - 1) / den))
    useful = entries.where((F.col("n") - F.col("rank")) * (num + den) >= num * (F.col("n") + partner)).drop("least")
    tiles = F.ceil(F.col("m") / TILE)
    tiled = (useful.withColumn("tile", F.pmod(F.xxhash64("node"), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles.cast("int") - 1))).drop("m"))
    block = F.pmod(F.xxhash64("col", F.least("tile", "other"), F.greatest("tile", "other")), F.lit(blocks))
    return (tiled.join(prefixes, "node", "left").withColumn("block", block)
            .groupBy("block").applyInArrow(multiply, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One row for each row of `docs`: id, n_shingles, component_id, copies.

    component_id is the smallest id reachable by links, the row's own included;
    for rows without words it is their own id.  `copies` is the number of rows
    with an equal set.  A null id takes part with its text and is smallest only
    where its component has no other id.
    """
    rows, roots, _ = _grouped(docs, id_column, text_column, k, num, den)
    known = (rows.where("n > 0").groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
             .join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    lowest = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = written(known.join(lowest, "root").select("node", "component_id", F.col("copies").alias("count"), "copies"), "known")
    out = join_counted(rows.where("n > 0"), known, "node", "count").unionByName(rows.where("n = 0").selectExpr("*", "id as component_id", "1L as copies"))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id", "copies")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """The rows of `docs` of which one of each group of linked rows stays; rows without words all stay.

    The row with the smallest id stays, a null id only where its group has no other; of rows that
    share that id, the one of the smallest set digest, then text, then other columns as JSON.
    Columns come back as they are.
    """
    rows, roots, shared = _grouped(docs, id_column, text_column, k, num, den)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "node")
    firsts = rows.where("n > 0").groupBy("node").agg(F.min(order).alias("first")).join(roots, "node", "left")
    stay = firsts.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select("first.node", "first.id")

    def name(batches):
        for batch in batches:
            sets = [(len(s), _node(s, shared)) for s in K.shingle_sets(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[i] for x in sets], pa.int64()) for i in (0, 1))], ["id", "text", "rest", "n", "node"])

    rest = [c for c in docs.columns if c not in (id_column, text_column)]
    base = small_batches(docs).select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), (F.struct(*rest) if rest else F.lit(0)).alias("rest"))
    named = written(base.mapInArrow(name, T.StructType([*base.schema.fields, T.StructField("n", T.LongType()), T.StructField("node", T.LongType())])), "named")
    match = (named["node"] == stay["node"]) & named["id"].cast("long").eqNullSafe(stay["id"])
    some = named.where("n > 0").join(stay, match, "left_semi")
    one = some.groupBy(F.col("id").cast("long").alias("key"), "node").agg(F.min_by(F.struct("id", "text", "rest"), F.struct("text", F.to_json(F.struct("rest")))).alias("row")).select("row.*")
    every = one.unionByName(named.where("n = 0").select("id", "text", "rest"))
    return every.select(*[F.col("id").alias(c) if c == id_column else F.col("text").alias(c) if c == text_column else F.col("rest")[c].alias(c) for c in docs.columns])


def _grouped(docs: DataFrame, id_column: str, text_column: str, k: int, num: int, den: int):
    """(id, n, node) of each row; (node, root) of each linked node; the digests that different sets share."""
    base = small_batches(docs).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    texts = base.select("text")
    blocks = block_count(texts)
    rows = written(_digests(base, k), "digests")
    alike = rows.where("n > 0").groupBy("node").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low <> high")
    shared = frozenset(r.node for r in alike.select("node").collect())  # about n * n / 2**65 of n documents
    rows = rows.select("id", "n", (F.when(F.col("node").isin(list(shared)), F.col("other")).otherwise(F.col("node")) if shared else F.col("node")).alias("node"))
    levels = _level_table(texts, k, blocks, shared)
    entries = _postings(texts, k, num, den, blocks, levels, shared)
    fit = _sizes_fit(num, den)

    # one leader in each of a row's first columns
    leads = entries.groupBy("col").agg(F.min(F.struct("node", "n")).alias("lead"))
    first = (entries.where("rank < 2").join(leads, "col")
             .select(F.col("lead.node").alias("a"), F.col("node").alias("b"), F.col("lead.n").alias("na"), F.col("n").alias("nb"))
             .where("a <> b").where(fit).select("a", "b").distinct())
    links = _verified(written(first, "pairs"), texts, k, num, den, shared)
    roots = written(components(links), "roots")

    def labelled():
        known = entries.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node"))
        open_ = known.groupBy("col").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least"), F.count("*").alias("m")).where("lo <> hi").select("col", "least", "m")
        return known.join(open_, "col").select("col", "node", "n", "rank", "label", "least", "m")

    # one row of every component that meets a column, with that of one of them; by hash, so that columns differ in both
    open_entries = written(labelled(), "open")
    tops = open_entries.groupBy("col", "label").agg(F.min(F.struct(F.xxhash64("node", "col").alias("h"), "node", "n")).alias("top"))
    leads = tops.groupBy("col").agg(F.min(F.struct(F.xxhash64("label", "col").alias("h"), "label", "top")).alias("lead"))
    second = (tops.join(leads, "col").where("label <> lead.label")
              .select(F.least("lead.top.node", "top.node").alias("a"), F.greatest("lead.top.node", "top.node").alias("b"), F.col("lead.top.n").alias("na"), F.col("top.n").alias("nb"))
              .where(fit).groupBy("a", "b").agg(F.count("*").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb")))
    more = _verified(written(second.select("a", "b"), "pairs"), texts, k, num, den, shared)
    links = links.union(more)
    roots = written(components(links), "roots")
    discard(open_entries)

    rest = _product(labelled(), blocks, num, den)
    links = links.union(_verified(written(rest, "pairs"), texts, k, num, den, shared))
    roots = written(components(links), "roots")
    discard(entries)
    return rows, roots, shared
