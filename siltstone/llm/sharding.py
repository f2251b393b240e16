"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2**16 slots; each shard owns `replicas` of them (virtual nodes) and
every arc up to its next virtual node.  A row's slot is the upper part of its
hash.  Shard loads are bounded by N // shards, plus one for N % shards shards
(those with the largest own load), so the counts of any two shards differ by one at
most.  A shard keeps its own rows in ring order up to its bound; what overflows
continues clockwise to the next shards with room.

Only the row count of each slot (65,536 numbers at any table size) reaches the
driver, which turns it into at most a few segments of ranks for each slot; they
return by a broadcast of that fixed size.  Rows shuffle once, by slot.

A row hashes by id, text and size, so null ids and copies of one id spread; rows equal in
all three share a slot and are placed one by one.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkernel import mix

SLOTS = 1 << 16


def ring(shards: int, replicas: int) -> np.ndarray:
    """The owner of each slot: the shard of the first virtual node at or after it."""
    owner = np.full(SLOTS, -1, np.int64)
    for replica in range(replicas):
        for shard in range(shards):
            at = int(mix(np.array([shard << 32 | replica], np.uint64))[0] >> np.uint64(48))
            while owner[at] >= 0:
                at = (at + 1) % SLOTS
            owner[at] = shard
    nodes = np.flatnonzero(owner >= 0)
    return owner[nodes[np.searchsorted(nodes, np.arange(SLOTS)) % len(nodes)]]


def segments(counts: np.ndarray, owner: np.ndarray, shards: int) -> list[tuple[int, int, int, int, int]]:
    """(slot, first rank, rank after the last, shard, position in the shard of the first)."""
    total = int(counts.sum())
    own = np.bincount(owner, counts, shards).astype(np.int64)
    bound = np.full(shards, total // shards, np.int64)
    bound[np.lexsort((np.arange(shards), -own))[:total % shards]] += 1
    filled = np.zeros(shards, np.int64)
    out, over = [], {}
    for slot in np.flatnonzero(counts):
        shard, n = owner[slot], int(counts[slot])
        take = int(min(n, bound[shard] - filled[shard]))
        if take:
            out.append((int(slot), 0, take, int(shard), int(filled[shard])))
            filled[shard] += take
        if take < n:
            over[int(slot)] = (take, n)
    # the overflow walks clockwise; what waits longest goes first
    waiting: list[list[int]] = []
    for slot in [*range(SLOTS), *range(SLOTS)] if over else []:
        room = int(bound[owner[slot]] - filled[owner[slot]])
        while waiting and room:
            origin, a, b = waiting[0]
            take = min(room, b - a)
            out.append((origin, a, a + take, int(owner[slot]), int(filled[owner[slot]])))
            filled[owner[slot]] += take
            room -= take
            waiting[0][1] += take
            if waiting[0][1] == b:
                waiting.pop(0)
        if slot in over:
            waiting.append([slot, *over.pop(slot)])
        if not over and not waiting:
            break
    return out


def assign(docs: DataFrame, shards: int, id_column: str = "doc_id", text_column: str = "text", replicas: int = 128) -> DataFrame:
    """One row for each row: id, size, text_crc32, shard, slot (its place in the shard, gapless from 0)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("h", F.xxhash64("id", "text_crc32", "size")).withColumn("at", F.shiftrightunsigned("h", 48).cast("int"))
    counts = np.zeros(SLOTS, np.int64)
    for slot, n in rows.groupBy("at").count().collect():  # at most SLOTS rows
        counts[slot] = n
    found = segments(counts, ring(shards, replicas), shards) or [(0, 0, 0, 0, 0)]
    table = pa.table([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["to", "a", "b", "shard", "first"])
    plan = spark.createDataFrame(table).withColumn("to", F.col("to").cast("int"))
    rank = F.row_number().over(Window.partitionBy("at").orderBy("h", "id", "text_crc32", "size")).cast("long") - 1
    placed = rows.withColumn("rank", rank).join(F.broadcast(plan), (F.col("at") == F.col("to")) & (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("b")))
    return placed.select(F.col("id").alias(id_column), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("rank") - F.col("a")).alias("slot"))
