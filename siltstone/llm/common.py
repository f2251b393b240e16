"""Shared plumbing: tables in the cluster's shared folder, compact blobs, a bounded Bloom filter."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CODEC = zstandard.ZstdCompressor(level=1)
_DECODEC = zstandard.ZstdDecompressor()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where master is local and none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` as a table in the shared folder and read it back.

    The table outlives lost executors; it goes with `discard`, or when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/siltstone-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._siltstone_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables of `written` whose last reader is done; the driver's collector then lets go of shuffles that nothing refers to."""
    for table in tables:
        _remove(table.sparkSession, table._siltstone_path)
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession, name: str):
    """A folder in the shared folder for files of a job; it goes at the end."""
    path = f"{shared_folder(spark)}/siltstone-{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        _remove(spark, path)


#: Rows of an Arrow batch, so that a Python worker and its JVM hold few texts at once.
BATCH_ROWS = 2000


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, with the session's Arrow batches made no larger than BATCH_ROWS."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name, "0")) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def plan_bytes(df: DataFrame, text_column: str = "text") -> int:
    """Catalyst's estimate of a plan's size, or where it has none the texts' bytes; only ever used to choose a number of blocks."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if found < 1 << 55:
        return found
    return df.agg(F.coalesce(F.sum(F.octet_length(text_column)), F.lit(0))).first()[0]


def block_count(df: DataFrame, per_block: int = 4 << 20, least: int = 24, most: int = 1 << 17) -> int:
    """Blocks that keep one block's share of the work near `per_block` bytes of input."""
    return int(min(most, max(least, plan_bytes(df) // per_block)))


def planes(values: np.ndarray) -> bytes:
    """Compress an integer array plane by plane: equal high bytes vanish."""
    values = np.ascontiguousarray(values)
    width = values.dtype.itemsize
    return _CODEC.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes())


def unplanes(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(_DECODEC.decompress(blob), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned integers as compressed differences."""
    return planes(np.diff(values.astype(np.uint64), prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unplanes(blob, np.uint64), dtype=np.uint64)


def compress(data: bytes) -> bytes:
    return _CODEC.compress(data)


def decompress(blob: bytes) -> bytes:
    return _DECODEC.decompress(blob)


def block_of(values: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each 64-bit hash: equal ranges of its upper half, so sorted hashes stay in runs."""
    return ((values >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def bundle_bytes(blocks: int, least: int = 12 << 20, most: int = 64 << 20, share: int = 1 << 10) -> int:
    """How much text a bundle gathers before it answers to `blocks` blocks: more blocks, larger bundles."""
    return int(min(most, max(least, blocks * share)))


def join_counted(left: DataFrame, right: DataFrame, key: str | list[str], count: str, parts: int = 1024) -> DataFrame:
    """left inner join right on `key`, where `right` has each key once and `count`, how many rows of `left` hold it.

    Keys that hold a `parts`-th of all these rows or more, of which there are `parts` at most,
    are broadcast; only the others shuffle, so no task gets a hot key.
    """
    total = right.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = F.broadcast(right.where(F.col(count) * parts >= total).drop(count))
    cold = right.where(F.col(count) * parts < total).drop(count)
    return left.join(hot, key).unionByName(left.join(hot.select(*([key] if isinstance(key, str) else key)), key, "left_anti").join(cold, key))


class Bloom:
    """A blocked two-probe Bloom filter of a fixed size.

    Its size is chosen from the number of keys and never exceeds `most_bits`
    (32 MiB), so a broadcast of it is bounded.  Past that it only lets more rows
    through; whatever follows it is exact.
    """

    def __init__(self, bits: int):
        self.bits = bits

    @classmethod
    def sized(cls, keys: int, most_bits: int = 1 << 28) -> "Bloom":
        return cls(1 << max(16, min(most_bits.bit_length() - 1, int(keys * 12).bit_length())))

    def slots(self, keys: np.ndarray):
        keys = keys.astype(np.uint64)
        mask = np.uint64(self.bits - 1)
        return keys & mask, (keys >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20) & mask

    def build(self, keys: np.ndarray, into: np.ndarray | None = None) -> np.ndarray:
        field = np.zeros(self.bits >> 3, np.uint8) if into is None else into
        for at in self.slots(keys):
            np.bitwise_or.at(field, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))
        return field

    def test(self, field: np.ndarray, keys: np.ndarray) -> np.ndarray:
        hit = np.ones(len(keys), bool)
        for at in self.slots(keys):
            hit &= field[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1) != 0
        return hit


def bloom_of(df: DataFrame, column: str, keys: int):
    """A broadcast Bloom filter of a long column, folded on the executors in a few tasks.

    What reaches the driver is at most four times the filter's bounded size.
    """
    import pyarrow as pa

    bloom = Bloom.sized(keys)

    def fold(batches):
        field = None
        for batch in batches:
            found = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
            field = bloom.build(found, field)
        if field is not None:
            yield pa.RecordBatch.from_arrays([pa.array([compress(field.tobytes())], pa.binary())], ["field"])

    total = np.zeros(bloom.bits >> 3, np.uint8)
    for row in df.select(column).where(f"{column} is not null").coalesce(4).mapInArrow(fold, "field binary").toLocalIterator():
        total |= np.frombuffer(decompress(bytes(row[0])), np.uint8)
    return bloom, df.sparkSession.sparkContext.broadcast(total)
