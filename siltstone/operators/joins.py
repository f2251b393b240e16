"""Relational operators that the engine needs beyond plain joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(uses: DataFrame, defs: DataFrame, keys: list[str], at: str = "line", value: str = "def") -> DataFrame:
    """For each use the latest definition strictly before it, by one sort of both sides.

    A running last() over the union replaces an inequality join, so a key with many
    definitions costs its rows, not their product.
    """
    left = uses.select(*keys, at, F.lit(1).alias("_use"), F.lit(None).cast(defs.schema[value].dataType).alias("_def"), F.struct(*[c for c in uses.columns]).alias("_row"))
    right = defs.select(*keys, at, F.lit(2).alias("_use"), F.col(value).alias("_def"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    order = Window.partitionBy(*keys).orderBy(at, "_use").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn(value, F.last("_def", ignorenulls=True).over(order))
    return both.where("_use = 1").select("_row.*", value)


def hierarchy(edges: DataFrame, start: DataFrame, depth: int = 40) -> DataFrame:
    """(root, node, depth) for all nodes reachable from start(root) over edges(a, b), each at its least depth.

    A frontier loop: every round is one join on a distinct frontier and an anti join with
    what is known, written down so that the lineage stays short; cycles end by themselves.
    """
    known = start.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct()
    frontier = known
    for level in range(1, depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["a"]).select("root", F.col("b").alias("node")).distinct()
        frontier = written_round(step.join(known, ["root", "node"], "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def by_prefix(rows: DataFrame, column: str, prefixes: DataFrame, prefix: str, separator: str = "/") -> DataFrame:
    """Rows with each of `prefixes` that their path begins with: a path's own beginnings, up to each separator, join as equals."""
    parts = F.split(column, separator)
    own = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), separator), F.lit(separator)))
    return rows.where(F.size(parts) > 1).withColumn(prefix, F.explode(F.array_distinct(own))).join(prefixes, prefix)


def shared_folder(spark) -> str:
    """The folder that driver and executors share; one of our own only where master is local and none is named."""
    import tempfile

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _remove(spark, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        return


#: Bytes of files up to which a written table may be broadcast: its rows are some thirty times as large in memory, and go through the driver.
SMALL_TABLE = 256 << 10


def written_round(df: DataFrame) -> DataFrame:
    """Cut the lineage of one round of a loop: a table in the shared folder, removed by `release` or at exit.

    Spark takes the size of a table's files for that of its rows; so tables beyond SMALL_TABLE are joined by a shuffle, not through the driver.
    """
    import atexit
    import uuid

    spark = df.sparkSession
    path = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    if int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL_TABLE:
        table = table.hint("merge")
    table._round_path = path
    return table


def buckets(rows: DataFrame) -> int:
    """Buckets for what is derived from `rows`, some 1 MB of its files each; the session's partitions where Catalyst knows no size."""
    found = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if found > 1 << 50 else max(least, min(1 << 12, found >> 20))


def bucketed(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """A table in the shared folder, dealt by `keys` once: a join on just these keys shuffles its other side alone, however often it comes.  Removed at exit."""
    import atexit
    import uuid

    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", path).format("parquet").saveAsTable(name)
    atexit.register(_remove, spark, path)
    # always with the hint: a broadcast would pass the rows through the driver
    return spark.table(name).hint("merge")


def release(*tables: DataFrame) -> None:
    """Remove tables of `written_round` whose last reader is done, so that disk does not grow with rounds."""
    for table in tables:
        _remove(table.sparkSession, table._round_path)


def partitions(df: DataFrame, per_part: int = 8 << 20, most: int = 1 << 14) -> int:
    """Partitions that keep one task's share of `df` near `per_part` bytes by Catalyst's estimate, and no fewer than the session's."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(most, found // per_part))


def dealt(texts: DataFrame, *keys: str) -> DataFrame:
    """Texts dealt to tasks by `keys`, some 4 MB of their files each: a file of few row groups is read by as few tasks, and what is done with a text takes far longer than to shuffle it."""
    return texts.repartition(partitions(texts, 4 << 20), *keys)


#: Texts of an Arrow batch, so that a Python worker holds few at once; the training-data operators use the same number.
BATCH_ROWS = 2000


def small_batches(files: DataFrame) -> DataFrame:
    """`files`, with the session's Arrow batches made no larger than BATCH_ROWS."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(files.sparkSession.conf.get(name, "0")) <= BATCH_ROWS:
        files.sparkSession.conf.set(name, str(BATCH_ROWS))
    return files


def purge_duplicates(rows: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """The first row of each key stays."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
