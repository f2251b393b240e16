"""Running values over an order, without a window over a whole group or table.

Rows are dealt to ranges of (keys, order), so a hot key spreads over many of them.  Each range
keeps its own running values in a window of its rows; one summary row for each key and range
carries what the ranges before it add.  Orders must be total: rows that tie in all columns of
(keys, order) fall into one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import written_round


def in_ranges(rows: DataFrame, keys: list[str], order: list[Column | str], parts: int | None = None) -> DataFrame:
    """Rows with `_key`, their keys (nulls are keys too), and `_part`, the number of their range; written down, as ranges are drawn from samples."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("_key", F.struct(*keys) if keys else F.struct(F.lit(0).alias("all")))
    return written_round(keyed.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))


def row_numbers(rows: DataFrame, keys: list[str], order: list[Column | str], name: str = "index", parts: int | None = None) -> DataFrame:
    """Rows with their number, from 1, in the order of their key; without keys of the whole table.  An empty table gives none."""
    ranged = in_ranges(rows, keys, order, parts)
    sizes = ranged.groupBy("_key", "_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    here = F.row_number().over(Window.partitionBy("_key", "_part").orderBy(*order))
    return ranged.withColumn("_here", here).join(before, ["_key", "_part"]).withColumn(name, (F.col("_here") + F.col("_before")).cast("int")).drop("_key", "_part", "_here", "_before")


def falls(rows: DataFrame, keys: list[str], value: str, ties: str, step: float, name: str = "cluster", parts: int | None = None) -> DataFrame:
    """Rows with the number, from 1, of their run: in the order of falling `value`, then `ties`, a run ends where the value falls by `step` or more."""
    order = [F.desc(value), F.col(ties)]
    ranged = in_ranges(rows, keys, order, parts)
    own = Window.partitionBy("_key", "_part").orderBy(*order)
    marked = ranged.withColumn("_fall", F.coalesce((F.lag(value).over(own) - F.col(value) >= step).cast("long"), F.lit(0).cast("long")))
    marked = marked.withColumn("_sum", F.sum("_fall").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    ends = marked.groupBy("_key", "_part").agg(F.sum("_fall").alias("_falls"), F.max(value).alias("_first"), F.min(value).alias("_last"))
    ranges = Window.partitionBy("_key").orderBy("_part")
    border = F.coalesce((F.lag("_last").over(ranges) - F.col("_first") >= step).cast("long"), F.lit(0).cast("long"))
    before = (ends.withColumn("_border", border).withColumn("_before", F.sum(F.col("_falls") + F.col("_border")).over(ranges.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_falls")).select("_key", "_part", "_before"))
    return marked.join(before, ["_key", "_part"]).withColumn(name, F.col("_sum") + F.col("_before") + 1).drop("_key", "_part", "_fall", "_sum", "_before")
