"""What must not grow with a table's rows: what goes through the driver, and what rounds shuffle again."""

from pyspark.sql import functions as F

from siltstone.operators import joins, sca


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_tables_that_pack_well_are_not_broadcast(spark):
    rows = spark.range(600_000).select("id", F.lit("the same long text in every row").alias("text"))
    written = joins.written_round(rows)
    size = int(str(written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert joins.SMALL_TABLE < size < 10 << 20  # of files; of rows it is some 40 MB
    found = written.where("id % 2 = 0").select("id", "text").distinct().join(rows.withColumnRenamed("text", "other"), "id")
    assert "Broadcast" not in _plan(found) and found.count() == 300_000
    few = joins.written_round(spark.range(10))
    assert "Broadcast" in _plan(rows.join(few, "id"))


def test_tables_of_every_round_are_dealt_once(spark):
    rows = spark.range(2_000).select(F.col("id").alias("path"), (F.col("id") % 7).alias("scope"), "id")
    dealt = joins.bucketed(rows, 8, "path", "scope")
    states = spark.range(500).select(F.col("id").alias("s_path"), (F.col("id") % 7).alias("s_scope"))
    for how in ("inner", "left"):
        found = states.join(dealt, (F.col("s_path") == F.col("path")) & (F.col("s_scope") == F.col("scope")), how)
        assert _plan(found).count("Exchange hashpartitioning") == 1 and "Broadcast" not in _plan(found)  # the states alone
        assert found.count() == 500


def _vendors_and_fixes(spark, names, versions, fixes):
    """`versions` versions of each name, each twice, and `fixes` fixes of it at 12 versions; some without a name, version or fix."""
    n, v = F.col("id") % names, F.floor(F.col("id") / names)
    vendors = spark.range(names * versions * 2).select(F.concat(F.when(F.col("id") % 2 == 0, "Pack ").otherwise("pack "), n), F.when(v % 90 == 7, "none").otherwise(F.concat(v % 30, F.lit("."), v % versions)))
    advisories = spark.range(names * fixes).select("id", F.concat(F.lit("ADV-"), "id").alias("vuln_id"), F.when(v % 40 != 39, F.concat(F.lit("PACK "), n)).alias("vendor_name"), F.concat(v % 12 * 2 + 4, F.lit(".3")).alias("fixed_before"))
    return vendors.toDF("name", "version").unionByName(spark.createDataFrame([("pack 0", None), (None, "1.1")], "name string, version string")), advisories


def test_pairs_below_a_fix_are_whole_across_blocks(spark):
    from siltstone.functions.scalars import version_key

    vendors, fixes = _vendors_and_fixes(spark, 3, 2 * sca.VERSIONS + 44, 48)
    found = sca.below_fix(vendors, fixes, 3)
    pairs = vendors.distinct().join(fixes, F.lower("name") == F.lower("vendor_name")).where(version_key(F.col("version")) <= version_key(F.col("fixed_before"))).select(*found.columns)
    assert found.columns == ["name", "version", "id", "vuln_id", "fixed_before"]
    assert found.count() == pairs.count() > 5_000 and found.exceptAll(pairs).isEmpty() and pairs.exceptAll(found).isEmpty()


def test_pairs_below_a_fix_pack_well_where_they_are_written(spark, tmp_path):
    vendors, fixes = _vendors_and_fixes(spark, 12, 600, 400)
    found = sca.below_fix(vendors, fixes)
    assert _plan(found).count("Exchange hashpartitioning") == 2  # each side once, by name
    found.write.parquet(f"{tmp_path}/pairs")
    rows = spark.read.parquet(f"{tmp_path}/pairs").count()
    assert rows > 1_000_000 and sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.3 * rows


def test_trees_from_one_row_group_are_read_by_many_tasks(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from siltstone import generated

    pq.write_table(pa.table({"doc_id": list(range(400)), "text": [f"text {k}" if k % 9 else None for k in range(400)]}), tmp_path / "documents.parquet")
    files = generated.tree(spark, str(tmp_path), {"one": ({"a.php": "f§();", "b.txt": "§"}, [])})
    assert len(set(files.select(F.spark_partition_id()).collect())) == 4
    assert files.count() == 800 and files.where("path = '/gen/9/a.php'").first().content == "<?php /**/\nf9();"
