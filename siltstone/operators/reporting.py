"""Reports over findings, tasks, projects, dependencies and advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import md5_hex


def finding_hash(results: DataFrame) -> DataFrame:
    """vul_hash over project, rule, language, path and code; rules 5xxx leave the line out."""
    path = F.when(F.startswith("cvi_id", F.lit("5")), F.regexp_replace("vulfile_path", r":\d+$", "")).otherwise(F.col("vulfile_path"))
    return results.withColumn("vulfile_path", path).withColumn("vul_hash", md5_hex(F.col("scan_project_id").cast("string"), "cvi_id", F.col("language"), "vulfile_path", "source_code"))


def finding_upsert(stored: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored rows updated and new ones added, the rows that are new): one row for each hash."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy("vul_hash").orderBy("id"))).where("_n = 1").drop("_n")
    added = first.join(stored.select("vul_hash").distinct(), "vul_hash", "left_anti")
    update = first.select("vul_hash", F.col("result_type").alias("_type"), F.col("is_unconfirm").alias("_unconfirm"))
    kept = (stored.join(update, "vul_hash", "left").withColumn("result_type", F.coalesce("_type", "result_type"))
            .withColumn("is_unconfirm", F.coalesce("_unconfirm", "is_unconfirm")).drop("_type", "_unconfirm"))
    return kept.unionByName(added.select(*kept.columns)), added


def with_rules(results: DataFrame, rules: DataFrame, vulns: DataFrame | None = None) -> DataFrame:
    """Findings with rule name and level; advisories stand in for rule 9999; else 'Unknown Rule'."""
    r = F.broadcast(rules.select(F.col("svid").cast("string").alias("_svid"), "rule_name", "level"))
    out = results.join(r, F.col("cvi_id") == F.col("_svid"), "left").drop("_svid")
    if vulns is not None:
        v = vulns.select(F.col("id").alias("_vid"), F.col("vuln_id").alias("_name"), F.col("severity").alias("_severity"))
        key = F.when(F.col("cvi_id") == "9999", F.element_at(F.split("vulfile_path", ":"), -1).try_cast("bigint"))
        out = out.withColumn("_key", key).join(v, F.col("_key") == F.col("_vid"), "left").withColumn("rule_name", F.coalesce("rule_name", "_name")).withColumn("level", F.coalesce("level", F.col("_severity").cast("int"))).drop("_key", "_vid", "_name", "_severity")
    return out.withColumn("rule_name", F.coalesce("rule_name", F.lit("Unknown Rule")))


def with_flow(results: DataFrame, flow: DataFrame) -> DataFrame:
    """Findings with their chain, ordered; empty where there is none."""
    chain = flow.groupBy("vul_id").agg(F.sort_array(F.collect_list(F.struct("seq", "node_type", "node_content", "node_lineno"))).alias("chain"))
    return results.join(chain, F.col("id") == F.col("vul_id"), "left").drop("vul_id")


def flow_context(flow: DataFrame, files: DataFrame, before: int = 3, after: int = 6) -> DataFrame:
    """Chain steps (path, line, ...) with the numbered source lines around them: a slice of each file's lines."""
    first = F.greatest(F.col("line") - before, F.lit(1))
    lines = files.select("path", F.split("content", "\n").alias("_lines"))
    steps = flow.select("path", "line").distinct().join(lines, "path")
    numbered = F.transform(F.slice("_lines", first, F.col("line") + after - first + 1), lambda text, i: F.format_string("%4d: %s", i + first, text))
    return steps.where(F.size("_lines") >= first).select("path", "line", F.array_join(numbered, "\n").alias("context"))


def vendor_statistics(vendors: DataFrame, most: int = 100) -> DataFrame:
    """The most used packages: id, name, language, total."""
    top = vendors.groupBy("name", "language").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "name", "language").limit(most)
    return top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("total"), "name", "language")))


def advisory_statistics(vulns: DataFrame, vendors: DataFrame) -> DataFrame:
    """For each package: advisories, those high, medium and low, and the projects' uses."""
    v = vulns.groupBy("vendor_name").agg(F.count("*").alias("total"), F.count_if(F.col("severity") > 6).alias("high"), F.count_if((F.col("severity") > 2) & (F.col("severity") <= 6)).alias("medium"), F.count_if(F.col("severity") <= 2).alias("low"))
    uses = vendors.groupBy("name").agg(F.count("*").alias("vendor_count"))
    return v.join(uses, F.col("vendor_name") == F.col("name"), "left").drop("name").withColumn("vendor_count", F.coalesce("vendor_count", F.lit(0)))


def project_overview(projects: DataFrame, tasks: DataFrame, vendors: DataFrame, results: DataFrame) -> DataFrame:
    """For each project: tasks, dependencies, active findings, last scan; each side is aggregated before its join."""
    t = tasks.groupBy("project_id").agg(F.count("*").alias("tasks"), F.max("last_scan_time").alias("last_scan"))
    d = vendors.groupBy("project_id").agg(F.count("*").alias("vendors"))
    r = results.where("is_active").groupBy(F.col("scan_project_id").alias("project_id")).agg(F.count("*").alias("findings"))
    out = projects.withColumnRenamed("id", "project_id").join(t, "project_id", "left").join(d, "project_id", "left").join(r, "project_id", "left")
    return out.select("project_id", "project_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tasks", "vendors", "findings")], "last_scan")


def task_histogram(tasks: DataFrame, most: int = 200) -> DataFrame:
    """Over the latest tasks: finished, running, failed, other, and the latest one."""
    top = tasks.orderBy(F.desc("id")).limit(most)
    status = F.col("is_finished")
    return top.agg(F.count_if(status == 1).alias("success"), F.count_if(status == 2).alias("running"), F.count_if(status == -1).alias("error"), F.count_if(~status.isin(1, 2, -1)).alias("other"), F.max_by("task_name", "id").alias("latest"))


def page(rows: DataFrame, order: list[Column | str], number: int, size: int = 50, total: int | None = None) -> DataFrame:
    """One page; a page beyond the rows is the first one."""
    if total is not None and (number - 1) * size >= total:
        number = 1
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def indexed(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """Rows with a display index from 1, numbered by ranges of the order."""
    from .ordered import row_numbers

    return row_numbers(rows, [], order)


def rule_counts(rules: DataFrame, results: DataFrame) -> DataFrame:
    """Rules that ran and rules that found something."""
    return rules.agg(F.count("*").alias("push_rules")).crossJoin(results.agg(F.count_distinct("cvi_id").alias("trigger_rules")))


def rule_changes(stored: DataFrame, loaded: DataFrame, columns: list[str]) -> DataFrame:
    """Full outer comparison on svid: (svid, change, fields) where anything differs; letters' case does not count."""
    s, l = (d.select("svid", F.lit(True).alias(f"{n}_"), *[F.col(c).cast("string").alias(f"{n}_{c}") for c in columns]) for n, d in (("s", stored), ("l", loaded)))
    fields = F.filter(F.array(*[F.when(~F.lower(f"s_{c}").eqNullSafe(F.lower(f"l_{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    out = s.join(l, "svid", "full_outer").withColumn("change", F.when(F.col("s_").isNull(), "added").when(F.col("l_").isNull(), "removed").when(F.size(fields) > 0, "changed"))
    return out.where("change is not null").select("svid", "change", F.when(F.col("change") == "changed", fields).otherwise(F.array().cast("array<string>")).alias("fields"))


def tamper_edit(tampers: DataFrame, tam_name: str, key: str, svid: int | None = None, cancel: bool = False) -> DataFrame:
    """Add or take back one sanitiser (with a rule) or input (without)."""
    kind = "Input-Control" if svid is None else "Filter-Function"
    same = (F.col("tam_name") == tam_name) & (F.col("tam_type") == kind) & (F.col("tam_key") == key) & F.col("svid").eqNullSafe(F.lit(svid).cast("int"))
    rest = tampers.where(~same)
    if cancel:
        return rest
    return rest.unionByName(tampers.sparkSession.createDataFrame([(tam_name, kind, key, svid)], tampers.schema))


def tamper_map(tampers: DataFrame) -> DataFrame:
    """(tam_name, filters as a map of function to rules, inputs)."""
    filters = tampers.where("tam_type = 'Filter-Function'").groupBy("tam_name", "tam_key").agg(F.sort_array(F.collect_set("svid")).alias("svids"))
    maps = filters.groupBy("tam_name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tam_key", "svids")))).alias("filters"))
    inputs = tampers.where("tam_type = 'Input-Control'").groupBy("tam_name").agg(F.sort_array(F.collect_list("tam_key")).alias("inputs"))
    return maps.join(inputs, "tam_name", "full_outer")
