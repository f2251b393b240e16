"""Source-code relations derived from the driver's tables; the same SQL text runs in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators.joins import partitions

_ON = {
    "v_files": ("documents",), "v_project": ("customer",), "v_project_vendors": ("lineitem", "orders", "part"), "v_vendor_vulns": ("part",),
    "v_scan_task": ("orders",), "v_scan_result": ("events",), "v_result_flow": ("conversations",),
}

VIEWS = {
    "v_files": """SELECT doc_id AS file_id,
       concat('/', source, '/', lang, '/f', CAST(doc_id AS STRING),
              CASE doc_id % 6 WHEN 0 THEN '.php' WHEN 1 THEN '.js' WHEN 2 THEN '.sol' WHEN 3 THEN '.html' WHEN 4 THEN '.py' ELSE '' END) AS path,
       CASE doc_id % 6 WHEN 0 THEN '.php' WHEN 1 THEN '.js' WHEN 2 THEN '.sol' WHEN 3 THEN '.html' WHEN 4 THEN '.py' ELSE 'no_extension' END AS ext,
       source AS project, text AS content, n_chars AS size FROM documents""",
    "v_project": "SELECT c_custkey AS id, c_name AS project_name, md5(c_name) AS project_hash FROM customer",
    "v_project_vendors": """SELECT o.o_custkey AS project_id, concat(p.p_name, ' ', CAST(p.p_partkey % 16 AS STRING)) AS name,
       concat(CAST(p.p_size AS STRING), '.', CAST(l.l_linenumber AS STRING), '.', CAST(CAST(floor(l.l_quantity) AS BIGINT) AS STRING)) AS version,
       CASE l.l_returnflag WHEN 'A' THEN 'python' WHEN 'N' THEN 'nodejs' ELSE 'java' END AS language,
       concat('/o', CAST(o.o_orderkey AS STRING), '/manifest') AS source
       FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey""",
    "v_vendor_vulns": """SELECT p_partkey AS id, concat('ADV-', CAST(p_partkey AS STRING)) AS vuln_id, concat(p_name, ' ', CAST(p_partkey % 16 AS STRING)) AS vendor_name,
       p_size % 11 AS severity, concat(CAST(p_size AS STRING), '.3') AS fixed_before FROM part""",
    "v_scan_task": """SELECT o_orderkey AS id, o_custkey AS project_id, o_orderpriority AS task_name, o_orderdate AS last_scan_time,
       CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 0 ELSE -1 END AS is_finished FROM orders""",
    "v_scan_result": """SELECT event_id AS id, user_id AS scan_project_id,
       CASE event_type WHEN 'error' THEN '1009' WHEN 'click' THEN '3005' WHEN 'purchase' THEN '1005' WHEN 'signup' THEN '5001' ELSE '9999' END AS cvi_id,
       concat('/app/m', CAST(user_id % 13 AS STRING), '.php:', CAST(event_id % 97 AS STRING)) AS vulfile_path,
       props AS source_code, event_type AS result_type, event_type = 'view' AS is_unconfirm, event_id % 10 <> 0 AS is_active FROM events""",
    "v_result_flow": """SELECT conv_id AS vul_id, turn AS seq, role AS node_type, text AS node_content, CAST(turn AS STRING) AS node_lineno FROM conversations""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a table is joined on first.
_KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey", "part": "p_partkey"}


def parts(spark: SparkSession, sf_dir: str, name: str) -> int | None:
    """Tasks that a view's joins and groups are dealt to, by its largest table; None where the session's number is enough."""
    most = max(partitions(table(spark, sf_dir, t)) for t in _ON[name])
    return most if most > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view over the tables in sf_dir; joined tables are dealt to tasks whose number grows with them."""
    n = parts(spark, sf_dir, name) if len(_ON[name]) > 1 else None
    for t in _ON[name]:
        rows = table(spark, sf_dir, t)
        (rows.repartition(n, _KEYS[t]) if n else rows).createOrReplaceTempView(t)
    return spark.sql(VIEWS[name])


def packages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Distinct rows of these columns of v_project_vendors, dealt by all of them to as many tasks as its joins."""
    rows, n = view(spark, sf_dir, "v_project_vendors").select(*columns), parts(spark, sf_dir, "v_project_vendors")
    return (rows.repartition(n, *columns) if n else rows).distinct()


def using(*names: str) -> str:
    """The WITH clause that defines these views for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + " "
