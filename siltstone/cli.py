"""Command line: scan a tree, show rules and tampers, search dependencies."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import catalog
from .operators import sinks
from .plans import scan as plan
from .sources import files as sources


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltstone", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan", help="scan a directory tree")
    s.add_argument("target")
    s.add_argument("-l", "--language", action="append")
    s.add_argument("-r", "--rule", action="append", type=int)
    s.add_argument("-f", "--format", choices=sinks.FORMATS)
    s.add_argument("-o", "--output")
    s.add_argument("-u", "--unconfirm", action="store_true")
    s.add_argument("-i", "--ignore", action="append", default=[])
    show = sub.add_parser("show", help="show rules or tampers")
    show.add_argument("what", choices=("rule", "tamper"))
    show.add_argument("-k", "--key", default="all")
    find = sub.add_parser("search", help="projects that use a package up to a version")
    find.add_argument("vendors", help="a Parquet table of project_id, name, version")
    find.add_argument("name")
    find.add_argument("version", nargs="?")
    return p


def run(spark: SparkSession, argv: list[str] | None = None):
    """Run a command and return its rows as a DataFrame."""
    args = parser().parse_args(argv)
    if args.command == "scan":
        found = plan.scan(sources.read_tree(spark, args.target), args.language, args.rule, unconfirmed=args.unconfirm, ignore=args.ignore)
        if args.format and args.output:
            sinks.write(found.drop("chain").withColumn("target", F.lit(args.target)), args.output, args.format)
        return plan.report(found)
    if args.command == "show":
        rows = catalog.rules(spark) if args.what == "rule" else catalog.tampers(spark)
        if args.key == "all":
            return rows
        return rows.where((F.col("svid").cast("string") == args.key) | (F.col("language") == args.key)) if args.what == "rule" else rows.where(F.col("tam_name") == args.key)
    vendors = spark.read.parquet(args.vendors)
    return plan.version_search(vendors, args.name, args.version)


def main() -> None:
    spark = SparkSession.builder.appName("siltstone").getOrCreate()
    run(spark).show(200, truncate=80)


if __name__ == "__main__":
    main()
