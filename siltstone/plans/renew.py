"""The code database brought up to date: only files that changed are read, only projects that they are in are searched again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import written_round
from . import codedb
from .parse import records


def sums(files: DataFrame) -> DataFrame:
    """(path, digest): what the next renewal compares with; a null content has the digest of an empty one."""
    return files.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"))


def changes(files: DataFrame, before: DataFrame) -> DataFrame:
    """(path, change) of files against the digests of an earlier state: added, changed or removed; the same files are left out."""
    old, new = before.select("path", F.col("digest").alias("was")), sums(files)
    change = F.when(F.col("was").isNull(), "added").when(F.col("digest").isNull(), "removed").otherwise("changed")
    return new.join(old, "path", "full").where(~F.col("was").eqNullSafe(F.col("digest"))).select("path", change.alias("change"))


def renewed_records(rows: DataFrame, files: DataFrame, changed: DataFrame, language: str = "php") -> DataFrame:
    """The records of `files`: those of unchanged ones as they were, those of added and changed ones read anew.

    Records depend on their own file alone, so nothing else needs to be read; both joins are on the path.
    """
    again = files.join(changed.where("change <> 'removed'").select("path"), "path", "left_semi")
    return rows.join(changed.select("path"), "path", "left_anti").unionByName(records(again, language))


def renewed_chains(chains: DataFrame, rows: DataFrame, changed: DataFrame, projects: str) -> DataFrame:
    """The chains of renewed records: mined again in projects with a changed file, kept in all others.

    Chains stay in a project (what the regular expression finds in a path), so those of other projects cannot have changed,
    and theirs are the only records that the search reads.
    """
    touched = written_round(changed.select(F.regexp_extract("path", projects, 0).alias("project")).distinct())
    own = rows.withColumn("project", F.regexp_extract("path", projects, 0)).join(touched, "project", "left_semi").drop("project")
    return chains.join(touched, "project", "left_anti").unionByName(codedb.chains(written_round(own), projects=projects).select(*chains.columns))
