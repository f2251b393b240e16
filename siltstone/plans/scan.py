"""The scan: files to findings, by all match modes, taint, derived rules and dependencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..functions.extractors import strip_comments
from ..functions.scalars import md5_hex
from ..operators import corpus, matching, onepass, predicates, sca
from ..sources import manifests
from . import taint

COLUMNS = ("svid", "path", "line", "code", "reason", "verdict", "chain")
_CHAIN = "array<struct<node:string,code:string,path:string,line:int>>"


def _shaped(found: DataFrame, svid: int, reason: str) -> DataFrame:
    return found.select(F.lit(svid).alias("svid"), "path", F.col("line").cast("int").alias("line"), F.col("text").alias("code"), F.lit(reason).alias("reason"), F.lit(1).alias("verdict"), F.array().cast(_CHAIN).alias("chain"))


def _of_language(files: DataFrame, language: str) -> DataFrame:
    extensions = catalog.EXTENSIONS[language]
    return files if "*" in extensions else files.where(F.col("ext").isin(*extensions))


def without_comments(files: DataFrame) -> DataFrame:
    """(path, ext, content), PHP and JavaScript less their comments."""
    commented = F.col("ext").isin(*catalog.EXTENSIONS["php"], *catalog.EXTENSIONS["javascript"])
    return files.select("path", "ext", F.when(commented, strip_comments(F.col("content"))).otherwise(F.col("content")).alias("content"))


def only_regex_findings(files: DataFrame, rules: list[dict]) -> DataFrame:
    """All only-regex rules in one pass over the files without comments."""
    found = onepass.match_rules(without_comments(files), rules)
    return found.select("svid", "path", F.col("line").cast("int").alias("line"), F.col("text").alias("code"), F.lit("Regex-only-match").alias("reason"), F.lit(1).alias("verdict"), F.array().cast(_CHAIN).alias("chain"))


def regex_findings(files: DataFrame, rule: dict) -> DataFrame:
    """One rule of the other modes that need no taint."""
    mine = _of_language(files, rule["language"])
    if rule["match_mode"] == catalog.NAMES:
        return _shaped(matching.names_not_guarded(mine, rule["match_name"], rule["match"], rule["unmatch"], rule["black_list"]), rule["svid"], "Regex-return-regex")
    if rule["match_mode"] == catalog.MANIFEST:
        packed = files.where(F.endswith("path", F.lit("manifest.json"))).select("path", F.col("content").alias("json"))
        return _shaped(matching.manifest_matches(packed, rule["keyword"], rule["match"], rule["unmatch"]), rule["svid"], "Specail-crx-keyword-match")
    hits = matching.path_matches(mine, rule["match"])
    return _shaped(hits.select("path", F.lit(0).alias("line"), F.col("keyword").alias("text")), rule["svid"], "file-path-regex-match")


def taint_findings(files: DataFrame, language: str, only, tampers: DataFrame, unconfirmed: bool) -> DataFrame:
    mine = _of_language(files, language)
    if language == "javascript":
        pages = corpus.script_parts(_of_language(files, "html").select("path", "content"), "path", "content").where("body <> ''")
        mine = mine.select("path", "content").unionByName(pages.select(F.concat("id", F.lit("#"), F.col("pos").cast("string")).alias("path"), F.col("body").alias("content")))
    rows = taint.written_round(taint.records(mine, language))
    found = taint.findings(rows, language, tampers, table=taint.sink_table(files.sparkSession, language, only), unconfirmed=unconfirmed)
    return found.select("svid", "path", "line", F.col("sink").alias("code"), "reason", "verdict", "chain")


def dependency_findings(files: DataFrame, advisories: DataFrame) -> DataFrame:
    """advisories(name, version, vuln_id): exact versions of packages in the files' manifests."""
    used = manifests.dependencies(files).where("version is not null").select("path", "name", F.regexp_replace("version", "^[v^~=]+", "").alias("version"))
    found = used.join(advisories, ["name", "version"])
    return _shaped(found.select("path", F.lit(0).alias("line"), F.concat_ws(":", "name", "version", "vuln_id").alias("text")), catalog.VENDOR_SVID, "vendor_source_match")


def scan(files: DataFrame, languages=None, only=None, tampers: DataFrame | None = None, advisories: DataFrame | None = None, unconfirmed: bool = False, ignore: list[str] = ()) -> DataFrame:
    """files(path, ext, size, content) to findings (svid, rule_name, language, level, path, line, code, reason, verdict, chain, vul_hash).

    Rules that are off run only if `only` names them.  Special files and matches that
    begin as comments are rejected.  Every finding comes once; rules whose hash leaves the line out give its first line.
    """
    spark = files.sparkSession
    tampers = catalog.tampers(spark) if tampers is None else tampers
    files = predicates.not_ignored(files, list(ignore))
    rules = [r for r in catalog.rule_rows() if (languages is None or r["language"] in (*languages, "base")) and (r["svid"] in only if only is not None else r["status"])]
    parts = [regex_findings(files, r) for r in rules if r["match_mode"] in (catalog.NAMES, catalog.MANIFEST, catalog.PATH)]
    texts = [r for r in rules if r["match_mode"] == catalog.REGEX]
    if texts:
        parts.append(only_regex_findings(files, texts))
    for language in ("php", "javascript"):
        chosen = [r["svid"] for r in rules if r["language"] == language and r["match_mode"] in (catalog.FUNCTION, catalog.CUSTOM)]
        if chosen:
            parts.append(taint_findings(files, language, chosen, tampers, unconfirmed))
    if advisories is not None:
        parts.append(dependency_findings(files, advisories))
    if not parts:
        raise ValueError("no rule is left to run")
    found = reduce(DataFrame.unionByName, parts)
    found = found.where(~predicates.special_file(F.col("path")) & ~F.coalesce(predicates.annotation(F.col("code")), F.lit(False))).withColumn("code", predicates.stored_code(F.col("code")))
    named = found.join(F.broadcast(catalog.rules(spark).select("svid", "rule_name", "language", "level")), "svid", "left")
    hashed = named.withColumn("vul_hash", md5_hex(F.col("svid").cast("string"), "path", F.when(F.col("svid") < 5000, F.col("line").cast("string")).otherwise(""), F.col("code")))
    rest = [c for c in hashed.columns if c != "vul_hash"]
    return hashed.groupBy("vul_hash").agg(F.min_by(F.struct(*rest), F.struct("line", "reason")).alias("one")).select(*["one." + c for c in rest], "vul_hash")


def report(findings: DataFrame) -> DataFrame:
    """What is shown: an index, short code, and the level's label."""
    from ..functions.scalars import level_label
    from ..operators.reporting import indexed

    shown = findings.select("svid", F.coalesce("rule_name", F.lit("Unknown Rule")).alias("rule_name"), level_label(F.col("level")).alias("level"), F.concat_ws(":", "path", F.col("line").cast("string")).alias("target"), predicates.reported_code(F.col("code")).alias("code"), "reason")
    return indexed(shown, [F.desc("level"), "svid", "target"])


def version_search(vendors: DataFrame, name: str, version: str | None, advisories: DataFrame | None = None) -> DataFrame:
    """Projects that use a package up to a version (any without one), with its advisories on request."""
    found = sca.projects_up_to(vendors, name, version) if version else vendors.where(predicates.wildcard(F.col("name"), name))
    return found if advisories is None else found.join(advisories.withColumnRenamed("vendor_name", "name"), "name", "left")
