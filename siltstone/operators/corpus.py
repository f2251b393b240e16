"""Corpus profiling: extensions, languages, frameworks, line counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog
from . import ordered
from .joins import written_round


def extension(path: Column) -> Column:
    found = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(found == "", "no_extension").otherwise(found)


def buckets(files: DataFrame, with_paths: bool = False) -> DataFrame:
    """(ext, count) and, on request, the sorted paths."""
    aggs = [F.count("*").alias("count")] + ([F.sort_array(F.collect_list("path")).alias("list")] if with_paths else [])
    return files.groupBy("ext").agg(*aggs)


def by_language(files: DataFrame, extensions: DataFrame) -> DataFrame:
    """Files of each scanned language; `*` takes every file."""
    wanted = files.withColumn("want", F.explode(F.array_distinct(F.array("ext", F.lit("*")))))
    return wanted.join(F.broadcast(extensions.withColumnRenamed("ext", "want")), "want").drop("want")


def language_counts(files: DataFrame, languages: DataFrame) -> DataFrame:
    """Files by language, many to many, counted by extension first."""
    return buckets(files).join(F.broadcast(languages), "ext").groupBy("language", "chiefly").agg(F.sum("count").alias("files"))


def main_languages(files: DataFrame, languages: DataFrame) -> DataFrame:
    """One row: chiefly languages in extension order, with javascript after chromeext; else the first other language."""
    known = files.select("ext").distinct().join(F.broadcast(languages), "ext")
    rows = known.select("ext", "chiefly", F.lower("language").alias("language"), "ord")
    firsts = rows.groupBy("language", "chiefly").agg(F.min(F.struct("ext", "ord")).alias("at"))
    many = firsts.agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("chiefly"), F.struct("at", "language")))), lambda x: x["language"]).alias("chief"),
                      F.transform(F.array_sort(F.collect_list(F.when(~F.col("chiefly"), F.struct("at", "language")))), lambda x: x["language"]).alias("other"))
    chief = F.when(F.array_contains("chief", "chromeext"), F.array_distinct(F.concat("chief", F.array(F.lit("javascript"))))).otherwise(F.col("chief"))
    return many.select(F.when(F.size("chief") > 0, chief).otherwise(F.slice("other", 1, 1)).alias("languages"))


def framework(files: DataFrame, dependencies: DataFrame, markers: DataFrame) -> DataFrame:
    """(framework, language) of every project: dependency markers first, then paths, then the markers' order.

    files(project, path), dependencies(project, name), markers(ord, framework, language, kind, marker).
    """
    def met(rows, wanted, hit, rank):
        some = markers.where(wanted).agg(F.collect_list(F.struct("ord", "framework", "language", "marker"))).scalar()  # a catalog table
        return rows.withColumn("_some", some).select("project", F.explode(F.filter("_some", hit)).alias("m")).select("project", F.lit(rank).alias("rank"), "m.ord", "m.framework", "m.language")

    by_name = met(dependencies, "kind = 'dependency'", lambda m: F.contains(F.lower("name"), F.lower(m["marker"])), 0)
    by_path = met(files, "kind <> 'dependency'", lambda m: F.contains("path", m["marker"]), 1)
    best = by_name.unionByName(by_path).groupBy("project").agg(F.min(F.struct("rank", "ord", "framework", "language")).alias("best"))
    return best.select("project", "best.framework", "best.language")


# How a line comment begins and what encloses a block comment, by extension; None: no comments are told apart.
COMMENTS = {
    ".py": ("#", ("'''", '"""')), ".php": ("//|#", ("/*",)), ".java": ("//", ("/*",)), ".js": ("//", ("/*",)), ".sol": ("//", ("/*",)), ".html": (None, ("<!--",)), ".xml": (None, ("<!--",)), ".md": (None, ()),
}
_CLOSE = {"'''": "'''", '"""': '"""', "/*": "*/", "<!--": "-->"}


def line_classes(files: DataFrame) -> DataFrame:
    """(path, ext, blank, comment, code): one fold over each file's lines, in the JVM, with the extension's markers as columns.

    A block comment begins where a line starts with one of its markers, and ends with a line that holds its end.
    """
    rows = [(ext, single or "", [(o, _CLOSE[o]) for o in openers]) for ext, (single, openers) in COMMENTS.items()]
    markers = F.broadcast(files.sparkSession.createDataFrame(rows, "ext string, single string, blocks array<struct<open:string,close:string>>"))
    single, blocks = F.col("single"), F.col("blocks")

    def step(state, line):
        text = F.trim(F.regexp_replace(line, r"[\r\t]", " "))
        own = F.get(F.filter(blocks, lambda b: F.startswith(text, b["open"])), F.lit(0))
        inside, blank = state["close"] != "", text == ""
        once = F.contains(F.substr(text, F.length(own["open"]) + 1), own["close"])
        alone = (single != "") & F.rlike(text, F.concat(F.lit("^("), single, F.lit(")")))
        comment = ~blank & (inside | own.isNotNull() | alone)
        close = F.when(inside, F.when(F.contains(text, state["close"]), "").otherwise(state["close"])).otherwise(F.when(own.isNull() | once | alone, "").otherwise(own["close"]))
        add = lambda name, one: (state[name] + one.cast("int")).alias(name)
        return F.struct(close.alias("close"), add("blank", blank), add("comment", comment), add("code", ~blank & ~comment))

    start = F.struct(F.lit("").alias("close"), F.lit(0).alias("blank"), F.lit(0).alias("comment"), F.lit(0).alias("code"))
    counted = files.join(markers, "ext").select("path", "ext", F.aggregate(F.split("content", "\n"), start, step).alias("c"))
    return counted.select("path", "ext", "c.blank", "c.comment", "c.code")


def cloc(files: DataFrame) -> DataFrame:
    """(ext, files, blank, comment, code) and a SUM row."""
    sums = [F.sum(c).alias(c) for c in ("blank", "comment", "code")]
    rolled = line_classes(files).rollup("ext").agg(F.grouping("ext").alias("g"), F.count("*").alias("files"), *sums)
    return rolled.select(F.when(F.col("g") == 1, "SUM").otherwise(F.col("ext")).alias("ext"), "files", "blank", "comment", "code").where((F.col("ext") != "SUM") | (F.col("files") > 0))


def script_parts(pages: DataFrame, id_column: str, html_column: str) -> DataFrame:
    """(id, pos, src, body) of every script element."""
    pattern = r"(?is)<script([^>]*)>(.*?)</script\s*>"
    heads = F.regexp_extract_all(html_column, F.lit(pattern), F.lit(1))
    bodies = F.regexp_extract_all(html_column, F.lit(pattern), F.lit(2))
    rows = pages.where(F.contains(F.lower(html_column), F.lit("<script"))).select(F.col(id_column).alias("id"), F.posexplode(F.arrays_zip(heads.alias("head"), bodies.alias("body"))).alias("pos", "s"))
    return rows.select("id", "pos", F.regexp_extract("s.head", r"(?i)src\s*=\s*[\"']?([^\"'\s>]+)", 1).alias("src"), F.trim("s.body").alias("body"))


def parsable_scripts(files: DataFrame) -> DataFrame:
    """Scripts short enough, and of 10 to 500 line breaks."""
    breaks = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    return files.where((F.length("content") <= 3000) & breaks.between(10, 500))


def character_counts(text: Column) -> Column:
    """(c, n) of each different character."""
    return F.transform(F.filter(F.array_distinct(F.split(text, "")), lambda c: c != ""), lambda c: F.struct(c.alias("c"), (F.length(text) - F.length(F.replace(text, c, F.lit("")))).alias("n")))


def similarity(counts: Column, size: Column, b: Column) -> Column:
    """2 * |shared characters as multisets| / (|a| + |b|), from a's character counts and size and the text b; null for two empty ones."""
    shared = F.aggregate(counts, F.lit(0), lambda n, x: n + F.least(x["n"], F.length(b) - F.length(F.replace(b, x["c"], F.lit("")))))
    return F.try_divide(shared * F.lit(2.0), (size + F.length(b)).cast("double"))


def similar_to_first(files: DataFrame, group: str, key: str, step: float = 0.03) -> DataFrame:
    """files(`group`, `key`, content): each one's similarity to the first of its group by `key`, and its cluster.

    In the order of falling similarity a cluster goes on while the ratio falls by less than `step`; clusters count from 1.
    A first text is counted once and its counts reach the group's rows by a join, whose hot side Spark may split; clusters run
    over ranges, so a hot group is no task of its own.  Keys should be unique in a group: rows that tie share a range.
    """
    firsts = files.groupBy(group).agg(F.min_by("content", key).alias("_first")).select(group, character_counts(F.col("_first")).alias("_counts"), F.length("_first").alias("_size"))
    rated = files.join(firsts, group).select(group, key, F.coalesce(similarity(F.col("_counts"), F.col("_size"), F.col("content")), F.lit(1.0)).alias("ratio"))
    return ordered.falls(written_round(rated), [group], "ratio", key, step)


def entrances(nodes: DataFrame, limit: int | None = 0) -> DataFrame:
    """Entrance finder: files by the weight of their top nodes: definitions and imports -1, control +2, others +1; descending."""
    weight = F.when(F.col("kind").isin("Function", "Class", "Trait", "Interface", "Namespace", "Use", "Include", "Constant"), -1).when(F.col("kind").isin("If", "While", "For", "Foreach", "Switch", "Try", "DoWhile"), 2).otherwise(1)
    return nodes.where("depth = 0").groupBy("path").agg(F.sum(weight).alias("weight")).where(F.lit(True) if limit is None else F.col("weight") > limit).orderBy(F.desc("weight"), "path")


def entrance_report(weights: DataFrame, limit: int = 0) -> DataFrame:
    """Entrance finder's report of entrances(nodes, limit=None) rows: weights above `limit` first, then those up to it; descending."""
    return weights.withColumn("bucket", F.when(F.col("weight") > limit, "above").otherwise("up to")).orderBy("bucket", F.desc("weight"), "path")


def ranked_once(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
