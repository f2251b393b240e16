"""Match modes: rules against file contents.

Strict semantics throughout: a pattern is searched in the whole content, every hit
counts, and a file's conditions are sets of paths (semi and anti joins).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog
from ..catalog import java_regex
from .onepass import hit_lines


def hits(files: DataFrame, pattern: str, group: int = 0, insensitive: bool = True) -> DataFrame:
    """(path, ..., line, text) for every hit of a pattern in `content`; files without a hit are filtered first."""
    pattern = ("(?i)" if insensitive else "") + java_regex(pattern)
    keep = [c for c in files.columns if c != "content"]
    found = files.where(F.col("content").rlike(pattern)).select(*keep, "content", F.regexp_extract_all("content", F.lit(pattern), F.lit(0)).alias("_found"))
    chosen = F.regexp_extract_all("content", F.lit(pattern), F.lit(group)) if group else F.col("_found")
    lines = hit_lines(F.col("content"), F.lit(pattern), F.col("_found"))
    return found.select(*keep, F.explode(F.arrays_zip(lines.alias("line"), chosen.alias("text"))).alias("_hit")).select(*keep, "_hit.line", "_hit.text")


def line_hits(files: DataFrame, pattern: str) -> DataFrame:
    """(path, line, text): the lines that a pattern hits."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    return lines.where(F.col("text").rlike("(?i)" + java_regex(pattern))).select("path", (F.col("pos") + 1).alias("line"), "text")


def match_and_not(files: DataFrame, match: list[str], unmatch: list[str] = ()) -> DataFrame:
    """Only-regex: hits of the first pattern in files that hold all patterns and none of `unmatch`.

    All conditions are on one row's content, so they are filters before any explode.
    """
    conditions = [F.col("content").rlike("(?i)" + java_regex(p)) for p in match[1:]]
    conditions += [~F.col("content").rlike("(?i)" + java_regex(p)) for p in unmatch]
    kept = files.where(reduce(lambda a, b: a & b, conditions)) if conditions else files
    return hits(kept, match[0])


def match_and_not_joined(matches: list[DataFrame], unmatches: list[DataFrame]) -> DataFrame:
    """The same over match tables: bag join on path for AND, anti join for NOT."""
    out = matches[0]
    for more in matches[1:]:
        out = out.join(more.select("path"), "path")
    for less in unmatches:
        out = out.join(less.select("path").distinct(), "path", "left_anti")
    return out


def windowed_hits(files: DataFrame, pattern: str, size: int = 10) -> DataFrame:
    """Hits inside windows of `size` lines; a hit does not cross windows."""
    lines = F.split("content", "\n")
    windows = files.select("path", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / size).cast("int")),
                                                            lambda w: F.array_join(F.slice(lines, w * size + 1, size), "\n"))).alias("w", "content"))
    found = hits(windows, pattern)
    return found.select("path", (F.col("w") * size + F.col("line")).alias("line"), F.trim("text").alias("text"))


def block_hits_compat(files: DataFrame, pattern: str, block: int = 1000) -> DataFrame:
    """Compat: the first block's first hit, once for every block of the file."""
    pattern = "(?i)" + java_regex(pattern)
    first = F.substring("content", 1, block)
    return (files.where(first.rlike(pattern)).select("path", F.regexp_extract(first, pattern, 0).alias("text"), F.explode(F.sequence(F.lit(1), F.ceil(F.length("content") / block).cast("int"))).alias("block")))


def names_not_guarded(files: DataFrame, match_name: str, match: list[str], unmatch: list[str], black_list: list[str], most: int = 32) -> DataFrame:
    """Regex-return-regex: names that a pattern's second group returns, whose own patterns nothing in the file unmatches.

    Names with a black-listed part or of `most` characters or more are dropped.  Without
    `match` a name is reported at line 0; else where a pattern holds it.
    """
    found = F.array_distinct(F.regexp_extract_all("content", F.lit("(?i)" + java_regex(match_name)), F.lit(2)))
    names = files.select("path", "content", F.explode(found).alias("name")).where((F.length("name") < most) & (F.trim("name") != ""))
    for part in black_list:
        names = names.where(~F.contains(F.col("name"), F.lit(part)))

    def own(pattern: str) -> Column:
        return F.replace(F.lit("(?i)" + java_regex(pattern)), F.lit("=padding="), F.concat(F.lit("\\Q"), F.col("name"), F.lit("\\E")))

    for pattern in unmatch:
        names = names.where(~F.rlike(F.col("content"), own(pattern)))
    if not match:
        return names.select("path", F.lit(0).alias("line"), F.col("name").alias("text"))
    one = reduce(lambda a, b: a | b, [F.rlike(F.col("content"), own(p)) for p in match])
    return names.where(one).select("path", F.lit(0).alias("line"), F.col("name").alias("text"))


def manifest_values(manifests: DataFrame, keyword: str) -> DataFrame:
    """(path, value) at a dotted path of `json`; `*` stands for every item of a list. A missing path gives null."""
    rows = manifests.select("path", F.expr("try_parse_json(json)").alias("v"))
    for key in keyword.split("."):
        if key == "*":
            rows = rows.select("path", F.expr("explode_outer(try_cast(v as array<variant>))").alias("v"))
        else:
            rows = rows.select("path", F.expr(f"try_variant_get(v, '$[\"{key}\"]', 'variant')").alias("v"))
    return rows.select("path", F.coalesce(F.expr("try_cast(v as string)"), F.expr("to_json(v)")).alias("value"))


def manifest_matches(manifests: DataFrame, keyword: str, match: list, unmatch: list[str] = ()) -> DataFrame:
    """Special keyword: values that a pattern hits and no unmatch pattern; a null pattern reports missing keys."""
    values = manifest_values(manifests, keyword)
    patterns = [java_regex(p) for p in match if p]
    hit = F.rlike(F.col("value"), F.lit("(?i)" + "|".join(f"(?:{p})" for p in patterns))) if patterns else F.lit(False)
    for p in unmatch:
        hit = hit & ~F.rlike(F.col("value"), F.lit("(?i)" + java_regex(p)))
    missing = F.col("value").isNull() if None in match else F.lit(False)
    return values.where(F.coalesce(hit, F.lit(False)) | missing).select("path", F.lit(0).alias("line"), F.concat(F.lit(keyword + " = "), F.coalesce("value", F.lit("None"))).alias("text"))


def path_matches(files: DataFrame, keywords: list[str], least: int = 10) -> DataFrame:
    """File-path mode: (path, keyword) of files larger than `least` bytes."""
    low = F.lower(F.translate("path", "\\", "/"))
    found = F.filter(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(low, k))
    return files.where(F.col("size") > least).select("path", F.explode(found).alias("keyword"))


def function_calls(files: DataFrame, match: str, language: str, echo: bool = False) -> DataFrame:
    """Function mode: hits of calls of the listed functions."""
    return windowed_hits(files, catalog.call_regex(match, language, echo))


def functions_by_regex(files: DataFrame, pattern: str = r"\bfunction\s+([A-Za-z_]\w*)") -> DataFrame:
    """(path, name, start, end): functions by their opening line, each up to the line before the next or the last line."""
    lines = files.select("path", F.size(F.split("content", "\n")).alias("last"), F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    named = lines.withColumn("name", F.regexp_extract("text", pattern, 1)).where("name <> ''")
    order = Window.partitionBy("path").orderBy("pos")
    return named.select("path", "name", (F.col("pos") + 1).alias("start"), F.coalesce(F.lead("pos").over(order), F.col("last")).alias("end"))


def enclosing_function(points: DataFrame, functions: DataFrame) -> DataFrame:
    """Interval join: each (path, line) with the function that holds it."""
    f = functions.select(F.col("path").alias("p"), "name", "start", "end")
    return points.join(f, (F.col("path") == F.col("p")) & (F.col("line") >= F.col("start")) & (F.col("line") <= F.col("end"))).drop("p")


def block_slices(points: DataFrame, files: DataFrame, functions: DataFrame) -> DataFrame:
    """For each (path, line): the lines of its function above it, its own line, and those below it."""
    lines = files.select("path", F.split("content", "\n").alias("lines"))
    joined = enclosing_function(points, functions).join(lines, "path")
    return joined.select("path", "line", "name", F.array_join(F.slice("lines", F.col("start"), F.col("line") - F.col("start")), "\n").alias("up"),
                         F.element_at("lines", F.col("line")).alias("own"), F.array_join(F.slice("lines", F.col("line") + 1, F.col("end") - F.col("line")), "\n").alias("down"))


def repaired_in_block(blocks: DataFrame, rule: str) -> DataFrame:
    """Blocks (path, line, param, block) whose `rule`, with {{PARAM}} filled in, hits: the parameter is checked there."""
    return blocks.withColumn("repaired", F.rlike(F.col("block"), F.replace(F.lit(rule), F.lit("{{PARAM}}"), F.concat(F.lit("\\Q"), F.col("param"), F.lit("\\E")))))


def verdict_reason(matches: DataFrame) -> DataFrame:
    """Matches (language, match_mode, ...) with the reason that a mode is accepted for a language, null where it is not."""
    mode, language = F.col("match_mode"), F.col("language")
    reason = (F.when(mode == catalog.REGEX, "Regex-only-match").when(mode == catalog.PATH, "file-path-regex-match")
              .when((mode == catalog.NAMES) & (language == "solidity"), "Regex-return-regex").when((mode == catalog.MANIFEST) & (language == "chromeext"), "Specail-crx-keyword-match")
              .when(mode.isin(catalog.FUNCTION, catalog.CUSTOM) & language.isin("php", "javascript"), "Function-param-controllable"))
    return matches.withColumn("reason", F.coalesce(reason, F.lit("Unsupport Match"))).withColumn("accepted", reason.isNotNull())


def java_parameter(blocks: DataFrame) -> DataFrame:
    """Blocks (path, line, param, block) of Java: a literal or a request parameter assigned to the parameter there goes on, else it is controllable."""
    own = F.concat(F.lit("\\Q"), F.col("param"), F.lit("\\E"))
    literal = F.rlike(F.col("block"), F.concat(own, F.lit('\\s*=\\s*"[^"]*"')))
    request = F.rlike(F.col("block"), F.concat(own, F.lit("\\s*=\\s*[\\w.]*getParameter\\(")))
    return blocks.withColumn("verdict", F.when(literal | request, "continue").otherwise("controllable"))


def custom_parameters(files: DataFrame, rule: dict) -> DataFrame:
    """Custom mode: (path, line, svid, parameters) of a rule's hits, the parameters as its extractor reads them from the hit, or from the value that it sets."""
    from ..functions.extractors import extract

    found = hits(files.select("path", "content"), rule["match"][0], group=2 if rule["extractor"] == "attr" else 1)
    return found.select("path", F.col("line").cast("int").alias("line"), F.lit(rule["svid"]).alias("svid"), extract(rule["extractor"], F.col("text"), rule["vul_function"] or "").alias("parameters"))
