"""Predicates and projections over files, matches and findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts of paths.
SPECIAL_PARTS = ("/node_modules/", "/bower_components/", ".min.js", "jquery")
TEST_PARTS = ("/test/", "/tests/", "/unitTests/")


def _any(path: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(path, F.lit(p)) for p in parts])


def special_file(path: Column) -> Column:
    return _any(path, SPECIAL_PARTS)


def test_file(path: Column) -> Column:
    return _any(path, TEST_PARTS)


def annotation(text: Column) -> Column:
    """The matched text begins as a comment."""
    return F.trim(text).rlike(r"^(#|\\\*|//)")


def white_listed(path: Column, listed) -> Column:
    return path.isin(*listed)


def target_extension(path: Column, extensions) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(F.lower(path), F.lit(e)) for e in extensions])


def parsable(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(php|java|sol|js)$")


def stored_code(code: Column) -> Column:
    """500 characters of code longer than 512."""
    return F.when(F.length(code) > 512, F.substring(code, 1, 500)).otherwise(code)


def reported_code(code: Column) -> Column:
    """The first 50 characters, trimmed, on one line."""
    return F.translate(F.trim(F.substring(code, 1, 50)), "\r\n", "  ")


def enabled_rules(rules: DataFrame) -> DataFrame:
    """Rules that are on; a rule loaded alone runs even if it is off."""
    alone = rules.agg(F.count("*").alias("n_rules"))
    return rules.where(F.col("status") | (alone.scalar() == 1))


def unconfirmed(reason: Column) -> Column:
    return F.contains(F.lower(reason), F.lit("unconfirmed"))


def wildcard(column: Column, query: str) -> Column:
    """*x* contains, *x ends with, x* begins with, x equals; letters' case does not count."""
    low, text = F.lower(column), query.strip("*").lower()
    if len(query) > 1 and query.startswith("*") and query.endswith("*"):
        return F.contains(low, F.lit(text))
    if query.startswith("*"):
        return F.endswith(low, F.lit(text))
    if query.endswith("*"):
        return F.startswith(low, F.lit(text))
    return low == text


def result_filter(results: DataFrame, cvi_id=None, language=None, result_type=None, active_vul=None, get_unconfirm=None) -> DataFrame:
    """Findings by any of the options; `all` and None do not restrict. get_unconfirm: True, False or only."""
    conds = [F.col(c) == str(v) for c, v in (("cvi_id", cvi_id), ("language", language), ("result_type", result_type)) if v not in (None, "all")]
    if active_vul not in (None, "all"):
        conds.append(F.col("is_active") == F.lit(bool(active_vul)))
    if get_unconfirm == "only":
        conds.append(F.col("is_unconfirm"))
    elif get_unconfirm is False:
        conds.append(~F.col("is_unconfirm"))
    return results.where(reduce(lambda a, b: a & b, conds)) if conds else results


def substring_filter(rows: DataFrame, **parts: str) -> DataFrame:
    """Rows whose columns contain these texts."""
    return rows.where(reduce(lambda a, b: a & b, [F.contains(F.col(c), F.lit(v)) for c, v in parts.items()])) if parts else rows


def soft_delete(results: DataFrame, condition: Column) -> DataFrame:
    return results.withColumn("is_active", F.col("is_active") & ~F.coalesce(condition, F.lit(False)))


def strip_arguments(arguments: Column, sensitive) -> Column:
    """An argument list less these options and the value after each."""
    lag = F.concat(F.array(F.lit("")), arguments)
    return F.filter(arguments, lambda a, i: ~a.isin(*sensitive) & ~F.get(lag, i).isin(*sensitive))


def ignore_pattern(line: str) -> str:
    """An ignore line as a regular expression: `*` is a word, `/` either slash."""
    out = "".join({"*": r"\w+", "/": r"[/\\]"}.get(c, c if c.isalnum() or c == "_" else "\\" + c) for c in line)
    return "(?i)" + out


def not_ignored(files: DataFrame, lines: list[str]) -> DataFrame:
    """Files whose path no ignore line hits anywhere."""
    found = [x.strip() for x in lines if x.strip()]
    return files.where(~F.col("path").rlike("|".join(ignore_pattern(x) for x in found))) if found else files


def not_black_listed(files: DataFrame, parts) -> DataFrame:
    """Opt-in: files without a path part from the black list."""
    return files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, parts))))
