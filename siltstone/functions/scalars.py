"""Scalar functions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import LEVELS, VENDOR_LEVELS

# What counts as true and false.
TRUE, FALSE = ("true", "t", "yes", "y", "on", "1"), ("false", "f", "no", "n", "off", "0")


def md5_hex(*parts) -> Column:
    """MD5 of the parts joined by commas, as lower-case hex."""
    return F.md5(F.concat_ws(",", *parts).cast("binary"))


def to_bool(text: Column) -> Column:
    """True or false by the token sets; any other token is an error."""
    low = F.lower(text)
    return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False).when(text.isNull(), None).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean"))


def duration(seconds: Column) -> Column:
    """Seconds as m's\"."""
    whole = F.floor(seconds)
    return F.when(seconds < 60, F.concat(whole.cast("string"), F.lit('"'))).otherwise(
        F.concat(F.floor(whole / 60).cast("string"), F.lit("'"), (whole % 60).cast("string"), F.lit('"')))


def thousands(number: Column) -> Column:
    return F.coalesce(F.format_number(number, 0), F.lit("0"))


def percent(part: Column, whole: Column) -> Column:
    """'20.0%'; 0 of 0 is '0'."""
    value = F.round(part.cast("double") * 100 / whole, 2)
    return F.when(whole == 0, "0").otherwise(F.concat(value.cast("string"), F.lit("%")))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def short_file(path: Column) -> Column:
    return F.concat(F.lit(".../"), base_name(path))


def short_path(path: Column, most: int = 36) -> Column:
    """A path of `most` characters or more as its first parts, `...`, and as many last parts; as many of each as fit."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.size(parts)
    fits = F.aggregate(F.sequence(F.lit(0), n - 1), F.struct(F.lit(0).alias("used"), F.lit(0).alias("pairs")),
                       lambda a, i: F.struct((a["used"] + F.length(F.get(parts, i)) + F.length(F.get(parts, n - 1 - i)) + 1).alias("used"),
                                             (a["pairs"] + (a["used"] + F.length(F.get(parts, i)) + F.length(F.get(parts, n - 1 - i)) + 1 <= most).cast("int")).alias("pairs")))["pairs"]
    short = F.array_join(F.concat(F.slice(parts, F.lit(1), fits), F.array(F.lit("...")), F.slice(parts, F.greatest(n - fits + 1, F.lit(1)), fits)), "/")
    return F.when(F.length(path) < most, path).when(fits == 0, F.concat(F.lit(".../"), F.element_at(parts, -1))).otherwise(short)


def gmt_timestamp(text: Column) -> Column:
    """'Thu, 01 Jan 2020 00:00:00 GMT' as yyyy-MM-dd HH:mm:ss."""
    return F.date_format(F.to_timestamp(F.substring(text, 6, 20), "dd MMM yyyy HH:mm:ss"), "yyyy-MM-dd HH:mm:ss")


def secure_name(text: Column) -> Column:
    """A file name of letters, digits, dots, dashes and underscores only."""
    plain = F.regexp_replace(F.regexp_replace(text, r"[/\\]", " "), r"\s+", "_")
    return F.regexp_replace(F.regexp_replace(plain, r"[^A-Za-z0-9_.-]", ""), r"^[._]+|[._]+$", "")


def main_name(path: Column) -> Column:
    """The last path part without its extension."""
    return F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]*)?$", 1)


def numbered(content: Column, first: int, last: int) -> Column:
    """Lines first to last, each as '%4d: text'."""
    lines = F.slice(F.split(content, "\n"), first, last - first + 1)
    return F.array_join(F.transform(lines, lambda x, i: F.format_string("%4d: %s", i + first, x)), "\n")


def line_range(content: Column, first: Column, last: Column) -> Column:
    return F.slice(F.split(content, "\n"), first, last - first + 1)


def score_bar(level: Column) -> Column:
    """'C-10: ++++++++++' and so on, by the level's band."""
    letter = F.when(level >= 10, "C").when(level >= 7, "H").when(level >= 4, "M").otherwise("L")
    return F.concat(letter, F.lit("-"), F.lpad(level.cast("string"), 2, "0"), F.lit(": "), F.rpad(F.repeat(F.lit("+"), level), 10, "-"))


def _pick(names: tuple[str, ...], severity: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), severity.cast("int"))


def level_label(level: Column) -> Column:
    return _pick(LEVELS, level)


def vendor_level_label(severity: Column) -> Column:
    return _pick(VENDOR_LEVELS, severity)


def abstract_version(version: Column) -> Column:
    """The last dotted number of a version text; null without one."""
    found = F.regexp_extract_all(version, F.lit(r"([0-9]+(?:\.[0-9]+)*)"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def normal_version(version: Column) -> Column:
    """The last dotted number; `unknown` for null, empty and unknown."""
    return F.when(version.isNull() | F.trim(version).isin("", "unknown"), "unknown").otherwise(F.coalesce(abstract_version(version), F.lit("unknown")))


def version_key(version: Column) -> Column:
    """Numbers of a version; arrays compare as versions do."""
    return F.transform(F.split(abstract_version(version), "[.]"), lambda x: x.cast("bigint"))


def version_le(a: Column, b: Column) -> Column:
    """a is not later than b; `latest` never is; without digits null."""
    return F.when((F.lower(a) == "latest") | (F.lower(b) == "latest"), False).otherwise(version_key(a) <= version_key(b))


def cves(aliases: Column) -> Column:
    return F.filter(aliases, lambda a: F.upper(a).startswith("CVE-"))


def osv_severity(text: Column) -> Column:
    """Words of an advisory database as severities; 5 where it says nothing."""
    low = F.lower(text)
    return F.when(low == "critical", 10).when(low == "high", 8).when(low.isin("moderate", "medium"), 6).when(low == "low", 3).otherwise(5)


def effective(items: Column) -> Column:
    return F.filter(items, lambda x: x != "")


def short_list(items: Column) -> Column:
    """Two items and `...` of longer lists, joined by commas."""
    return F.array_join(F.when(F.size(items) > 2, F.concat(F.slice(items, 1, 2), F.array(F.lit("...")))).otherwise(items), ",")


def references(text: Column) -> Column:
    """The quoted URLs of a list in text, or the text itself without quotes."""
    found = F.regexp_extract_all(text, F.lit('"(http[^"]*)"'), F.lit(1))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.trim(text, F.lit('"'))))


def clean_identifier(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^.*\\", ""), r"[^A-Za-z0-9_]", "")


def property_path(text: Column) -> Column:
    """$this->a->b as [a, b]."""
    chain = F.regexp_extract(text, r"\$this((?:->[A-Za-z_][A-Za-z0-9_]*+)++)", 1)  # possessive: long chains take no stack
    return F.filter(F.split(chain, "->"), lambda x: x != "")


def quoted_output(text: Column) -> Column:
    """A field for a delimited file: quoted if it holds a comma, quote or line break."""
    return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def line_of(content: Column, index: Column) -> Column:
    """The line, from 1, of the character at `index` (from 1)."""
    before = F.substring(content, F.lit(1), index - 1)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


# The parts of a rule, by number.
BLOCKS = ("match", "match-name", "black-list", "keyword", "unmatch", "vul-function")


def block_name(index: Column) -> Column:
    """The part of a rule with this number; null for none."""
    return F.get(F.array(*map(F.lit, BLOCKS)), index)


def split_arguments(text: Column) -> Column:
    """The arguments of a command line: words, or what single or double quotes enclose, without them."""
    found = F.regexp_extract_all(text, F.lit("\"[^\"]*\"|'[^']*'|[^\\s\"']+"), F.lit(0))
    return F.transform(found, lambda x: F.when(x.rlike("^[\"']"), F.substr(x, F.lit(2), F.length(x) - 2)).otherwise(x))


def target_mode(target: Column) -> Column:
    """git for URLs of http, https and ssh; else file or folder by the ending of the last part."""
    last = F.element_at(F.split(F.rtrim(target, F.lit("/")), "/"), -1)
    return F.when(target.rlike("^(https?|ssh)://"), "git").when(F.contains(last, F.lit(".")), "file").otherwise("folder")
