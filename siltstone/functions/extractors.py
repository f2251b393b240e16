"""Parameter extractors: what a custom rule's hit hands to the taint search."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PIECE = re.compile(r"""'(?:[^'\\]|\\.)*(?:'|$)|"(?:[^"\\]|\\.)*(?:"|$)|(?P<end>;|\}\ else|\ else\ |\?>)|.""", re.S | re.X)
_KEYWORD = re.compile(r"(?:select|insert|update)\b", re.I)


def variables(text: Column) -> Column:
    """All $names."""
    return F.regexp_extract_all(text, F.lit(r"\$\w+"), F.lit(0))


def curl_target(text: Column) -> Column:
    """Names with their members in a URL option."""
    return F.regexp_extract_all(text, F.lit(r"\$[\w+\->]*"), F.lit(0))


def sql_slice(text: str | None) -> list[str]:
    """The $names of the first SQL statement: from the quote before its keyword to the statement's end outside quotes."""
    keyword = _KEYWORD.search(text or "")
    if keyword:
        quote = max(text.rfind(q, 0, keyword.start()) for q in "'\"")
        begin = quote if quote >= 0 else keyword.start()
        stop = next((m.start() for m in _PIECE.finditer(text, begin) if m["end"]), len(text))
        text = text[begin:stop]
    return re.findall(r"\$\w+", text or "")


@F.pandas_udf(T.ArrayType(T.StringType()))
def sql_variables(text: pd.Series) -> pd.Series:
    return text.map(sql_slice)


def html_tokens(text: Column, name: str) -> Column:
    """Names on the right side of an assignment, after = + ( or a comma; the property itself if there is none."""
    found = F.regexp_extract_all(text, F.lit(r"(?<=[(,=+])\s*(\"[^\"]+?\"|'[^']+'|[\w.]+)"), F.lit(1))
    plain = F.filter(F.transform(found, F.trim), lambda x: ~x.rlike("[\"']"))
    return F.when(F.size(found) > 0, plain).otherwise(F.array(F.lit(name)))


def attribute_tokens(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(r"[\w.]+"), F.lit(0))


def extract(name: str | None, text: Column, property_name: str = "") -> Column:
    """The extractor of a rule by its name in the catalog; rules without one give null."""
    if name == "curl":
        return curl_target(text)
    if name == "sql":
        return sql_variables(text)
    if name == "echo":
        return variables(text)
    if name == "html":
        return html_tokens(text, property_name)
    if name == "attr":
        return attribute_tokens(text)
    return F.lit(None).cast("array<string>")


def _mapped(text: Column, pattern: str, change) -> Column:
    """The text with every hit of a pattern changed by an expression."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(parts, found, lambda p, h: F.concat(p, F.coalesce(change(h), F.lit("")))), "")


_STRINGS = r"\"(?:[^\"\\]++|\\.)*+\"|'(?:[^'\\]++|\\.)*+'"  # possessive: long strings take no stack


def strip_comments(text: Column) -> Column:
    """The text without // and /* */ comments; strings and line breaks stay, so lines keep their numbers."""
    return _mapped(text, _STRINGS + r"|//[^\n]*|(?s:/\*.*?\*/)", lambda h: F.when(F.startswith(h, F.lit("/")), F.regexp_replace(h, r"[^\n]", "")).otherwise(h))


def strip_comments_compat(text: Column) -> Column:
    """Compat: only the marker of a // comment goes, and the inside of /* */ comments."""
    return _mapped(text, r"//|(?s:/\*.*?(?:\*/|$))", lambda h: F.when(F.startswith(h, F.lit("//")), "").otherwise(F.regexp_replace(h, r"[^\n]", "")))


def pretty_script(text: Column) -> Column:
    """One statement a line: a break after ; { and } outside strings; empty lines go."""
    broken = _mapped(text, _STRINGS + r"|`[^`]*`|[;{}]", lambda h: F.when(h.isin(";", "{", "}"), F.concat(h, F.lit("\n"))).otherwise(h))
    return F.btrim(F.regexp_replace(broken, r"\n\s*", "\n"), F.lit("\n"))
