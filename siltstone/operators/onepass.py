"""One pass for all only-regex rules.

Each rule's patterns give *required literals*: texts of which one stands in every match.  One
multi-pattern automaton over the literals of all rules reads a file once and names the rules
that may hit there; only these candidate (rule, file) pairs meet the exact expressions.  A
pattern without required literals makes its rule a candidate everywhere.

Rules are rows, so the plan has one scan of the files whatever the number of rules.
"""

from __future__ import annotations

import re
from functools import cache
from re import _constants as C
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..catalog import EXTENSIONS, java_regex

#: Literals of fewer characters stand nearly everywhere.
LEAST = 2


def required_literals(pattern: str) -> frozenset[str] | None:
    """Lower-case literals of which every match of the pattern, any case, holds one; None where no such set is known."""
    try:
        tree = parser.parse(pattern, re.IGNORECASE)
    except re.error:
        return None  # an expression of another dialect
    return _of_sequence(tree)


def _of_sequence(items) -> frozenset[str] | None:
    """The best set of a sequence: the one whose shortest literal is longest."""
    found, run = [], []

    def close() -> None:
        if len(run) >= LEAST:
            found.append(frozenset(["".join(run)]))
        run.clear()

    for kind, value in items:
        if kind is C.LITERAL and chr(value).lower().upper().lower() == chr(value).lower() and value < 128:
            run.append(chr(value).lower())
            continue
        if kind is C.AT:
            continue  # positions take no text
        if kind is C.SUBPATTERN and len(value[3]) and all(k is C.LITERAL and v < 128 for k, v in value[3]):
            run += [chr(v).lower() for _, v in value[3]]
            continue
        close()
        inner = None
        if kind is C.SUBPATTERN:
            inner = _of_sequence(value[3])
        elif kind is C.BRANCH:
            parts = [_of_sequence(x) for x in value[1]]
            inner = frozenset().union(*parts) if parts and all(parts) else None
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] >= 1:
            inner = _of_sequence(value[2])
        if inner:
            found.append(inner)
    close()
    return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=None)


def automaton(rules: dict[int, list[str]]):
    """Content to the sorted numbers of rules that may hit in it, by one automaton.  `rules`: number to patterns that must all hit."""
    import ahocorasick

    needs: dict[int, list[frozenset[str]]] = {n: [x for x in (required_literals(java_regex(p)) for p in patterns) if x] for n, patterns in rules.items()}
    words = {word: i for i, word in enumerate(sorted({w for sets in needs.values() for one in sets for w in one}))}
    machine = ahocorasick.Automaton()
    for word, i in words.items():
        machine.add_word(word, i)
    machine.make_automaton()
    wanted = {n: [frozenset(words[w] for w in one) for one in sets] for n, sets in needs.items()}

    def candidates(content: str | None) -> list[int] | None:
        if content is None:
            return None
        seen = {i for _, i in machine.iter(content.lower())} if words else set()
        return sorted(n for n, sets in wanted.items() if all(one & seen for one in sets))

    return candidates


@cache
def _machine(rules: tuple):
    """The automaton of rules as pairs, made once a worker."""
    return automaton({n: list(patterns) for n, patterns in rules})


def candidate_rules(content: Column, rules: dict[int, list[str]]) -> Column:
    """An array of the rules that may hit in a content; evaluated in Arrow batches, the content itself stays with Spark."""
    key = tuple((n, tuple(patterns)) for n, patterns in rules.items())

    @arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        find = _machine(key)
        return pa.array([find(x) for x in texts.to_pylist()], pa.list_(pa.int32()))

    return of(content)


def hit_lines(content: Column, pattern: Column, found: Column) -> Column:
    """The line of each of `found`, all hits of the pattern, in one pass along the content.

    Between hits only line breaks count: marks of hits and breaks are joined, cut at the breaks,
    and a line's number is repeated for each mark on it.
    """
    breaks = lambda x: F.regexp_replace(x, r"[^\n]+", "")
    marks = F.array_join(F.zip_with(F.split(content, pattern, -1), found, lambda p, h: F.concat(F.coalesce(breaks(p), F.lit("")), F.coalesce(F.concat(F.lit("x"), breaks(h)), F.lit("")))), "")
    return F.flatten(F.transform(F.split(marks, "\n"), lambda line, i: F.array_repeat(i + 1, F.length(line))))


def match_rules(files: DataFrame, rules: list[dict]) -> DataFrame:
    """files(path, ext, content) and only-regex rules to (svid, path, line, text): every hit of a rule's first pattern in files of its
    language that hold all its patterns and none of `unmatch`.

    Null contents have no hits; repeated files have theirs repeated; no rules give no rows.
    """
    spark = files.sparkSession
    rows = [(r["svid"], EXTENSIONS[r["language"]], "(?i)" + java_regex(r["match"][0]), ["(?i)" + java_regex(p) for p in r["match"][1:]], ["(?i)" + java_regex(p) for p in r["unmatch"]]) for r in rules]
    table = spark.createDataFrame(rows, "svid int, exts array<string>, first string, rest array<string>, unmatch array<string>")
    pairs = files.select("path", "ext", "content", F.explode(candidate_rules(F.col("content"), {r["svid"]: r["match"] for r in rules})).alias("svid"))
    held = lambda p: F.rlike(F.col("content"), p)
    exact = (pairs.join(F.broadcast(table), "svid").where(F.array_contains("exts", "*") | F.array_contains("exts", F.col("ext")))
             .where(F.forall("rest", held) & ~F.exists("unmatch", held)))
    found = exact.select("svid", "path", "content", "first", F.regexp_extract_all("content", F.col("first"), F.lit(0)).alias("found")).where(F.size("found") > 0)
    hits = found.select("svid", "path", F.explode(F.arrays_zip(hit_lines(F.col("content"), F.col("first"), F.col("found")).alias("line"), F.col("found").alias("text"))).alias("hit"))
    return hits.select("svid", "path", F.col("hit.line").alias("line"), F.col("hit.text").alias("text"))
