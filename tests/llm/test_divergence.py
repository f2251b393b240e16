"""Source divergence against whole-number Python, and DuckDB's SQL."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

from siltstone.llm import divergence

from .cases import empty, rows, table


def brute(docs, least):
    """Rows of (lang, source, text) documents by the contract's arithmetic."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))) for a, b, t in docs]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        kept = {t for t, n in Counter(t for d in mine for t in set(d[2])).items() if n >= least}
        counts = defaultdict(Counter)
        for _, source, terms in mine:
            counts[source].update(t for t in terms if t in kept)
        total = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + (1_000_000_000 * (c[t] + 2)) // (sum(c.values()) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: share(c) for s, c in counts.items()}, share(total)
        gap = lambda x, y: (x - y) ** 2 // (x + y)
        for s in counts:
            pairs = [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, gap(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:None if part == "pair" else 10]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return Counter(out)


def some():
    words = "the The THE é É ß Straße a1b don't 漢字 tea".split()
    out = [(i, " ".join(words[(i * k) % len(words)] for k in range(1, 2 + i % 9)), ("en", "fr", None, "")[i % 4], (None, "s1", "s2", "é", "")[i % 5], 1, None, i, "h") for i in range(160)]
    return out + rows() + [(900 + i, "x y z", "alone", "only", None, None, None, None) for i in range(3)]


@pytest.mark.parametrize("least", [1, 4, 10, 1000])
def test_against_brute_force(spark, least):
    got = Counter(tuple(r) for r in divergence.divergence(table(spark, some()), min_docs=least).collect())
    assert got == brute([(r[2], r[3], r[1]) for r in some()], least)


def test_sql_says_the_same(spark):
    docs = table(spark, some())
    got = Counter(tuple(r) for r in divergence.divergence(docs).collect())
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert got == Counter(con.execute(divergence.ORACLE).fetchall()) and {r[2] for r in got} == {"pair", "term"}


def test_an_empty_table(spark):
    assert divergence.divergence(empty(spark)).count() == 0
