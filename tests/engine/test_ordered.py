"""Numbers and runs over ranges against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siltstone.operators import ordered


def rows(n=400):
    """A key with most rows, null keys, and values that tie."""
    rng = random.Random(4)
    return [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.choice([0.1, 0.12, 0.5, 0.9, 0.55]) + rng.randrange(3) / 100) for i in range(n)] + [("alone", n, 0.3)]


def grouped():
    out = defaultdict(list)
    for k, i, v in rows():
        out[k].append((i, v))
    return out


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_row_numbers(spark, parts):
    df = spark.createDataFrame(rows(), "k string, i int, v double").repartition(3)
    got = {r.i: r.n for r in ordered.row_numbers(df, ["k"], [F.desc("v"), "i"], "n", parts).collect()}
    assert got == {i: at + 1 for some in grouped().values() for at, (i, _) in enumerate(sorted(some, key=lambda x: (-x[1], x[0])))}
    got = {r.i: r.n for r in ordered.row_numbers(df, [], [F.desc("v"), "i"], "n", parts).collect()}
    assert got == {i: at + 1 for at, (_, i, _) in enumerate(sorted(rows(), key=lambda x: (-x[2], x[1])))}


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_falls(spark, parts):
    df = spark.createDataFrame(rows(), "k string, i int, v double").repartition(3)
    want = {}
    for some in grouped().values():
        number, last = 1, None
        for i, v in sorted(some, key=lambda x: (-x[1], x[0])):
            number += last is not None and last - v >= 0.03
            last, want[i] = v, number
    assert {r.i: r.cluster for r in ordered.falls(df, ["k"], "v", "i", 0.03, parts=parts).collect()} == want


def test_no_window_takes_a_whole_key(spark):
    plan = ordered.row_numbers(spark.createDataFrame(rows(), "k string, i int, v double"), ["k"], ["i"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x]
    assert len(windows) == 2 and any("_part" in x.rsplit("], [", 2)[1] for x in windows)


def test_empty(spark):
    none = spark.createDataFrame([], "k string, i int, v double")
    assert ordered.row_numbers(none, ["k"], ["i"]).count() == 0 and ordered.falls(none, ["k"], "v", "i", 0.1).count() == 0
