"""The one-pass matcher against rule-by-rule matching, and against plain regular expressions."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone import catalog
from siltstone.operators import matching, onepass
from siltstone.plans import scan

FILES = "path string, ext string, size long, content string"


def test_required_literals():
    need = onepass.required_literals
    assert need(r"\.extend\(\s*true") == {".extend("} and need("a(bc|de)+f") == {"bc", "de"} and need("(foo|b)x") is None
    assert need("(?:ab)?CD") == {"cd"} and need("[ab]c") is None and need("x{2}yz") == {"yz"} and need("(a|)bcd") == {"bcd"} and need("(broken") is None and need("") is None


@pytest.mark.parametrize("seed", range(3))
def test_every_match_holds_a_required_literal(seed):
    rng = random.Random(seed)
    parts = ["ab", "cd", "(ef|gh)", "[xy]", "z?", r"\d+", "(?:ij)+", "kl*", ".", r"\b", "(mn)?", "OP", r"\(", "(q|rst)"]
    alphabet = "abcdefghijklmnopqrstxyz0(OP "
    for _ in range(400):
        pattern = "".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))
        need = onepass.required_literals(pattern)
        if need is None:
            continue
        for text in ("".join(rng.choice(alphabet) for _ in range(40)) for _ in range(25)):
            for hit in re.finditer(pattern, text, re.I):
                assert any(w in hit[0].lower() for w in need), (pattern, hit[0], need)


def rows():
    rng = random.Random(2)
    lines = ["password = hunter2", "PASSWORD: 'x'", "value", "http://10.20.30.40:8080", "127.0.0.1:80", "window.addEventListener('message', function(e) {})", "$.extend(true, a)", "null", "", "é plain", "if (a) { b } else {\n return false; }",
             "chrome.tabs.executeScript(t, {code: x})", "JSON.stringify(x)"]
    out = [(f"/f{i}.{e}", f".{e}", 1, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for i in range(120) for e in [("js", "sol", "conf", "php")[i % 4]]]
    return out + [out[0], ("/null.js", ".js", None, None), ("/long.conf", ".conf", 1, "x\n" * 50_000 + "password = hunter2\n" + "y" * 100_000 + " password: abc")]


def rules():
    return [r for r in catalog.rule_rows() if r["match_mode"] == catalog.REGEX]


def test_equals_rule_by_rule(spark):
    files = spark.createDataFrame(rows(), FILES)
    want = Counter()
    for r in rules():
        mine = scan._of_language(files, r["language"]).select("path", "content")
        want.update((r["svid"], x.path, x.line, x.text) for x in matching.match_and_not(mine, r["match"], r["unmatch"]).collect())
    got = Counter((r.svid, r.path, r.line, r.text) for r in onepass.match_rules(files, rules()).collect())
    assert got == want and len({x[0] for x in got}) >= 5 and (5001, "/long.conf", 50_001, "password = hunter2") in got


def test_lines_are_those_of_the_matches(spark):
    content, pattern = "a1\n\nb22 c3\n4\n5", r"\d(\n\d)?"
    (row,) = spark.createDataFrame([(content,)], "content string").select(onepass.hit_lines(F.col("content"), F.lit(pattern), F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("lines")).collect()
    assert row.lines == [content.count("\n", 0, m.start()) + 1 for m in re.finditer(pattern, content)]


def test_one_scan_whatever_the_number_of_rules(spark, tmp_path):
    spark.createDataFrame(rows(), FILES).write.parquet(f"{tmp_path}/files")
    plan = onepass.match_rules(spark.read.parquet(f"{tmp_path}/files"), rules())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Union" not in plan


def test_no_files_and_no_rules(spark):
    assert onepass.match_rules(spark.createDataFrame([], FILES), rules()).count() == 0
    assert onepass.match_rules(spark.createDataFrame(rows(), FILES), []).count() == 0
