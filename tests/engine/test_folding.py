"""Texts put together from constants, and the includes that they name."""

import pytest

from siltstone.operators.joins import written_round
from siltstone.plans import taint
from siltstone.plans.parse import Reader, records, text_parts, tokens


def parts(code):
    found = text_parts(tokens("<?php " + code, "php"))
    return found if found is None else [(x["kind"], x["name"] or x["key"]) for x in found]


@pytest.mark.parametrize("code, expected", [
    ("'a' . B . \"c\"", [("str", "a"), ("const", "B"), ("str", "c")]),
    ("__DIR__ . '/x.php'", [("dir", "1"), ("str", "/x.php")]),
    ("dirname(dirname(__FILE__)) . ('/' . (X . '.php'))", [("dir", "2"), ("str", "/"), ("const", "X"), ("str", ".php")]),
    ("dirname(__DIR__, 3)", [("dir", "4")]),
    ("'it\\'s'", [("str", "it's")]),
    ("'a' . $b", None), ("\"a$b\"", None), ("f('a')", None), ("dirname('a')", None), ("dirname()", None), ("'a' . (B", None), ("", None), ("dirname(__DIR__, X)", None), ("1 + 2", None),
])
def test_parts(code, expected):
    assert parts(code) == expected


def test_deep_nesting_takes_no_stack():
    assert text_parts(tokens("<?php " + "(" * 20000 + "'a'" + ")" * 20000, "php"))[0]["name"] == "a"
    assert len(text_parts(tokens("<?php 'a'" + " . 'a'" * 20000, "php"))) == 20001


def table(spark, files):
    return written_round(records(spark.createDataFrame(list(files.items()), "path string, content string"), "php"))


def test_constants_of_constants_cycles_and_several_values(spark):
    rows = table(spark, {
        "/p/a.php": "<?php define('A', 'x'); const B = A . '/y'; define('C', B . D); define('E', F . '1'); define('F', E . '2'); define('G', G . 'z'); define('H', $v . 'q');",
        "/p/b.php": "<?php define('D', '1');", "/p/c.php": "<?php define('D', '2'); define('K', D); define('A', 'z'); class Z { const A = 'no'; }", "/p/d.php": "<?php define('L', A);", "/p/e.php": None})
    got = {tuple(r) for r in taint.constants(rows).collect()}
    assert got == {("/p/a.php", "A", "x"), ("/p/a.php", "B", "x/y"), ("/p/a.php", "C", "x/y1"), ("/p/a.php", "C", "x/y2"), ("/p/b.php", "D", "1"), ("/p/c.php", "D", "2"), ("/p/c.php", "K", "2"),
                   ("/p/c.php", "A", "z"), ("/p/d.php", "L", "x"), ("/p/d.php", "L", "z")}


def test_includes_by_full_paths_projects_and_ends(spark):
    rows = table(spark, {
        "/p/a.php": "<?php define('ROOT', __DIR__); include ROOT . '/lib/f.php'; include UNKNOWN . 'g.php'; include $x . 'h.php'; include 'h.php' or die('no');",
        "/p/lib/f.php": "<?php require dirname(__FILE__) . '/../a.php';", "/q/lib/f.php": "<?php include ROOT . '/a.php'; include 'deep/f.php';", "/p/g.php": "<?php $y = 1;", "/q/g.php": "<?php $y = 1;", "/p/h.php": "<?php $y = 1;",
        "/q/k/deep/f.php": "<?php $z = 1;", "/q/lib/none.php": "<?php include dirname(__FILE__) . '/f2.php';", "/z/f2.php": "<?php $a = 1;"})
    whole = {tuple(r) for r in taint.include_links(rows).collect()}
    assert ("/p/a.php", "/p/lib/f.php") in whole and ("/p/a.php", "/q/lib/f.php") not in whole
    assert ("/p/lib/f.php", "/p/a.php") in whole and ("/q/lib/f.php", "/p/a.php") in whole
    assert ("/p/a.php", "/p/g.php") in whole and ("/p/a.php", "/p/h.php") in whole
    assert ("/q/lib/f.php", "/q/k/deep/f.php") in whole
    assert not any(i == "/q/lib/none.php" for i, _ in whole)
    own = {tuple(r) for r in taint.include_links(rows, "^/[^/]+/").collect()}
    assert ("/q/lib/f.php", "/p/a.php") not in own and ("/p/a.php", "/p/g.php") in own and ("/p/a.php", "/q/g.php") not in own


def test_no_includes(spark):
    assert taint.include_links(table(spark, {"/a.php": "<?php $a = 1;"})).count() == 0
    assert taint.constants(table(spark, {"/a.php": ""})).count() == 0


def test_order_of_records_is_untouched():
    rows = Reader("<?php include 'a' . B; $x = 1;", "php").read()
    assert [r["rec"] for r in rows if r["rec"] == "path"] == ["path"] and sorted({r["ord"] for r in rows if r["rec"] != "path"}) == list(range(1, 1 + sum(r["rec"] != "path" for r in rows)))
