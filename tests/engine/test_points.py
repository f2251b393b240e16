"""Points-to sets of JavaScript, and chains over product states."""

import pytest

from . import fixtures
from siltstone import generated as G
from siltstone.plans import codedb, points, taint
from siltstone.plans.parse import records


def tree(cases, suffix):
    """Each case a folder; PHP is opened on the first line."""
    return {f"/{i}/{name}": ("<?php " if suffix == ".php" else "") + text.replace("§", str(i)) for i, (files, _) in enumerate(cases.values()) for name, text in files.items() if name.endswith(suffix)}


def test_points_to_sets(spark):
    text = """function F(x) { this.a = x; }
F.prototype.m = function(y) { return y; };
var o = new F(1), p = o, q = {k: p, n: function() { return this.k; }};
var r = q.k; var s = r.m; s(2); q.n();
function each(cb) { cb(3); } each(p.m); var loop = loop2; var loop2 = loop;
var w = document.write;"""
    rows = records(fixtures.files(spark, {"/a.js": text}), "javascript")
    sets = {}
    for x in points.solve(points.facts(rows, ["document.write"])).collect():
        sets.setdefault((x.scope, x.name), set()).add(x.obj)
    assert sets["", "o"] == sets["", "p"] == sets["", "r"] == {"new:F"} and sets["", "q"] == {"lit:|q"}
    assert sets["", "s"] == sets["each", "cb"] == {"fn:F.prototype.m"} and sets["q.n", "this"] == {"lit:|q"} and sets["", "w"] == {"ext:document.write"}
    assert "new:F" in sets["F", "this"] and ("", "loop") not in sets


def test_javascript_cases(spark):
    found = taint.scan(fixtures.files(spark, tree(G.JS, ".js")), "javascript").collect()
    want = {(f"/{i}/{f[0]}", f[1], f[2], f[3].replace("§", str(i))) for i, (_, some) in enumerate(G.JS.values()) for f in some}
    assert {(r.path, r.line, r.svid, "closure" if r.sink.startswith("closure@") else r.sink) for r in found} == want


def test_no_scripts(spark):
    rows, aliases, targets = points.resolve(records(fixtures.files(spark, {}), "javascript"), ["eval"])
    assert rows.count() == aliases.count() == targets.count() == 0


@pytest.fixture(scope="module")
def chains(spark):
    rows = records(fixtures.files(spark, tree(G.CHAINS, ".php")), "php")
    return codedb.chains(rows, projects="^/[^/]+/").collect()


def test_chain_cases(chains):
    want = {(f"/{i}/", c[0], c[1], c[2], c[3]) for i, (_, some) in enumerate(G.CHAINS.values()) for c in some}
    assert {(r.project, r.entry, " ".join(r.methods), r.sink, r.line) for r in chains} == want and len(chains) == len(want)


def test_every_simple_chain_once(spark):
    """All methods may run each other by names: every simple path from the entry to the method with the sink, by plain search."""
    calls = {"a": "bcd", "b": "acd", "c": "bde", "d": "ae", "e": "b"}
    body = "".join(f"function {m}() {{ {''.join(f'$this->x->{n}();' for n in to)} {'eval($this->y);' if m == 'e' else ''} }}\n" for m, to in calls.items())
    rows = records(fixtures.files(spark, {"/a.php": f"<?php class K {{ function __wakeup() {{ $this->x->a(); }}\n{body} }}"}), "php")

    def walk(at, path):
        if at == "e":
            yield path
        for n in calls[at]:
            if n not in path:
                yield from walk(n, [*path, n])

    want = {("K::__wakeup", *(f"K::{m}" for m in path)) for path in walk("a", ["a"])}
    got = [tuple(r.methods) for r in codedb.chains(rows).collect()]
    assert set(got) == want and len(got) == len(want) > 5


def test_no_code(spark):
    assert codedb.chains(records(fixtures.files(spark, {}), "php")).count() == 0
