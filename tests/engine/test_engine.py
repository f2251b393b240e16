"""The engine against expected rows on sources of our own, and brute force on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone import catalog
from siltstone.functions import scalars as X
from siltstone.operators import corpus, joins, matching, predicates, reporting, sca, sinks
from siltstone.plans import codedb, taint
from siltstone.plans.parse import read_file, records
from siltstone.sources import files as file_sources
from siltstone.sources import manifests

from . import fixtures


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_php_taint(spark):
    got = {(r.path, r.line, r.svid) for r in taint.scan(fixtures.files(spark, fixtures.PHP), "php").collect()}
    assert got == fixtures.PHP_FINDINGS


def test_js_taint(spark):
    got = {(r.path, r.line, r.svid) for r in taint.scan(fixtures.files(spark, fixtures.JS), "javascript").collect()}
    assert got == fixtures.JS_FINDINGS


def test_unconfirmed_is_opt_in(spark):
    source = fixtures.files(spark, {"/a.php": "<?php system($nowhere);"})
    assert taint.scan(source, "php").count() == 0
    assert [r.reason for r in taint.scan(source, "php", unconfirmed=True).collect()] == ["Unconfirmed Function-param-controllable"]


def test_recursion_ends(spark):
    source = fixtures.files(spark, {"/a.php": "<?php function f($a) { return g($a); } function g($b) { return f($b); } system(f($_GET['x'])); function h($c) { h($c); eval($c); } $i = $i . $i; exec($i);"})
    assert {r.sink for r in taint.scan(source, "php").collect()} == {"system"}


def test_long_flow(spark):
    steps = " ".join(f"$a{i + 1} = $a{i};" for i in range(19))
    source = fixtures.files(spark, {"/a.php": f"<?php $a0 = $_GET['x']; {steps} system($a19);"})
    assert {r.sink for r in taint.scan(source, "php").collect()} == {"system"}


def test_chains(spark):
    rows = records(fixtures.files(spark, fixtures.CHAIN), "php")
    got = {tuple(r.methods) for r in codedb.chains(rows).collect()}
    assert ("A::__destruct", "B::act", "C::__toString", "D::__call") in got
    kinds = {r.node_type for r in codedb.dataflow(rows).select("node_type").distinct().collect()}
    assert {"newClass", "newMethod", "MethodCall", "FunctionCall", "Assignment", "params"} <= kinds


@pytest.mark.parametrize("language", ["php", "javascript"])
def test_reader_takes_anything(language):
    rng = random.Random(5)
    parts = ["<?php ", "?>", "function ", "f", "(", ")", "{", "}", "[", "]", "$a", "=", ";", "->", ".", "'x", "\"y$z\"", "`", "class A ", "if", "else", ":", "=>", "case", "\n", "/*", "//", "é", "\\", "new ", "return ", "1.5", "?", "??", "switch", "for", "foreach", " as "]
    for _ in range(400):
        read_file("<?php " + "".join(rng.choice(parts) for _ in range(rng.randrange(60))), language)
    assert read_file("", language) == [] and read_file(None, language) == []


def test_manifests(spark):
    got = {(r.language, r.name, r.version, r.ext) for r in manifests.dependencies(fixtures.files(spark, fixtures.MANIFESTS)).collect()}
    assert got == fixtures.DEPENDENCIES
    assert [r.path for r in manifests.manifests(fixtures.files(spark, fixtures.MANIFESTS)).collect()][0] == "/p/go.mod"
    compat = manifests.requirements(fixtures.files(spark, fixtures.MANIFESTS), compat=True)
    assert compat.count() == 6


def test_hits_and_lines(spark):
    f = spark.createDataFrame([("a", "x 1\ny\nz 22 3\n"), ("b", None), ("c", "")], "path string, content string")
    assert [(r.path, r.line, r.text) for r in matching.hits(f, r"\d+").collect()] == [("a", 1, "1"), ("a", 3, "22"), ("a", 3, "3")]
    multi = spark.createDataFrame([("a", "f(\n1)\nf(2)")], "path string, content string")
    assert [(r.line, r.text) for r in matching.hits(multi, r"f\(\s*(\d)\)", group=1).collect()] == [(1, "1"), (3, "2")]


def test_every_rule_compiles(spark):
    f = spark.createDataFrame([("a", "text")], "path string, content string")
    for r in catalog.rule_rows():
        patterns = [p for p in [*r["match"], *r["unmatch"], r["match_name"]] if p and r["match_mode"] != catalog.PATH]
        if r["match_mode"] == catalog.FUNCTION and r["svid"] != 1006:
            patterns = [catalog.call_regex(p, r["language"], r["keyword"] == "is_echo_statement") for p in patterns]
        if r["svid"] == 1006:
            continue  # the pattern has an open bracket: only its function names serve
        for p in patterns:
            f.where(F.col("content").rlike("(?i)" + catalog.java_regex(p.replace("=padding=", "x")))).count()


def test_executescript_rule(spark):
    r = catalog.rule(3011)
    f = spark.createDataFrame([("a", "chrome.tabs.executeScript(id, {code: 'x' + y})"), ("b", "chrome.tabs.executeScript(id, {code: 'x' + JSON.stringify(y)})")], "path string, content string")
    assert [x.path for x in matching.match_and_not(f, r["match"], r["unmatch"]).collect()] == ["a"]


def test_address_zero(spark):
    r = catalog.rule(2100)
    got = matching.names_not_guarded(fixtures.files(spark, fixtures.SOLIDITY), r["match_name"], r["match"], r["unmatch"], r["black_list"])
    assert {x.text for x in got.collect()} == {"to"}


def test_manifest_keywords(spark):
    rows = [("a", '{"permissions": ["tabs", "http://*/*"], "content_scripts": [{"all_frames": true}, {"all_frames": false}]}'), ("b", '{"name": "x"}'), ("c", "{broken")]
    m = spark.createDataFrame(rows, "path string, json string")
    r = catalog.rule(4001)
    assert [(x.path, x.text) for x in matching.manifest_matches(m, r["keyword"], r["match"]).collect()] == [("a", "content_scripts.*.all_frames = true")]
    r = catalog.rule(4004)
    assert {x.path for x in matching.manifest_matches(m, r["keyword"], r["match"]).collect()} == {"a"}
    r = catalog.rule(4002)
    assert {x.path for x in matching.manifest_matches(m, r["keyword"], r["match"]).collect()} == {"a", "b", "c"}


def test_cloc(spark):
    some = {"/a.py": "# c\nx = 1\n'''doc\nmore\n'''\n\n'''one'''\ny = 2\n", "/b.php": "<?php\n// c\n/* a\n b */\necho 1;\n# d\n", "/c.html": "<!-- a\n-->\n<p>\n"}
    got = {r.ext: (r.files, r.blank, r.comment, r.code) for r in corpus.cloc(fixtures.files(spark, some)).collect()}
    assert got[".py"] == (1, 2, 5, 2) and got[".php"] == (1, 1, 4, 2) and got[".html"] == (1, 1, 2, 1)
    assert got["SUM"] == tuple(sum(got[e][i] for e in (".py", ".php", ".html")) for i in range(4))


def test_unzip_and_children(spark):
    import io
    import zipfile

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("manifest.json", '{"content_scripts": [{"js": ["a.js"]}], "background": {"page": "bg.html"}, "web_accessible_resources": ["x.png", "r.js"], "chrome_url_overrides": {"newtab": "n.html"}}')
        z.writestr("a.js", "1")
    table = spark.createDataFrame([("p.crx", bytearray(b"Cr24header" + data.getvalue())), ("bad", bytearray(b"no"))], "path string, content binary")
    members = file_sources.unzip(table)
    assert {(r.path, r.member, r.error is None) for r in members.collect()} == {("p.crx", "manifest.json", True), ("p.crx", "a.js", True), ("bad", None, False)}
    assert [(r.path, r.member, r.error) for r in file_sources.unzip(table.where("path <> 'bad'"), most_members=1).collect()] == [("p.crx", None, "beyond the guards")]
    assert {(r.child, r.kind) for r in file_sources.extension_children(members).collect()} == {("a.js", "js"), ("bg.html", "html"), ("r.js", "js"), ("n.html", "html")}


def test_read_tree(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "A.PHP").write_bytes(b"<?php \xff")
    (tmp_path / "none").write_text("x")
    got = {(r.path.rsplit("/", 1)[-1], r.ext, r["size"]) for r in file_sources.read_tree(spark, str(tmp_path)).collect()}
    assert got == {("A.PHP", ".php", 7), ("none", "no_extension", 1)}


@pytest.mark.parametrize("kind", sinks.FORMATS)
def test_sinks(spark, tmp_path, kind):
    rows = spark.createDataFrame([(1, "t", 'a,"b"\nc')], "id int, target string, code string")
    path = str(tmp_path / kind)
    assert sinks.write(rows, path, kind, sid="s1")
    reader = {"csv": lambda: spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path), "json": lambda: spark.read.json(path),
              "xml": lambda: spark.read.format("xml").option("rowTag", "vul").load(path), "parquet": lambda: spark.read.parquet(path)}[kind]
    assert reader().first().target == "t"
    assert not sinks.write(rows.limit(0), path, kind) and not sinks.write(rows, path, "html")


def test_asof_against_loop(spark):
    rng = random.Random(2)
    defs = [("k%d" % rng.randrange(3), rng.randrange(40), i) for i in range(60)]
    uses = [("k%d" % rng.randrange(4), rng.randrange(40), i) for i in range(60)]
    got = {(r.u, r["def"]) for r in joins.asof(spark.createDataFrame(uses, "k string, line int, u int"), spark.createDataFrame(defs, "k string, line int, def int"), ["k"]).withColumn("def", F.col("def")).collect()}
    for k, line, u in uses:
        best = [d for d in defs if d[0] == k and d[1] < line]
        want = {d[2] for d in best if d[1] == max(x[1] for x in best)} or {None}
        assert {d for uu, d in got if uu == u} <= want


def test_hierarchy_with_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 9)], "a long, b long")
    got = {tuple(r) for r in joins.hierarchy(edges, spark.createDataFrame([(1,)], "root long")).collect()}
    assert got == {(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3)}


def test_scalars(spark):
    lit = F.lit
    assert one(spark, X.duration(lit(59))) == '59"' and one(spark, X.duration(lit(125))) == "2'5\""
    assert one(spark, X.thousands(lit(1234567))) == "1,234,567" and one(spark, X.thousands(lit(None).cast("int"))) == "0"
    assert one(spark, X.percent(lit(1), lit(5))) == "20.0%" and one(spark, X.percent(lit(0), lit(0))) == "0"
    assert one(spark, X.gmt_timestamp(lit("Wed, 05 Feb 2020 01:02:03 GMT"))) == "2020-02-05 01:02:03"
    assert one(spark, X.abstract_version(lit("v1.2 or 1.10.3-beta"))) == "1.10.3" and one(spark, X.abstract_version(lit("none"))) is None
    assert one(spark, X.secure_name(lit("../a b/c?.txt"))) == "a_b_c.txt"
    assert one(spark, X.property_path(lit("f($this->a->b)"))) == ["a", "b"] and one(spark, X.property_path(lit("x"))) == []
    assert one(spark, X.short_path(lit("/a/b"))) == "/a/b"
    with pytest.raises(Exception, match="not a boolean"):
        one(spark, X.to_bool(lit("maybe")))


def test_version_order(spark):
    def le(a, b):
        x, y = ([int(p) for p in v.split(".")] for v in (a, b))
        return x <= y

    rng = random.Random(4)
    pairs = [(".".join(str(rng.randrange(12)) for _ in range(rng.randrange(1, 4))), ".".join(str(rng.randrange(12)) for _ in range(rng.randrange(1, 4)))) for _ in range(200)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", X.version_le(F.col("a"), F.col("b")).alias("le")).collect()
    assert all(r.le == le(r.a, r.b) for r in rows)
    assert one(spark, X.version_le(F.lit("latest"), F.lit("1"))) is False


def test_ignore_and_wildcards(spark):
    f = spark.createDataFrame([("/src/a.php",), ("/lib/b.php",), ("/SRC2/c.js",)], "path string")
    assert {r.path for r in predicates.not_ignored(f, ["/src*/", ""]).collect()} == {"/src/a.php", "/lib/b.php"}
    assert {r.path for r in predicates.not_ignored(f, ["lib/"]).collect()} == {"/src/a.php", "/SRC2/c.js"}
    assert {r.path for r in f.where(predicates.wildcard(F.col("path"), "*.PHP")).collect()} == {"/src/a.php", "/lib/b.php"}


def test_batches_keep_every_package(spark):
    rows = spark.createDataFrame([("python", f"p{i}", "1") for i in range(950)], "language string, name string, version string")
    got = sca.batches(rows, 2).collect()
    assert sum(len(r.packages) for r in got) == 950 and max(len(r.packages) for r in got) <= 2


def test_advisory_payloads(spark):
    def rows(f, payload):
        return f(spark.createDataFrame([("python", "p", "1", payload), ("python", "q", "1", None), ("python", "r", "1", "{bad")], "language string, name string, version string, payload string")).collect()

    r = rows(sca.osv_rows, '{"vulns": [{"id": "G1", "details": "d", "aliases": ["CVE-1", "X"], "references": [{"url": "u"}], "database_specific": {"severity": "HIGH"}}]}')
    assert [(x.vuln_id, x.severity, x.cves, x.reference) for x in r] == [("G1", 8, '["CVE-1"]', '["u"]')]
    r = rows(sca.ossindex_rows, '{"vulnerabilities": [{"id": "o", "title": "t", "cvssScore": 7.5}, {"id": "n", "title": "t"}]}')
    assert [(x.vuln_id, x.severity) for x in r] == [("o", 7), ("n", 5)]
    r = rows(sca.depsdev_rows, '{"advisories": [{"id": "d", "title": "t", "aliases": ["CVE-2"]}]}')
    assert [(x.vuln_id, x.cves) for x in r] == [("d", '["CVE-2"]')]
    r = rows(sca.murphysec_rows, '{"vulns": [{"id": "m", "level": 8, "suggest": "strong"}, {"id": "k", "level": 2, "suggest": "weak"}]}')
    assert [(x.vuln_id, x.severity) for x in r] == [("m", 8), ("k", 0)]


def test_upsert_adds_once(spark):
    new = spark.createDataFrame([(1, 5, "1009", "php", "/a:1", "x", "t", False), (2, 5, "1009", "php", "/a:1", "x", "t", False), (3, 5, "5001", "php", "/a:1", "x", "t", False), (4, 5, "5001", "php", "/a:2", "x", "t", False)],
                                "id long, scan_project_id long, cvi_id string, language string, vulfile_path string, source_code string, result_type string, is_unconfirm boolean")
    hashed = reporting.finding_hash(new)
    stored, added = reporting.finding_upsert(hashed.limit(0), hashed)
    assert added.count() == 2 and stored.count() == 2
    stored, added = reporting.finding_upsert(stored, hashed)
    assert added.count() == 0 and stored.count() == 2


def test_flow_context_and_page(spark):
    f = spark.createDataFrame([("a", "\n".join(f"l{i}" for i in range(1, 21)))], "path string, content string")
    got = reporting.flow_context(spark.createDataFrame([("a", 10)], "path string, line int"), f).first().context
    assert got.splitlines()[0] == "   7: l7" and got.splitlines()[-1] == "  16: l16"
    rows = spark.range(10)
    assert [r.id for r in reporting.page(rows, ["id"], 2, 4).collect()] == [4, 5, 6, 7]
    assert [r.id for r in reporting.page(rows, ["id"], 9, 4, total=10).collect()] == [0, 1, 2, 3]


def test_extractors(spark):
    from siltstone.functions import extractors

    assert extractors.sql_slice("$q = \"SELECT a FROM t WHERE s = '$size' ORDER BY $order LIMIT $limit, $offset;\";") == ["$size", "$order", "$limit", "$offset"]
    assert extractors.sql_slice("{$plan = $odb -> query(\"SELECT x WHERE id = '$id'\") -> f(0);} else {$plan='No';}") == ["$id"]
    assert extractors.sql_slice("{$plan = $odb -> query(\"SELECT x WHERE id = '$id'\") -> f(0)} else {$plan='No';}") == ["$id"]
    assert extractors.sql_slice('$sql = "SELECT a WHERE 1=1 " . $where . " ORDER BY " . $order . ";";') == ["$where", "$order"]
    assert extractors.sql_slice(None) == [] and extractors.sql_slice("no") == []
    assert one(spark, extractors.html_tokens(F.lit(".innerHTML = a.b + 'x' + c"), "innerHTML")) == ["a.b", "c"]
    assert one(spark, extractors.html_tokens(F.lit("x"), "innerHTML")) == ["innerHTML"]
    assert one(spark, extractors.strip_comments(F.lit("a // b\n\"//s\" /* x\ny */ c"))) == "a \n\"//s\" \n c"
    assert one(spark, extractors.pretty_script(F.lit("if(a){b=';';c()}"))) == "if(a){\nb=';';\nc()}"


def test_short_path(spark):
    path = "/impl/src/main/java/com/x/service/mgs/digitalcert/utils/CertUtil.java"
    assert one(spark, X.short_path(F.lit(path))) == "impl/src/.../utils/CertUtil.java"
    assert one(spark, X.short_path(F.lit("/averyveryverylongdirectoryname/averyveryverylongfilename.php"))) == ".../averyveryverylongfilename.php"


def test_scan_end_to_end(spark, tmp_path):
    from siltstone import cli

    (tmp_path / "a.php").write_text("<?php\nsystem($_GET['x']);\n")
    (tmp_path / "config.php").write_text("<?php $password = 'hunter22xyz';")
    (tmp_path / "jquery.js").write_text("eval(location.hash)")
    (tmp_path / "p.html").write_text("<script>document.write(location.hash)</script>")
    got = {(r.svid, r.target.rsplit("/", 1)[-1]) for r in cli.run(spark, ["scan", str(tmp_path)]).collect()}
    assert {(1011, "a.php:2"), (5003, "config.php:0"), (5001, "config.php:1"), (3002, "p.html#0:1")} <= got
    assert not any("jquery" in t for _, t in got)
    assert cli.run(spark, ["show", "rule", "-k", "php"]).count() == 18


def test_properties_stay_in_their_pom(spark):
    def one(v):
        return f"<project><properties><a.v>{v}</a.v></properties><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${{a.v}}</version></dependency></dependencies></project>"

    f = fixtures.files(spark, {"/x/pom.xml": one("2.0"), "/y/pom.xml": one("9.0")})
    assert {(r.path, r.version) for r in manifests.pom(f).collect()} == {("/x/pom.xml", "2.0"), ("/y/pom.xml", "9.0")}
    assert {r.version for r in manifests.pom(f, compat=True).collect()} == {"2.0"}


def test_ancestors_of_any_depth(spark):
    rows = records(fixtures.files(spark, {"/p/a.php": "<?php class A {} class B extends A {} class C extends B {} class D extends C {} class E extends D {}"}), "php")
    up = {(r.cls, r.parent) for r in codedb.ancestors(rows).collect()}
    assert {("E", x) for x in "ABCDE"} <= up and ("A", "B") not in up


def test_chains_have_no_products(spark):
    rows = records(fixtures.files(spark, fixtures.CHAIN), "php")
    deeper, has = codedb.assigned(rows), codedb.inherited(rows)
    steps = codedb.moves(rows, deeper, has)
    for part in (steps, codedb.targets(rows, steps.select("project", "node").distinct(), has), codedb.danger(rows, deeper)):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_calls_of_other_files_stay_apart(spark):
    """Files whose calls have the same numbers: a constant argument in one is no source in another."""
    text = "<?php function f{0}($w) {{ return trim($w); }} system(f{0}({1}));"
    found = taint.scan(fixtures.files(spark, {f"/{i}.php": text.format(i, "$_GET['a']" if i % 2 else "'ls'") for i in range(6)}), "php").collect()
    assert {r.path for r in found} == {"/1.php", "/3.php", "/5.php"}


def test_call_pattern():
    import re

    pattern = taint.call_pattern("run", 1)
    assert [m[1] for m in re.finditer(pattern, "function run($a, $b) {} run(1, $x); rerun(1, $y); run( 2 ,$z )")] == [" $x", "$z "]
    assert re.search(taint.call_pattern("Box", 0, constructed=True), "$o = new Box($p);")[1] == "$p"
    assert re.search(taint.call_pattern("run", 1, optional=1), "run($x)")[1] == "$x"


def test_reports_grow_or_replace(spark, tmp_path):
    one = spark.createDataFrame([("t", 1, 'a, "b"\nc')], "target string, n int, code string")
    assert sinks.write_csv(one, f"{tmp_path}/r.csv") and sinks.write_csv(one.withColumn("extra", F.lit("x")), f"{tmp_path}/r.csv")
    assert not sinks.write_csv(one.limit(0), f"{tmp_path}/r.csv")
    text = (tmp_path / "r.csv").read_text()
    assert text.count("target") == 1 and text.startswith('"target"') and text.count('a, ""b""') == 2
    for sid, n in (("a", 1), ("b", 2), ("a", 3)):
        sinks.write_json(one.withColumn("n", F.lit(n)), f"{tmp_path}/j", sid)
    assert {(r.sid, r.n) for r in spark.read.json(f"{tmp_path}/j").collect()} == {("a", 3), ("b", 2)}


def test_similarity_clusters(spark):
    rows = spark.createDataFrame([("g", 1, "aaaa"), ("g", 2, "aaaa"), ("g", 3, "aaab"), ("g", 4, ""), ("h", 1, ""), ("h", 2, "")], "grp string, k int, content string")
    got = {(r.grp, r.k): (r.ratio, r.cluster) for r in corpus.similar_to_first(rows, "grp", "k").collect()}
    assert got == {("g", 1): (1.0, 1), ("g", 2): (1.0, 1), ("g", 3): (0.75, 2), ("g", 4): (0.0, 3), ("h", 1): (1.0, 1), ("h", 2): (1.0, 1)}


def test_beginnings_join_as_equals(spark):
    rows = spark.createDataFrame([("/a/b/c.php",), ("/a/x.php",), ("plain",), (None,)], "path string")
    some = spark.createDataFrame([("/a/",), ("/a/b/",), ("/z/",)], "dir string")
    assert {(r.path, r.dir) for r in joins.by_prefix(rows, "path", some, "dir").collect()} == {("/a/b/c.php", "/a/"), ("/a/b/c.php", "/a/b/"), ("/a/x.php", "/a/")}


def test_long_chains_and_strings_take_no_stack(spark):
    from siltstone.functions import extractors

    assert one(spark, F.size(X.property_path(F.concat(F.lit("$this"), F.repeat(F.lit("->a"), 100_000))))) == 100_000
    assert one(spark, F.length(extractors.strip_comments(F.concat(F.lit('"'), F.repeat(F.lit("a\\n//"), 50_000), F.lit('" // gone'))))) == 250_003


@pytest.mark.parametrize("source", ["{open}$_GET['a']{close}", "f({open}$_GET['a']{close})", "{call}$_GET['a']{close}"])
def test_deep_expressions_keep_their_flow(spark, source):
    n = 10_000
    text = "<?php $x = " + source.format(open="(" * n, call="trim(" * n, close=")" * n) + "; system($x);"
    assert [r.sink for r in taint.scan(fixtures.files(spark, {"/a.php": text}), "php").collect()] == ["system"]


def test_deep_blocks_are_read():
    rows = read_file("<?php " + "if ($a) { " * 10_000 + "system($_GET['x']);" + " }" * 10_000, "php")
    assert [r["name"] for r in rows if r["rec"] == "arg"] == ["system"] and not [r for r in rows if r["kind"] == "Unknown"]


def test_includes_of_the_same_name_in_other_folders(spark):
    """The file beside the including one is meant; without one, any whose path ends alike."""
    tainted, clean = "<?php $c = $_GET['c'];", "<?php $c = 'ls';"
    tree = {"/x/conf.php": tainted, "/y/conf.php": clean, "/x/a.php": "<?php include 'conf.php'; system($c);", "/y/a.php": "<?php include 'conf.php'; system($c);",
            "/y/b.php": "<?php include __DIR__ . '/../x/conf.php'; system($c);", "/z/a.php": "<?php include './conf.php'; system($c);", "/y/c/d.php": "<?php include '../conf.php'; system($c);", "/lib/k.php": tainted, "/w/a.php": "<?php include 'lib/k.php'; system($c);"}
    assert {r.path for r in taint.scan(fixtures.files(spark, tree), "php").collect()} == {"/x/a.php", "/y/b.php", "/z/a.php", "/w/a.php"}


def test_large_csv_report_is_parts(spark, tmp_path, monkeypatch):
    """Beyond one file's bytes a report is parts that many tasks write; it grows as before, from a file too."""
    monkeypatch.setattr(sinks, "PART_ROWS", 40)
    rows = spark.range(300).select(F.lit("t").alias("target"), F.col("id").alias("n"), F.concat(F.lit('a, "b"\n'), F.col("id").cast("string")).alias("code")).repartition(3)
    path = f"{tmp_path}/r.csv"
    read = lambda: sorted((r.target, int(r.n), r.code) for r in spark.read.options(header=True, quoteAll=True, escape='"', multiLine=True).csv(path).collect())
    want = sorted((r.target, r.n, r.code) for r in rows.collect())
    assert sinks.write_csv(rows.where("n < 10"), path, one_file=1000) and (tmp_path / "r.csv").is_file()
    assert sinks.write_csv(rows.where("n between 10 and 199"), path, one_file=1000) and sinks.write_csv(rows.where("n >= 200"), path, one_file=1000)
    parts = list((tmp_path / "r.csv").glob("part-*"))
    assert len(parts) >= 8 and max(p.read_text().count("t\",") for p in parts) <= 41
    assert read() == want


def test_versions_meet_advisories_as_equals(spark):
    """A name with many versions and many advisories does not bring all pairs together: the plan's join is on the version too."""
    from siltstone.operators import sca

    v = spark.createDataFrame([("A", "1.1"), ("a", "2"), ("a", ""), ("a", None), ("b", "2")], "name string, version string")
    a = spark.createDataFrame([("a", ["1.1", "1.1", "3", None], "x"), ("A", ["2"], "y"), ("b", None, "z")], "vendor_name string, affected_versions array<string>, vuln_id string")
    found = sca.vulnerable(v, a)
    assert sorted((r.name, str(r.version), r.vuln_id) for r in found.collect()) == [("A", "1.1", "x"), ("a", "", "x"), ("a", "", "y"), ("a", "2", "y"), ("a", "None", "x"), ("a", "None", "y")]
    assert "array_contains" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_vendor_joins_are_dealt_by_their_size(spark, tmp_path, monkeypatch):
    """Tasks of the joined view grow with its tables, so that one task's share does not."""
    from siltstone import views

    spark.range(20).selectExpr("id as o_orderkey", "id as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(20).selectExpr("id as p_partkey", "'p' as p_name", "1 as p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(100).selectExpr("id % 20 as l_orderkey", "id % 20 as l_partkey", "1 as l_linenumber", "2.0D as l_quantity", "'A' as l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert views.parts(spark, str(tmp_path), "v_project_vendors") is None
    monkeypatch.setattr(views, "partitions", lambda df: 9)
    found = views.packages(spark, str(tmp_path), "language", "name", "version")
    assert found.count() == 16
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and plan.count(", 9)") >= 4


def test_reader_batches_hold_few_texts(spark):
    from siltstone.plans.parse import records

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    records(spark.createDataFrame([("a.php", "<?php f($x);")], "path string, content string"), "php")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
