"""Small sources of our own for operators whose input the driver's tables do not hold."""

from __future__ import annotations

PHP = {
    "/app/a.php": """<?php
function show($m) { $x = "pre" . $m; echo $x; return $x; }
$a = $_GET['id'];
$b = htmlspecialchars($a);
echo $b;
echo $a;
$c = 1;
system($c);
$c = $_POST['x'];
system($c);
show($a);
function run($p) { helper($p); }
function helper($q) { eval($q); }
run($_COOKIE['z']);
$r = wrap($a); passthru($r);
function wrap($w) { return trim($w); }
$q = "select * from t where id=$a"; mysql_query($q);
if ($z) { $d = $a; } else { $d = 2; } exec($d);
foreach ($_POST as $k => $v) { eval($v); }
class A { public $p; function __construct($q) { $this->p = $q; } function go() { system($this->p); } }
$o = new A($_GET['y']);
curl_setopt($ch, CURLOPT_URL, $a);
$arr = ['k' => $_GET['x'], 'j' => 2]; exec($arr['j']); popen($arr['k']);
include $a . ".php";
unserialize($unknown);
$e = intval($_GET['n']); mysql_query("select 1 from t where n=" . $e);
""",
    "/app/b.php": "<?php include 'conf.php'; system($conf); system($safe);",
    "/app/conf.php": "<?php $conf = $_GET['c']; $safe = 'ls';",
}
#: (path, line, svid) that PHP must give.
PHP_FINDINGS = {
    ("/app/a.php", 6, 10002), ("/app/a.php", 10, 1011), ("/app/a.php", 11, 10002), ("/app/a.php", 14, 1009), ("/app/a.php", 15, 1011), ("/app/a.php", 17, 1004), ("/app/a.php", 17, 1005), ("/app/a.php", 18, 1011),
    ("/app/a.php", 19, 1009), ("/app/a.php", 21, 1011), ("/app/a.php", 22, 1001), ("/app/a.php", 23, 1011), ("/app/a.php", 24, 1007), ("/app/b.php", 1, 1011),
}

JS = {"/app/a.js": """var a = location.hash; let b = a.substr(1) + "x";
function f(x, y) { return x + y; }
document.write(f(b, 1));
el.innerHTML = `p ${b}`;
var o = {k: a, m: function(z) { eval(z); }};
o.m(o.k);
var c = 2;
$("#x").html(c);
(function(e){ eval(e) })(a);
el.setAttribute('x', b);
"""}
JS_FINDINGS = {("/app/a.js", 3, 3002), ("/app/a.js", 4, 3005), ("/app/a.js", 6, 3003), ("/app/a.js", 9, 3003), ("/app/a.js", 10, 3006)}

CHAIN = {"/app/c.php": """<?php
class A { public $b; function __destruct() { $this->b->act($this->c); } }
class B { public $x; function act($p) { echo $this->x; } }
class C { public $f; function __toString() { return $this->f->missing(1); } }
class D { public $cmd; function __call($n, $a) { system($this->cmd); } function __wakeup() { $this->cmd = ''; } }
"""}

MANIFESTS = {
    "/p/requirements.txt": "Django==3.2.1\n# comment\n\nrequests\nflask == 2.0 # web\n",
    "/p/composer.json": '{"require": {"php": ">=7", "monolog/monolog": "2.0"}, "name": "x"}',
    "/p/go.mod": "module m\ngo 1.17\nrequire (\n\tgithub.com/a/b v1.2.3 // indirect\n\tgolang.org/x/c v0.1.0\n)\nrequire github.com/d/e v2.0.0\n",
    "/p/pom.xml": """<?xml version="1.0"?><project xmlns="http://m"><parent><groupId>g</groupId><artifactId>par</artifactId><version>9.1</version></parent><version>1.0</version>
<properties><spring.version>5.3.1</spring.version></properties><dependencies><dependency><groupId>org.springframework</groupId><artifactId>core</artifactId><version>${spring.version}</version></dependency>
<dependency><groupId>h</groupId><artifactId>own</artifactId><version>${project.version}</version></dependency><dependency><groupId>n</groupId><artifactId>none</artifactId></dependency></dependencies></project>""",
    "/q/build.gradle": "plugins {\n id 'java'\n id 'org.boot' version '2.5.0'\n id(\"k.t\") version \"1.6\"\n}\n",
    "/q/package.json": '{"name": "app", "version": "1.1", "dependencies": {"lodash": "^4.17.1"}, "devDependencies": {"jest": "27"}}',
    "/q/broken/package.json": "{not json",
}
DEPENDENCIES = {
    ("python", "Django", "3.2.1", None), ("python", "requests", None, None), ("python", "flask", "2.0", None), ("php", "php", ">=7", None), ("php", "monolog/monolog", "2.0", None),
    ("golang", "github.com/a/b", "v1.2.3", "1.17"), ("golang", "golang.org/x/c", "v0.1.0", "1.17"), ("golang", "github.com/d/e", "v2.0.0", "1.17"),
    ("java", "g:par", "9.1", None), ("java", "org.springframework:core", "5.3.1", None), ("java", "h:own", "1.0", None), ("java", "n:none", None, None), ("java", "org.boot", "2.5.0", None), ("java", "k.t", "1.6", None),
    ("nodejs", "lodash", "^4.17.1", "app 1.1.dependencies"), ("nodejs", "jest", "27", "app 1.1.devDependencies"),
}

SOLIDITY = {"/s/a.sol": "contract A {\n function send(address to, uint n) public {\n  to.transfer(n);\n }\n function safe(address who) public {\n  require(who != address(0));\n }\n function balanceOf(address balanceOfX) {}\n}\n"}


def files(spark, table: dict[str, str]):
    """A table of sources as files(path, ext, size, content)."""
    from pyspark.sql import functions as F

    from siltstone.operators.corpus import extension

    rows = spark.createDataFrame(list(table.items()), "path string, content string")
    return rows.select("path", extension(F.col("path")).alias("ext"), F.length("content").cast("long").alias("size"), "content")
