"""Source trees made from `documents`: each row becomes a project of its own, /gen/<doc_id>/, holding one
of the cases below behind a comment with the row's whole text.

`§` in a case stands for the row's id, so that names differ between projects.  A case states
its files and what must be found there as (file, line of the case, ...); the queries and their
SQL both start from the table, so found lines move with the line breaks of each text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.corpus import extension
from .operators.joins import dealt
from .views import table

#: name -> (files, findings as (file, line, rule, sink)).
PHP: dict[str, tuple[dict[str, str], list[tuple]]] = {
    "variable argument": ({"a.php": "$a = $_GET['id'];\n$b = $a;\nsystem($b);"}, [("a.php", 3, 1011, "system")]),
    "binary argument": ({"a.php": "$dir = $_GET['d'];\nexec('ls ' . $dir . ' -l');\nexec('ls ' . $none);"}, [("a.php", 2, 1011, "exec")]),
    "property argument": ({"a.php": "class Box§ {\npublic $p;\nfunction __construct($q) { $this->p = $q; }\nfunction go() { system($this->p); }\n}\n$o = new Box§($_GET['y']);"}, [("a.php", 6, 1011, "Box§")]),
    "array offset": ({"a.php": "$arr = ['k' => $_GET['x'], 'j' => 2];\nexec($arr['j']);\npopen($arr['k']);"}, [("a.php", 3, 1011, "popen")]),
    "sanitised call": ({"a.php": "$a = $_GET['id'];\n$b = htmlspecialchars($a);\necho $b;\necho $a;"}, [("a.php", 4, 10002, "echo")]),
    "sanitised number": ({"a.php": "$e = intval($_GET['n']);\nmysql_query('select 1 from t where n=' . $e);\neval($_GET['m']);"}, [("a.php", 3, 1009, "eval")]),
    "ternary": ({"a.php": "$d = $z ? $_GET['a'] : 'ls';\npassthru($d);\n$e = $z ? 'a' : 'b';\npassthru($e);"}, [("a.php", 2, 1011, "passthru")]),
    "branches": ({"a.php": "if ($z) {\n$d = $_GET['a'];\n} elseif ($y) {\n$d = 3;\n} else {\n$d = 2;\n}\nexec($d);"}, [("a.php", 8, 1011, "exec")]),
    "try and catch": ({"a.php": "try {\n$d = $_POST['a'];\n} catch (Exception $e) {\n$d = 2;\n} finally {\n$f = 1;\n}\nsystem($d);\nsystem($f);"}, [("a.php", 8, 1011, "system")]),
    "overwritten": ({"a.php": "$c = $_GET['x'];\n$c = 1;\nsystem($c);\n$c = $_POST['x'];\nsystem($c);"}, [("a.php", 5, 1011, "system")]),
    "concatenation": ({"a.php": "$s = 'ls ';\n$s .= $_GET['d'];\nsystem($s);"}, [("a.php", 3, 1011, "system")]),
    "interpolation": ({"a.php": "$a = $_GET['id'];\n$q = \"ls $a\";\nexec($q);\n$r = 'ls $a';\nexec($r);"}, [("a.php", 3, 1011, "exec")]),
    "internal function": ({"a.php": "$r = trim($_GET['a']);\neval($r);"}, [("a.php", 2, 1009, "eval")]),
    "function return": ({"a.php": "function wrap§($w) {\nreturn trim($w);\n}\n$r = wrap§($_GET['a']);\npassthru($r);\npassthru(wrap§('ls'));"}, [("a.php", 5, 1011, "passthru")]),
    "recursive function": ({"a.php": "function turn§($w) {\nif ($w) { return turn§($w); }\nreturn $w;\n}\nexec(turn§($_GET['a']));"}, [("a.php", 5, 1011, "exec")]),
    "global name": ({"a.php": "$g = $_GET['a'];\nfunction use§() {\nglobal $g;\nsystem($g);\n}"}, [("a.php", 4, 1011, "system")]),
    "loops": ({"a.php": "while ($i) { $d = $_GET['a']; }\nsystem($d);\nfor ($j = 0; $j < 3; $j++) { $f = $_GET['b']; }\nsystem($f);\ndo { $h = 1; } while ($h);\nsystem($h);"}, [("a.php", 2, 1011, "system"), ("a.php", 4, 1011, "system")]),
    "switch": ({"a.php": "switch ($m) {\ncase 1: $d = 1; break;\ndefault: $d = $_COOKIE['a'];\n}\nsystem($d);"}, [("a.php", 5, 1011, "system")]),
    "foreach": ({"a.php": "foreach ($_POST as $k => $v) {\neval($v);\n}"}, [("a.php", 2, 1009, "eval")]),
    "to string": ({"a.php": "class Str§ {\nfunction __toString() { return $_GET['s']; }\n}\n$s = new Str§();\nsystem($s);"}, [("a.php", 5, 1011, "system")]),
    "include": ({"a.php": "include 'conf§.php';\nsystem($conf);\nsystem($safe);", "conf§.php": "$conf = $_GET['c'];\n$safe = 'ls';"}, [("a.php", 2, 1011, "system")]),
    "include by constant": ({"a.php": "define('CONF§', 'conf§.php');\ninclude CONF§;\nsystem($conf);\nsystem($safe);", "conf§.php": "$conf = $_GET['c'];\n$safe = 'ls';"}, [("a.php", 3, 1011, "system")]),
    "include beside": ({"x/a.php": "include 'own§.php';\nsystem($conf);", "y/a.php": "include 'own§.php';\nsystem($conf);", "x/own§.php": "$conf = $_GET['c'];", "y/own§.php": "$conf = 'ls';"}, [("x/a.php", 2, 1011, "system")]),
    "include put together": ({"x/a.php": "define('BASE§', dirname(__FILE__) . '/');\ndefine('LIB§', BASE§ . 'lib/');\ninclude_once (LIB§ . 'own§') . '.php';\nsystem($conf);", "x/lib/own§.php": "$conf = $_GET['c'];", "y/lib/own§.php": "$conf = 'ls';",
                              "y/b.php": "require __DIR__ . '/lib/own§.php';\nsystem($conf);", "y/z/c.php": "include dirname(__DIR__, 2) . DIRECTORY_SEPARATOR . 'x/lib/own§.php';\nsystem($conf);"}, [("x/a.php", 4, 1011, "system"), ("y/z/c.php", 2, 1011, "system")]),
    "derived rule": ({"a.php": "function run§($p) { helper§($p); }\nfunction helper§($q) { eval($q); }\nrun§('1');\nrun§($_COOKIE['z']);"}, [("a.php", 4, 1009, "run§")]),
    "derived position": ({"a.php": "function two§($p, $q) {\nexec($q);\n}\ntwo§($_GET['a'], 'ls');\ntwo§('ls', $_GET['a']);"}, [("a.php", 5, 1011, "two§")]),
    "nothing": ({"a.php": "$a = 'fixed';\nsystem($a);\necho 'x';\neval('1;');"}, []),
}

#: (case, rule, function, argument, the sink it hands on to) of the functions that PHP's cases derive rules from.
DERIVED = [("property argument", 1011, "Box§", 0, "system"), ("derived rule", 1009, "helper§", 0, "eval"), ("derived rule", 1009, "run§", 0, "helper§"), ("derived position", 1011, "two§", 1, "exec")]
#: (case, file, line, function, argument as written) of their calls.
DERIVED_CALLS = [("property argument", "a.php", 6, "Box§", "$_GET['y']"), ("derived rule", "a.php", 1, "helper§", "$p"), ("derived rule", "a.php", 3, "run§", "'1'"), ("derived rule", "a.php", 4, "run§", "$_COOKIE['z']"),
                 ("derived position", "a.php", 4, "two§", " 'ls'"), ("derived position", "a.php", 5, "two§", " $_GET['a']")]

JS: dict[str, tuple[dict[str, str], list[tuple]]] = {
    "variable": ({"a.js": "var a = location.hash;\nlet b = a.substr(1) + 'x';\ndocument.write(b);\ndocument.write('fixed');"}, [("a.js", 3, 3002, "document.write")]),
    "function return": ({"a.js": "var a = location.hash;\nfunction f§(x, y) { return x + y; }\ndocument.write(f§(a, 1));"}, [("a.js", 3, 3002, "document.write")]),
    "assigned member": ({"a.js": "var b = location.search;\nel.innerHTML = `p ${b}`;\nel.innerHTML = 'p';"}, [("a.js", 2, 3005, "el.innerHTML")]),
    "object method": ({"a.js": "var a = location.hash;\nvar o = {k: a, m§: function(z) { eval(z); }};\no.m§(o.k);"}, [("a.js", 3, 3003, "o.m§")]),
    "constant": ({"a.js": "var c = 2;\nel.innerHTML = c;\neval('1');"}, []),
    "closure": ({"a.js": "var a = document.cookie;\n(function(e){\neval(e);\n})(a);"}, [("a.js", 2, 3003, "closure")]),
    "attribute": ({"a.js": "var b = location.hash;\nel.setAttribute('x', b);\nel.setAttribute('x', 'b');"}, [("a.js", 2, 3006, "el.setAttribute")]),
    "another name": ({"a.js": "function g§(x) { return eval(x); }\nvar h§ = g§;\nh§(location.hash);\nh§('1');\nvar w = document.write;\nw(location.search);"}, [("a.js", 3, 3003, "h§"), ("a.js", 6, 3002, "document.write")]),
    "own member": ({"a.js": "var o = {a: location.hash, m: function(z) {\neval(this.a);\n}};\no.m(1);"}, [("a.js", 2, 3003, "eval")]),
    "prototype": ({"a.js": "function F§(x) { this.a = x; }\nF§.prototype.get = function() { return this.a; };\nF§.prototype.run = function(y) { eval(y); };\nfunction G§() { }\nG§.prototype.run = function(y) { return 1; };\nvar f§ = new F§(location.hash), g§ = new G§();\ng§.run(location.hash);\nf§.run(location.hash);\ndocument.write(f§.get());"},
                  [("a.js", 8, 3003, "f§.run"), ("a.js", 9, 3002, "document.write")]),
    "class": ({"a.js": "class A§ { constructor(x) { this.a = x; } run(y) { return y; } go(y) { eval(y); } }\nclass B§ extends A§ { run(y) { eval(y); } }\nvar a§ = new A§(1), b§ = new B§(1);\na§.run(location.hash);\nb§.run(location.hash);\nb§.go(location.hash);"}, [("a.js", 5, 3003, "b§.run"), ("a.js", 6, 3003, "b§.go")]),
    "handed function": ({"a.js": "function each§(cb, v) { cb(v); }\nfunction bad§(p) { eval(p); }\neach§(bad§, location.hash);"}, [("a.js", 3, 3003, "each§")]),
    "evaluated name": ({"a.js": "eval('location.hash');\nsetTimeout('later', 1);\neval('1 + 1');"}, [("a.js", 1, 3003, "eval")]),
    "branches": ({"a.js": "var d;\nif (z) { d = location.hash; } else { d = 1; }\ndocument.write(d);"}, [("a.js", 3, 3002, "document.write")]),
}



#: name -> (files, chains as (entry, methods, sink, line of the case)).
CHAINS: dict[str, tuple[dict[str, str], list[tuple]]] = {
    "through magic": ({"a.php": """class A { public $b; function __destruct() { $this->b->act($this->c); } }
class B { public $x; function act($p) { echo $this->x; } }
class C { public $f; function __toString() { return $this->f->missing(1); } }
class D { public $cmd; function __call($n, $a) { system($this->cmd); } function __wakeup() { $this->cmd = ''; } }"""},
                      [("A::__destruct", "A::__destruct B::act C::__toString D::__call", "system", 4), ("C::__toString", "C::__toString D::__call", "system", 4), ("D::__call", "D::__call", "system", 4)]),
    "inherited over four levels": ({"a.php": """class A { public $v; function act() { eval($this->v); } }
class B extends A { }
class C extends B { }
class D extends C { function __destruct() { $this->act(); } }"""}, [("D::__destruct", "D::__destruct A::act", "eval", 1)]),
    "two files": ({"a.php": "class A { public $h; function __wakeup() { $this->h->close(); } }", "b.php": "class H { public $f;\nfunction close() { call_user_func($this->f, 1); } }"},
                  [("A::__wakeup", "A::__wakeup H::close", "call_user_func", 2)]),
    "harmless": ({"a.php": "class A { public $h; function __destruct() { $this->h->close(); } }\nclass H { function close() { system('ls'); } }"}, []),
    "fixed argument": ({"a.php": "class A { public $b; function __destruct() { $this->b->act('fixed'); } }\nclass B { function act($p) { system($p); } }"}, []),
    "argument handed on": ({"a.php": "class A { public $b; function __destruct() { $this->b->act($this->c, 1); } }\nclass B { function act($p, $q) { $this->d->run($q, $p); } }\nclass D { function run($x, $y) {\nsystem($y);\neval($x); } }"},
                           [("A::__destruct", "A::__destruct B::act D::run", "system", 4)]),
    "local variable": ({"a.php": "class A { function __wakeup() { $x = $this->c; $y = 'a' . $x; $this->b->act($y); } }\nclass B { function act($p) { $q = trim($p);\neval($q); } }"}, [("A::__wakeup", "A::__wakeup B::act", "eval", 3)]),
    "arity": ({"a.php": "class A { function __destruct() { $this->b->act($this->c, 1); $this->b->opt($this->c); } }\nclass B { function act($p) { eval($p); } }\nclass C { function opt($p, $q = 1) {\nsystem($p); } }"},
              [("A::__destruct", "A::__destruct C::opt", "system", 4)]),
    "two ways": ({"a.php": "class A { function __destruct() { $this->b->one(); $this->b->two(); } }\nclass B { function one() { $this->c->run(); } function two() { $this->c->run(); $this->b->one(); } }\nclass C { function run() { eval($this->d); $this->b->one(); } }"},
                 [("A::__destruct", "A::__destruct B::one C::run", "eval", 3), ("A::__destruct", "A::__destruct B::two C::run", "eval", 3), ("A::__destruct", "A::__destruct B::two B::one C::run", "eval", 3)]),
    "called object": ({"a.php": "class A { function __destruct() { $f = $this->f; $f('id'); $g = 'x'; } }\nclass B { function __invoke($p) { system($this->cmd);\neval($p); } }"}, [("A::__destruct", "A::__destruct B::__invoke", "system", 2), ("B::__invoke", "B::__invoke", "system", 2)]),
    "parent method": ({"a.php": "class A { function act($p) { eval($p); } }\nclass B extends A { function act($p) { parent::act($this->v); } function __wakeup() { self::act(1); } }"}, [("B::__wakeup", "B::__wakeup B::act A::act", "eval", 1)]),
}

#: name -> (files, database rows as (file, place below the file, order, source, kind, sink)).
CODE: dict[str, tuple[dict[str, str], list[tuple]]] = {
    "class": ({"a.php": "class Base { public $x; function run($p) { $this->x = $p; return strlen($p); } }"}, [
        ("a.php", "", 1, "Base", "Class", ""), ("a.php", "", 2, "Base", "newClass", ""), ("a.php", ".Class-Base", 3, "$this->x", "Assignment", ""), ("a.php", ".Class-Base", 4, "run", "Method", ""),
        ("a.php", ".Class-Base.Method-run", 5, "run", "newMethod", ""), ("a.php", ".Class-Base.Method-run", 6, "$p", "params", ""), ("a.php", ".Class-Base.Method-run", 7, "$this->x", "Assignment", "$p"),
        ("a.php", ".Class-Base.Method-run", 8, "$this->x", "Assignment", ""), ("a.php", ".Class-Base.Method-run", 9, "strlen", "FunctionCall", "$p"), ("a.php", ".Class-Base.Method-run", 11, "", "Return", ""),
        ("a.php", ".Class-Base.Method-run", 12, "Base::run", "Return", "strlen,$p"), ("a.php", ".Class-Base.Method-run", 13, "return", "FunctionCall", "strlen,$p")]),
    "calls": ({"a.php": "class Kid extends Base { function go() { $this->run(1); Base::make(2); $o = new Kid(); } }"}, [
        ("a.php", "", 1, "Kid", "Class", ""), ("a.php", "", 2, "Kid", "newClass", "Base"), ("a.php", ".Class-Kid", 3, "go", "Method", ""), ("a.php", ".Class-Kid.Method-go", 4, "go", "newMethod", ""),
        ("a.php", ".Class-Kid.Method-go", 5, "run", "MethodCall", ""), ("a.php", ".Class-Kid.Method-go", 7, "run", "Call", ""), ("a.php", ".Class-Kid.Method-go", 8, "Base::make", "StaticMethodCall", ""),
        ("a.php", ".Class-Kid.Method-go", 10, "Base::make", "Call", ""), ("a.php", ".Class-Kid.Method-go", 11, "Kid", "New", ""), ("a.php", ".Class-Kid.Method-go", 12, "$o", "Assignment", "Kid"),
        ("a.php", ".Class-Kid.Method-go", 13, "Kid", "Assignment", "")]),
    "control": ({"a.php": "if ($v) { echo $v; }\nforeach ($v as $k => $w) { call($w); }\nfor ($i = 0; $i < 3; $i++) { while (0) { } }"}, [
        ("a.php", "", 1, "", "If", ""), ("a.php", "", 2, "", "Echo", ""), ("a.php", "", 3, "echo", "FunctionCall", "$v"), ("a.php", "", 5, "", "Foreach", ""), ("a.php", "", 6, "$k", "Assignment", "$v"),
        ("a.php", "", 7, "$w", "Assignment", "$v"), ("a.php", "", 8, "call", "FunctionCall", "$w"), ("a.php", "", 10, "call", "Call", ""), ("a.php", "", 11, "", "For", ""), ("a.php", "", 12, "$i", "Assignment", ""),
        ("a.php", "", 13, "", "While", "")]),
}

#: name -> (files, entrance weights as (file, weight)): definitions and imports -1, control +2, others +1, at top level.
ENTRANCES: dict[str, tuple[dict[str, str], list[tuple]]] = {
    "library": ({"a.php": "function one() { return 1; }\nclass Two { }\nfunction three() { return 3; }"}, [("a.php", -3)]),
    "page": ({"a.php": "include 'lib.php';\nif ($a) { one(); }\nforeach ($b as $c) { two(); }\n$d = 1;"}, [("a.php", 5)]),
    "both": ({"a.php": "function one() { return 1; }\nif ($a) { one(); }"}, [("a.php", 1)]),
}

_POM = """<?xml version="1.0"?><project xmlns="http://m"><parent><groupId>g</groupId><artifactId>par</artifactId><version>9.1</version></parent><version>1.0</version>
<properties><a.v>{v}</a.v></properties><dependencies><dependency><groupId>org.a</groupId><artifactId>core</artifactId><version>${{a.v}}</version></dependency>
<dependency><groupId>h</groupId><artifactId>own</artifactId><version>${{project.version}}</version></dependency><dependency><groupId>n</groupId><artifactId>none</artifactId></dependency></dependencies></project>"""
#: name -> (files, dependencies as (file, language, name, version, ext)).
MANIFESTS: dict[str, tuple[dict[str, str], list[tuple]]] = {
    "pip": ({"requirements.txt": "Django==3.2.§\n# comment\n\nrequests\nflask == 2.0 # web\n"},
            [("requirements.txt", "python", "Django", "3.2.§", None), ("requirements.txt", "python", "requests", None, None), ("requirements.txt", "python", "flask", "2.0", None)]),
    "composer": ({"composer.json": '{"require": {"php": ">=7", "monolog/monolog": "2.§"}, "name": "x"}'}, [("composer.json", "php", "php", ">=7", None), ("composer.json", "php", "monolog/monolog", "2.§", None)]),
    "go": ({"go.mod": "module m\ngo 1.17\nrequire (\n\tgithub.com/a/b v1.2.3 // indirect\n\tgolang.org/x/c v0.1.§\n)\nrequire github.com/d/e v2.0.0\n"},
           [("go.mod", "golang", "github.com/a/b", "v1.2.3", "1.17"), ("go.mod", "golang", "golang.org/x/c", "v0.1.§", "1.17"), ("go.mod", "golang", "github.com/d/e", "v2.0.0", "1.17")]),
    "two poms": ({"x/pom.xml": _POM.format(v="2.§"), "y/pom.xml": _POM.format(v="9.0")}, [
        (f, "java", n, v, None) for f, own in (("x/pom.xml", "2.§"), ("y/pom.xml", "9.0")) for n, v in (("g:par", "9.1"), ("org.a:core", own), ("h:own", "1.0"), ("n:none", None))]),
    "gradle": ({"build.gradle": "plugins {\n id 'java'\n id 'org.boot' version '2.5.§'\n id(\"k.t\") version \"1.6\"\n}\n"}, [("build.gradle", "java", "org.boot", "2.5.§", None), ("build.gradle", "java", "k.t", "1.6", None)]),
    "npm": ({"package.json": '{"name": "app", "version": "1.§", "dependencies": {"lodash": "^4.17.1"}, "devDependencies": {"jest": "27"}}', "broken/package.json": "{not json"},
            [("package.json", "nodejs", "lodash", "^4.17.1", "app 1.§.dependencies"), ("package.json", "nodejs", "jest", "27", "app 1.§.devDependencies")]),
    "pip and maven": ({"requirements.txt": "numpy==1.§\nscipy # any\n", "pom.xml": _POM.format(v="3.§")}, [
        ("requirements.txt", "python", "numpy", "1.§", None), ("requirements.txt", "python", "scipy", None, None),
        *(("pom.xml", "java", n, v, None) for n, v in (("g:par", "9.1"), ("org.a:core", "3.§"), ("h:own", "1.0"), ("n:none", None)))]),
}
#: (case, name, version) that framework detection must give for MANIFESTS.
FRAMEWORK = [("pip", "Django", "3.2.§"), ("pip", "requests", "The latest version"), ("pip", "flask", "2.0"), ("pip and maven", "numpy", "1.§"), ("pip and maven", "scipy", "The latest version"),
             *(("two poms", n, v) for n, v in (("par", "9.1"), ("core", "2.§"), ("core", "9.0"), ("own", "1.0"), ("none", "The latest version")))]

#: name -> (files, findings as (file, code, rule)): rules that need no taint, and advisories.
OTHERS: dict[str, tuple[dict[str, str], list[tuple]]] = {
    "address": ({"a.sol": "contract A {\n function send(address to, uint n) public {\n  to.transfer(n);\n }\n function safe(address who) public {\n  require(who != address(0));\n }\n function balanceOf(address balanceOfX) {}\n}\n"},
                [("a.sol", "to", 2100)]),
    "extension": ({"manifest.json": '{"permissions": ["tabs"], "content_scripts": [{"all_frames": true}]}'},
                  [("manifest.json", "content_scripts.*.all_frames = true", 4001), ("manifest.json", "content-security-policy = None", 4002), ("manifest.json", 'permissions = ["tabs"]', 4004), ("manifest.json", 'permissions = ["tabs"]', 4104)]),
    "configuration": ({"config.php": "$x = 1;"}, [("config.php", "config.php", 5003)]),
    "advisory": ({"requirements.txt": "Django==3.2.1\nflask==2.0\n"}, [("requirements.txt", "Django:3.2.1:ADV-1", 9999)]),
}

#: name -> (files, what custom rules' hits hand on as (file, line, rule, parameters)).
CUSTOM: dict[str, tuple[dict[str, str], list[tuple]]] = {
    "curl": ({"a.php": "$ch = curl_init();\ncurl_setopt($ch, CURLOPT_URL, $url->host);\ncurl_setopt($ch, CURLOPT_TIMEOUT, $t);"}, [("a.php", 2, 1001, "$url->host")]),
    "sql": ({"a.php": "$q = \"select * from t where a=$a and b='\" . $b . \"'\"; $later = 1;\n$r = \"choose $c\";"}, [("a.php", 1, 1004, "$a,$b")]),
    "html": ({"a.js": "el.innerHTML = b;\nel.outerHTML = 'x' + c;\nel.textContent = d;"}, [("a.js", 1, 3005, "b"), ("a.js", 2, 30051, "c")]),
    "attribute": ({"a.js": "el.setAttribute('x',b.c);\n$(el).attr('y',d);"}, [("a.js", 1, 3006, "b.c"), ("a.js", 2, 30061, "d")]),
}

#: Texts of configuration files: addresses with ports, passwords, and both beside what excludes them.
BASE: dict[str, tuple[dict[str, str], list[tuple]]] = {
    "address": ({"a.conf": "host = 'http://10.20.30.40:8080/x'\nother 10.20.30.41:99\n"}, []),
    "local": ({"a.conf": "url http://127.0.0.1:80 and 10.0.0.1:81\n"}, []),
    "password": ({"a.ini": "user = root\npassword = 'hunter§xyz'\nPassword: open§sesame\n"}, []),
    "no password": ({"a.ini": "password = value\n"}, []),
}

OPENS = {"php": ("<?php /*", "*/\n"), "js": ("/*", "*/\n"), "sol": ("/*", "*/\n"), "conf": ("", "\n"), "ini": ("", "\n")}


def _rows(cases: dict) -> list[tuple]:
    """(case, name, source, whether the text comes with it, what opens it, what closes it)."""
    return [(i, name, text, name.rsplit(".", 1)[-1] in OPENS, *OPENS.get(name.rsplit(".", 1)[-1], ("", ""))) for i, (files, _) in enumerate(cases.values()) for name, text in files.items()]


def tree(spark: SparkSession, sf_dir: str, cases: dict) -> DataFrame:
    """files(path, ext, size, content): for each document, the files of case doc_id mod the number of cases."""
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", (F.col("doc_id") % len(cases)).cast("int").alias("case"), F.replace(F.coalesce("text", F.lit("")), F.lit("*/"), F.lit("")).alias("text"))
    own = lambda c: F.replace(c, F.lit("§"), F.col("doc_id").cast("string"))
    some = spark.createDataFrame(_rows(cases), "case int, name string, source string, texts boolean, opens string, closes string")  # a table above
    rows = docs.join(F.broadcast(some), "case")
    rows = rows.select(F.concat(F.lit("/gen/"), F.col("doc_id").cast("string"), F.lit("/"), own("name")).alias("path"),
                       F.concat("opens", F.when(F.col("texts"), F.col("text")).otherwise(""), "closes", own("source")).alias("content"))
    return rows.select("path", extension(F.col("path")).alias("ext"), F.length("content").cast("long").alias("size"), "content")


#: What of a path is its project.
PROJECT = "^/gen/[^/]+/"


def values(rows: list[tuple], names: str) -> str:
    """Rows as a DuckDB table expression."""
    def text(v):
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") AS c({names})"


def own(column: str) -> str:
    return f"replace({column}, '§', d.doc_id::varchar)"


#: DuckDB's path of a case's file, and its line breaks before the case.
PATH = f"'/gen/' || d.doc_id || '/' || {own('c.name')}"
LINES = "(length(coalesce(d.text, '')) - length(replace(coalesce(d.text, ''), chr(10), '')) + 1)"


def expected(cases: dict, names: str, select: str) -> str:
    """SQL over `documents d` and a case's findings c (case_no, the columns `names`)."""
    found = [(i, *row) for i, (_, some) in enumerate(cases.values()) for row in some]
    return f"SELECT {select} FROM documents d JOIN {values(found, 'case_no, ' + names)} ON d.doc_id % {len(cases)} = c.case_no"


def tree_sql(cases: dict) -> str:
    """The tree as a DuckDB query: path, content."""
    return f"""SELECT {PATH} AS path, c.opens || CASE WHEN c.texts THEN replace(coalesce(d.text, ''), '*/', '') ELSE '' END || c.closes || {own('c.source')} AS content
FROM documents d JOIN {values(_rows(cases), 'case_no, name, source, texts, opens, closes')} ON d.doc_id % {len(cases)} = c.case_no"""
