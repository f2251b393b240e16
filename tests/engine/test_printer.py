"""The script printer: tokens stay, lines are those of the source."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.functions import printer
from siltstone.functions.printer import admitted, at_source, by_source, print_by_source, print_scripts, printed
from siltstone.plans.parse import of, records, tokens

PIECES = ["a", "b.c", "f(x, 1)", "'s;{'", "`t ${u}`", "/r[/]}/g", "return", "if (a) { b }", "else", "{", "}", "(", ")", "[", "]", ";", "\n", "+", "-", "++", "--", "!", "=", "=>", "?", ":", ",", "// c\n", "/* d\n */", "function", "in", "new", "1.5", "..."]


def words(text):
    return [(k, t) for k, t, _ in tokens(text, "javascript")]


def test_layout():
    assert printed("var a=1;if(a){f(-a,[1,2]);}else{for(var i=0;i<3;i++)g('x');}") == [
        ("var a = 1;", 1), ("if (a) {", 1), ("    f(-a, [1, 2]);", 1), ("} else {", 1), ("    for (var i = 0; i < 3; i++) g('x');", 1), ("}", 1)]
    assert printed("a = 1\nb = function(x) {\n return x\n}\n(c)\nreturn\nd\n") == [("a = 1", 1), ("b = function (x) {", 2), ("    return x", 3), ("} (c)", 4), ("return", 6), ("d", 7)]


@pytest.mark.parametrize("text", [None, "", "   ", "// only a comment", "\n\n"])
def test_nothing(text):
    assert printed(text) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30))
def test_tokens_and_lines_stay(pieces):
    text = " ".join(pieces)
    out = printed(text)
    source = tokens(text, "javascript")
    at = 0
    for line, number in out:
        own = line.strip(" ")
        assert own and source[at][2] == number
        taken = ""
        while at < len(source) and len(taken) < len(own.replace(" ", "").replace("\n", "")):
            taken += source[at][1].replace(" ", "").replace("\n", "")
            at += 1
        assert taken == own.replace(" ", "").replace("\n", "")
    assert at == len(source)


def test_read_again_gives_the_same_tokens():
    text = "x=a- -b;y=+ +c;z=a++ +b;w=!(-d);q=typeof[1];s=/a/g.test(t)?u:v;class A{m(){return{k:1}}};o={a:[1],b(){}};\nlabel:for(;;){break label}\nlet f=async(x)=>{await x};"
    out = "\n".join(x for x, _ in printed(text))
    assert words(out) == words(text) and printed(out) == [(x, n + 1) for n, (x, _) in enumerate(printed(text))]


def test_deep_blocks_take_no_stack():
    out = printed("{" * 3000 + "a;" + "}" * 3000)
    assert len(out) == 6001 and out[3000] == ("    " * 40 + "a;", 1) and out[2] == ("    " * 2 + "{", 1)


def test_findings_at_source_lines(spark):
    body = "".join(f"function f{i}(x){{y{i}(x);}}" for i in range(6))
    files = spark.createDataFrame([("a.js", "/* one\n two */\n" + body + "\n" + body), ("b.js", "a;"), ("c.js", None)], "path string, content string")
    scripts = print_scripts(files)
    assert sorted(r.path for r in admitted(scripts).collect()) == ["a.js"]
    calls = lambda df: sorted((r.path, r.name, r.line) for r in of(df, "call").collect())
    read = records(admitted(scripts), "javascript")
    assert calls(at_source(read, scripts)) == calls(records(files.where("path = 'a.js'"), "javascript"))
    assert {r.line for r in of(read, "call").collect()} > {2, 5, 8}


def _by_line(rows):
    """The lines of each source line: (source line, first line, how many, lines)."""
    found = {}
    for k, (line, n) in enumerate(rows, 1):
        found.setdefault(n, (k, []))[1].append(line)
    return [(n, k, len(lines), "\n".join(lines)) for n, (k, lines) in found.items()]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*PIECES, "}", "a}", '"', "`", "'", "/", "\\", "/*", "*/", "/[", "]/", "<!--", "foo", "x$", "éa", "1a", "{0}", "%s", "\0", "Zq0qZ", "\r"]), max_size=30), st.booleans())
def test_blocks_of_known_shapes_print_as_token_by_token(pieces, apart):
    text = (" " if apart else "").join(pieces)
    text = f"{text}\n{text.replace('a', 'other')}"
    plain = printer._printed(tokens(text, "javascript"))
    assert printed(text) == plain and by_source(text) == _by_line(plain)


def test_blocks_of_one_shape_are_read_once(monkeypatch):
    read = []
    monkeypatch.setattr(printer, "tokens", lambda text, language: read.append(text) or tokens(text, language))
    printer._PRINTED.clear()
    text = "\n".join(f"if(w_{k}>-1){{out(\"{k}x\",/[/;{{]/g)/*}}*/;}} if(v{k}){{y}}" for k in range(500))
    text = "".join(c for c in text if not c.isdigit() or c == "1")
    assert printed(text) == printer._printed(tokens(text, "javascript"))
    assert sum(map(len, read)) < 0.2 * len(text) and len(printer._PRINTED) < 40


def test_many_shapes_are_not_kept_and_do_not_cost_more(monkeypatch):
    read = []
    monkeypatch.setattr(printer, "tokens", lambda text, language: read.append(text) or tokens(text, language))
    printer._PRINTED.clear()
    text = "".join(f"if(a[{k}]){{b({k});}}" for k in range(3000))
    assert printed(text) == printer._printed(tokens(text, "javascript"))
    assert sum(map(len, read)) < 1.2 * len(text) and len(printer._PRINTED) < 100


def test_lines_by_source_come_without_a_shuffle(spark):
    files = [("a", "var x=1;if(x){f(x);}\ng(`t\n}`);}\n/* } */h(1);"), ("b", ""), ("c", None), ("d", "// }")]
    rows = print_by_source(spark.createDataFrame(files, "path string, content string"))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in rows.collect()] == [("a", *x) for x in _by_line(printer._printed(tokens(files[0][1], "javascript")))]
