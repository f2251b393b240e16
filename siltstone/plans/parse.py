"""PHP and JavaScript sources to normalised tables.

A tolerant recursive-descent reader turns each file into records: definitions,
calls, returns, formal parameters, includes, classes and nodes.  An expression
becomes its *flow*: the leaves that its value may come from, each with the
functions that it passes through.  So taint is joins over tables, not tree walks.

A construct that is not understood gives an Unknown node and the reader goes on
after it; a file is never dropped.  Nothing is kept between files.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import small_batches

FLOW = "array<struct<kind:string,name:string,key:string,through:array<string>,call:int>>"
SCHEMA = f"path string, rec string, scope string, cls string, name string, key string, line int, ord int, kind string, branch string, pos int, id int, flow {FLOW}"
_LEAF = pa.struct([("kind", pa.string()), ("name", pa.string()), ("key", pa.string()), ("through", pa.list_(pa.string())), ("call", pa.int32())])
_COLUMNS = (("rec", pa.string()), ("scope", pa.string()), ("cls", pa.string()), ("name", pa.string()), ("key", pa.string()), ("line", pa.int32()), ("ord", pa.int32()), ("kind", pa.string()),
            ("branch", pa.string()), ("pos", pa.int32()), ("id", pa.int32()), ("flow", pa.list_(_LEAF)))

_OPS = ("<<<=", ">>>=", "===", "!==", "**=", "...", "<=>", "??=", "&&=", "||=", ">>>", "<<=", ">>=", "?->", "->", "=>", "::", "==", "!=", "<>", "<=", ">=", "&&", "||", "??", "?.", "++", "--", "+=", "-=", "*=", "/=", ".=", "%=", "&=", "|=", "^=", "<<", ">>", "**")
_ALONE = "-+*/%=<>!.?:;,(){}[]&|^~@#\\$`"
# by their first character, longer ones first
_OP = "[" + re.escape("".join(c for c in _ALONE if not any(o[0] == c for o in _OPS))) + "]|" + "|".join(re.escape(c) + "(?:" + "|".join(re.escape(o[1:]) for o in _OPS if o[0] == c) + ")?" for c in _ALONE if any(o[0] == c for o in _OPS))
_PHP = re.compile(rf"""\s*+(?:(?P<str>'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|`[^`\\]*+(?:\\.[^`\\]*+)*+`)|(?P<var>\$[A-Za-z_\x80-￿][\w\x80-￿]*)|(?P<num>\d[\w.]*)|(?P<id>\\?[A-Za-z_\x80-￿][\w\x80-￿]*(?:\\[A-Za-z_]\w*)*)|(?P<close>\?>)
|(?P<comment>//[^\n]*?(?=\n|\?>|$)|\#(?!\[)[^\n]*?(?=\n|\?>|$)|/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/)?)|(?P<doc><<<[ \t]*(?P<q>['"]?)(?P<tag>\w+)(?P=q)\r?\n.*?\n[ \t]*(?P=tag)\b)|(?P<op>{_OP})|(?P<bad>.?))""", re.S | re.X)
_JS = re.compile(rf"""\s*+(?:(?P<num>\d[\w.]*)|(?P<id>[A-Za-z_$\x80-￿][\w$\x80-￿]*)|(?P<str>'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+")|(?P<comment>//[^\n]*|/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/)?|<!--[^\n]*)|(?P<tpl>`[^`\\]*+(?:\\.[^`\\]*+)*+`)|(?P<op>{_OP})|(?P<bad>.?))""", re.S | re.X)
_OPEN = re.compile(r"<\?(?:php\b|=)?")
# plain texts joined by dots on one line, after the first, and the texts in them
_RUN, _PLAIN = re.compile(r"(?:[ \t]*+\.[ \t]*+'[^'\\\n]*+')++"), re.compile(r"'[^']*+'")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_INTERPOLATED = re.compile(r"\$(\w+)(?:\[['\"]?(\w+)['\"]?\]|->(\w+))?")
_SQL = re.compile(r"\s*(select|insert|update|delete)\s", re.I)
_COMPARE = {"==", "===", "!=", "!==", "<", ">", "<=", ">=", "<>", "<=>", "instanceof", "in", "of"}
_LOGIC = {"&&", "||", "and", "or", "xor"}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", ".=", "%=", "&=", "|=", "^=", "<<=", ">>=", "**=", "??=", "&&=", "||=", ">>>="}
_SPECIAL = {"echo", "print", "eval", "include", "include_once", "require", "require_once", "exit", "die", "return", "isset", "empty", "unset", "list", "array"}


#: Calls in each other's arguments that are read one by one; the flow of so many has some thousands of leaves.
CALL_DEPTH = 120


class Stop(Exception):
    pass


def tokens(text: str, language: str) -> list[tuple[str, str, int]]:
    """(kind, text, line); text outside of <?php is one html token."""
    out, line = [], 1
    add, at, n = out.append, 0, len(text)
    breaks = text.find("\n")  # the next line break
    breaks = n if breaks < 0 else breaks
    if language == "php":
        while at < n:
            begin = _OPEN.search(text, at)
            if not begin:
                break
            at = begin.end()
            while breaks < at:
                line += 1
                breaks = text.find("\n", breaks + 1)
                breaks = n if breaks < 0 else breaks
            if begin[0] == "<?=":
                add(("id", "echo", line))
            inside = True
            while inside:
                inside = False
                for m in _PHP.finditer(text, at):
                    kind, at = m.lastgroup, m.end()
                    part = m[kind]
                    begun = at - len(part)
                    while breaks < begun:
                        line += 1
                        breaks = text.find("\n", breaks + 1)
                        breaks = n if breaks < 0 else breaks
                    if kind == "op" or kind == "var" or kind == "id" or kind == "num":
                        add((kind, part, line))
                    elif kind == "str":
                        add((kind, part, line))
                        if run := _RUN.match(text, at):  # read at once
                            while breaks < at:
                                line += 1
                                breaks = text.find("\n", breaks + 1)
                                breaks = n if breaks < 0 else breaks
                            at, dot = run.end(), ("op", ".", line)
                            out += [x for part in _PLAIN.findall(run[0]) for x in (dot, ("str", part, line))]
                            inside = True
                            break
                    elif kind == "close":
                        add(("op", ";", line))
                        break
                    elif kind == "doc":
                        add(("doc", part, line))
                else:
                    return out  # only blanks are left
        return out
    while at < n:
        for m in _JS.finditer(text, at):
            kind, at = m.lastgroup, m.end()
            part = m[kind]
            begun = at - len(part)
            while breaks < begun:
                line += 1
                breaks = text.find("\n", breaks + 1)
                breaks = n if breaks < 0 else breaks
            if part[:1] == "/" and (not out or out[-1][0] == "op" and out[-1][1] not in (")", "]", "}") or out[-1][1] in ("return", "typeof", "case")):
                if r := _REGEX.match(text, begun):
                    add(("str", r[0], line))
                    at = r.end()
                    break
            if kind != "comment" and kind != "bad":
                add((kind, part, line))
        else:
            break
    return out


def leaf(kind, name, key=None, through=(), call=None):
    return {"kind": kind, "name": name, "key": key, "through": list(through), "call": call}


def text_parts(tokens: list[tuple[str, str, int]]) -> list[dict] | None:
    """The leaves of a concatenation of texts, constants and the file's own folder, in order; None for anything else.

    A leaf of kind `dir` counts in its key how many last parts are taken off the file's path: __FILE__ 0, __DIR__ 1, dirname() one more.
    """
    levels: list[list[dict]] = [[]]
    heads: list[bool] = []
    for kind, text, _ in tokens:
        here, low = levels[-1], text.lower()
        if kind == "str" and (text[0] == "'" or text[0] == '"' and "$" not in text):
            here.append(leaf("str", re.sub(r"\\([\\'\"])", r"\1", text[1:-1])))
        elif kind == "id" and low in ("__file__", "__dir__"):
            here.append(leaf("dir", "", str(int(low == "__dir__"))))
        elif kind == "id" and low == "directory_separator":
            here.append(leaf("str", "/"))
        elif kind == "id":
            here.append(leaf("const", text.lstrip("\\")))
        elif kind == "op" and text == "(":
            heads.append(bool(here) and here[-1]["kind"] == "const" and here[-1]["name"].lower() == "dirname")
            if heads[-1]:
                here.pop()
            elif here and here[-1]["kind"] != "." and here[-1]["kind"] != "(":
                return None  # a call of anything else
            levels.append([])
        elif kind == "op" and text == ")" and heads:
            inner = [x for x in levels.pop() if x["kind"] != "."]
            if heads.pop():
                up = int(inner[2]["name"]) if len(inner) == 3 and inner[1]["kind"] == "," and inner[2]["kind"] == "num" and inner[2]["name"].isdigit() else 1 if len(inner) == 1 else 0
                if not up or inner[0]["kind"] != "dir":
                    return None
                inner = [leaf("dir", "", str(int(inner[0]["key"]) + up))]
            levels[-1].extend(inner)
        elif kind == "op" and text == ".":
            here.append(leaf(".", ""))
        elif heads and heads[-1] and (kind == "num" or text == ","):
            here.append(leaf("num" if kind == "num" else ",", text))
        else:
            return None
    found = [x for x in levels[0] if x["kind"] != "."]
    return found if len(levels) == 1 and found and all(x["kind"] in ("str", "dir", "const") for x in found) else None


class Reader:
    """Reads one file."""

    def __init__(self, text: str, language: str):
        self.php = language == "php"
        self.t = tokens(text, language)
        self.i = self.ids = self.ord = self.branches = 0
        self.scope, self.cls, self.branch, self.depth = "", "", "", 0
        self.rows: list[dict] = []
        self.pending: list[tuple] = []

    # ------------------------------------------------------------ tokens
    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k][1] if self.i + k < len(self.t) else ""

    def kind(self, k: int = 0) -> str:
        return self.t[self.i + k][0] if self.i + k < len(self.t) else "end"

    def kind_at(self, at: int) -> str:
        return self.t[at][0] if at < len(self.t) else "end"

    def text_at(self, at: int) -> str:
        return self.t[at][1] if at < len(self.t) else ""

    def line(self) -> int:
        return self.t[min(self.i, len(self.t) - 1)][2] if self.t else 0

    def low(self, k: int = 0) -> str:
        return self.peek(k).lower() if self.php else self.peek(k)

    def take(self) -> str:
        if self.i >= len(self.t):
            raise Stop
        self.i += 1
        return self.t[self.i - 1][1]

    def accept(self, *texts: str) -> bool:
        if self.kind() != "str" and self.low() in texts and self.i < len(self.t):
            self.i += 1
            return True
        return False

    def skip_group(self) -> None:
        """Past a bracketed group that begins here."""
        level = 0
        while self.i < len(self.t):
            kind, text, _ = self.t[self.i]
            self.i += 1
            if kind == "op":
                level += (text in "([{") - (text in ")]}")
                if level <= 0:
                    return

    # ------------------------------------------------------------ records
    def add(self, rec, name="", key=None, kind="", pos=None, id_=None, flow=(), line=None, scope=None, cls=None):
        self.ord += 1
        self.rows.append({"rec": rec, "scope": self.scope if scope is None else scope, "cls": self.cls if cls is None else cls, "name": name, "key": key, "line": self.line() if line is None else line,
                          "ord": self.ord, "kind": kind, "branch": self.branch, "pos": pos, "id": id_, "flow": list(flow)})

    def texts(self, kind: str, name: str, at: int, line: int) -> bool:
        """Notes what the expression from token `at` on is put together from, if that is texts and constants alone."""
        level, end = 0, at
        while end < len(self.t):
            token, text, _ = self.t[end]
            if token == "op":
                level += (text in "([{") - (text in ")]}")
                if level < 0 or not level and text in (";", ",", "||", "&&"):
                    break
            elif token == "id" and text.lower() in _LOGIC:
                break
            end += 1
        parts = text_parts(self.t[at:end])
        if parts:
            self.rows.append({"rec": "path", "scope": self.scope, "cls": self.cls, "name": name, "key": None, "line": line, "ord": self.ord, "kind": kind, "branch": self.branch, "pos": None, "id": None, "flow": parts})
        return bool(parts)

    def call(self, name, kind, args, line) -> int:
        self.ids += 1
        own = self.ids
        self.add("call", name, kind=kind, id_=own, line=line, pos=len(args), flow=[x for a in args for x in a])
        for pos, flow in enumerate(args):
            self.add("arg", name, kind=kind, pos=pos, id_=own, flow=flow, line=line)
        return own

    def called(self, name, kind, args, line) -> list[dict]:
        """The flow of a call's value: the call itself, and its arguments through it."""
        own = self.call(name, kind, args, line)
        through = [x | {"through": [*x["through"], name]} for a in (args[:1] if name == "array_map" else args) for x in a]
        return [leaf("call", name, call=own), *through]

    # ------------------------------------------------------------ statements
    def read(self) -> list[dict]:
        while self.i < len(self.t):
            at = self.i
            try:
                self.statement()
            except Stop:
                break
            except (IndexError, RecursionError):
                self.add("node", kind="Unknown", pos=self.depth)
            if self.i == at:
                self.i += 1
        return self.rows

    def block(self, ends=()) -> None:
        """One statement, a block, or PHP's colon form up to one of `ends`."""
        self.depth += 1
        if self.accept("{"):
            while self.i < len(self.t) and not self.accept("}"):
                self.step()
        elif self.php and ends and self.accept(":"):
            while self.i < len(self.t) and self.low() not in ends:
                self.step()
        else:
            self.step()
        self.depth -= 1

    def step(self) -> None:
        at = self.i
        self.statement()
        if self.i == at:
            self.i += 1

    def arm(self, ends=()) -> None:
        """A block that may not run."""
        old = self.branch
        self.branches += 1
        self.branch = f"{old}/{self.branches}"
        self.block(ends)
        self.branch = old

    def group(self) -> list[dict]:
        """(expression)"""
        if not self.accept("("):
            return []
        flow = [] if self.peek() == ")" else self.expression()
        while self.i < len(self.t) and not self.accept(")"):
            at = self.i
            self.expression()
            if self.i == at:
                self.i += 1
        return flow

    def statement(self) -> None:
        word, line = self.low(), self.line()
        if self.kind() in ("str", "doc", "tpl", "num"):
            word = ""
        node = lambda kind, name="": self.add("node", name, kind=kind, pos=self.depth, line=line)
        if self.accept(";"):
            return
        if word == "{":
            self.block()
        elif word in ("if", "elseif") and self.take():
            node("If")
            self.group()
            ends = ("elseif", "else", "endif")
            self.arm(ends)
            while self.low() in ("else", "elseif"):
                if self.accept("elseif"):
                    self.group()
                    self.arm(ends)
                else:
                    self.take()
                    if self.low() == "if" and self.take():
                        self.group()
                    self.arm(ends)
            if self.accept("endif"):
                self.accept(";")
        elif word == "while" and self.take():
            node("While")
            self.group()
            self.arm(("endwhile",))
            if self.accept("endwhile"):
                self.accept(";")
        elif word == "do" and self.take():
            node("DoWhile")
            self.block()
            if self.accept("while"):
                self.group()
        elif word == "for" and self.take():
            node("For")
            self.for_head()
            self.arm(("endfor",))
            if self.accept("endfor"):
                self.accept(";")
        elif self.php and word == "foreach" and self.take():
            node("Foreach")
            self.foreach_head()
            self.arm(("endforeach",))
            if self.accept("endforeach"):
                self.accept(";")
        elif word == "switch" and self.take():
            node("Switch")
            self.group()
            self.accept("{") or self.accept(":")
            self.depth += 1
            while self.i < len(self.t) and not self.accept("}", "endswitch"):
                if self.accept("case"):
                    self.expression()
                    self.accept(":") or self.accept(";")
                elif self.accept("default"):
                    self.accept(":") or self.accept(";")
                else:
                    old, self.branches = self.branch, self.branches + 1
                    self.branch = f"{old}/{self.branches}"
                    self.step()
                    self.branch = old
            self.depth -= 1
        elif word == "try" and self.take():
            node("Try")
            self.block()
            while self.low() in ("catch", "finally"):
                if self.accept("catch"):
                    if self.peek() == "(":
                        self.skip_group()
                    self.arm()
                else:
                    self.take()
                    self.block()
        elif word in ("abstract", "final", "public", "private", "protected", "static", "var", "readonly", "async", "export") and self.modifiers(word):
            return
        elif word == "function" and (self.kind(1) == "id" or self.peek(1) in ("&", "*")):
            self.take()
            self.function(None)
        elif word in ("class", "interface", "trait") and self.kind(1) == "id" and self.take():
            self.class_(word)
        elif self.php and word in ("namespace", "use") and self.take():
            node("Namespace" if word == "namespace" else "Use", self.peek())
            while self.i < len(self.t) and self.peek() not in (";", "{"):
                self.take()
            if word == "use" and self.peek() == "{":
                self.skip_group()
        elif word in ("return", "throw", "yield") and self.take():
            flow = [] if self.peek() in (";", "}") else self.expression()
            node("Return" if word == "return" else "Throw")
            if word == "return":
                self.add("return", self.scope, flow=flow, line=line)
                self.call("return", "special", [flow], line)
            self.accept(";")
        elif self.php and word in ("echo", "print") and self.peek(1) != "->" and self.take():
            args = [self.expression()]
            while self.accept(","):
                args.append(self.expression())
            node("Echo")
            self.call(word, "special", args, line)
            self.accept(";")
        elif self.php and word == "global" and self.take():
            node("Global")
            while self.kind() == "var":
                self.add("def", self.take(), kind="global", line=line)
                self.accept(",")
        elif self.php and word in ("const",) and self.take():
            node("Constant", self.peek())
            if not self.cls and self.kind() == "id" and self.peek(1) == "=":
                self.texts("define", self.peek(), self.i + 2, line)
            while self.i < len(self.t) and not self.accept(";"):
                self.take()
        elif not self.php and word in ("let", "const", "var") and self.take():
            self.declare()
        elif word in ("break", "continue", "goto") and self.take():
            while self.i < len(self.t) and self.peek() not in (";", "}") and self.line() == line:
                self.take()
        else:
            flow_at = len(self.rows)
            self.expression()
            fresh = self.rows[flow_at:]
            node("Assignment" if any(r["rec"] == "def" for r in fresh) else "Call" if any(r["rec"] == "call" for r in fresh) else "Expression", next((r["name"] for r in fresh if r["rec"] in ("def", "call")), ""))
            self.accept(";")

    def modifiers(self, word: str) -> bool:
        """Class members and modified declarations; False leaves the statement as it is."""
        if not self.php and word in ("var", "static"):
            return False
        at = self.i
        while self.low() in ("abstract", "final", "public", "private", "protected", "static", "var", "readonly", "async", "export", "default"):
            self.take()
        if self.low() in ("function", "class", "interface", "trait"):
            self.statement()
            return True
        if self.php and self.low() == "const":
            self.statement()
            return True
        if self.php and self.kind() in ("id", "op") and self.kind(1) == "var" and self.low() != "(":
            self.take()
        if self.php and self.kind() == "var":
            while self.kind() == "var":
                name, line = self.take(), self.line()
                flow = self.expression() if self.accept("=") else []
                if self.cls and not self.scope.rpartition("::")[2]:
                    self.add("def", "$this->" + name[1:], kind="property", flow=flow, line=line)
                else:
                    self.add("def", name, kind="assign", flow=flow, line=line)
                self.accept(",")
            self.accept(";")
            return True
        if word in ("async", "export"):
            self.statement()
            return True
        self.i = at
        return False

    def for_head(self) -> None:
        if not self.accept("("):
            return
        if not self.php and self.low() in ("var", "let", "const"):
            self.take()
        if not self.php and self.kind() == "id" and self.peek(1) in ("in", "of"):
            name, line = self.take(), self.line()
            self.take()
            self.add("def", name, kind="foreach", flow=self.expression(), line=line)
        while self.i < len(self.t) and not self.accept(")"):
            if not self.accept(";", ","):
                at = self.i
                self.expression()
                if self.i == at:
                    self.i += 1

    def foreach_head(self) -> None:
        if not self.accept("("):
            return
        line, flow = self.line(), self.expression()
        if self.accept("as"):
            names = []
            while self.i < len(self.t) and self.peek() != ")":
                if self.kind() == "var":
                    names.append(self.peek())
                self.take()
            for name in names:
                self.add("def", name, kind="foreach", flow=flow, line=line)
        self.accept(")")

    def declare(self) -> None:
        while self.i < len(self.t):
            names = []
            line = self.line()
            if self.peek() in ("{", "["):
                level = 0
                while self.i < len(self.t):
                    text = self.take()
                    level += (text in ("{", "[")) - (text in ("}", "]"))
                    if self.t[self.i - 1][0] == "id":
                        names.append(text)
                    if level == 0:
                        break
            elif self.kind() == "id":
                names.append(self.take())
            flow = self.assigned(names[0]) if names and self.accept("=") else []
            for name in names:
                self.add("def", name, kind="assign", flow=flow, line=line)
            self.members()
            if not self.accept(","):
                break
        self.add("node", kind="Assignment", pos=self.depth)
        self.accept(";")

    def assigned(self, name: str) -> list[dict]:
        """The right side of an assignment to `name`; a function there takes the name."""
        self.alias = name
        flow = self.expression()
        self.alias = None
        return flow

    alias: str | None = None
    nested = 0

    def function(self, name: str | None, arrow: bool = False) -> str:
        """Parameters and body after `function`; returns the scope's name."""
        line = self.line()
        self.accept("&") or self.accept("*")
        if name is None:
            name = self.take() if self.kind() == "id" else f"closure@{line}_{self.ids + 1}"
        self.ids += 1
        full = f"{self.cls}::{name}" if self.cls else name
        self.add("node", name, kind="Method" if self.cls else "Function", pos=self.depth, line=line)
        self.add("function", name, scope=full, kind="method" if self.cls else "function", line=line, id_=self.ids)
        old = self.scope, self.branch, self.depth
        outer = self.scope
        self.scope, self.branch = full, ""
        if self.peek() == "(":
            self.parameters()
        elif arrow and self.kind() == "id":
            self.add("param", self.take(), pos=0)
        if self.php and self.accept("use") and self.peek() == "(":
            while self.i < len(self.t) and not self.accept(")"):
                if self.kind() == "var":
                    self.add("def", self.peek(), kind="outer", key=outer)
                self.take()
        if self.accept(":"):
            while self.i < len(self.t) and self.peek() not in ("{", ";", "=>"):
                self.take()
        if self.accept("=>") and self.peek() != "{":
            at = self.line()
            flow = self.expression()
            self.add("return", full, flow=flow, line=at)
        elif self.peek() == "{":
            self.block()
        else:
            self.accept(";")
        self.add("function_end", name, scope=full)
        self.scope, self.branch, self.depth = old
        return full

    def parameters(self) -> None:
        self.take()
        pos, level = 0, 1
        while self.i < len(self.t) and level:
            kind, text, _ = self.t[self.i]
            if kind == ("var" if self.php else "id") and level == 1 and (self.php or self.peek(-1) in ("(", ",", "...")):
                self.add("param", text, pos=pos, kind="rest" if self.peek(-1) == "..." else "optional" if self.peek(1) == "=" else "")
                pos += 1
            level += (kind == "op" and text in "([{") - (kind == "op" and text in ")]}")
            self.i += 1

    def class_(self, word: str) -> None:
        name, line = self.take(), self.line()
        parents = []
        while self.i < len(self.t) and self.peek() != "{":
            text = self.take()
            if text.lower() not in ("extends", "implements", ","):
                parents.append(text)
        self.add("node", name, kind="Class" if word == "class" else word.title(), pos=self.depth, line=line)
        self.add("class", name, key=",".join(parents), kind=word, line=line)
        old = self.cls, self.scope, self.branch
        self.cls, self.scope, self.branch = name, f"{name}::", ""
        if self.accept("{"):
            self.depth += 1
            while self.i < len(self.t) and not self.accept("}"):
                at = self.i
                if not self.php and self.kind() == "id" and self.peek(1) == "(" and self.low() not in ("if", "for", "while", "switch"):
                    self.function(self.take())
                elif not self.php and self.low() in ("static", "async", "get", "set") and self.kind(1) == "id":
                    self.take()
                else:
                    self.statement()
                if self.i == at:
                    self.i += 1
            self.depth -= 1
        self.cls, self.scope, self.branch = old

    # ------------------------------------------------------------ expressions
    def expression(self) -> list[dict]:
        """The flow of an expression up to a comma, semicolon or closing bracket."""
        flow: list[dict] = []
        compared = False
        while self.i < len(self.t):
            kind, text, line = self.t[self.i]
            low = text.lower() if self.php else text
            if kind == "op" and text in (",", ";", ")", "]", "}", ":", "=>"):
                break
            if kind == "id" and low in ("as", "endif", "endwhile", "endforeach", "endfor", "endswitch"):
                break
            if low in _COMPARE and kind != "str":
                compared = True
                self.i += 1
                continue
            if low in _LOGIC and kind != "str":
                if self.php or text == "&&":
                    compared = True
                self.i += 1
                continue
            if kind == "op" and text == "?":
                self.i += 1
                short = self.accept(":")
                condition = flow if short and not compared else []
                compared = False
                first = [] if short else self.expression()
                if not short:
                    self.accept(":")
                flow = condition + first + self.expression()
                continue
            if kind == "op" and text in ("??",):
                self.i += 1
                flow = flow + self.expression()
                continue
            if kind == "op" and text == "!":
                self.i += 1
                self.term()
                compared = True
                continue
            at = self.i
            flow = flow + self.term()
            if self.i == at:
                self.i += 1
            if not self.php and self.i < len(self.t) and self.t[self.i][2] > self.t[self.i - 1][2] and self.kind() != "op" and self.t[self.i - 1][1] not in ("+", "-", "*", "/", "&", "|", "="):
                break
        return [] if compared else flow

    def arguments(self) -> list[list[dict]]:
        """(a, b, ...); deeper than CALL_DEPTH, one argument of all variables that stand there, as each call's flow holds all inside it."""
        if self.nested >= CALL_DEPTH:
            at = self.i
            self.skip_group()
            names = dict.fromkeys(text for kind, text, _ in self.t[at:self.i] if kind == ("var" if self.php else "id"))
            return [[leaf("var", x) for x in names]]
        self.nested += 1
        try:
            return self.argument_list()
        finally:
            self.nested -= 1

    def argument_list(self) -> list[list[dict]]:
        self.take()
        out = []
        while self.i < len(self.t) and not self.accept(")"):
            if self.accept(","):
                continue
            at = self.i
            if self.php and self.kind() == "id" and self.peek(1) == ":" and self.peek(2) != ":":
                self.i += 2
            flow = self.expression()
            while self.accept("=>", ":"):
                flow += self.expression()
            out.append(flow)
            if self.i == at:
                self.i += 1
        return out

    def items(self, close: str, target: str | None = None) -> list[dict]:
        """The flow of an array or object literal; keyed items also define target's members."""
        flow = []
        while self.i < len(self.t) and not self.accept(close):
            if self.accept(","):
                continue
            at = self.i
            key = None
            if self.kind() in ("str", "id", "num") and self.peek(1) in ("=>", ":") and not (self.php and self.peek(1) == ":"):
                key = self.take().strip("'\"")
                self.take()
            elif not self.php and close == "}" and self.kind() == "id" and self.peek(1) == "(":
                name = self.take()
                full = self.function(name)
                flow.append(leaf("function", full))
                continue
            line = self.line()
            self.alias = f"{target}.{key}" if target and key and not self.php else None
            item = self.expression()
            self.alias = None
            while self.accept("=>", ":"):
                item = item + self.expression()
            if target and key is not None:
                self.pending.append((target if self.php else f"{target}.{key}", key if self.php else None, item, line))
            else:
                flow += item
            if self.i == at:
                self.i += 1
        return flow

    def term(self) -> list[dict]:
        kind, text, line = self.t[self.i]
        low = text.lower() if self.php else text
        alias, self.alias = self.alias, None
        if kind == "op":
            self.i += 1
            if text == "(":
                if self.php and self.kind() == "id" and self.peek(1) == ")" and self.low() in ("int", "integer", "float", "double", "string", "bool", "boolean", "array", "object"):
                    cast = self.low()
                    self.i += 2
                    inner = self.term()
                    return [x | {"through": [*x["through"], "intval"]} for x in inner] if cast in ("int", "integer", "float", "double", "bool", "boolean") else inner
                if not self.php and self.arrow_ahead():
                    self.i -= 1
                    return [leaf("function", self.function(alias, arrow=True))]
                flow = [] if self.peek() == ")" else self.expression()
                while self.accept(","):
                    flow = self.expression()
                self.accept(")")
                return self.postfix(None, flow, line)
            if text == "[":
                return self.postfix(None, self.items("]", alias), line)
            if text == "{" and not self.php:
                return self.items("}", alias)
            if text == "{":
                self.i -= 1
                self.skip_group()
            return []
        if kind in ("str", "doc", "tpl"):
            self.i += 1
            flow = []
            if self.php and (text[:1] in "\"`" or kind == "doc" and "<<<'" not in text.replace(" ", "")[:5]):
                for m in _INTERPOLATED.finditer(text):
                    flow.append(leaf("var", f"$this->{m[3]}" if m[1] == "this" and m[3] else "$" + m[1], m[2]))
                if flow and _SQL.match(text[1:]):
                    self.call("sql", "statement", [flow], line)
                if text[:1] == "`":
                    self.call("shell_exec", "function", [flow], line)
            elif kind == "tpl":
                for part in re.findall(r"\$\{([^}]*)\}", text):
                    flow += [leaf("var", m) for m in re.findall(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*", part)]
            else:
                flow = [leaf("str", text.strip("'\"")[:200])]
            return self.postfix(None, flow, line)
        if kind == "num":
            self.i += 1
            return []
        if kind == "var":
            self.i += 1
            return self.postfix(text, None, line)
        if kind == "id":
            if low in ("new",):
                self.i += 1
                if self.kind() == "id" and self.low() == "class":
                    self.take()
                    return []
                name = self.take() if self.kind() in ("id", "var") else ""
                while not self.php and self.accept("."):
                    name += "." + self.take()
                args = self.arguments() if self.peek() == "(" else []
                flow = self.called(name, "new", args, line)
                return self.postfix(None, [leaf("new", name, call=flow[0]["call"]), *flow[1:]], line)
            if low in ("function", "fn"):
                self.i += 1
                if not self.php and self.kind() == "id":
                    return self.postfix(None, [leaf("function", self.function(None))], line)
                name = alias if alias and not self.php else None
                return self.postfix(None, [leaf("function", self.function(name or f"closure@{line}_{self.ids + 1}"))], line)
            if low in ("clone", "typeof", "void", "await", "delete", "yield", "async", "static") and self.kind(1) in ("var", "id"):
                self.i += 1
                return self.term()
            if self.php and low in ("include", "include_once", "require", "require_once", "print", "exit", "die", "echo", "throw"):
                self.i += 1
                at = self.i
                if self.accept("(") and self.accept(")"):
                    flow = []
                elif self.peek(-1) == "(":
                    flow = self.expression()
                    self.accept(")")
                else:
                    flow = [] if self.peek() in (";", ")") else self.expression()
                if low.startswith(("include", "require")):
                    self.add("include", low, key="texts" if self.texts("include", low, at, line) else None, flow=flow, line=line)
                    self.add("node", low, kind="Include", pos=self.depth, line=line)
                self.call(low, "special", [flow], line)
                return []
            if not self.php and self.peek(1) == "=>":
                return [leaf("function", self.function(alias, arrow=True))]
            self.i += 1
            return self.postfix(text, None, line)
        self.i += 1
        return []

    def arrow_ahead(self) -> bool:
        """Whether the bracket just taken opens an arrow function's parameters."""
        level, k = 1, 0
        while level and self.i + k < len(self.t):
            kind, text, _ = self.t[self.i + k]
            if kind == "op":
                level += (text in "([{") - (text in ")]}")
            k += 1
        return self.peek(k) == "=>"

    def postfix(self, name: str | None, flow: list[dict] | None, line: int) -> list[dict]:
        """Members, offsets, calls and assignments after a name or a value."""
        key, static = None, False
        while self.i < len(self.t) and self.kind() == "op":
            text = self.peek()
            if self.php and text in ("->", "?->", "::") or not self.php and text in (".", "?."):
                self.i += 1
                static = text == "::"
                if self.peek() == "{":
                    self.skip_group()
                    member = "*"
                elif self.peek() == "(":
                    continue
                else:
                    member = self.take()
                joint = text if self.php else "."
                if name is not None:
                    name, key = f"{name}{'->' if joint == '?->' else joint}{member}", None
                elif flow is not None:
                    if self.peek() == "(":
                        flow = [x | {"through": [*x["through"], member]} for x in flow] + self.called(member, "method", self.arguments(), line)
            elif text == "[" and (name is not None or flow is not None):
                self.i += 1
                literal = self.peek() if self.kind() in ("str", "num", "id") and self.peek(1) == "]" else None
                inner = [] if self.peek() == "]" else self.expression()
                self.accept("]")
                if name is not None:
                    if literal is not None and not self.php and self.t[self.i - 2][0] == "str":
                        name = f"{name}.{literal.strip(chr(39) + chr(34))}"
                    else:
                        key = literal.strip("'\"") if literal is not None else "*"
                del inner
            elif text == "{" and self.php and name and name[0] == "$" and self.kind(1) in ("num", "str"):
                self.skip_group()
            elif text == "(":
                at = self.i
                args = self.arguments()
                if name is None:
                    extra = [y for a in args for y in a]
                    found = [x for x in flow or [] if x["kind"] == "function"]
                    if found:
                        flow = self.called(found[0]["name"], "function", args, line)
                    else:
                        flow = (flow or []) + extra
                    continue
                target, plain = name, name
                if self.php:
                    plain = re.split(r"->|::", name)[-1]
                    kind = "static" if static else "method" if "->" in name else "dynamic" if name[0] == "$" else "function"
                    plain = plain.lstrip("\\") if kind != "static" else name
                else:
                    kind = "method" if "." in name else "function"
                through = [leaf("var", target.rpartition("." if not self.php else "->")[0])] if kind == "method" else []
                if plain == "define" and self.php and args:
                    names = [x["name"] for x in args[0] if x["kind"] == "str"]
                    if names:
                        self.add("define", names[0], flow=args[1] if len(args) > 1 else [], line=line)
                        if self.kind_at(at + 1) == "str" and self.text_at(at + 2) == ",":
                            self.texts("define", names[0], at + 3, line)
                if plain in ("extract", "parse_str") and self.php and args:
                    self.add("def", "*", kind="extract", flow=args[0], line=line)
                called = self.called(plain, kind, args, line)
                called[0]["key"] = target
                flow = called + [x | {"through": [plain]} for x in through if x["name"]]
                name, key = None, None
            elif text in _ASSIGN and name is not None and not (text == "=" and self.peek(1) == ">"):
                self.i += 1
                self.accept("&")
                own = name
                right = self.assigned(own)
                if text not in ("=",):
                    right = right + [leaf("var", name, key)]
                self.define(name, key, "concat" if text == ".=" or text == "+=" and not self.php else "assign", right, line)
                return right
            elif text == "=" and flow is not None:
                self.i += 1
                right = self.expression()
                for x in flow:
                    if x["kind"] == "var":
                        self.define(x["name"], x["key"], "assign", right, line)
                return right
            elif text in ("++", "--"):
                self.i += 1
            else:
                break
        if flow is not None:
            return flow
        if self.php and name[0] != "$" and "::" not in name:
            return [] if name.lower() in ("true", "false", "null") else [leaf("const", name)]
        if not self.php and name in ("true", "false", "null", "undefined"):
            return []
        return [leaf("var", name, key)]

    def define(self, name: str, key: str | None, kind: str, flow: list[dict], line: int) -> None:
        if self.php and name.lower() in ("list", "array"):
            return
        self.add("def", name, key=key, kind=kind, flow=flow, line=line)
        self.members()

    def members(self) -> None:
        """Definitions of a literal's keyed items, after that of the name that holds it."""
        pending, self.pending = self.pending, []
        for name, key, flow, line in pending:
            self.add("def", name, key=key, kind="item", flow=flow, line=line)


def read_file(text: str, language: str) -> list[dict]:
    """The records of a text.  Nesting is as deep as the text has it: the reader's calls, which take no C stack, may be as many as its tokens need."""
    reader, limit = Reader(text or "", language), sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 1000 + 20 * len(reader.t)))
    try:
        return reader.read()
    finally:
        sys.setrecursionlimit(limit)


#: Records and leaves of an output batch; a file's records stay together.
BATCH_ITEMS = 8192


def _batch(paths: list[str], rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *(pa.array([r[c] for r in rows], t) for c, t in _COLUMNS)], ["path", *(c for c, _ in _COLUMNS)])


def read_batches(batches, language: str):
    """Batches (path, content) to batches of records, each of whole files up to BATCH_ITEMS records and leaves."""
    paths, rows, items = [], [], 0
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):  # one text at a time leaves Arrow
            found = read_file(content.as_py(), language)
            paths += [path.as_py()] * len(found)
            rows += found
            items += sum(1 + len(r["flow"]) for r in found)
            if items >= BATCH_ITEMS:
                yield _batch(paths, rows)
                paths, rows, items = [], [], 0
    if rows:
        yield _batch(paths, rows)


def records(files: DataFrame, language: str) -> DataFrame:
    """files(path, content) to records of SCHEMA; one pass, one file at a time."""
    return small_batches(files.select("path", "content")).mapInArrow(lambda batches: read_batches(batches, language), SCHEMA)


def of(rows: DataFrame, *kinds: str) -> DataFrame:
    return rows.where(F.col("rec").isin(*kinds))
