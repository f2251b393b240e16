"""A printer for scripts: one statement a line, indented by blocks, with each printed line's place in the source.

It works on tokens, so texts, templates and regular expressions come out as they stand; comments go.
The printed text has the source's tokens in the source's order, and a line break where the source's ends a statement.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import small_batches
from ..plans.parse import tokens

INDENT = "    "
#: Deeper blocks are not indented further, so that a text of brackets alone does not print as its square.
DEEPEST = 40
#: Words that a bracket's content follows after a blank.
_SPACED = {"if", "for", "while", "switch", "catch", "with", "return", "typeof", "case", "in", "of", "new", "delete", "throw", "void", "else", "do", "var", "let", "const", "await", "yield", "instanceof", "function"}
#: Operators that may stand before their operand alone.
_SIGNS = {"+", "-", "!", "~", "++", "--", "..."}


def _joined(before: tuple[str, str] | None, kind: str, text: str, sign: bool) -> bool:
    """Whether a token stands at the one before without a blank."""
    if before is None:
        return True
    last_kind, last = before
    if text in (";", ",", ")", "]", ".", "?.") or last in (".", "?.", "(", "[") or sign:
        return True
    if text in ("(", "["):
        return last not in _SPACED and last_kind != "op" or last in (")", "]") or text == "[" and last_kind == "id" and last not in _SPACED
    if text in ("++", "--"):
        return last_kind != "op" or last in (")", "]")
    return text == ":" and last_kind != "op"


#: Words after which a line break ends the statement.
_ENDS = {"return", "break", "continue", "throw"}
#: Words that go on after a block.
_AFTER_BLOCK = {"else", "catch", "finally", "while"}


def _ended(before: tuple[str, str], kind: str, text: str) -> bool:
    """Whether a line break between two tokens ends a statement."""
    if before[0] == "id" and before[1] in _ENDS:
        return True
    operand = before[0] != "op" and before[1] not in _SPACED or before[1] in (")", "]", "}")
    return operand and (kind != "op" or text in ("++", "--", "!", "~")) and text not in ("in", "of", "instanceof")


#: Words that decide by themselves; any other token does by its kind alone, so that decisions are few and kept.
_WORDS = _SPACED | _ENDS | _AFTER_BLOCK
_DECIDED: dict[tuple, tuple[bool, bool]] = {}


def _decided(before: tuple[str, str] | None, kind: str, token: str, sign: bool) -> tuple[bool, bool]:
    """Whether a token stands at the one before, and whether it is the sign of what follows."""
    unary = kind == "op" and token in _SIGNS and (before is None or before[0] == "op" and before[1] not in (")", "]", "}") and (sign or before[1] not in ("++", "--")) or before[1] in _SPACED)
    return bool(_joined(before, kind, token, sign) and not (sign and token[:1] in "+-" and token[:1] == before[1][:1])), bool(unary)


def _printed(found: list[tuple[str, str, int]], open_: bool = False) -> list[tuple[str, int]] | None:
    """The lines of some tokens.  `open_`: without that of the last token, a `}` after which no bracket is open; None if one is."""
    out: list[tuple[str, int]] = []
    brackets: list[str] = []
    blocks = start = last_at = 0
    words: list[str] = []
    before, sort, sign = None, None, False

    def flush() -> None:
        nonlocal before, sort, sign
        if words:
            out.append((INDENT * min(blocks, DEEPEST) + "".join(words), start))
            words.clear()
        before, sort, sign = None, None, False

    for this in found:
        kind, token, at = this
        op = kind == "op"
        if token == "}":
            flush()
            while brackets and brackets.pop() != "{":
                pass
            blocks = max(blocks - 1, 0)
        elif sort == "}":
            if not op and token not in _AFTER_BLOCK or token in ("{", "++", "--", "!", "~"):
                flush()
        elif at > last_at and before and (not brackets or brackets[-1] == "{") and _ended(before, kind, token):
            flush()
        if not words:
            start = at
        own = token if op or token in _WORDS else f" {kind}"
        key = (sort, own, sign)
        found = _DECIDED.get(key)
        if found is None:
            found = _DECIDED[key] = _decided(before and before[:2], kind, token, sign)
        words.append(token if found[0] else " " + token)
        before, sort, sign = this, own, found[1]
        if not op:
            last_at = at + token.count("\n")
            continue
        last_at = at
        if token == "{":
            flush()
            brackets.append("{")
            blocks += 1
        elif token == "(" or token == "[":
            brackets.append(token)
        elif token == ")" or token == "]":
            if brackets and brackets[-1] != "{":
                brackets.pop()
        elif token == ";" and (not brackets or brackets[-1] == "{"):
            flush()
    if open_:
        return None if brackets or blocks else out
    flush()
    return out


#: Words whose letters decide nothing: what such a word is replaced by is read and printed in the same way.
#: Those after a slash may be a regular expression's flags, and those of `_WORDS` and beside `$` or letters beyond ASCII stay as they are.
#: The class comes first and words are told by their first letter, as the expression then passes over the rest quickly.
_KEPT = "|".join(f"(?<={c})(?:{'|'.join(x[1:] for x in sorted(_WORDS) if x[0] == c)})" for c in sorted({x[0] for x in _WORDS}))
_SLOT = re.compile(rf"([A-Za-z_](?<![\w$/][A-Za-z_])(?!(?:{_KEPT})\b)[A-Za-z0-9_]*+(?![\w$]))")
_HOLE = "\0"
#: Shapes that are kept, the characters of one, and the brackets that one may go on for.
_SHAPES, _LONGEST, _REACH = 1 << 14, 1000, 8
#: New shapes in a script, beside a quarter of its blocks, after which it is read token by token: a new one costs several times that.
_NEW = 16
_PRINTED: dict[str, tuple[str, list[int], int, int] | None] = {}
#: What may close a text, template or regular expression that a shape leaves open, by what opens it.
_CLOSING = (('"', '"'), ("'", "'"), ("`", "`"), ("/", "]/"))


def _template(shape: str) -> tuple[str, list[int], int, int] | None:
    """What a shape, up to and with a `}`, is printed as: (format of its lines but the last, their source lines from 0 on, line breaks, holes).

    None unless it ends in a token `}` with no bracket open, whatever follows: no quote or slash waits for another one behind it.
    """
    holes, made = shape.count(_HOLE), None
    names = [f"Zq{k}qZ" for k in range(holes)]
    if not any(x in shape for x in ("Zq", "\r")):
        text = "".join(x for pair in zip(shape.split(_HOLE), [*names, ""], strict=True) for x in pair)
        own = tokens(text, "javascript")
        if own and own[-1][1] == "}" and own[-1][0] == "op" and tokens(text[:-1], "javascript") == own[:-1] and all(tokens(text + end, "javascript")[:len(own)] == own for mark, end in _CLOSING if mark in text):
            lines = _printed(own, open_=True)
            if lines is not None and not any("\n" in x for x, _ in lines):
                form = "\n".join(x for x, _ in lines).replace("{", "{{").replace("}", "}}")
                made = re.sub(r"Zq(\d+)qZ", r"{\1}", form), [n - 1 for _, n in lines], text.count("\n"), holes
    if len(_PRINTED) >= _SHAPES:
        _PRINTED.clear()
    _PRINTED[shape] = made
    return made


def _parts(text: str):
    """(lines joined by breaks, their source lines from `base` on, base) of a script's pieces: blocks of known shapes, then the rest token by token.

    A block at the top ends in a `}` whose line may go on, so it is the first character of the next piece.
    """
    if _HOLE in text:
        for line, n in _printed(tokens(text, "javascript")):
            yield line, [n], 0
        return
    pieces = _SLOT.split(text)
    words, chunks = pieces[1::2], _HOLE.join(pieces[::2]).split("}")
    i = at = new = 0
    last, base, lead = len(chunks) - 1, 1, ""
    while i < last:
        shape, end, found = lead, i, None
        while found is None and end < last and end - i < _REACH and len(shape) < _LONGEST:
            shape = f"{shape}{chunks[end]}}}"
            found = _PRINTED.get(shape, 0)
            if found == 0:
                new += 1
                found = _template(shape)
            end += 1
        if found is None or new > _NEW + i // 4:
            break
        form, lines, breaks, holes = found
        if lines:
            yield form.format(*words[at:at + holes]), lines, base
        base += breaks
        at += holes
        i, lead = end, "}"
    rest = (lead + "}".join(chunks[i:])).split(_HOLE)
    for line, n in _printed(tokens("".join(x for pair in zip(rest, [*words[at:], ""], strict=True) for x in pair), "javascript")):
        yield line, [n - 1], base


def printed(text: str | None) -> list[tuple[str, int]]:
    """(line, number of the source line that its first token stands on) of a script; a null or an empty text has none.

    Unclosed brackets keep what follows on one line; closing ones without a partner are printed as they are.
    """
    return [(line, base + n) for said, lines, base in _parts(text or "") for line, n in zip([said] if len(lines) == 1 else said.split("\n"), lines, strict=True)]


def by_source(text: str | None) -> list[tuple[int, int, int, str]]:
    """(source line, number of the first printed line, how many, the lines) of what each source line of a script is printed as."""
    out, run, line, first, count = [], [], 0, 1, 0
    for said, lines, base in _parts(text or ""):
        if lines[0] == lines[-1]:  # they ascend
            each = ((said, lines[0], len(lines)),)
        else:
            each = [(x, n, 1) for x, n in zip(said.split("\n"), lines, strict=True)]
        for x, n, many in each:
            if base + n != line:
                if run:
                    out.append((line, first, count, "\n".join(run)))
                run, line, first, count = [], base + n, first + count, 0
            run.append(x)
            count += many
    if run:
        out.append((line, first, count, "\n".join(run)))
    return out


def print_scripts(files: DataFrame) -> DataFrame:
    """files(path, content) to (path, content, lines): the printed text, and the source line of each of its lines; one pass, a file at a time."""
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):  # one text at a time leaves Arrow
                rows = printed(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()], pa.string()), pa.array(["\n".join(x for x, _ in rows)], pa.string()), pa.array([[n for _, n in rows]], pa.list_(pa.int32()))], ["path", "content", "lines"])

    return small_batches(files.select("path", "content")).mapInArrow(run, "path string, content string, lines array<int>")


#: Characters that a batch of printed lines is filled up to.
_BATCH_CHARS = 4 << 20


def print_by_source(files: DataFrame) -> DataFrame:
    """files(path, content) to (path, source_line, first_line, lines, code): what each source line is printed as, made where its script is; a script without tokens has no row."""
    def run(batches):
        names, rows, chars = [], [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True))], ["path", "source_line", "first_line", "lines", "code"])
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):  # one text at a time leaves Arrow
                found = by_source(content.as_py())
                names += [path.as_py()] * len(found)
                rows += found
                chars += sum(len(x[3]) for x in found)
                if chars >= _BATCH_CHARS:
                    yield made()
                    names, rows, chars = [], [], 0
        if rows:
            yield made()

    return small_batches(files.select("path", "content")).mapInArrow(run, "path string, source_line int, first_line int, lines long, code string")


def admitted(scripts: DataFrame, longest: int = 3000, fewest: int = 10, most: int = 500) -> DataFrame:
    """Printed scripts that are read: by the length and the line breaks of the printed text, so a script on one line counts as what it holds."""
    breaks = F.size("lines") - 1
    return scripts.where((F.length("content") <= longest) & breaks.between(fewest, most))


def at_source(found: DataFrame, scripts: DataFrame, line: str = "line") -> DataFrame:
    """Rows whose `line` counts lines of printed scripts, with the source's line in its place; rows of other paths, and lines that no token begins, stay."""
    lines = scripts.select("path", F.posexplode("lines").alias("_n", "_source")).select("path", (F.col("_n") + 1).alias(line), "_source")
    return found.join(lines, ["path", line], "left").withColumn(line, F.coalesce("_source", line)).select(*found.columns)
