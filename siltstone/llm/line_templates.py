"""Line dedup by a log-template tree, in DataFrame operations only.

Lines that are not blank are parsed into a tree of fixed depth: token count, then the
first DEPTH tokens; a token with a digit is a variable field, `<*>`, at any depth.  A line's
*form* is its tokens with digit fields masked; lines of fewer than DEPTH tokens count as
they are.  A form recurs if it stands in two different texts.

A leaf of lines of more than DEPTH + 1 tokens also yields any number of templates with word
fields.  Below DEPTH a token is a constant of its leaf if it stands there in `min_docs` different
texts; a form's pattern is its constants, all other fields variable; a pattern of which at least
half of the tokens below DEPTH are constant and that `min_docs` texts spell is a template.  The
leading tokens, alike in a whole leaf, do not count.  A template takes each form that agrees
with its constants; of several, the one with the most constants, then the first by (place, token).

Of a recurring form, or of all forms of a template, the first line stays (by id, then
position); every other line is dropped, other lines stay as they are.  Everything is counted in
different texts, so exact copies of a text weigh nothing and keep their own lines.

Counts are partial aggregations, so a line that a third of all rows share shuffles as one count
a task; lines meet the forms that recur through a broadcast for the hottest forms (1,024 at most)
and a shuffle for the rest.  Texts are parsed once, lines and forms written down.  Only lines of leaves
that may hold a template are read again: a bitmap of fixed size tells them, and what it lets through by chance cannot reach
`min_docs`.  Forms are told apart by 96 bits of hashes.  Null texts have no lines and come back
null; rows that repeat id and text come back alike.  Other columns of the input pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_counted, written

DEPTH = 3
BLANK = r"[\x09-\x0D\x20]+"
WORDS = 1 << 16


def _raw_tokens(line):
    """The tokens of a line; one empty token for a blank line."""
    return F.split(F.btrim(line, F.lit(" \t\n\x0b\f\r")), BLANK)


def _masked(tokens):
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), "<*>").otherwise(t))


def _texts(lines: DataFrame, key: str) -> DataFrame:
    return lines.select(key, "h").distinct().groupBy(key).agg(F.count("*").alias("texts"))


def _slot(key):
    return F.pmod(key, F.lit(WORDS * 64))


def _bitmap(keys: DataFrame, key: str) -> DataFrame:
    """One row with an array of WORDS longs (512 KB at any input size) whose bits mark the keys' slots."""
    marks = keys.select(_slot(F.col(key)).alias("slot")).groupBy(F.floor(F.col("slot") / 64).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    words = keys.sparkSession.range(WORDS).join(marks, F.col("id") == F.col("i"), "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("bitmap"))


def _may_hold(bitmap: DataFrame, key):
    """Whether a key's slot is marked: no key is missed; false hits are for an exact join to drop."""
    slot = _slot(key)
    return F.get(bitmap.scalar(), F.floor(slot / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))) != 0


def _leaf(x):
    """The leaf of a line with its raw tokens and whether it has digits."""
    lead = F.slice(x["raw"], 1, DEPTH)
    return F.xxhash64(F.size(x["raw"]), F.when(x["digits"], _masked(lead)).otherwise(lead))


def _templates(deep: DataFrame, min_docs: int) -> DataFrame:
    """(key, template) of the forms that a template with word fields takes, from deep(leaf, key, h, tokens)."""
    spot = F.xxhash64("leaf", "at", "token")
    tokens = lambda rows, *more: rows.select(*more, F.posexplode("tokens").alias("at", "token")).where(F.col("at") >= DEPTH)
    constants = written(_texts(tokens(deep, "leaf", "h").select(spot.alias("spot"), "h"), "spot").where(F.col("texts") >= min_docs), "constants")
    forms = deep.groupBy("leaf", "key").agg(F.first("tokens").alias("tokens"))
    spots = tokens(forms, "leaf", "key", F.size("tokens").alias("n")).select("leaf", "key", "n", "at", "token", spot.alias("spot")).join(constants, "spot")
    patterns = written(spots.groupBy("leaf", "key", "n").agg(F.sort_array(F.collect_list(F.struct("at", "token", "spot", "texts"))).alias("constants"))
                       .select("key", "n", "constants", F.xxhash64("leaf", "constants.spot").alias("template")), "patterns")
    spelt = deep.select("key", "h").distinct().join(patterns.where(F.size("constants") * 2 >= F.col("n") - DEPTH).select("key", "template"), "key")
    known = _texts(spelt, "template").where(F.col("texts") >= min_docs).select("template")
    # a template meets the forms that hold its rarest constant, then all constants decide
    whole = (patterns.join(known, "template", "left_semi").groupBy("template").agg(F.first("constants").alias("constants"))
             .select("template", F.col("constants.spot").alias("needs"), F.transform("constants", lambda c: F.struct(c["at"].alias("at"), c["token"].alias("token"))).alias("spelling"),
                     F.array_min(F.transform("constants", lambda c: F.struct(c["texts"].alias("texts"), c["spot"].alias("spot"))))["spot"].alias("spot")))
    held = patterns.select("key", F.col("constants.spot").alias("holds"), F.explode("constants.spot").alias("spot"))
    fit = held.join(whole, "spot").where(F.size(F.array_except("needs", "holds")) == 0)
    return fit.groupBy("key").agg(F.min(F.struct((-F.size("needs")).alias("less"), "spelling", "template"))["template"].alias("template"))


def drop_templates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_docs: int = 16) -> DataFrame:
    """The columns of `docs` with the text less its dropped lines, and n_lines, n_dropped (these replace columns of that name)."""
    rest = [c for c in docs.columns if c not in (id_column, text_column)]
    base = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), (F.struct(*rest) if rest else F.lit(0)).alias("rest"), F.xxhash64(text_column).alias("h"))
    # tokens, form and leaf are made inside the array, so that no filter makes them again
    split = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("pos"), _raw_tokens(line).alias("raw"), line.rlike("[0-9]").alias("digits")))
    some = F.filter(split, lambda x: F.get(x["raw"], F.lit(0)) != "")
    form = lambda x: F.when(x["digits"] & (F.size(x["raw"]) >= DEPTH), _masked(x["raw"])).otherwise(x["raw"])
    formed = F.transform(some, lambda x: F.struct(x["pos"].alias("pos"), form(x).alias("form"), F.when(F.size(x["raw"]) > DEPTH + 1, _leaf(x)).alias("leaf")))
    keyed = F.transform(formed, lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(F.size(x["form"]), x["form"]).alias("key"), F.hash(x["form"]).alias("also"), x["leaf"].alias("leaf"),
                                                    F.when(x["leaf"].isNotNull(), F.array_join(x["form"], " ")).alias("form")))
    lines = written(base.where(F.col("text").isNotNull()).select("id", "h", F.inline(keyed)), "lines")

    forms = lines.groupBy("key", "also").agg((F.min("h") != F.max("h")).alias("same"), F.min(F.struct("id", "pos", "h")).alias("first"), F.count("*").alias("n"))
    # only leaves of several forms and enough texts can hold a template that is not one form
    full = (lines.where("leaf is not null").groupBy("leaf", "h").agg(F.min("key").alias("low"), F.max("key").alias("high"))
            .groupBy("leaf").agg(F.count("*").alias("texts"), F.min("low").alias("low"), F.max("high").alias("high"))
            .where((F.col("texts") >= min_docs) & (F.col("low") != F.col("high"))).select("leaf"))
    marked = written(_bitmap(full, "leaf"), "bitmap")
    deep = written(lines.where(F.col("leaf").isNotNull() & _may_hold(marked, F.col("leaf"))).select("h", "leaf", "key", F.split("form", " ").alias("tokens")), "deep")
    templates = written(_templates(deep, min_docs), "templates")
    groups = written(forms.join(templates, "key", "left").where(F.col("same") | F.col("template").isNotNull()), "forms")
    discard(deep, templates)
    heads = groups.where("template is not null").groupBy("template").agg(F.min("first").alias("head"))
    recurring = written(groups.join(heads, "template", "left").select("key", "also", F.coalesce("head", "first").alias("first"), "n"), "recurring")
    gone = written(join_counted(lines.drop("form"), recurring, ["key", "also"], "n").where(~F.struct("id", "pos", "h").eqNullSafe(F.col("first")))
                   .groupBy("id", "h").agg(F.array_sort(F.collect_set("pos")).alias("gone")).withColumnsRenamed({"id": "gone_id", "h": "gone_h"}), "gone")
    discard(lines, marked, groups, recurring)
    # dealt by id and text at every size: a table small enough to broadcast today would be planned otherwise tomorrow
    out = base.join(gone.hint("merge"), base["id"].eqNullSafe(gone["gone_id"]) & (base["h"] == gone["gone_h"]), "left")
    # the runs of lines between dropped ones
    starts, ends = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g + 1)), F.concat("gone", F.array(F.size("parts")))
    kept = F.flatten(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.slice("parts", x["a"] + 1, x["b"] - x["a"])))
    out = out.withColumn("parts", F.split("text", "\n"))
    return out.select(*[(F.col("id").alias(c) if c == id_column else F.col("rest")[c].alias(c)) for c in docs.columns if c not in (text_column, "n_lines", "n_dropped")],
                      F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias(text_column),
                      F.coalesce(F.size("parts"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def oracle(min_docs: int = 16) -> str:
    """The same rows in DuckDB: doc_id, n_lines, n_dropped, text."""
    return f"""
with lines as (
  select doc_id, text, pos, n, case when n >= {DEPTH} and regexp_matches(line, '[0-9]') then list_transform(raw, lambda t: case when regexp_matches(t, '[0-9]') then '<*>' else t end) else raw end as form
  from (select *, len(raw) as n from (
    select doc_id, text, line, pos, list_filter(regexp_split_to_array(line, '[\x09-\x0D\x20]+'), lambda x: x <> '') as raw
    from (select doc_id, text, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents where text is not null)))
  where n > 0),
forms as (select form, count(distinct text) > 1 as same, min({{'id': doc_id, 'pos': pos}}) as first from lines group by form),
leaves as (select n, form[1:{DEPTH}] as lead from lines where n > {DEPTH + 1} group by all having count(distinct text) >= {min_docs} and count(distinct form) > 1),
deep as (select l.n, l.form[1:{DEPTH}] as lead, l.form, l.text from lines l join leaves f on l.n = f.n and l.form[1:{DEPTH}] = f.lead),
consts as (select n, lead, place, token from (select n, lead, text, unnest(form) as token, unnest(range(n)) as place from deep) where place >= {DEPTH} group by all having count(distinct text) >= {min_docs}),
spots as (select distinct n, lead, form, unnest(form) as token, unnest(range(n)) as place from (select distinct n, lead, form from deep)),
patterns as (select s.n, s.lead, s.form, list({{'place': s.place, 'token': s.token}} order by s.place, s.token) as spelling
  from spots s join consts c on s.n = c.n and s.lead = c.lead and s.place = c.place and s.token = c.token group by s.n, s.lead, s.form),
whole as (select p.n, p.lead, p.spelling from patterns p join (select distinct form, text from deep) d on d.form = p.form
  where len(p.spelling) * 2 >= p.n - {DEPTH} group by p.n, p.lead, p.spelling having count(distinct d.text) >= {min_docs}),
fit as (select p.form, w.n, w.lead, w.spelling, row_number() over (partition by p.form order by len(w.spelling) desc, w.spelling) as r
  from patterns p join whole w on p.n = w.n and p.lead = w.lead and list_has_all(p.spelling, w.spelling)),
groups as (select f.form, f.first, case when t.form is not null then {{'n': t.n, 'lead': t.lead, 'spelling': t.spelling}} end as template
  from forms f left join (select * from fit where r = 1) t on f.form = t.form where f.same or t.form is not null),
recurring as (select form, case when template is null then first else min(first) over (partition by template) end as first from groups),
gone as (select l.doc_id, list(l.pos) as gone from lines l join recurring r on l.form = r.form where not (l.doc_id = r.first.id and l.pos = r.first.pos) group by l.doc_id)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::bigint as n_lines, coalesce(len(g.gone), 0)::bigint as n_dropped,
  case when g.gone is null then d.text else
    array_to_string(list_transform(list_filter(range(len(string_split(d.text, chr(10)))), lambda i: not list_contains(g.gone, i)), lambda i: string_split(d.text, chr(10))[i + 1]), chr(10)) end as text
from documents d left join gone g on d.doc_id = g.doc_id"""
