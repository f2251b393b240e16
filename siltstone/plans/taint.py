"""Backward taint as a fixpoint of joins over the records of plans.parse.

A state is a leaf that a sink's value may come from: (fid, path, cls, scope, name, key,
ord, branch, through, stack, chain).  Each round settles what it can (sources,
sanitisers, constants), joins variables with their definitions, formal parameters with
the arguments of the call they were entered by, calls with returns and `__toString`, and
open names with included files.  States that were met before are dropped, include hops are
bounded, and each round is one table in the shared folder.

Verdicts: 1 controllable, 4 flows to a parameter (a new rule), 3 open, 2 sanitised,
-1 constant; of a sink's verdicts the first in that order counts.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import catalog
from ..operators.joins import bucketed, buckets, written_round
from . import points
from .parse import of, records

STATE = ("fid", "svid", "path", "cls", "scope", "kind", "name", "key", "ord", "branch", "through", "call", "stack", "chain", "hops")
LAST = 1 << 30


def function_names(rule: dict) -> list[str]:
    """The functions that a function-mode rule lists."""
    text = rule["match"][0]
    inside = re.match(r"\((.*?)\)", text)
    return re.findall(r"[A-Za-z_][\w.]*", inside[1] if inside else text)


def sink_table(spark: SparkSession, language: str, only=None) -> DataFrame:
    """(svid, sink, argument, kind): argument null takes all; kind: name, member (last part of a dotted name) or target (assigned member)."""
    rows = []
    for r in catalog.rule_rows():
        if r["language"] != language or (only is None and not r["status"]) or (only is not None and r["svid"] not in only):
            continue
        if r["match_mode"] == catalog.FUNCTION:
            member = language == "javascript"
            rows += [(r["svid"], n, 0 if n == "array_map" else None, "member" if member and "." not in n else "name") for n in function_names(r)]
        elif r["match_mode"] == catalog.CUSTOM:
            rows += {"curl": [(r["svid"], "curl_setopt", 2, "name")], "sql": [(r["svid"], "sql", 0, "name")], "echo": [(r["svid"], "echo", 0, "name")],
                     "html": [(r["svid"], r["vul_function"], None, "target")], "attr": [(r["svid"], r["vul_function"], 1, "member")]}[r["extractor"]]
    return spark.createDataFrame(rows, "svid int, sink string, argument int, kind string")


def numbered(rows: DataFrame) -> DataFrame:
    """Records whose call numbers are unique over all files, for stacks of calls that cross them."""
    number = lambda c: F.when(c.isNotNull(), F.xxhash64("path", c))
    return rows.withColumn("id", number(F.col("id"))).withColumn("flow", F.transform("flow", lambda leaf: leaf.withField("call", number(leaf["call"]))))


def folded_texts(rows: DataFrame, projects: str | None = None) -> DataFrame:
    """(project, path, kind, name, ord, text, whole) of constants and include targets that are put together from texts.

    Each round puts the values known so far in the place of the first constant that stands open; new values meet what waits for
    them, and what begins to wait meets all values, so no pair is formed twice.  Several definitions give several texts; a file's
    own definition goes before those of its project.  A constant is never part of its own value, so cycles give none.
    `whole` is true where the text begins with the file's own folder; `project` is what the regular expression `projects` finds in the path.
    """
    project = F.regexp_extract("path", projects, 0) if projects else F.lit("")
    parts = F.split("path", "/")
    up = lambda x: F.when(x["kind"] == "dir", F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - x["key"].cast("int"), F.lit(0))), "/")).otherwise(x["name"])
    leaves = F.transform("flow", lambda x: F.struct((x["kind"] == "const").alias("open"), up(x).alias("name")))
    first = of(rows, "path").select(project.alias("project"), "path", "kind", "name", "ord", F.lit("").alias("text"), leaves.alias("leaves"), (F.get("flow", F.lit(0))["kind"] == "dir").alias("whole"),
                                    F.when(F.col("kind") == "define", F.array("name")).otherwise(F.array().cast("array<string>")).alias("used"))
    own = first.where("kind = 'define'").select("path", F.col("name").alias("waits"), F.lit(True).alias("own")).distinct()

    def settled(items: DataFrame) -> DataFrame:
        at = F.array_position(F.transform("leaves", lambda x: x["open"]), True).cast("int")
        ready = F.when(at > 0, at - 1).otherwise(F.size("leaves"))
        plain = F.array_join(F.transform(F.slice("leaves", F.lit(1), ready), lambda x: x["name"]), "")
        moved = items.withColumn("text", F.concat("text", plain)).withColumn("leaves", F.slice("leaves", ready + 1, F.size("leaves") - ready)).withColumn("waits", F.get("leaves", F.lit(0))["name"])
        return written_round(moved.join(own, ["path", "waits"], "left").withColumn("own", F.coalesce("own", F.lit(False))))

    def put(waiting: DataFrame, values: DataFrame) -> DataFrame:
        v = values.select("project", F.col("name").alias("waits"), F.col("text").alias("value"), F.when(F.col("whole"), F.lit(True)).otherwise(F.lit(False)).alias("v_whole"), F.col("used").alias("v_used"), F.col("path").alias("v_path"))
        met = waiting.join(v, ["project", "waits"]).where((~F.col("own") | (F.col("path") == F.col("v_path"))) & ~F.when(F.col("kind") == "define", F.array_contains("v_used", F.col("name"))).otherwise(False))
        begins = (F.length("text") == 0) & F.col("v_whole")
        return met.select("project", "path", "kind", "name", "ord", F.concat("text", "value").alias("text"), F.slice("leaves", F.lit(2), F.size("leaves")).alias("leaves"), (F.col("whole") | begins).alias("whole"), F.array_union("used", "v_used").alias("used")).distinct()

    new = settled(first)
    values = waiting = done = None
    while not new.isEmpty():
        fresh, begun = new.where("waits is null and kind = 'define'"), new.where("waits is not null")
        before = waiting
        values = fresh if values is None else values.unionByName(fresh)
        waiting = begun if waiting is None else waiting.unionByName(begun)
        ready = new.where("waits is null")
        done = ready if done is None else done.unionByName(ready)
        step = put(begun, values)
        new = settled(step if before is None else step.unionByName(put(before, fresh)))
    return (new if done is None else done).select("project", "path", "kind", "name", "ord", "text", "whole")


def constants(rows: DataFrame, projects: str | None = None) -> DataFrame:
    """The constant table: (path, key, value) of each constant that a file defines as a text or puts together from texts and constants."""
    return folded_texts(rows, projects).where("kind = 'define'").select("path", F.col("name").alias("key"), F.col("text").alias("value")).distinct()


def plain_path(path):
    """A path without empty, `.` and `..` parts."""
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(parts, "/"))


def include_links(rows: DataFrame, projects: str | None = None) -> DataFrame:
    """(i_path, f_path): the files that a file includes.

    Targets are folded first.  One that begins with the file's own folder is a full path and means that file alone; another means
    the file beside the including one, and only where there is none, every file (of its project) whose path ends in it.
    Where a variable or an unknown constant is part of a target, the texts in it are looked up by path ends.
    """
    project = lambda c: F.regexp_extract(c, projects, 0) if projects else F.lit("")
    folded = written_round(folded_texts(rows, projects).where("kind = 'include'"))
    told = folded.select(F.col("path").alias("i_path"), F.col("text").alias("target"), "whole").distinct()
    left = (of(rows, "include").where("key is null").select("path", "flow")
            .unionByName(of(rows, "path").where("kind = 'include'").join(folded.select("path", "ord"), ["path", "ord"], "left_anti").select("path", "flow")))
    texts = left.select(F.col("path").alias("i_path"), F.explode(F.filter("flow", lambda x: x["kind"] == "str")).alias("i")).select("i_path", F.col("i.name").alias("target"), F.lit(False).alias("whole"))
    named = written_round(told.unionByName(texts).distinct())
    files = rows.select(F.col("path").alias("f_path")).distinct()
    here = plain_path(F.when(F.col("whole"), F.col("target")).otherwise(F.concat(F.regexp_replace("i_path", "[^/]*$", ""), F.ltrim(F.col("target"), F.lit("/")))))
    exact = written_round(named.withColumn("f_path", here).join(files, "f_path").select("i_path", "target", "f_path"))
    rest = named.where("not whole").join(exact.select("i_path", "target").distinct(), ["i_path", "target"], "left_anti")
    ends = F.endswith("f_path", F.concat(F.lit("/"), F.regexp_replace("target", r"^(\./|/)", "")))
    by_name = files.withColumn("f_base", F.substring_index("f_path", "/", -1)).withColumn("project", project("f_path"))
    suffix = rest.withColumn("f_base", F.substring_index("target", "/", -1)).withColumn("project", project("i_path")).join(by_name, ["project", "f_base"]).where(ends)
    return exact.select("i_path", "f_path").unionByName(suffix.select("i_path", "f_path")).where("i_path <> f_path").distinct()


def sinks(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Seeds: one row for each sink's argument, with its flow; equal joins on the kind and the name that it looks at."""
    last = F.element_at(F.split("name", r"[.]"), -1)
    args, defs = of(rows, "arg"), of(rows, "def")
    looked = (args.withColumn("sink_kind", F.explode(F.array(F.lit("name"), F.lit("member")))).withColumn("sink", F.when(F.col("sink_kind") == "name", F.col("name")).otherwise(last))
              .unionByName(defs.where(F.contains("name", F.lit("."))).withColumn("sink_kind", F.lit("target")).withColumn("sink", last)))
    # an argument of a known function is looked up by that function alone
    own = F.startswith("key", F.lit("@")) & (F.col("rec") == "arg")
    looked = looked.where(~F.coalesce(own, F.lit(False))).unionByName(args.where(F.startswith("key", F.lit("@"))).withColumn("sink_kind", F.lit("function")).withColumn("sink", F.col("key")))
    found = looked.join(table.withColumnRenamed("kind", "sink_kind"), ["sink", "sink_kind"]).where((F.col("sink_kind") == "target") | F.col("argument").isNull() | (F.col("pos") == F.col("argument")))
    return found.withColumn("fid", F.xxhash64("path", "svid", "ord"))


def _start(seeds: DataFrame) -> DataFrame:
    return seeds.select("fid", "svid", "path", "cls", "scope", "ord", "branch", "name", "line", F.explode("flow").alias("leaf")).select(
        "fid", "svid", "path", "cls", "scope", F.col("leaf.kind").alias("kind"), F.col("leaf.name").alias("name"), F.col("leaf.key").alias("key"), "ord", "branch", F.col("leaf.through").alias("through"), F.col("leaf.call").alias("call"),
        F.array().cast("array<bigint>").alias("stack"), F.array(F.struct(F.lit("sink").alias("node"), F.col("name").alias("code"), F.col("path").alias("path"), F.col("line").alias("line"))).alias("chain"), F.lit(0).alias("hops"))


def _follow(found: DataFrame, prefix: str, node: str, stack=None) -> DataFrame:
    """States of the leaves of `flow` in records joined to states; record columns carry `prefix`."""
    p = lambda c: F.col(prefix + c)
    step = F.struct(F.lit(node).alias("node"), p("name").alias("code"), p("path").alias("path"), p("line").alias("line"))
    rows = found.select(*STATE, *[c for c in found.columns if c.startswith(prefix) and c != prefix + "flow"], F.explode(prefix + "flow").alias("leaf"))
    return rows.select("fid", "svid", p("path").alias("path"), p("cls").alias("cls"), p("scope").alias("scope"), F.col("leaf.kind").alias("kind"), F.col("leaf.name").alias("name"), F.col("leaf.key").alias("key"),
                       p("ord").alias("ord"), p("branch").alias("branch"), F.concat("through", "leaf.through").alias("through"), F.col("leaf.call").alias("call"), (F.col("stack") if stack is None else stack).alias("stack"), F.concat("chain", F.array(step)).alias("chain"), "hops")


def _with(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.withColumnsRenamed({c: prefix + c for c in rows.columns})


def lookups(rows: DataFrame, language: str, included: DataFrame, aliases: DataFrame | None = None, targets: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables that every round of `trace` looks states up in, each dealt once by what it is joined on."""
    place, n = ("path", "cls", "scope", "name", "line", "ord", "branch", "flow"), buckets(rows)
    defs = of(rows, "def").select(*place, "key", "kind")
    if language != "php":
        defs = defs.withColumn("base", F.substring_index("name", ".", 1))
    tables = {
        "defs": bucketed(defs, n, "path", "name" if language == "php" else "base"),
        "params": bucketed(of(rows, "param").select("path", "scope", "name", "pos"), n, "path", "scope"),
        "returns": bucketed(of(rows, "return").select(*place), n, "path", "scope"),
        "arguments": bucketed(of(rows, "arg").select(*place, "id", "pos"), n, "id", "pos"),
        "functions": bucketed(of(rows, "function").select("path", "scope", "name").distinct(), n, "name"),
        "included": bucketed(included, n, "i_path"),
    }
    if aliases is not None:
        tables["aliases"] = bucketed(aliases, n, "path", "scope", "name")
    if targets is not None:
        tables["targets"] = bucketed(targets, n, "call")
    return tables


def trace(rows: DataFrame, seeds: DataFrame, language: str, tampers: DataFrame, depth: int = 20, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """(fid, svid, verdict, param, function, chain) of every seed; `tables` as `lookups` gives them, made of `rows` if absent.

    Rounds go on until no state is new: seen states and the stack guard end cycles.  `depth` bounds include hops alone.
    """
    php = language == "php"
    filters = tampers.where("tam_type = 'Filter-Function'").groupBy("svid").agg(F.collect_set("tam_key").alias("sanitisers"))
    inputs = [r.tam_key for r in tampers.where("tam_type = 'Input-Control'").select("tam_key").distinct().collect()]  # a catalog table
    names = F.array(*[F.lit(n) for n in (*(catalog.PHP_SOURCES if php else catalog.JS_SOURCES), *inputs)])
    tables = lookups(rows, language, include_links(rows)) if tables is None else tables
    defs, params, returns, arguments, functions, followed = (tables[k] for k in ("defs", "params", "returns", "arguments", "functions", "included"))
    aliases, targets = tables.get("aliases"), tables.get("targets")

    root = F.regexp_extract("name", r"^(\$?[\w\\]+)", 1) if php else F.col("name")
    verdicts: list[DataFrame] = []
    states = written_round(_start(seeds))
    seen = states.select("fid", "path", "scope", "name", "key", "ord", "stack", "kind", "hops")
    empty = seeds.select("fid", "svid", F.lit(-1).alias("verdict"), F.lit(None).cast("int").alias("param"), F.lit(None).cast("string").alias("function"), F.array().cast(states.schema["chain"].dataType).alias("chain"))
    for turn in count(1):
        known = states.join(F.broadcast(filters), "svid", "left")
        clean = F.coalesce(F.arrays_overlap("through", "sanitisers"), F.lit(False))
        if php:
            source = F.col("kind").isin("var", "call") & (F.array_contains(names, root) | F.array_contains(names, F.col("name")) | F.array_contains(names, F.col("key")))
        else:
            source = F.col("kind").isin("var", "call") & F.exists(names, lambda n: F.contains(F.coalesce("name", F.lit("")), n))
        judged = known.withColumn("verdict", F.when(clean, 2).when(source, 1).when(F.col("kind").isin("str", "const"), -1)).drop("sanitisers")
        settled = judged.where("verdict is not null").select("fid", "svid", "verdict", F.lit(None).cast("int").alias("param"), F.lit(None).cast("string").alias("function"), F.concat("chain", F.array(F.struct(F.lit("source").alias("node"), F.col("name").alias("code"), "path", F.lit(0).alias("line")))).alias("chain"))
        told = [settled]  # the round's verdicts
        open_ = judged.where("verdict is null").drop("verdict").withColumn("sid", F.xxhash64("fid", "path", "scope", "kind", "name", F.coalesce("key", F.lit("")), "ord", "branch", "stack", F.coalesce("call", F.lit(-1)), "through"))
        variables = open_.where("kind = 'var'")

        # nearest definitions: the last that surely ran, and all after it that may have
        d = _with(defs, "d_")
        same = F.col("path") == F.col("d_path")
        if php:
            member = F.startswith("name", F.lit("$this->"))
            own = (F.col("name") == F.col("d_name")) & ((~member & (F.col("scope") == F.col("d_scope")) & (F.col("d_ord") < F.col("ord"))) | (member & (F.col("cls") == F.col("d_cls")) & (F.col("cls") != "")))
            met = variables.join(d, same & own & (F.col("d_key").isNull() | F.col("key").isNull() | (F.col("d_key") == F.col("key")) | (F.col("d_key") == "*") | F.col("d_kind").isin("outer")))
        else:
            base = F.substring_index(F.col("name"), ".", 1)
            member = F.lit(False)
            hit = (F.col("d_name") == F.col("name")) | F.startswith("name", F.concat("d_name", F.lit("."))) | F.startswith("d_name", F.concat("name", F.lit(".")))
            inside = (F.col("d_scope") == F.col("scope")) & (F.col("d_ord") < F.col("ord")) | (F.col("d_scope") == "") & (F.col("scope") != "") | (F.col("d_kind") == "field")
            met = variables.withColumn("base", base).join(d, same & (F.col("base") == F.col("d_base")) & hit & inside).drop("base", "d_base")
        kills = F.col("d_kind").isin("assign", "foreach", "global", "outer") & F.startswith("branch", F.col("d_branch")) & (F.col("d_scope") == F.col("scope")) & (F.col("d_key").isNull() | F.col("d_key").eqNullSafe(F.col("key")))
        if php:
            kills = kills & ~member
        at = F.max(F.when(kills, F.col("d_ord"))).over(Window.partitionBy("sid"))
        live = met.withColumn("kill", at).where(F.col("kill").isNull() | (F.col("d_ord") >= F.col("kill")))
        live = live.drop("kill")
        out = _follow(live.where("d_kind not in ('global', 'outer')"), "d_", "def")
        bound = live.where((F.size("d_flow") == 0) & (F.col("d_kind") != "item") & ~F.col("d_kind").isin("global", "outer")).select("fid", "svid", F.lit(-1).alias("verdict"), F.lit(None).cast("int").alias("param"), F.lit(None).cast("string").alias("function"), "chain")
        told.append(bound)
        outer = live.where("d_kind in ('global', 'outer')").select(*[F.when(F.col("d_kind") == "outer", F.col("d_key")).otherwise("").alias("scope") if c == "scope" else F.when(F.col("d_kind") == "outer", F.col("ord")).otherwise(F.lit(LAST)).alias("ord") if c == "ord" else F.lit("").alias("branch") if c == "branch" else F.col(c) for c in STATE])

        # no definition: a parameter, an outer name, an included file, or open
        lost = variables.join(live.select("sid").distinct(), "sid", "left_anti")
        prm = params.select(F.col("path").alias("p_path"), F.col("scope").alias("p_scope"), F.col("name").alias("p_name"), F.col("pos").alias("p_pos"))
        first = F.regexp_extract("name", r"^(\$\w+)", 1) if php else F.substring_index(F.col("name"), ".", 1)
        lost = lost.withColumn("first", first).join(prm, (F.col("path") == F.col("p_path")) & (F.col("scope") == F.col("p_scope")) & ((F.col("p_name") == F.col("name")) | (F.col("p_name") == F.col("first"))), "left").drop("first", "p_path", "p_scope", "p_name")
        entered = lost.where("p_pos is not null and size(stack) > 0")
        a = _with(arguments, "a_")
        back = entered.join(a, (F.element_at("stack", -1) == F.col("a_id")) & (F.col("p_pos") == F.col("a_pos")))
        to_args = _follow(back, "a_", "argument", F.slice("stack", F.lit(1), F.size("stack") - 1))
        as_param = lost.where("p_pos is not null and size(stack) = 0").select("fid", "svid", F.lit(4).alias("verdict"), F.col("p_pos").alias("param"), F.col("scope").alias("function"), "chain")
        told.append(as_param)
        free = lost.where("p_pos is null")
        into = free.where("scope = ''").join(followed, F.col("path") == F.col("i_path"))
        across = into.where((F.col("f_path") != F.col("path")) & (F.col("hops") < depth)).select(*[(F.col("hops") + 1).alias("hops") if c == "hops" else F.col("f_path").alias("path") if c == "path" else F.lit(LAST).alias("ord") if c == "ord" else F.lit("").alias("branch") if c == "branch" else F.col(c) for c in STATE])
        told.append(free.select("fid", "svid", F.lit(3).alias("verdict"), F.lit(None).cast("int").alias("param"), F.lit(None).cast("string").alias("function"), "chain"))

        # calls of functions that the files define
        calls = open_.where("kind in ('call', 'new', 'function')")
        target = F.when(F.col("kind") == "new", F.concat("name", F.lit("::__toString"))).otherwise(F.col("name"))
        if targets is not None:
            calls = calls.join(targets, "call", "left")
            target = F.coalesce("run", target)
        f = functions.select(F.col("path").alias("f_path"), F.col("scope").alias("f_scope"), F.col("name").alias("f_name"))
        known_calls = calls.withColumn("target", target).join(f, (F.col("f_name") == F.element_at(F.split("target", "::"), -1)) & ((F.col("f_scope") == F.col("target")) | (F.col("kind") == "call") & ~F.contains("target", F.lit("::"))))
        r = _with(returns, "r_")
        to_returns = known_calls.where("call is not null and not array_contains(stack, call)").join(r, (F.col("f_path") == F.col("r_path")) & (F.col("f_scope") == F.col("r_scope")))
        entering = _follow(to_returns, "r_", "return", F.concat("stack", F.array("call")))

        if aliases is not None:  # the same field under another name
            out = out.unionByName(variables.join(aliases, ["path", "scope", "name"]).withColumn("name", F.col("alias")).select(*STATE))
        new = out.unionByName(outer).unionByName(to_args).unionByName(across).unionByName(entering)
        key = ["fid", "path", "scope", "name", "key", "ord", "stack", "kind"]
        # a state met before comes again only with fewer include hops
        fresh = new.groupBy(*key).agg(F.min_by(F.struct(*[c for c in STATE if c not in key]), "hops").alias("rest")).select(*[c if c in key else "rest." + c for c in STATE])
        k = seen.select(*[F.col(c).alias("k_" + c) for c in (*key, "hops")])
        match = F.col("k_hops") <= F.col("hops")
        for c in key:
            one = F.col(c).eqNullSafe(F.col("k_" + c)) if c in ("key", "name") else F.col(c) == F.col("k_" + c)
            match = match & one
        # verdicts and new states are one table, so that a round is one job and what both need is read once
        judged_rows = reduce(DataFrame.unionByName, told).select(F.struct("fid", "svid", "verdict", "param", "function", "chain").alias("v"))
        new_rows = fresh.join(k, match, "left_anti").select(F.struct(*STATE).alias("s"))
        kinds = judged_rows.schema["v"].dataType, new_rows.schema["s"].dataType
        table = written_round(judged_rows.withColumn("s", F.lit(None).cast(kinds[1])).unionByName(new_rows.select(F.lit(None).cast(kinds[0]).alias("v"), "s")))
        verdicts.append(table.where("v is not null").select("v.*"))
        states = table.where("s is not null").select("s.*")
        if states.isEmpty():
            break
        seen = seen.unionByName(states.select(*key, "hops"))
        if turn % 16 == 0:  # plans stay small over many rounds
            seen = written_round(seen)
            verdicts = [written_round(reduce(DataFrame.unionByName, verdicts))]
    every = empty
    for v in verdicts:
        every = every.unionByName(v)
    rank = F.when(F.col("verdict") == 1, 0).when(F.col("verdict") == 4, 1).when(F.col("verdict") == 3, 2).when(F.col("verdict") == 2, 3).otherwise(4)
    best = every.groupBy("fid", "svid").agg(F.min_by(F.struct("verdict", "param", "function", "chain"), F.struct(rank.alias("r"), F.size("chain").alias("n"), F.coalesce("param", F.lit(0)).alias("p"))).alias("b"))
    return best.select("fid", "svid", "b.*")


def derive(rows: DataFrame, language: str, tampers: DataFrame, table: DataFrame | None = None, derive: int = 20, unconfirmed: bool = False, projects: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings, (path, line, svid, sink, verdict, reason, chain), of the rules and of rules derived from parameters; and the derived functions.

    A verdict of 4 makes the function a sink at that argument for the same rule; derived sinks
    are traced in the next round, each (function, argument, rule) once, at most `derive` rounds.
    `projects`: a regular expression for what of a path is its project, which includes and constants stay in.
    Derived functions are rows (svid, sink, argument, kind, origin, round): which sink's parameter they came from, and in which round.
    """
    spark = rows.sparkSession
    table = sink_table(spark, language) if table is None else table
    included, more = include_links(rows, projects), {}
    if language == "javascript":
        rows, aliases, targets = points.resolve(rows, [r.sink for r in table.where("kind <> 'target'").select("sink").distinct().collect()])  # the catalog's names
        more = {"aliases": aliases, "targets": targets.where(F.startswith("target", F.lit("fn:"))).select(F.xxhash64("path", "id").alias("call"), F.substring("target", 4, 1 << 30).alias("run"))}
    rows = numbered(rows)
    tables = lookups(rows, language, included, **more)  # once for all levels
    made = written_round(table.select("svid", "sink", "argument", "kind"))
    out = functions = None
    for level in range(derive + 1):
        seeds = written_round(sinks(rows, table))
        traced = written_round(trace(rows, seeds, language, tampers, tables=tables).join(seeds.select("fid", F.col("path").alias("at"), "line", F.col("name").alias("called")).distinct(), "fid"))
        keep = [1, 3] if unconfirmed else [1]
        reason = F.when(F.col("verdict") == 3, "Unconfirmed Function-param-controllable").otherwise("Function-param-controllable" if not level else "New-function-param-controllable")
        found = traced.where(F.col("verdict").isin(keep)).select(F.col("at").alias("path"), "line", "svid", F.col("called").alias("sink"), "verdict", reason.alias("reason"), "chain")
        out = found if out is None else out.unionByName(found)
        method = F.element_at(F.split("function", "::"), -1)
        constructor = F.element_at(F.split("function", "::"), 1)
        if language != "php":
            method = F.element_at(F.split(method, "[.]"), -1)
        new = (traced.where("verdict = 4 and function is not null").select("svid", F.when(method == "__construct", constructor).otherwise(method).alias("sink"), F.col("param").alias("argument"),
                                                                          F.lit("name" if language == "php" else "member").alias("kind"), F.col("called").alias("origin"))
               .groupBy("svid", "sink", "argument", "kind").agg(F.min("origin").alias("origin")))
        if language == "javascript":  # by the function itself where calls are known to run it
            new = new.unionByName(traced.where("verdict = 4 and function is not null").groupBy("svid", F.concat(F.lit("@"), "function").alias("sink"), F.col("param").alias("argument")).agg(F.min("called").alias("origin")).withColumn("kind", F.lit("function")))
        table = written_round(new.join(made, ["svid", "sink", "argument"], "left_anti").withColumn("round", F.lit(level + 1)))
        functions = table if functions is None else functions.unionByName(table)
        if table.isEmpty():
            break
        made = made.unionByName(table.select("svid", "sink", "argument", "kind"))
        table = table.select("svid", "sink", "argument", "kind")
    return out.dropDuplicates(["path", "line", "svid", "sink"]), functions


def findings(rows: DataFrame, language: str, tampers: DataFrame, **more) -> DataFrame:
    """The findings of `derive`."""
    return derive(rows, language, tampers, **more)[0]


def call_pattern(name: str, argument: int, optional: int = 0, constructed: bool = False) -> str:
    """A regular expression for calls of a derived function that hands on `argument`, of which the last `optional` before it may be absent; its first group is the argument.

    Definitions of the function are no calls.
    """
    before = "[^,()]*," * (argument - optional) + "(?:[^,()]*,)?" * optional
    return rf"(?<!function )(?<!\w)(?:{'new ' if constructed else ''}{re.escape(name)})\s*\({before}([^,()]*)"


def derived_parameters(groups, php: bool = True):
    """What a derived rule's hit hands on: of the first group that is not empty, the PHP variables, or else the arguments, trimmed."""
    first = F.get(F.filter(groups, lambda g: F.trim(g) != ""), F.lit(0))
    if php:
        return F.regexp_extract_all(first, F.lit(r"\$\w+"), F.lit(0))
    return F.transform(F.split(first, ","), lambda x: F.btrim(x, F.lit(" \t\n\r'\"")))


def scan(files: DataFrame, language: str, tampers: DataFrame | None = None, **more) -> DataFrame:
    """files(path, content) of one language to findings with rule names and levels."""
    spark = files.sparkSession
    rows = written_round(records(files, language))
    found = findings(rows, language, catalog.tampers(spark) if tampers is None else tampers, **more)
    return found.join(F.broadcast(catalog.rules(spark).select("svid", "rule_name", "level")), "svid")
