"""Points-to sets of JavaScript, by inclusion constraints that joins solve.

Variables are (path, scope, name); objects are functions (`fn:scope`), instances of a class or
constructor (`new:F`), prototypes (`proto:F`), object literals (`lit:scope|name`) and functions from
outside (`ext:name`).  A field of an object is the variable (path, @object, field).  Rules:

* copy: x = y; argument to parameter where a call's callee points to a function;
* load: x.f holds what field f of each object of x holds;
* store: what x.f is given goes to field f of each object of x;
* `this` of a function holds what it was called on, its class's instances, or the literal that holds it.

Sets only grow, so rounds end; each is one table.  All joins are inside a file.  A file that names
nothing twice gives no facts.  Order of statements and branches is not told apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import bucketed, buckets, hierarchy, release, written_round
from .parse import of

_VAR = ["path", "scope", "name"]
#: Callees whose first argument is a program's text.
EVALUATED = ("eval", "setTimeout", "setInterval", "Function")


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _base(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def _field(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def _placed(rows: DataFrame, locals_: DataFrame) -> DataFrame:
    """Names with the scope that they belong to: their function's where it has a definition or parameter of that name, else the file's."""
    return (rows.withColumn("root", F.substring_index("name", ".", 1)).join(locals_, ["path", "scope", "root"], "left")
            .withColumn("scope", F.when(F.col("local").isNotNull() | (F.col("root") == "this"), F.col("scope")).otherwise("")).drop("root", "local"))


def _leaves(rows: DataFrame, kind: str, *keep: str) -> DataFrame:
    return rows.select("path", "scope", *keep, F.explode(F.filter("flow", lambda x: x["kind"] == kind)).alias("leaf")).select("path", "scope", *keep, F.col("leaf.name").alias("name"))


def facts(rows: DataFrame, outside: list[str]) -> dict[str, DataFrame]:
    """The constraints of the files: tables of copies, mentions, calls, parameters, arguments and first facts (path, scope, name, obj)."""
    defs, functions, classes = of(rows, "def"), of(rows, "function"), of(rows, "class")
    locals_ = written_round(defs.where("scope <> ''").where(~F.contains("name", F.lit("."))).select("path", "scope", F.col("name").alias("root"))
                            .unionByName(of(rows, "param").select("path", "scope", F.col("name").alias("root"))).distinct().withColumn("local", F.lit(True)))
    place = lambda df: _placed(df, locals_)
    target = place(defs.select("path", "scope", "name", "ord")).select("path", "ord", F.col("scope").alias("to_scope"), F.col("name").alias("to_name"))
    copies = place(_leaves(defs, "var", "ord")).join(target, ["path", "ord"]).select("path", "scope", "name", "to_scope", "to_name").distinct()
    given = lambda df, obj: df.select("path", F.col("to_scope").alias("scope"), F.col("to_name").alias("name"), obj.alias("obj"))
    made = defs.select("path", "ord", F.col("scope").alias("at"), "kind", F.explode("flow").alias("leaf")).join(target, ["path", "ord"])
    of_function = given(made.where("leaf.kind = 'function'"), F.concat(F.lit("fn:"), F.col("leaf.name")))
    of_new = given(made.where("leaf.kind = 'new'"), F.concat(F.lit("new:"), F.col("leaf.name")))
    literal = F.concat(F.lit("lit:"), "to_scope", F.lit("|"), _base(F.col("to_name")))
    items = defs.where("kind = 'item'").where(F.contains("name", F.lit("."))).select("path", "ord").join(target, ["path", "ord"])
    plain = items.where(~F.contains("to_name", F.lit(".prototype")))
    of_literal = plain.select("path", F.col("to_scope").alias("scope"), _base(F.col("to_name")).alias("name"), literal.alias("obj"))
    own_literal = made.where("leaf.kind = 'function' and kind = 'item'").where(~F.contains("to_name", F.lit(".prototype"))).select("path", F.col("leaf.name").alias("scope"), F.lit("this").alias("name"), literal.alias("obj"))
    declared = functions.where("cls = ''").where(~F.contains("name", F.lit("."))).select("path", F.lit("").alias("scope"), "name", F.concat(F.lit("fn:"), "scope").alias("obj"))
    # constructors, prototypes and classes
    prototype = defs.where(F.col("name").rlike(r"^[^.]+\.prototype\.")).select("path", F.lit("").alias("scope"), F.regexp_extract("name", r"^([^.]+\.prototype)\.", 1).alias("name"), F.concat(F.lit("proto:"), F.substring_index("name", ".", 1)).alias("obj"))
    on_prototype = made.where("leaf.kind = 'function'").where(F.col("to_name").rlike(r"^[^.]+\.prototype\.")).select("path", F.col("leaf.name").alias("scope"), F.lit("this").alias("name"), F.concat(F.lit("new:"), F.substring_index("to_name", ".", 1)).alias("obj"))
    built = of(rows, "call").where("kind = 'new'").select("path", F.col("name").alias("scope"), F.lit("this").alias("name"), F.concat(F.lit("new:"), "name").alias("obj"))
    methods = functions.where("cls <> ''").select("path", "cls", "name", "scope")
    in_class = methods.select("path", "scope", F.lit("this").alias("name"), F.concat(F.lit("new:"), "cls").alias("obj"))
    constructor = methods.where("name = 'constructor'").select("path", F.lit("").alias("scope"), F.col("cls").alias("name"), F.concat(F.lit("fn:"), "scope").alias("obj"))
    at = lambda c: F.struct("path", F.col(c).alias("cls"))
    parents = classes.where("key <> ''").select("path", "name", F.explode(F.split("key", ",")).alias("parent")).select(at("name").alias("a"), at("parent").alias("b"))
    up = hierarchy(parents, classes.select(at("name").alias("root"))).select("root.path", F.col("root.cls").alias("own"), F.col("node.cls").alias("cls"), "depth")
    nearest = Window.partitionBy("path", "own", "name").orderBy("depth")
    inherited = methods.join(up, ["path", "cls"]).withColumn("n", F.rank().over(nearest)).where("n = 1").select("path", F.concat(F.lit("@new:"), "own").alias("scope"), "name", F.concat(F.lit("fn:"), "scope").alias("obj"))
    # functions from outside that a name is given
    last = F.substring_index("name", ".", -1)
    known = _union(defs.select("path", F.substring_index("name", ".", 1).alias("root")), functions.select("path", F.substring_index("name", ".", 1).alias("root")), of(rows, "param").select("path", F.col("name").alias("root"))).distinct()
    foreign = (copies.where(F.col("name").isin(*outside) | F.contains("name", F.lit(".")) & last.isin(*outside)).withColumn("root", F.substring_index("name", ".", 1)).join(known, ["path", "root"], "left_anti")
               .select("path", F.col("to_scope").alias("scope"), F.col("to_name").alias("name"), F.concat(F.lit("ext:"), "name").alias("obj")))
    first = _union(of_function, of_new, of_literal, own_literal, declared, prototype, on_prototype, built, in_class, constructor, inherited, foreign).distinct()

    calls = place(of(rows, "call").where("kind in ('function', 'method', 'new')").select("path", "scope", "name", "id")).distinct()
    args = of(rows, "arg")
    passed = place(_leaves(args, "var", "id", "pos")).distinct()
    passed_functions = _leaves(args, "function", "id", "pos").select("path", "id", "pos", F.concat(F.lit("fn:"), "name").alias("obj"))
    every = _union(place(_leaves(of(rows, "def", "arg", "return"), "var")), calls.select(*_VAR), copies.select("path", F.col("to_scope").alias("scope"), F.col("to_name").alias("name")), first.where(~F.startswith("scope", F.lit("@"))).select(*_VAR))
    dotted = every.where(F.contains("name", F.lit("."))).select("path", "scope", F.explode(F.transform(F.sequence(F.lit(2), F.size(F.split("name", "[.]"))), lambda n: F.array_join(F.slice(F.split("name", "[.]"), F.lit(1), n), "."))).alias("name")).distinct()
    mentions = dotted.select(*_VAR, _base(F.col("name")).alias("base"), _field(F.col("name")).alias("field"))
    stored = target.where(F.contains("to_name", F.lit("."))).select("path", F.col("to_scope").alias("scope"), F.col("to_name").alias("name"), _base(F.col("to_name")).alias("base"), _field(F.col("to_name")).alias("field")).distinct()
    params = of(rows, "param").select("path", F.concat(F.lit("fn:"), "scope").alias("obj"), "scope", "name", "pos")
    tables = {"first": first, "copies": copies, "calls": calls, "passed": passed, "passed_functions": passed_functions, "mentions": mentions, "stored": stored, "params": params}
    dealt = {"copies": _VAR, "calls": _VAR, "passed": _VAR, "mentions": ["path", "scope", "base"], "stored": ["path", "scope", "base"], "params": ["path", "obj"]}  # by what every round of `solve` joins them on
    n = buckets(rows)
    return {k: bucketed(v, n, *dealt[k]) if k in dealt else written_round(v) for k, v in tables.items()} | {"locals": locals_}


def solve(f: dict[str, DataFrame]) -> DataFrame:
    """(path, scope, name, obj): the least sets that all constraints allow."""
    points, size = f["first"], -1
    while True:
        p = points
        held = p.select("path", "scope", F.col("name").alias("base"), F.col("obj").alias("owner"))
        fields = p.where(F.startswith("scope", F.lit("@"))).select("path", F.substring("scope", 2, 1 << 30).alias("owner"), F.col("name").alias("field"), "obj")
        # an instance has what its prototype has, unless it has its own
        shared = fields.where(F.startswith("owner", F.lit("proto:"))).select("path", F.concat(F.lit("@new:"), F.substring("owner", 7, 1 << 30)).alias("scope"), F.col("field").alias("name"), "obj")
        copied = p.join(f["copies"], _VAR).select("path", F.col("to_scope").alias("scope"), F.col("to_name").alias("name"), "obj")
        loaded = f["mentions"].join(held, ["path", "scope", "base"]).join(fields, ["path", "owner", "field"]).select(*_VAR, "obj")
        stored = f["stored"].join(held, ["path", "scope", "base"]).join(p, _VAR).select("path", F.concat(F.lit("@"), "owner").alias("scope"), F.col("field").alias("name"), "obj")
        called = f["calls"].join(p, _VAR).select("path", "scope", "name", "id", "obj").where(F.startswith("obj", F.lit("fn:")))
        bound = called.select("path", "id", "obj").join(f["params"], ["path", "obj"]).select("path", "id", "pos", "scope", F.col("name").alias("param"))
        handed = bound.join(f["passed"].join(p, _VAR).select("path", "id", "pos", "obj").unionByName(f["passed_functions"]), ["path", "id", "pos"]).select("path", "scope", F.col("param").alias("name"), "obj")
        receiver = (called.where(F.contains("name", F.lit("."))).withColumn("base", _base(F.col("name"))).join(held, ["path", "scope", "base"])
                    .select("path", F.substring("obj", 4, 1 << 30).alias("scope"), F.lit("this").alias("name"), F.col("owner").alias("obj")))
        points, before = written_round(_union(p, shared, copied, loaded, stored, handed, receiver).distinct()), p
        if size >= 0:  # the first facts serve other readers
            release(before)
        now = points.count()
        if now == size:
            return points
        size = now


def _token(obj: Column) -> Column:
    return F.concat(F.lit("@"), F.md5(obj.cast("binary")))


def resolve(rows: DataFrame, outside: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records with what points-to sets say; aliases (path, scope, name, alias) of names; targets (path, id, target) of calls.

    An argument of a call whose callee is known comes once for each function that it may be, `key` being `@` and the
    function's scope, or by the name of a function from outside; a definition of x.f comes again under the field of each
    object of x (`kind` field).  Names read x.f are aliases of such fields where x is `this` or no definition bears that very name.
    A text that is evaluated and is a name is read as one.
    """
    read = F.transform("flow", lambda x: x.withField("kind", F.when((x["kind"] == "str") & x["name"].rlike(r"^[A-Za-z_$][\w$]*(\.[A-Za-z_$][\w$]*)*$"), "var").otherwise(x["kind"])))
    rows = rows.withColumn("flow", F.when((F.col("rec") == "arg") & F.col("name").isin(*EVALUATED) & (F.col("pos") == 0), read).otherwise(F.col("flow")))
    f = facts(rows, outside)
    p = solve(f)
    held = p.select("path", "scope", F.col("name").alias("base"), F.col("obj").alias("owner")).where(~F.startswith("obj", F.lit("ext:")) & ~F.startswith("obj", F.lit("fn:")))
    targets = written_round(f["calls"].join(p, _VAR).where(F.startswith("obj", F.lit("fn:")) | F.startswith("obj", F.lit("ext:"))).select("path", "id", F.col("obj").alias("target")).distinct())
    chosen = targets.groupBy("path", "id").agg(F.collect_set("target").alias("targets"))  # functions of one file
    args = of(rows, "arg").join(chosen, ["path", "id"], "left").withColumn("target", F.explode_outer("targets")).drop("targets")
    function, outer = F.startswith("target", F.lit("fn:")), F.startswith("target", F.lit("ext:"))
    args = args.withColumn("key", F.when(function, F.concat(F.lit("@"), F.substring("target", 4, 1 << 30))).otherwise(F.col("key"))).withColumn("name", F.when(outer, F.substring("target", 5, 1 << 30)).otherwise(F.col("name"))).drop("target")
    dotted = of(rows, "def").where(F.contains("name", F.lit(".")))
    place = _placed(dotted.select("path", "scope", "name", "ord"), f["locals"]).select("path", "ord", F.col("scope").alias("at"), _base(F.col("name")).alias("base"), _field(F.col("name")).alias("field"))
    objects = place.join(held.withColumnRenamed("scope", "at"), ["path", "at", "base"]).select("path", "ord", F.concat(_token(F.col("owner")), F.lit("."), "field").alias("as")).distinct()
    again = dotted.join(objects, ["path", "ord"]).withColumn("name", F.col("as")).withColumn("kind", F.lit("field")).drop("as")
    names = _leaves(of(rows, "def", "arg", "return"), "var").where(F.contains("name", F.lit("."))).distinct()
    same = dotted.select("path", "name", F.col("scope").alias("defined")).distinct()
    bare = names.join(same, ["path", "name"], "left").groupBy(*_VAR).agg(F.coalesce(F.bool_or(F.col("defined").isin("") | (F.col("defined") == F.col("scope"))), F.lit(False)).alias("direct"))
    wanted = bare.where(~F.col("direct") | F.startswith("name", F.lit("this."))).select(*_VAR).withColumn("from", F.col("scope"))
    aliases = (_placed(wanted, f["locals"]).withColumn("base", _base(F.col("name"))).join(held, ["path", "scope", "base"])
               .select("path", F.col("from").alias("scope"), "name", F.concat(_token(F.col("owner")), F.lit("."), _field(F.col("name"))).alias("alias")).distinct())
    return written_round(_union(rows.where("rec <> 'arg'"), args.select(*rows.columns), again.select(*rows.columns))), written_round(aliases), targets
