"""The code database of a PHP corpus, and chains of magic methods found in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import PHP_SOURCES
from ..operators.joins import hierarchy, written_round
from .parse import of

# Entry methods, and sinks with the positions that must be controllable.
ENTRIES = ("__destruct", "__wakeup", "__toString", "__invoke", "__get", "__set", "__call", "__callStatic", "__isset", "__unset", "__sleep")
SINKS = {"call_user_func": (0,), "call_user_func_array": (0, 1), "eval": (0,), "system": (0,), "file_put_contents": (0, 1), "create_function": (0, 1)}

_TYPES = {"class": "newClass", "param": "params", "def": "Assignment", "include": "Include", "return": "Return"}


def dataflow(rows: DataFrame) -> DataFrame:
    """(path, node_locate, node_sort, source_node, node_type, sink_node): the database's rows, in source order."""
    locate = F.concat_ws(".", F.col("path"), F.when(F.col("cls") != "", F.concat(F.lit("Class-"), "cls")), F.when((F.col("scope") != "") & ~F.endswith("scope", F.lit("::")), F.concat(F.lit("Method-"), F.element_at(F.split("scope", "::"), -1))))
    kind = F.when(F.col("rec") == "function", F.when(F.col("cls") != "", "newMethod").otherwise("newFunction"))
    kind = F.coalesce(kind, F.when(F.col("rec") == "call", F.when(F.col("kind") == "method", "MethodCall").when(F.col("kind") == "static", "StaticMethodCall").when(F.col("kind") == "new", "New").otherwise("FunctionCall")))
    for rec, name in _TYPES.items():
        kind = F.coalesce(kind, F.when(F.col("rec") == rec, name))
    kind = F.coalesce(kind, F.when(F.col("rec") == "node", F.col("kind")))
    sink = F.when(F.col("rec") == "class", F.col("key")).otherwise(F.array_join(F.transform("flow", lambda x: x["name"]), ","))
    return rows.withColumn("node_type", kind).where("node_type is not null").select("path", locate.alias("node_locate"), F.col("ord").alias("node_sort"), F.col("name").alias("source_node"), "node_type", sink.alias("sink_node"))


def _project(projects: str | None):
    """The project of a record: what the regular expression finds in its path; one for all without it."""
    return (F.regexp_extract("path", projects, 0) if projects else F.lit("")).alias("project")


def methods(rows: DataFrame, projects: str | None = None) -> DataFrame:
    return of(rows, "function").where("cls <> ''").select(_project(projects), "cls", F.col("name").alias("method"), "scope").distinct()


def ancestors(rows: DataFrame, projects: str | None = None) -> DataFrame:
    """(project, cls, parent) with each class its own first parent, all levels up."""
    named = lambda c: F.struct(_project(projects), F.col(c).alias("cls"))
    classes = of(rows, "class")
    direct = classes.where("key <> ''").select("path", "name", F.explode(F.split("key", ",")).alias("parent")).select(named("name").alias("a"), named("parent").alias("b"))
    found = hierarchy(direct, classes.select(named("name").alias("root")))
    return found.select("root.project", F.col("root.cls").alias("cls"), F.col("node.cls").alias("parent"))


def inherited(rows: DataFrame, projects: str | None = None) -> DataFrame:
    """(project, cls, name, dst): the methods that a class has, its own and its parents'; written down."""
    m = methods(rows, projects).select("project", F.col("cls").alias("parent"), F.col("method").alias("name"), F.col("scope").alias("dst"))
    return written_round(m.join(ancestors(rows, projects), ["project", "parent"]).select("project", "cls", "name", "dst"))


_FROM = "struct<base:boolean,params:array<int>>"
#: Functions that turn an object into text.
TEXTS = ("echo", "print", "strlen", "trim", "strtolower", "md5", "preg_match", "file_exists", "die", "exit")


def _first(name):
    """What a leaf of a method's flow begins with: $this for a property, $_ for input from outside, else the variable."""
    return F.when(F.startswith(name, F.lit("$this->")), "$this").when(F.regexp_extract(name, r"^(\$\w+)", 1).isin(*PHP_SOURCES), "$_").otherwise(F.regexp_extract(name, r"^(\$\w+)", 1))


def parameters(rows: DataFrame) -> DataFrame:
    """(path, scope, name, pos, kind) of methods."""
    return of(rows, "param").where("cls <> ''").select("path", "scope", "name", "pos", "kind")


def assigned(rows: DataFrame) -> DataFrame:
    """(path, scope, var, more): what a method assigns to its local variables, over any number of steps; written down."""
    plain = of(rows, "def").where("cls <> ''").where(F.col("name").rlike(r"^\$\w+$") & (F.col("name") != "$this"))
    at = lambda c: F.struct("path", "scope", F.col(c).alias("var"))
    step = plain.select("path", "scope", "name", F.explode(F.filter("flow", lambda x: x["kind"] == "var")).alias("leaf")).select("path", "scope", "name", _first(F.col("leaf.name")).alias("var"))
    reach = hierarchy(step.select(at("name").alias("a"), at("var").alias("b")).where("a <> b").distinct(), plain.select(at("name").alias("root")), depth=1 << 20)
    return written_round(reach.where("root <> node").select("root.path", "root.scope", "root.var", F.col("node.var").alias("more")))


def origins(rows: DataFrame, leaves: DataFrame, keys: list[str], deeper: DataFrame) -> DataFrame:
    """leaves(path, scope, *keys, flow) of methods to (*keys, path, scope, base, params): whether a property or outside input, and which own parameters, may flow in.

    Local variables count with all that their method assigns to them: `deeper`, from `assigned`.
    """
    flow = leaves.select("path", "scope", *keys, F.explode_outer(F.filter("flow", lambda x: x["kind"] == "var")).alias("leaf")).select("path", "scope", *keys, _first(F.col("leaf.name")).alias("var"))
    every = flow.unionByName(flow.join(deeper, ["path", "scope", "var"]).select("path", "scope", *keys, F.col("more").alias("var")))
    own = parameters(rows).select("path", "scope", F.col("name").alias("var"), F.col("pos").alias("param"))
    return every.join(own, ["path", "scope", "var"], "left").groupBy("path", "scope", *keys).agg(F.coalesce(F.bool_or(F.col("var").isin("$this", "$_")), F.lit(False)).alias("base"), F.collect_set("param").alias("params"))


def _holds(x, ctrl):
    """Whether a value is controllable in a state: by itself, or by a parameter that is."""
    return x["base"] | F.arrays_overlap(x["params"], ctrl)


def moves(rows: DataFrame, deeper: DataFrame, has: DataFrame, projects: str | None = None) -> DataFrame:
    """(project, scope, node, need, gives): how a method's calls lead on.

    `node` names what is called: `->name/n` (a method of any class, with n arguments), `Class=>name/n` (a static call),
    `__invoke/n`, or a magic method.  All of `need` must be controllable; parameter `to` of the called one is if its value in `gives` is.
    """
    project = _project(projects)
    calls = of(rows, "call").where("cls <> ''")
    args = of(rows, "arg").where("cls <> ''")
    deep = lambda c: F.regexp_count(c, F.lit("->")) >= 2
    # one row for each value that decides: arguments by position, -1 what a dynamic call calls, -2 the object of a deep property
    callee = calls.where("kind = 'dynamic'").select("path", "scope", "id", F.lit(-1).alias("pos"), F.array(F.struct(F.lit("var").alias("kind"), "name")).alias("flow"))
    light = lambda df: df.withColumn("flow", F.transform("flow", lambda x: F.struct(x["kind"].alias("kind"), x["name"].alias("name"))))
    values = light(args.select("path", "scope", "id", "pos", "flow")).unionByName(callee)
    places = of(rows, "def", "arg", "return").where("cls <> ''")
    reads = places.select("path", "scope", F.explode("flow").alias("x")).where((F.col("x.kind") == "var") & deep(F.col("x.name"))).select("path", "scope", F.col("x.name").alias("name"), F.lit("__get").alias("node")).distinct()
    sets = of(rows, "def").where("cls <> ''").where(deep(F.col("name"))).select("path", "scope", "name", F.lit("__set").alias("node"), "ord", "flow")
    objects = reads.withColumn("ord", F.lit(None).cast("int")).unionByName(sets.drop("flow")).select("path", "scope", F.concat_ws("#", "node", "name", F.col("ord").cast("string")).alias("key"), F.lit(-2).alias("pos"), F.array(F.struct(F.lit("var").alias("kind"), "name")).alias("flow"))
    stored = light(sets.select("path", "scope", F.concat_ws("#", "node", "name", F.col("ord").cast("string")).alias("key"), F.lit(1).alias("pos"), "flow"))
    leaves = values.select("path", "scope", F.col("id").cast("string").alias("key"), "pos", "flow").unionByName(objects).unionByName(stored)
    told = origins(rows, leaves, ["key", "pos"], deeper).groupBy("path", "scope", "key").agg(F.collect_list(F.struct("pos", "base", "params")).alias("values"))  # a call's arguments
    told = written_round(told)

    of_pos = lambda test: F.transform(F.filter("values", test), lambda x: F.struct(x["base"].alias("base"), x["params"].alias("params")))
    give = lambda to: F.transform(F.filter("values", lambda x: x["pos"] >= 0), lambda x: F.struct((x["pos"] if to is None else F.lit(to)).cast("int").alias("to"), x["base"].alias("base"), x["params"].alias("params")))
    none = F.array().cast(f"array<{_FROM}>")
    nothing = F.array().cast("array<struct<to:int,base:boolean,params:array<int>>>")
    all_calls = calls.select(project, "path", "scope", "cls", F.col("id").cast("string").alias("key"), "name", "kind", F.col("pos").alias("n")).join(told, ["path", "scope", "key"], "left").withColumn("values", F.coalesce("values", F.array().cast(told.schema["values"].dataType)))
    known = methods(rows, projects).select("project", F.col("method").alias("name")).distinct().withColumn("known", F.lit(True))
    named = all_calls.where("kind = 'method'").join(known, ["project", "name"], "left")
    by_name = named.where("known").select("project", "scope", F.concat(F.lit("->"), "name", F.lit("/"), F.col("n").cast("string")).alias("node"), none.alias("need"), give(None).alias("gives"))
    unknown = named.where("known is null").select("project", "scope", F.lit("__call").alias("node"), none.alias("need"), give(1).alias("gives"))
    dynamic = all_calls.where("kind = 'dynamic'").select("project", "scope", F.concat(F.lit("__invoke/"), F.col("n").cast("string")).alias("node"), of_pos(lambda x: x["pos"] == -1).alias("need"), give(None).alias("gives"))
    cls, method = F.element_at(F.split("name", "::"), 1), F.element_at(F.split("name", "::"), -1)
    static = all_calls.where("kind = 'static'").withColumn("of", F.when(F.lower(cls).isin("self", "static", "parent"), F.col("cls")).otherwise(cls)).withColumn("method", method)
    there = has.select("project", F.col("cls").alias("of"), F.col("name").alias("method")).distinct().withColumn("known", F.lit(True))
    static = static.join(there, ["project", "of", "method"], "left")
    by_class = static.where("known").select("project", "scope", F.concat("of", F.lit("=>"), "method", F.lit("/"), F.col("n").cast("string")).alias("node"), none.alias("need"), give(None).alias("gives"))
    no_class = static.where("known is null").select("project", "scope", F.lit("__callStatic").alias("node"), none.alias("need"), give(1).alias("gives"))
    texts = all_calls.where(F.col("name").isin(*TEXTS)).select("project", "scope", F.lit("__toString").alias("node"), F.explode("values").alias("x")).where("x.pos >= 0").select("project", "scope", "node", F.array(F.struct("x.base", "x.params")).alias("need"), nothing.alias("gives"))
    properties = told.where("key rlike '^__[gs]et#'").select(project, "scope", F.substring("key", 1, 5).alias("node"), of_pos(lambda x: x["pos"] == -2).alias("need"), give(None).alias("gives"))
    out = by_name
    for more in (unknown, dynamic, by_class, no_class, texts, properties):
        out = out.unionByName(more)
    return out.distinct()


def targets(rows: DataFrame, nodes: DataFrame, has: DataFrame, projects: str | None = None) -> DataFrame:
    """(project, node, dst, last): the methods that each of nodes(project, node) may run; a call of another number of arguments does not fit.

    Callers and methods meet through nodes alone, so their product is never formed.  `last`: the place that takes all further arguments, if any.
    """
    arity = parameters(rows).groupBy(_project(projects), "scope").agg(F.count_if(F.col("kind") == "").alias("least"), F.count("*").alias("most"), F.max(F.when(F.col("kind") == "rest", F.col("pos"))).alias("last"))
    m = methods(rows, projects).join(arity, ["project", "scope"], "left").select("project", "cls", "method", "scope", F.coalesce("least", F.lit(0)).alias("least"), F.coalesce("most", F.lit(0)).alias("most"), "last")
    counted = nodes.where(F.contains("node", F.lit("/"))).select("project", "node", F.split("node", "/").alias("p")).select("project", "node", F.get("p", F.lit(0)).alias("what"), F.get("p", F.lit(1)).cast("int").alias("n"))
    fits = (F.col("n") >= F.col("least")) & ((F.col("n") <= F.col("most")) | F.col("last").isNotNull())
    sized = m.select("project", F.col("method").alias("name"), F.col("scope").alias("dst"), "least", "most", "last")
    by_name = counted.where(~F.contains("what", F.lit("=>"))).withColumn("name", F.regexp_replace("what", "^->", "")).join(sized, ["project", "name"]).where(fits)
    static = counted.where(F.contains("what", F.lit("=>"))).withColumn("cls", F.get(F.split("what", "=>"), F.lit(0))).withColumn("name", F.get(F.split("what", "=>"), F.lit(1)))
    by_class = static.join(has, ["project", "cls", "name"]).join(sized.drop("name"), ["project", "dst"]).where(fits)
    magic = nodes.where(~F.contains("node", F.lit("/"))).join(sized.withColumn("node", F.col("name")), ["project", "node"])
    names = ["project", "node", "dst", "last"]
    return by_name.select(*names).unionByName(by_class.select(*names)).unionByName(magic.select("project", "node", "dst", F.lit(None).cast("int").alias("last"))).distinct()


def danger(rows: DataFrame, deeper: DataFrame, projects: str | None = None) -> DataFrame:
    """(project, scope, sink, line, need): calls of a dangerous function, and the values at its required positions."""
    want = rows.sparkSession.createDataFrame([(n, p) for n, ps in SINKS.items() for p in ps], "name string, pos int")
    args = of(rows, "arg").where("cls <> ''").join(F.broadcast(want), ["name", "pos"]).select("path", "scope", "name", "id", "pos", "line", "flow")
    full = F.broadcast(want.groupBy("name").agg(F.count("*").alias("n")))
    told = origins(rows, args, ["name", "id", "pos", "line"], deeper).groupBy("path", "scope", "name", "id").agg(F.min("line").alias("line"), F.collect_list(F.struct("base", "params")).alias("need"))
    return told.join(full, "name").where(F.size("need") == F.col("n")).select(_project(projects), "scope", F.col("name").alias("sink"), "line", "need").distinct()


def states(rows: DataFrame, deeper: DataFrame, projects: str | None = None, depth: int = 40) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The product of methods and controllable parameters that entries reach.

    (project, scope, ctrl) with ctrl the sorted controllable positions; (project, scope, ctrl, node, given) of calls, and (project, node, given, dst, ctrl_dst)
    of what they run.  Entries begin with none.  A frontier loop: each state is met once, and each round is one table.
    """
    has = inherited(rows, projects)
    steps = written_round(moves(rows, deeper, has, projects))
    ends = written_round(targets(rows, steps.select("project", "node").distinct(), has, projects))

    def calls_of(some: DataFrame) -> DataFrame:
        taken = some.join(steps, ["project", "scope"]).where(F.forall("need", lambda x: _holds(x, F.col("ctrl"))))
        given = F.array_sort(F.array_distinct(F.transform(F.filter("gives", lambda x: _holds(x, F.col("ctrl"))), lambda x: x["to"])))
        return taken.select("project", "scope", "ctrl", "node", given.alias("given")).distinct()

    def runs_of(calls: DataFrame) -> DataFrame:
        into = F.when(F.col("last").isNull(), F.col("given")).otherwise(F.array_sort(F.array_distinct(F.transform("given", lambda x: F.least(x, "last")))))
        return calls.select("project", "node", "given").distinct().join(ends, ["project", "node"]).select("project", "node", "given", "dst", into.alias("ctrl_dst"))

    known = frontier = written_round(methods(rows, projects).where(F.col("method").isin(*ENTRIES)).select("project", "scope", F.array().cast("array<int>").alias("ctrl")).distinct())
    for _ in range(depth - 1):
        reached = runs_of(calls_of(frontier)).select("project", F.col("dst").alias("scope"), F.col("ctrl_dst").alias("ctrl")).distinct()
        frontier = written_round(reached.join(known, ["project", "scope", "ctrl"], "left_anti"))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    calls = written_round(calls_of(known))
    return known, calls, written_round(runs_of(calls))


def chains(rows: DataFrame, depth: int = 40, projects: str | None = None) -> DataFrame:
    """(project, entry, methods, classes, sink, line, fingerprint, has_wakeup): every simple chain of at most `depth` methods from an entry method to a dangerous call whose required values are controllable there.

    A chain comes once by its methods and sink, with the first line.  Three loops of joins, written down round by round: the states that entries reach,
    which of these lead to danger, and paths over what is left, so that a path is extended only to where some chain may end.
    Their number may grow fast with the calls of a project, as chains do.  Projects are what the regular expression `projects` finds in paths; without it all files are one.
    """
    deeper = assigned(rows)
    known, calls, runs = states(rows, deeper, projects, depth)
    key = ["project", "scope", "ctrl"]
    hot = written_round(known.join(danger(rows, deeper, projects), ["project", "scope"]).where(F.forall("need", lambda x: _holds(x, F.col("ctrl")))).groupBy(*key, "sink").agg(F.min("line").alias("line")))
    useful = back = hot.select(*key).distinct()
    while True:
        from_ = back.select("project", F.col("scope").alias("dst"), F.col("ctrl").alias("ctrl_dst")).join(runs, ["project", "dst", "ctrl_dst"]).select("project", "node", "given").distinct()
        back = written_round(calls.join(from_, ["project", "node", "given"]).select(*key).distinct().join(useful, key, "left_anti"))
        if back.isEmpty():
            break
        useful = useful.unionByName(back)
    useful = written_round(useful)
    live = written_round(runs.join(useful.select("project", F.col("scope").alias("dst"), F.col("ctrl").alias("ctrl_dst")), ["project", "dst", "ctrl_dst"]))
    start = useful.where(F.element_at(F.split("scope", "::"), -1).isin(*ENTRIES) & (F.size("ctrl") == 0))
    paths = written_round(start.select(*key, F.col("scope").alias("entry"), F.array("scope").alias("methods")))
    found = paths
    for _ in range(depth - 1):
        step = paths.join(calls, key).select("project", "entry", "methods", "node", "given").distinct().join(live, ["project", "node", "given"]).where(~F.array_contains("methods", F.col("dst")))
        paths = written_round(step.select("project", F.col("dst").alias("scope"), F.col("ctrl_dst").alias("ctrl"), "entry", F.concat("methods", F.array("dst")).alias("methods")).distinct())
        if paths.isEmpty():
            break
        found = found.unionByName(paths)
    found = found.join(hot, key).groupBy("project", "entry", "methods", "sink").agg(F.min("line").alias("line"))
    classes = F.array_distinct(F.transform("methods", lambda x: F.element_at(F.split(x, "::"), 1)))
    return (found.select("project", "entry", "methods", classes.alias("classes"), "sink", "line", F.md5(F.to_json(F.struct("methods", "sink")).cast("binary")).alias("fingerprint"))
            .withColumn("has_wakeup", F.exists("methods", lambda x: F.endswith(x, F.lit("::__wakeup")))))
