"""Dependency manifests as rows: (path, language, name, version, ext).

Every parser is a DataFrame expression over files(path, content); a file that cannot
be parsed gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import MANIFEST_FILES


def manifests(files: DataFrame) -> DataFrame:
    """Files whose base name is a known manifest, with its language; shorter paths first."""
    kinds = files.sparkSession.createDataFrame([(l, n) for l, ns in MANIFEST_FILES.items() for n in ns], "language string, base string")
    named = files.withColumn("base", F.element_at(F.split(F.translate("path", "\\", "/"), "/"), -1))
    return named.join(F.broadcast(kinds), "base").orderBy(F.length("path"), "path")


def _named(files: DataFrame, base: str) -> DataFrame:
    return files.where(F.element_at(F.split(F.translate("path", "\\", "/"), "/"), -1) == base)


def _row(language: str, name, version, ext=None):
    return ["path", F.lit(language).alias("language"), F.trim(name).alias("name"), version.alias("version"), (F.lit(None).cast("string") if ext is None else ext).alias("ext")]


def requirements(files: DataFrame, compat: bool = False) -> DataFrame:
    """name==version lines. Strict: comments and blank lines are no dependencies; compat: they are."""
    lines = _named(files, "requirements.txt").select("path", F.posexplode(F.split("content", "\r?\n")).alias("pos", "line"))
    if not compat:
        lines = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).where("line <> ''")
    parts = F.split("line", "==")
    return lines.select(*_row("python", F.get(parts, 0), F.trim(F.get(parts, 1))))


def composer(files: DataFrame) -> DataFrame:
    rows = _named(files, "composer.json").select("path", F.explode(F.from_json("content", "require map<string,string>")["require"]).alias("name", "version"))
    return rows.select(*_row("php", F.col("name"), F.col("version")))


def go_mod(files: DataFrame) -> DataFrame:
    """The require block, found by a running count over the file's lines; ext is the go version."""
    text = F.regexp_replace("content", r"(//|#)[^\n]*", "")
    block = F.regexp_extract_all(text, F.lit(r"(?s)require\s*\((.*?)\)"), F.lit(1))
    singles = F.regexp_extract_all(text, F.lit(r"(?m)^\s*require\s+([^\s(]+\s+\S+)"), F.lit(1))
    lines = F.filter(F.flatten(F.array(F.flatten(F.transform(block, lambda b: F.split(b, "\n"))), singles)), lambda x: F.trim(x) != "")
    rows = _named(files, "go.mod").select("path", F.regexp_extract(text, r"(?m)^\s*go\s+(\S+)", 1).alias("go"), F.explode(lines).alias("line"))
    parts = F.split(F.btrim("line", F.lit(" \t\r")), r"\s+")
    return rows.select(*_row("golang", F.get(parts, 0), F.get(parts, 1), F.col("go")))


def _xpath(path: str) -> str:
    return "/".join(f"*[local-name()=\"{p}\"]" for p in path.split("/"))


def pom(files: DataFrame, compat: bool = False) -> DataFrame:
    """Maven dependencies; ${name} is looked up in the own file's properties, with `compat` in those of all files; ${project.version} in the own file."""
    docs = _named(files, "pom.xml").where(F.contains("content", F.lit("</project>"))).withColumn("xml", F.regexp_replace("content", r"(?s)<\?xml.*?\?>|<!--.*?-->", ""))
    block = F.regexp_extract("xml", r"(?s)<properties>(.*?)</properties>", 1)
    found = docs.select("path", F.explode(F.arrays_zip(F.regexp_extract_all(block, F.lit(r"<([\w.-]+)>([^<]*)</"), F.lit(1)).alias("key"), F.regexp_extract_all(block, F.lit(r"<([\w.-]+)>([^<]*)</"), F.lit(2)).alias("value"))).alias("p")).select("path", "p.key", "p.value")
    at = ["key"] if compat else ["path", "key"]
    properties = found.groupBy(*at).agg(F.min("value").alias("value"))
    items = F.regexp_extract_all("xml", F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))
    parent = F.regexp_extract("xml", r"(?s)<parent>(.*?)</parent>", 1)
    rest = F.regexp_replace("xml", r"(?s)<(parent|dependencies|dependencyManagement|build|profiles|plugins)>.*?</\1>", "")

    def tag(text, name):
        return F.trim(F.regexp_extract(text, rf"(?s)<{name}>(.*?)</{name}>", 1))

    own = F.coalesce(F.nullif(tag(rest, "version"), F.lit("")), F.nullif(tag(parent, "version"), F.lit("")))
    rows = docs.select("path", own.alias("own"), F.explode(F.concat(F.when(parent != "", F.array(parent)).otherwise(F.array().cast("array<string>")), items)).alias("item"))
    rows = rows.select("path", "own", F.concat_ws(":", tag(F.col("item"), "groupId"), tag(F.col("item"), "artifactId")).alias("name"), F.nullif(tag(F.col("item"), "version"), F.lit("")).alias("raw"))
    rows = rows.withColumn("key", F.nullif(F.regexp_extract("raw", r"^\$\{(.+)\}$", 1), F.lit("")))
    joined = rows.join(properties, at, "left")
    version = F.when(F.col("key").isin("project.version", "version"), F.col("own")).when(F.col("key").isNotNull(), F.col("value")).otherwise(F.col("raw"))
    return joined.select(*_row("java", F.col("name"), version))


def gradle(files: DataFrame) -> DataFrame:
    block = F.regexp_extract("content", r"(?s)plugins\s*\{(.*?)\}", 1)
    pattern = F.lit(r"id\s*\(?\s*['\"]([^'\"]+)['\"]\s*\)?\s+version\s+['\"]([^'\"]+)['\"]")
    rows = _named(files, "build.gradle").select("path", F.explode(F.arrays_zip(F.regexp_extract_all(block, pattern, F.lit(1)).alias("name"), F.regexp_extract_all(block, pattern, F.lit(2)).alias("version"))).alias("p"))
    return rows.select(*_row("java", F.col("p.name"), F.col("p.version")))


def package_json(files: DataFrame) -> DataFrame:
    """dependencies and devDependencies; ext is 'name version.section' of the package."""
    kind = "name string, version string, dependencies map<string,string>, devDependencies map<string,string>"
    rows = _named(files, "package.json").select("path", F.from_json("content", kind).alias("j"))
    parts = [rows.select("path", F.concat(F.coalesce("j.name", F.lit("")), F.lit(" "), F.coalesce("j.version", F.lit("")), F.lit("." + s)).alias("ext"), F.explode(f"j.{s}").alias("name", "version")) for s in ("dependencies", "devDependencies")]
    return parts[0].union(parts[1]).select(*_row("nodejs", F.col("name"), F.col("version"), F.col("ext")))


def dependencies(files: DataFrame) -> DataFrame:
    """All manifests' rows."""
    out = requirements(files)
    for more in (composer, go_mod, pom, gradle, package_json):
        out = out.unionByName(more(files))
    return out


NO_VERSION = "The latest version"


def framework_dependencies(files: DataFrame, projects: str | None = None) -> DataFrame:
    """(project, name, version) as framework detection sees them: names of requirements.txt files, or, in a project without one, artifacts of pom.xml files.

    A package without a version has NO_VERSION.  `projects` is a regular expression for the project in a path.
    """
    project = (F.regexp_extract("path", projects, 0) if projects else F.lit("")).alias("project")
    lines = _named(files, "requirements.txt").select(project, F.explode(F.split("content", "\r?\n")).alias("line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).where("line <> ''")
    parts = F.split("line", "==")
    pip = lines.select("project", F.trim(F.get(parts, 0)).alias("name"), F.trim(F.get(parts, 1)).alias("version"))
    named = _named(files, "requirements.txt").select(project).distinct()
    maven = pom(files).select(project, F.element_at(F.split("name", ":"), -1).alias("name"), "version").join(named, "project", "left_anti")
    return pip.unionByName(maven).where("name <> ''").withColumn("version", F.coalesce(F.nullif("version", F.lit("")), F.lit(NO_VERSION))).distinct()
