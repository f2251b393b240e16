"""File trees, archives and extension packages as tables."""

from __future__ import annotations

import io
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import extension


def target_mode(target: str) -> str:
    """git for URLs of http, https and ssh; else file or folder by its ending."""
    if target.startswith(("http://", "https://", "ssh://")):
        return "git"
    return "file" if "." in target.rstrip("/").rsplit("/", 1)[-1] else "folder"


def read_tree(spark: SparkSession, root: str, most_bytes: int | None = None) -> DataFrame:
    """files(path, ext, size, content) of a directory tree; bytes that are no UTF-8 become U+FFFD."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if most_bytes is not None:
        raw = raw.where(F.col("length") <= most_bytes)
    return raw.select("path", extension(F.col("path")).alias("ext"), F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def unzip(archives: DataFrame, most_members: int = 100_000, most_bytes: int = 1 << 28) -> DataFrame:
    """archives(path, content binary) to (path, member, content, error); a package's header before the zip is skipped.

    An archive that cannot be read, or whose members go beyond the guards against zip bombs, gives one row
    with the error alone; so does a member that cannot be read.  Nothing is written to disk.
    """
    names = ["path", "member", "content", "error"]

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content or b""))
                    members = [i for i in archive.infolist() if not i.is_dir()]
                    if len(members) > most_members or sum(i.file_size for i in members) > most_bytes:
                        rows, members = [(path, None, None, "beyond the guards")], []
                except zipfile.BadZipFile as error:
                    rows, members = [(path, None, None, str(error))], []
                for i in members:
                    try:
                        rows.append((path, i.filename, archive.read(i).decode("utf-8", "replace"), None))
                    except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError) as error:  # damaged, of an unknown method, or with a password
                        rows.append((path, i.filename, None, str(error)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], names)

    return archives.select("path", "content").mapInArrow(run, "path string, member string, content string, error string")


def extension_children(members: DataFrame) -> DataFrame:
    """Members of extension packages with the scripts and pages that their manifest names: (path, child, kind, key)."""
    manifest = members.where("member = 'manifest.json'")
    kind = ("content_scripts array<struct<js:array<string>>>, background struct<scripts:array<string>,page:string>, browser_action struct<default_popup:string>, "
            "web_accessible_resources array<string>, chrome_url_overrides map<string,string>")
    j = manifest.select("path", F.from_json("content", kind).alias("j"))

    def rows(items, key):
        return j.select("path", F.explode(items).alias("child"), F.lit(key).alias("key"))

    out = rows(F.flatten(F.transform("j.content_scripts", lambda x: x["js"])), "content_scripts")
    for items, key in ((F.col("j.background.scripts"), "background.scripts"), (F.array("j.background.page"), "background.page"), (F.array("j.browser_action.default_popup"), "browser_action.default_popup"),
                       (F.col("j.web_accessible_resources"), "web_accessible_resources"), (F.map_values("j.chrome_url_overrides"), "chrome_url_overrides")):
        out = out.union(rows(items, key))
    found = out.where("child is not null").distinct()
    kind_of = F.when(F.col("child").rlike(r"(?i)\.js$"), "js").when(F.col("child").rlike(r"(?i)\.html?$"), "html")
    return found.withColumn("kind", kind_of).where("kind is not null")
