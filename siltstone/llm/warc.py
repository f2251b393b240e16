"""WARC archives with a two-level capture index.

*Archives.*  Every record is a gzip member of its own, so any WARC reader opens the files
and one record can be read by its byte range.  A task packs its rows into archives of about
`archive_bytes`; each is one row that Spark's text writer puts into a file of its own, on
any store that Spark writes to.  (The row ends with an empty member less its last byte, 0,
which is the line separator.)  Of records with equal payloads of `least` bytes or more, the
one with the largest id is a response and the others are revisits of it.

*Index.*  The archives are scanned once for captures: reversed-host URL key (`com,example,www)/a?b`),
file, offset, length.  Captures are range-partitioned and sorted by key; every 3,000 of them or
more are a compressed block of CDXJ lines.  The sparse directory has each block's first key:
32,768 blocks and one a partition at most, keys of 565 bytes at most, so its broadcast is bounded
whatever the number of captures.

*Reads.*  Keys to look up are sorted, find their blocks by binary search in the directory, meet
these in an equal join, find their lines by binary search again, and the captures' ranges are cut
out of the archives that hold them; nothing else is decompressed.

Skew: digests with a 1,024th of all rows are joined by broadcast (1,024 at most), so copies of one
payload stay where they are; captures of one key spread over blocks, as file and offset are sort keys too.

Null payloads count as empty; null ids come back as null and never name a response, unless a group
has no other: then each of its rows is a response, as are all rows that repeat the largest id.  Null
URLs have the key `-`; control characters and blanks in URLs are percent-encoded.  Empty tables give
no archives, an empty index and no records; other columns are not read.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_counted, small_batches, written

LINES, BLOCKS = 3000, 1 << 15
KEY_BYTES = 500
#: Parts of a gzip stream that are looked at in one go, so that a member's end costs no copy of the rest.
PIECE = 1 << 16
_EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")

# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ESCAPES = {chr(i): f"%{i:02X}" for i in (*range(0x21), 0x7F)}


def escaped(url: str) -> str:
    """A URL that fits a header line."""
    return url.translate(str.maketrans(_ESCAPES))


def url_key(url: str | None) -> str:
    """Reversed-host key; scheme, user, fragment, a leading `www.` and default ports are left out.

    Long keys keep their first 500 bytes and a digest of the whole.
    """
    if url is None:
        return "-"
    scheme, found, rest = escaped(url).partition("://")
    if not found:
        key = "-)" + scheme
    else:
        cut = min((at for at in (rest.find(c) for c in "/?#") if at >= 0), default=len(rest))
        host, path = rest[:cut].rpartition("@")[2].lower(), rest[cut:].partition("#")[0]
        host, _, port = host.partition(":") if not host.startswith("[") else (host, "", "")
        key = ",".join(reversed(host.removeprefix("www.").split("."))) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (path if path.startswith("/") else "/" + path)
    raw = key.encode()
    return key if len(raw) <= KEY_BYTES else raw[:KEY_BYTES].decode("utf-8", "ignore") + "~" + sha256(raw).hexdigest()


def record_id(page: int | None, digest: str) -> str:
    """A response's id, which its revisits can name without having met it."""
    return f"<urn:uuid:{uuid.UUID(bytes=sha256(f'{page}:{digest}'.encode()).digest()[:16])}>"


def _member(fields: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", body_column: str = "html", least: int = 1000, archive_bytes: int = 32 << 20,
                   date: str = "1970-01-01T00:00:00Z", level: int = 6) -> None:
    """Write a record for each row as .warc.gz content into the files of `folder`."""
    rows = small_batches(pages).select(F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"), F.coalesce(F.col(body_column).cast("binary"), F.lit(b"")).alias("body"))
    rows = rows.withColumn("sha", F.when(F.octet_length("body") >= least, F.sha2("body", 256)))
    groups = written(rows.where("sha is not null").groupBy("sha").agg(F.max("id").alias("keep"), F.count("*").alias("copies")).where("copies > 1"), "payloads")
    total = rows.count()
    hot, cold = F.broadcast(groups.where(F.col("copies") * 1024 >= total)), groups.where(F.col("copies") * 1024 < total)
    judged = rows.join(hot, "sha").unionByName(rows.join(hot.select("sha"), "sha", "left_anti").join(cold, "sha", "left"))
    judged = judged.withColumn("revisit", F.col("keep").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep")))
    judged = judged.select("id", "url", "keep", "revisit", F.coalesce("sha", F.lit("")).alias("sha"), F.sha1("body").alias("sha1"), F.octet_length("body").alias("size"), F.when(~F.col("revisit"), F.col("body")).alias("body"))

    def pack(batches):
        info = b"software: siltstone\r\nformat: WARC File Format 1.1\r\n"
        head = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(bytes=sha256(info).digest()[:16])}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], info, level)
        parts, size = [head], len(head)

        def archive():
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts) + _EMPTY_MEMBER[:-1]], pa.binary())], ["archive"])

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, keep, revisit, sha, sha1, n, body = (batch.column(k)[i].as_py() for k in range(8))
                own = record_id(page, sha) if sha and not revisit else f"<urn:uuid:{uuid.uuid4()}>"
                fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own), ("WARC-Date", date)]
                fields += [("WARC-Target-URI", escaped(url))] if url is not None else []
                fields += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode())]
                fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(keep, sha))] if revisit else []
                fields += [("X-Page-Id", str(page))] if page is not None else []
                fields += [("Content-Type", "application/http; msgtype=response")]
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
                parts.append(_member(fields, http + (body or b""), level))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield archive()
                    parts, size = [head], len(head)
        if len(parts) > 1:
            yield archive()

    (judged.mapInArrow(pack, "archive binary").select(F.col("archive").cast("string").alias("value"))
     .write.option("lineSep", "\x00").option("compression", "none").option("maxRecordsPerFile", 1).text(folder))
    discard(groups)


def members(content: bytes):
    """(offset, length, bytes) of each gzip member."""
    at, view = 0, memoryview(content)
    while at < len(content):
        unpack, parts, end = zlib.decompressobj(31), [], at
        while not unpack.eof:
            piece = view[end:end + PIECE]
            if not len(piece):
                raise ValueError(f"the member at {at} is cut short")
            parts.append(unpack.decompress(piece))
            end += len(piece)
        end -= len(unpack.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the block."""
    head = record.find(b"\r\n\r\n")
    if not record.startswith(b"WARC/") or head < 0:
        raise ValueError("not a WARC record")
    lines = record[:head].decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, record[head + 4:head + 4 + int(fields["content-length"])]


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def captures_of(spark: SparkSession, folder: str) -> DataFrame:
    """(key, path, offset, length, line) of every response and revisit, by a scan of the archives; `line`: the CDXJ line."""
    def scan(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                path, content, found = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), []
                for offset, length, record in members(content):
                    if not record:
                        continue
                    fields, _ = parse(record)
                    if fields["warc-type"] in ("response", "revisit"):
                        url = fields.get("warc-target-uri")
                        stamp = "".join(c for c in fields.get("warc-date", "") if c.isdigit())[:14]
                        said = json.dumps({"url": url, "digest": fields.get("warc-payload-digest"), "type": fields["warc-type"], "offset": offset, "length": length, "filename": path}, ensure_ascii=False)
                        found.append((url_key(url), path, offset, length, f"{stamp} {said}"))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["key", "path", "offset", "length", "line"])

    return _archives(spark, folder).mapInArrow(scan, "key string, path string, offset long, length long, line string")


class CaptureIndex:
    """Sorted blocks of captures in a table, and a sparse directory of their first keys."""

    def __init__(self, blocks: DataFrame, archives: str):
        self.blocks, self.archives = blocks, archives

    @classmethod
    def build(cls, spark: SparkSession, archives: str, folder: str | None = None, lines: int = LINES) -> "CaptureIndex":
        """Index the archives of a folder; the blocks are written to `folder`, or to the shared folder where none is named."""
        if not archives_exist(spark, archives):
            return cls(spark.createDataFrame([], "block long, first string, lines int, data binary"), archives)
        captures = written(captures_of(spark, archives), "captures")
        total = captures.count()
        share = max(lines, -(-total // BLOCKS))

        def cut(batches):
            number, keys, texts = 0, [], []

            def block():
                return pa.RecordBatch.from_arrays([pa.array([part << 32 | number], pa.int64()), pa.array([keys[0]]), pa.array([len(keys)], pa.int32()), pa.array([zlib.compress("\n".join(texts).encode())], pa.binary())], ["block", "first", "lines", "data"])

            part = 0
            for batch in batches:
                for k, text, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    part = p
                    keys.append(k)
                    texts.append(f"{k} {text}")
                    if len(keys) >= share:
                        yield block()
                        number, keys, texts = number + 1, [], []
            if keys:
                yield block()

        parts = max(1, min(4096, total // 100_000))
        cut_ = (captures.repartitionByRange(parts, "key", "path", "offset").sortWithinPartitions("key", "path", "offset")
                .select("key", "line", F.spark_partition_id().alias("part")).mapInArrow(cut, "block long, first string, lines int, data binary"))
        if folder is None:
            blocks = written(cut_, "index")
        else:
            cut_.write.parquet(folder)
            blocks = spark.read.parquet(folder)
        discard(captures)
        return cls(blocks, archives)

    def directory(self) -> list[tuple[bytes, int]]:
        """(first key, block), in order."""
        return sorted((r.first.encode(), r.block) for r in self.blocks.select(F.col("first"), "block").collect())

    def lookup(self, urls: DataFrame, url_column: str = "url") -> DataFrame:
        """(key, path, offset, length) of all captures of the URLs; each URL's key is looked up once."""
        spark = self.blocks.sparkSession
        directory = self.directory()
        sent = spark.sparkContext.broadcast(([x[0] for x in directory], [x[1] for x in directory]))

        def key(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([url_key(x) for x in batch.column(0).to_pylist()], pa.string())], ["key"])

        def locate(batches):
            first, block = sent.value
            for batch in batches:
                asked: dict[int, list[str]] = {}
                for k in batch.column(0).to_pylist():
                    raw = k.encode()
                    for at in range(max(0, bisect_left(first, raw) - 1), bisect_right(first, raw)):
                        asked.setdefault(block[at], []).append(k)
                yield pa.RecordBatch.from_arrays([pa.array(list(asked), pa.int64()), pa.array(list(asked.values()), pa.list_(pa.string()))], ["block", "keys"])

        def find(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    lines = [x.split(" ", 2) for x in zlib.decompress(batch.column(1)[i].as_py()).decode().split("\n")]
                    known, found = [x[0].encode() for x in lines], []
                    for k in batch.column(0)[i].as_py():
                        raw = k.encode()
                        for at in range(bisect_left(known, raw), bisect_right(known, raw)):
                            said = json.loads(lines[at][2])
                            found.append((k, said["filename"], said["offset"], said["length"]))
                    for at in range(0, len(found), 8192):
                        some = found[at:at + 8192]
                        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in some], t) for n, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "path", "offset", "length"])

        keys = small_batches(urls).select(F.col(url_column).cast("string").alias("url")).distinct().mapInArrow(key, "key string").distinct()
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        asked = keys.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(locate, "block long, keys array<string>")
        return asked.join(self.blocks.select("block", "data"), "block").select("keys", "data").mapInArrow(find, "key string, path string, offset long, length long")

    def read(self, captures: DataFrame) -> DataFrame:
        """The records at captures' ranges: page_id, url, record_type, record, refers_to_record, payload (null for revisits)."""
        spark = self.blocks.sparkSession
        schema = "page_id long, url string, record_type string, record string, refers_to_record string, payload binary"
        if not archives_exist(spark, self.archives):
            return spark.createDataFrame([], schema)
        ranges = captures.groupBy("path").agg(F.collect_list(F.struct("offset", "length")).alias("ranges"))  # an archive's bytes bound its records

        def cut(batches):
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary())
            names = ["page_id", "url", "record_type", "record", "refers_to_record", "payload"]
            for batch in batches:
                for i in range(batch.num_rows):
                    content, found, size = batch.column(0)[i].as_buffer(), [], 0
                    view = memoryview(content)
                    for x in batch.column(1)[i].as_py():
                        fields, block = parse(zlib.decompress(view[x["offset"]:x["offset"] + x["length"]], 31))
                        payload = None if fields["warc-type"] == "revisit" else block[block.find(b"\r\n\r\n") + 4:]
                        page = fields.get("x-page-id")
                        found.append((None if page is None else int(page), fields.get("warc-target-uri"), fields["warc-type"], fields["warc-record-id"], fields.get("warc-refers-to"), payload))
                        size += len(payload or b"") + 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in enumerate(kinds)], names)
                            found, size = [], 0
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in enumerate(kinds)], names)

        return _archives(spark, self.archives).join(ranges.hint("shuffle_hash"), "path").select("content", "ranges").mapInArrow(cut, schema)


def archives_exist(spark: SparkSession, folder: str) -> bool:
    """Whether a folder holds any archive; Spark writes none for an empty table."""
    return not spark.read.format("binaryFile").load(folder).select("path").isEmpty()


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest (SHA-1), record_type, refers_to: a revisit has what its response's payload has."""
    told = written(records.select("page_id", "record_type", "record", "refers_to_record", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")), "records")
    responses, revisits = told.where("record_type = 'response'"), told.where("record_type = 'revisit'")
    counts = revisits.groupBy("refers_to_record").agg(F.count("*").alias("revisits"))
    meant = (responses.select(F.col("record").alias("refers_to_record"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").dropDuplicates(["refers_to_record"])
             .join(counts, "refers_to_record"))
    again = join_counted(revisits.select("refers_to_record", "page_id", "record_type"), meant, "refers_to_record", "revisits")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*names).unionByName(again.select(*names))
