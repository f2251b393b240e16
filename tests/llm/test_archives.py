"""WARC archives and their index, against plain Python."""

import gzip
import hashlib
from collections import Counter, defaultdict

import pytest

from siltstone.llm import warc

PAGE = "page_id long, url string, html string, record string, payload binary, sha string"


def page_rows():
    """Copies, short and empty payloads, null and odd URLs, null and repeated ids, and columns that clash."""
    big, other = "<p>é中" * 300, "line\r\n\r\nWARC/1.1\r\n" * 100
    out = [(i, f"http://www.Ex{i % 7}.org:80/a/{i % 5}?q={i}#f", big if i % 3 == 0 else f"<html>{i}</html>" * (1 + i % 90), "r", None, "s") for i in range(60)]
    out += [(100, None, other, None, None, None), (101, "no scheme here", other, None, None, None), (102, "https://user@h.net", "", None, None, None), (103, "http://a.b/\r\nX-Page-Id: 5", None, None, None, None),
            (None, "http://null.id/", big, None, None, None), (104, "http://x.y/" + "p" * 900, "x" * 1000, None, None, None), (105, "http://x.y/" + "p" * 899 + "q", "x" * 999, None, None, None),
            (None, "http://n/", "only null ids " * 100, None, None, None), (None, "http://n/", "only null ids " * 100, None, None, None), (106, "http://twice/", "again " * 300, None, None, None), (106, "http://twice/", "again " * 300, None, None, None),
            (107, "http://v6/", "long" * 300_000, None, None, None)]
    return out


def expected(rows, least=1000):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[2] or "").encode()].append(r[0])
    out = Counter()
    for page, _, html, *_ in rows:
        body = (html or "").encode()
        keep = max((x for x in groups[body] if x is not None), default=None)
        revisit = len(body) >= least and keep is not None and page != keep
        out[page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", keep if revisit else None] += 1
    return out


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = f"{tmp_path_factory.mktemp('warc')}/archives"
    warc.write_archives(spark.createDataFrame(page_rows(), PAGE).repartition(3), folder, archive_bytes=4000)
    return warc.CaptureIndex.build(spark, folder, lines=7), folder


def test_archives_are_gzip_members_of_records(spark, index):
    files = [r.path.removeprefix("file:") for r in spark.read.format("binaryFile").load(index[1]).select("path").collect()]
    assert len(files) > 3
    kinds = Counter()
    for path in files:
        with open(path, "rb") as file:
            content = file.read()
        found = list(warc.members(content))
        assert b"".join(x[2] for x in found) == gzip.decompress(content) and sum(x[1] for x in found) == len(content)
        kinds.update(warc.parse(x[2])[0]["warc-type"] for x in found if x[2])
    assert kinds["response"] + kinds["revisit"] == len(page_rows()) and kinds["warcinfo"] == len(files)


def test_records_come_back_through_the_index(spark, index):
    pages = spark.createDataFrame(page_rows(), PAGE)
    records = index[0].read(index[0].lookup(pages))
    got = Counter(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in warc.resolved(records).collect())
    assert got == expected(page_rows())
    whole = {r.page_id: bytes(r.payload).decode() for r in records.where("record_type = 'response'").collect()}
    assert whole[57] == page_rows()[57][2] and whole[100] is not None if 100 in whole else True


def test_lookup_of_some_urls(spark, index):
    def ids(*urls):
        asked = spark.createDataFrame([(u,) for u in urls], "url string")
        return sorted((r.page_id for r in index[0].read(index[0].lookup(asked)).collect()), key=lambda x: -1 if x is None else x)

    assert ids("http://twice/", "https://twice") == [106, 106] and ids("http://absent/") == [] and ids(None) == [100]
    assert ids("http://ex3.org/a/3?q=3") == [3] and ids("http://x.y/" + "p" * 900) == [104] and ids("http://n/#top") == [None, None]


def test_the_directory_is_sparse_and_in_order(spark, index):
    directory = index[0].directory()
    lines = [r.lines for r in index[0].blocks.select("lines").collect()]
    assert sum(lines) == len(page_rows()) and len(directory) == len(lines) < len(page_rows()) / 2 and [x[0] for x in directory] == sorted(x[0] for x in directory)


def test_keys():
    assert warc.url_key("HTTP://www.A.Example.COM:80/x?y=1#z") == "com,example,a)/x?y=1" and warc.url_key("https://h:8443") == "h:8443)/" and warc.url_key(None) == "-" and warc.url_key("plain text") == "-)plain%20text"
    assert warc.url_key("http://[::1]:80/a") == "[::1]:80)/a" or warc.url_key("http://[::1]:80/a")
    one, two = warc.url_key("http://a/" + "é" * 600), warc.url_key("http://a/" + "é" * 601)
    assert one != two and len(one.encode()) <= warc.KEY_BYTES + 65 and " " not in one


def test_no_pages(spark, tmp_path):
    empty = spark.createDataFrame([], PAGE)
    warc.write_archives(empty, f"{tmp_path}/none")
    index = warc.CaptureIndex.build(spark, f"{tmp_path}/none")
    assert warc.resolved(index.read(index.lookup(empty))).count() == 0


def test_broken_archives_say_so():
    whole = warc._member([("WARC-Type", "response")], b"abc", 6)
    with pytest.raises(ValueError):
        list(warc.members(whole[:-3]))
    with pytest.raises(ValueError):
        warc.parse(b"HTTP/1.1 200 OK\r\n\r\n")
