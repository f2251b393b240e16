"""The opN queries on a small folder: every column that a contract fixes."""

import hashlib
import struct
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from siltstone.llm.queries import ORACLE_SQL, QUERIES, tokenizer_file

from .cases import rows
from .test_alignment import told, tools  # noqa: F401
from .test_divergence import brute as divergence_brute
from .test_operators import PAGES, brute_components, line_cases, words

TABLES = Path("/root/testdata/sf0.01")


def docs():
    """The cases, with ids that are known and differ."""
    found = list({r[0]: r for r in line_cases() if r[0] is not None}.values())
    return found + [(9000 + i, r[1]) for i, r in enumerate(rows()) if i % 5 == 0]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    some = [(r[0], r[1], "en", f"src{r[0] % 3}", len(r[1] or "")) for r in docs()]
    some += [(20000 + i, f"plain words {i} here and there" + (" you zorgle" if i % 4 == 0 else ""), "en", "s", 1) for i in range(200)]
    spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(20000 + i, int(i % 4 == 0), 1) for i in range(200)], "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string").selectExpr("*", "'' as html").write.parquet(f"{path}/pages.parquet")
    return path, some


def run(spark, folder, name):
    return QUERIES[name](spark, str(folder[0])).collect()


def test_every_query_is_called_here():
    assert sorted(QUERIES) == sorted(["op1_ngram_join", "op2_sharding", "op3_substring_dedup", "op4_bpe", "op5_exact_dedup", "op6_toxicity", "op7_packing", "op8_media", "op9_url_filter", "op10_line_dedup", "op11_warc", "op12_alignment", "op13_divergence"])


def test_op1(spark, folder):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in run(spark, folder, "op1_ngram_join"))
    assert got == brute_components([r[:2] for r in folder[1]])


def test_op2(spark, folder):
    got = run(spark, folder, "op2_sharding")
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in folder[1])
    places = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        places[r.shard].append(r.slot)
    assert sorted(places) == list(range(8)) and all(sorted(x) == list(range(len(x))) for x in places.values())
    assert max(map(len, places.values())) - min(map(len, places.values())) <= 1


def test_op3(spark, folder):
    seen = Counter(tuple(words(t)[i:i + 35]) for _, t, *_ in folder[1] for i in range(len(words(t)) - 34))
    want = set()
    for id_, text, *_ in folder[1]:
        w = words(text)
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i:i + 35])] > 1 for j in range(i, i + 35)}
        want.add((id_, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in run(spark, folder, "op3_substring_dedup")} == want


def test_op4(spark, folder):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want = set()
    for id_, text, *_ in folder[1]:
        ids = plain.encode(text or "", add_special_tokens=False).ids
        want.add((id_, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, folder, "op4_bpe")} == want


def duck(folder):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder[0]}/documents.parquet/*.parquet'")
    con.execute(f"create view pages as select * from '{folder[0]}/pages.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, folder, name):
    found = duck(folder).sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, str(folder[0])).select(*found.columns).collect()
    assert Counter(map(tuple, got)) == Counter(found.fetchall())


def test_op6(spark, folder):
    got = run(spark, folder, "op6_toxicity")
    assert len(got) == len(folder[1])
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in got if r.doc_id >= 20000)


def test_op6_never_learns_from_held_out_rows(spark, folder, tmp_path):
    import shutil

    shutil.copytree(folder[0], tmp_path / "turned")
    shutil.rmtree(tmp_path / "turned" / "labels.parquet")
    turned = [(20000 + i, int((i % 4 == 0) != (zlib.crc32(str(20000 + i).encode()) % 3 == 1)), 1) for i in range(200)]
    spark.createDataFrame(turned, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/turned/labels.parquet")
    one, two = ({r.doc_id: r.score for r in QUERIES["op6_toxicity"](spark, str(p)).collect()} for p in (folder[0], tmp_path / "turned"))
    assert one == two


@pytest.mark.skipif(not TABLES.is_dir(), reason="the driver's tables are not here")
def test_op6_on_held_out_labels(spark):
    """Toxic rows that hold a word only toxic rows share are found; the others carry labels that no text explains."""
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    held = [r for r in QUERIES["op6_toxicity"](spark, str(TABLES)).where("held_out").collect() if labels.get(r.doc_id) is not None]
    toxic, clean = ([r.predicted for r in held if labels[r.doc_id] == y] for y in (1, 0))
    assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_op7(spark, folder):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    got = run(spark, folder, "op7_packing")
    ids = {i: plain.encode(t or "", add_special_tokens=False).ids + [1] for i, t, *_ in folder[1]}
    assert Counter(r.doc_id for r in got if r.start == 0) == Counter(ids.keys())
    for r in got:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 2048
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *own[r.start:r.start + r.length]))
    assert sum(r.length for r in got) == sum(map(len, ids.values())) and len({r.sequence_id for r in got}) == len(got)
    # any partitioning gives the same sequences
    again = [(r.doc_id, r.start, r.sequence_id) for r in got]
    spark.read.parquet(f"{folder[0]}/documents.parquet").repartition(7, "n_chars").write.parquet(f"{folder[0]}/again/documents.parquet")
    assert Counter(again) == Counter((r.doc_id, r.start, r.sequence_id) for r in QUERIES["op7_packing"](spark, f"{folder[0]}/again").collect())


def test_op8(spark, folder):
    texts = {i: (t or "").encode() for i, t, *_ in folder[1]}
    alike = defaultdict(set)
    for r in run(spark, folder, "op8_media"):
        raw = texts.pop(r.doc_id)
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        alike[raw].add((r.media_bytes, r.media_sha256, r.feature))
    assert not texts and all(len(x) == 1 for x in alike.values())


def test_op9(spark, folder):
    got = run(spark, folder, "op9_url_filter")
    assert len(got) == len(PAGES)
    ruled = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    assert all(r.verdict == ruled[r.rule] if r.rule else r.verdict in ("allow", "block") for r in got) and {r.rule for r in got} == {None, *ruled}


def test_op11(spark, folder):
    got = run(spark, folder, "op11_warc")
    assert Counter(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got) == Counter((p[0], 0, hashlib.sha1(b"").hexdigest(), "response", None) for p in PAGES)


def test_op12(spark, folder, tools):
    got = run(spark, folder, "op12_alignment")
    want = told([r[:2] for r in folder[1]], tools)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(tuple(r[c] for c in names) for r in got) == Counter({(*k[:7], hashlib.sha256(k[7].encode()).hexdigest() if k[7] else ""): n for k, n in want.items()})


def test_op13(spark, folder):
    got = Counter(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in run(spark, folder, "op13_divergence"))
    assert got == divergence_brute([(r[2], r[3], r[1]) for r in folder[1]], 10) and got
