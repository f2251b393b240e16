"""Queries over the driver tables, one for each operator, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, line_templates, toxicity, url_filter
from .alignment import align
from .bpe import encode_decode
from .common import scratch
from .exact_dedup import exact_duplicates
from .line_templates import drop_templates
from .media import store_texts
from .ngram_join import near_duplicates
from .packing import pack
from .sharding import assign
from .substring_dedup import remove_repeats
from .warc import CaptureIndex, resolved, write_archives


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file; operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), k=5, num=75, den=100)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(_documents(spark, sf_dir), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir), window=35).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(_documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_documents(spark, sf_dir), keep="largest")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    grammar, weights = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.select("doc_id", "text"), grammar, weights)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(_documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), longest=2048, end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_texts(_documents(spark, sf_dir), row_bytes=576)
    return stored.select(
        "doc_id", "n_bytes", F.octet_length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, -32, 32)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_templates(_documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", "text")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    with scratch(spark, "warc") as folder:
        write_archives(pages, folder, least=1000)
        index = CaptureIndex.build(spark, folder)
        return resolved(index.read(index.lookup(pages)))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align(_documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"), groups="sha256")
    return aligned.withColumnRenamed("groups", "groups_sha256")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_documents(spark, sf_dir), min_docs=10, terms=10)


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_sharding": op2_sharding,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_bpe": op4_bpe,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_media": op8_media,
    "op9_url_filter": op9_url_filter,
    "op10_line_dedup": op10_line_dedup,
    "op11_warc": op11_warc,
    "op12_alignment": op12_alignment,
    "op13_divergence": op13_divergence,
}

_EXACT = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))"""

_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

_NGRAM_JOIN = f"""
with recursive w as (select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
s as (select doc_id, list_sort(list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end)) as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as g from s),
links as (select a.doc_id as a, b.doc_id as b from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach as (select doc_id as a, doc_id as b from s union select r.a, l.b from reach r join links l on r.b = l.a),
low as (select a, min(b) as component_id from reach group by a)
select s.doc_id, len(s.sh)::bigint as n_shingles, low.component_id, case when len(s.sh) = 0 then 1 else count(*) over (partition by s.sh) end::bigint as copies from s join low on s.doc_id = low.a"""

_SUBSTRING = f"""
with w as (select doc_id, {_WORDS.format("coalesce(text, '')")} as ws from documents),
windows as (select doc_id, i, array_to_string(ws[i:i + 34], ' ') as t from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from w where len(ws) >= 35)),
gone as (select distinct doc_id, unnest(range(i, i + 35)) as j from windows where t in (select t from windows group by t having count(*) > 1)),
words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as j from w),
kept as (select doc_id, string_agg(word, ' ' order by j) as t, count(*) as n from words anti join gone using (doc_id, j) group by doc_id)
select w.doc_id, len(w.ws)::bigint as n_words, (len(w.ws) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.t, '')) as kept_sha256 from w left join kept k on w.doc_id = k.doc_id"""

_WARC = """
with p as (select page_id, strlen(coalesce(html, '')) as size, sha1(coalesce(html, '')) as digest, max(page_id) over (partition by coalesce(html, '')) as last from pages)
select page_id, size::bigint as payload_bytes, digest as payload_digest, case when size >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type, case when size >= 1000 and page_id <> last then last end as refers_to from p"""

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": _NGRAM_JOIN,
    "op3_substring_dedup": _SUBSTRING,
    "op5_exact_dedup": _EXACT,
    "op10_line_dedup": line_templates.oracle(),
    "op11_warc": _WARC,
    "op13_divergence": divergence.ORACLE,
}
