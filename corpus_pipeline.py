"""The corpus pipeline: five operators of siltstone.llm applied to `documents`, one after the other.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept;
all but the last return the columns of documents, with n_chars as the text's length.
Columns beyond doc_id and text travel as one struct, so none of their names can clash with
an operator's and their values come back untouched.  Ids may be null or repeat: rows are
told apart by their texts as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import toxicity
from siltstone.llm.common import written
from siltstone.llm.line_templates import drop_templates
from siltstone.llm.ngram_join import keep_one
from siltstone.llm.packing import pack
from siltstone.llm.queries import tokenizer_file
from siltstone.llm.substring_dedup import remove_repeats


def _folded(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns as one struct, `carry`."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(0)).alias("carry"))


def _unfolded(rows: DataFrame, docs: DataFrame, changed: bool = True) -> DataFrame:
    """The columns of `docs` again; n_chars recounted where texts have changed."""
    count = F.length("text").cast(docs.schema["n_chars"].dataType) if changed and "n_chars" in docs.columns else None
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else (count if c == "n_chars" and changed else F.col("carry")[c]).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents predicted toxic go."""
    grammar, weights = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unfolded(toxicity.score(_folded(docs), grammar, weights).where("predicted = 0"), docs, changed=False)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: recurring lines keep their first one only."""
    return _unfolded(drop_templates(_folded(docs)), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of linked documents the one with the smallest id stays."""
    return keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: words inside repeated 35-word windows go; what is left keeps its layout."""
    return _unfolded(remove_repeats(_folded(docs), carry=("carry",), layout=True).withColumn("carry", F.col("carry.carry")), docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one row for each piece, its token ids included."""
    packed = pack(docs, tokenizer_file("byte_bpe_50k.json"), longest=2048, end_id=1)
    return packed.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("packing", pack_tokens),
]

#: A learned score, shingle hashes and a tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
