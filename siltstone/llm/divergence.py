"""Source divergence audit: how far the sources of a language differ in their words.

Plain relations: terms are exploded and counted by (lang, source, term); a language keeps
the terms in enough of its documents; its groups are crossed with the kept terms, so that
a term that a group lacks counts 0; a self-join on lang and term gives the terms of two
sources next to each other; their differences are summed and ranked.

All arithmetic is on integers (products as decimals), so any order of rows gives the same sums.

How it scales: a document's terms are sorted within the row, so that its first one of each
kind counts as a document; counts are combined before they shuffle.  The cross is an equal
join on lang and one of 64 salts of the term, so a language with a third of all rows is
spread.  The self-join meets each pair of sources once, as the value is the same both ways.

Nulls in text, lang and source count as ''.  Repeated rows each count.  Groups without terms
count nothing and are compared all the same; where a language keeps no term every value of
`pair` is 0.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

# Fixed value: what stands between terms; a term is a longest run of letters A-Z, a-z and characters beyond ASCII.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 64
SCALE = 1_000_000_000


def term_counts(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term."""
    base = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_column, "lang"), (source_column, "source"), (text_column, "text"))])
    small = F.when(F.octet_length("text") == F.length("text"), F.lower("text")).otherwise(F.translate("text", UPPER, LOWER))
    terms = base.select("lang", "source", F.sort_array(F.split(small, BETWEEN)).alias("terms"))
    # each term beside the one before it: equal ones stand together
    beside = terms.select("lang", "source", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.concat(F.array(F.lit(None).cast("string")), F.col("terms")).alias("before")))).where("term <> ''")
    return beside.groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.count_if(~F.col("term").eqNullSafe(F.col("before"))).alias("docs"))


def _share(count: str, total: str, kept: str):
    """1 + floor(1e9 * (count + 2) / (total + 2 * kept)), exactly."""
    return F.expr(f"1 + (cast({count} + 2 as decimal(20, 0)) * {SCALE}) div cast({total} + 2 * {kept} as decimal(20, 0))")


#: floor((p - q)^2 / (p + q)); p and q are 1e9 + 1 at most, so the square fits a long.
_GAP = "((p - q) * (p - q)) div (p + q)"


def divergence(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source", min_docs: int = 10, terms: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the lang (`pair`), and the terms that mark the source (`term`, ranks to `terms`)."""
    groups = written(docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_column, "lang"), (source_column, "source"))]).distinct(), "groups")
    counts = written(term_counts(docs, text_column, lang_column, source_column), "terms")
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    kept = written(counts.drop("docs").join(vocabulary, ["lang", "term"]), "kept")
    discard(counts)
    vocabulary = kept.groupBy("lang", "term").agg(F.first("n_lang").alias("n_lang"))
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    told = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang").withColumn("total", F.coalesce("total", F.lit(0)))
    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS))
    dense = (vocabulary.withColumn("salt", salt).join(told.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["lang", "salt"]).drop("salt")
             .join(kept.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left")
             .select("lang", "source", "term", F.coalesce("n", F.lit(0)).alias("n"), _share("coalesce(n, 0)", "total", "v").alias("p"), _share("n_lang", "total_lang", "v").alias("q")))
    dense = written(dense, "shares")

    one, other = dense.select("lang", "term", "source", "p"), dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    gaps = one.join(other, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(F.expr(_GAP)).alias("value"))
    both = gaps.unionByName(gaps.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = (groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source <> item")
             .join(both, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long"))))
    marks = dense.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_GAP).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = (pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
              .unionByName(marks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= terms).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")))
    return ranked


ORACLE = r"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
groups as (select distinct lang, source from d),
occurrences as (select lang, source, row, unnest(terms) as term from d),
vocabulary as (select lang, term, count(*) as n from occurrences group by lang, term having count(distinct row) >= 10),
langs as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from vocabulary group by lang),
counts as (select lang, source, term, count(*)::hugeint as n from occurrences semi join vocabulary using (lang, term) group by all),
sizes as (select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as total from groups g left join counts c on g.lang = c.lang and g.source = c.source group by all),
dense as (select g.lang, g.source, t.term, coalesce(c.n, 0) as n,
    (1 + 1000000000::hugeint * (coalesce(c.n, 0) + 2) // (g.total + 2 * l.v))::bigint as p, (1 + 1000000000::hugeint * (t.n + 2) // (l.total + 2 * l.v))::bigint as q
  from sizes g join langs l on g.lang = l.lang join vocabulary t on g.lang = t.lang left join counts c on g.lang = c.lang and g.source = c.source and t.term = c.term),
gaps as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select g.lang, g.source, h.source as item, coalesce(x.value, 0)::bigint as value from groups g join groups h on g.lang = h.lang and g.source <> h.source left join gaps x on x.lang = g.lang and x.source = g.source and x.item = h.source),
marks as (select lang, source, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from dense where n > 0 and p > q)
select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
union all
select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from marks qualify row_number() over (partition by lang, source order by value desc, item) <= 10"""
