"""URL filter: host and path rules, else a character language-model ratio.

Rules judge first; the longest that fits wins.  The URLs that rules allow or block
are the accepted and the rejected class of the model: for each class a smoothed
variable-order Markov model over 40 symbols, orders 0 to 3 interpolated by
Witten-Bell weights.  A URL's score is the difference of its log-likelihoods under
the two, divided by its symbols; it is blocked below a threshold.

The threshold is the one with the least sum of the two error rates on a fifth of the judged
URLs (by hash of the URL) under models of the other four fifths; these rates come with the
model.  The models that judge then count every judged URL.  Counts are sums over at most
4 * 40**4 cells, whatever the input's size; a scoring table sent to tasks has 40**4
four-byte cells (10 MB).

Null urls, and those without `://`, have an empty host and path; no rule fits them.
An empty url scores 0.  Without judged URLs of both classes every other URL is allowed.
Repeated rows each come back.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import small_batches

# Verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

ORDER = 3
SYMBOLS = 40
START, END, OTHER = 0, 1, 2
_SYMBOL = np.full(256, OTHER, np.int64)
_SYMBOL[ord("a"):ord("z") + 1] = np.arange(3, 29)
_SYMBOL[ord("A"):ord("Z") + 1] = np.arange(3, 29)
_SYMBOL[ord("0"):ord("9") + 1] = 29
for _i, _c in enumerate(b"./:-_?=&#%"):
    _SYMBOL[_c] = 30 + _i
BINS, SPAN = 4001, 10.0


def host_and_path(url):
    """Two expressions: the host (A-Z lower-cased) and the path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring({0}, locate('://', {0}) + 3)".format(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _grams(data: np.ndarray, offsets: np.ndarray):
    """(row, index of symbol and its context) of every symbol, each row's end included."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    total = size + ORDER + 1
    to = np.cumsum(total) - total
    padded = np.full(int(total.sum()), START, np.int64)
    padded[np.arange(len(data)) + np.repeat(to + ORDER - offsets[:-1], size)] = _SYMBOL[data]
    padded[to + total - 1] = END
    at = np.arange(int((size + 1).sum())) + np.repeat(to + ORDER - (np.cumsum(size + 1) - size - 1), size + 1)
    index = padded[at]
    for k in range(1, ORDER + 1):
        index = index + padded[at - k] * SYMBOLS**k
    return np.repeat(np.arange(n), size + 1), index


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """log P(symbol | three before it), from counts of four symbols, by interpolated Witten-Bell smoothing."""
    counts = counts.reshape((SYMBOLS,) * (ORDER + 1)).astype(np.float64)
    lower = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(ORDER + 1):
        here = counts.sum(axis=tuple(range(ORDER - order)))
        total, kinds = here.sum(axis=-1, keepdims=True), (here > 0).sum(axis=-1, keepdims=True)
        lower = np.where(total > 0, (here + kinds * lower) / np.maximum(total + kinds, 1), np.broadcast_to(lower, here.shape))
    return np.log(lower).astype(np.float32).reshape(-1)


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios by symbol and context, the threshold, and the shares of held-out URLs that it gets wrong."""

    table: np.ndarray
    threshold: float
    allowed_lost: float | None = None
    blocked_missed: float | None = None


def _ratio(rejected: np.ndarray, accepted: np.ndarray) -> np.ndarray | None:
    return log_probabilities(accepted) - log_probabilities(rejected) if rejected.any() and accepted.any() else None


def _scores(column, table: np.ndarray) -> np.ndarray:
    out = [np.zeros(0)]
    for _, data, offsets in K.chunks(column):
        row, index = _grams(data, offsets)
        size = np.diff(offsets) + 1
        total = np.bincount(row, table[index].astype(np.float64), len(size))
        out.append(np.where(size > 1, total / size, 0.0))
    return np.concatenate(out)


def _ruled(pages: DataFrame, id_column: str, url_column: str, rules) -> DataFrame:
    """id, url, host, path, rule, ruled (the rule's verdict)."""
    base = small_batches(pages).select(F.col(id_column).alias("id"), F.col(url_column).alias("url"))
    host, path = host_and_path("url")
    base = base.select("id", "url", host.alias("host"), path.alias("path"))
    rule = ruled = F.lit(None).cast("string")
    for verdict, name, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == name) | F.endswith("host", F.lit("." + name))) & F.startswith("path", F.lit(prefix))
        rule, ruled = F.when(fits, name + prefix).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    return base.withColumn("rule", rule).withColumn("ruled", ruled)


def fit(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", rules=RULES) -> Model:
    """The model of the URLs that the rules judge; without URLs of both classes it allows everything."""
    judged = (_ruled(pages, id_column, url_column, rules).where("ruled is not null")
              .select("url", (F.col("ruled") == "allow").cast("int").alias("kind"), (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).cast("int").alias("held")))
    cells_of = SYMBOLS**(ORDER + 1)

    def count(batches):
        held = {}
        for batch in batches:
            part = np.asarray(batch.column(1)).astype(np.int64) + 2 * np.asarray(batch.column(2))
            for first, data, offsets in K.chunks(batch.column(0)):
                row, index = _grams(data, offsets)
                cell, n = np.unique(index + part[first + row] * cells_of, return_counts=True)
                for c, m in zip(cell.tolist(), n.tolist(), strict=True):
                    held[c] = held.get(c, 0) + m
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], ["cell", "n"])

    counts = np.zeros(4 * cells_of, np.int64)
    for batch in judged.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().to_batches():  # at most one row a cell
        counts[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    counts = counts.reshape(2, 2, cells_of)  # held out or not, rejected or accepted
    final = _ratio(*counts.sum(axis=0))
    if final is None:
        return Model(np.zeros(cells_of, np.float32), -np.inf)
    trial, check = _ratio(*counts[0]), "held = 1"
    if trial is None or not counts[1].any(axis=1).all():  # too few to hold any out
        trial, check = final, "true"
    shared = pages.sparkSession.sparkContext.broadcast(trial)

    def spread(batches):
        held = np.zeros((2, BINS), np.int64)
        for batch in batches:
            place = np.clip(np.floor((_scores(batch.column(0), shared.value) / SPAN + 0.5) * BINS), 0, BINS - 1).astype(np.int64)
            np.add.at(held, (np.asarray(batch.column(1)).astype(np.int64), place), 1)
        kind, place = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(place), pa.array(held[kind, place])], ["kind", "bin", "n"])

    bins = np.zeros((2, BINS), np.int64)
    for kind, place, n in judged.where(check).mapInArrow(spread, "kind long, bin long, n long").groupBy("kind", "bin").agg(F.sum("n")).collect():  # 2 * BINS rows at most
        bins[kind, place] = n
    # a bin's lower edge as threshold blocks everything below it
    below = np.cumsum(bins, axis=1) - bins
    lost, missed = below[1] / bins[1].sum(), 1 - below[0] / bins[0].sum()
    edges = (np.arange(BINS) / BINS - 0.5) * SPAN
    best = np.flatnonzero(lost + missed == (lost + missed).min())
    at = best[np.argmin(np.abs(edges[best]))]
    return Model(final, float(edges[at]), float(lost[at]), float(missed[at]))


def judge(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", rules=RULES, model: Model | None = None) -> DataFrame:
    """One row for each row: id, host, path, rule, verdict, score (null where a rule judged); `model` is fitted on `pages` if not given."""
    base = _ruled(pages, id_column, url_column, rules)
    model = fit(pages, id_column, url_column, rules) if model is None else model
    shared, threshold = pages.sparkSession.sparkContext.broadcast(model.table), model.threshold

    def decide(batches):
        for batch in batches:
            score = _scores(batch.column(1), shared.value)
            verdict = pa.array(np.where(score < threshold, "block", "allow"))
            ruled = batch.column(5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4),
                                              pc.coalesce(ruled, verdict), pa.array(score, mask=np.asarray(ruled.is_valid()))], ["id", "host", "path", "rule", "verdict", "score"])

    kind = dict(pages.dtypes)[id_column]
    return base.mapInArrow(decide, f"id {kind}, host string, path string, rule string, verdict string, score double").withColumnRenamed("id", id_column)
