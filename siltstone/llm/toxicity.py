"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer turns each token into a class and a weight; transducers for
negation, reported speech, insult, threat and target (transducers.py) read the classes
of a clause, and their composition, one table, accepts a clause that holds an insult, or a
threat with a target, and gives it one of the kinds in KINDS.  A negation up to three
tokens before an insult, or a verb of speech before it, changes the clause's kind.  A
clause weighs as much as its heaviest insult.
A text's features are its clauses of each kind; weights are learned, so how much a
negated or reported insult counts comes from the labels, starting from priors.

The insult transducer reads whole words and word beginnings.  Besides a few seeds
they are learned from labelled texts: patterns whose presence separates toxic from
other texts, chosen greedily by the toxic texts they newly explain, then all others
that stand out beyond chance.

Learning uses at most `sample` labelled rows of each class (those with the smallest
hash of the id), of which labels and texts alone are read; candidates reach the driver as
at most `candidates` patterns.  Scoring reads every whole text in one pass without a
shuffle; texts without a match cost one automaton run.

Null and empty texts get the base score.  Labels that are null, or not 0 or 1, or that
contradict each other are not learned from.  Without labels the priors hold.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import transducers as T
from .common import small_batches, written

# Seeds of the transducers, by class, in English, German, French and Spanish.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "worthless", "pathetic", "dummkopf", "arschloch", "connard", "imbécile", "estúpido", "idiota")
THREATS = ("kill", "hurt", "destroy", "murder", "töten", "umbringen", "vernichten", "tuer", "détruire", "matar", "destruir")
TARGETS = ("you", "your", "yourself", "he", "she", "they", "them", "du", "dich", "ihr", "euch", "tu", "toi", "vous", "te", "ti", "usted", "ustedes")
NEGATIONS = ("not", "no", "never", "nobody", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "jamás")
REPORTS = ("said", "says", "called", "wrote", "claimed", "quoted", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió")

KINDS = ("insult", "insult at a target", "negated insult", "reported insult", "threat at a target")
# Weights before any label is seen; the last is the base.
PRIOR = np.array([2.0, 3.0, 0.5, 0.5, 2.5, 0.3, -3.0])
CLAUSE = re.compile(r"[.!?;\n]")
TOKEN = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)


class Grammar:
    """The composed transducers: clauses of a text to counts of kinds and the weight of its insults."""

    def __init__(self, words: dict[str, float], starts: dict[str, float]):
        self.words, self.starts = words, starts
        self.automaton = ahocorasick.Automaton()  # finds the clauses worth reading
        for word in {*words, *THREATS}:
            self.automaton.add_word(word, (len(word), True))
        for start in starts:
            self.automaton.add_word(start, (len(start), False))
        self.automaton.make_automaton()
        self.classes = {t: c for c, some in ((T.THREAT, THREATS), (T.REPORT, REPORTS), (T.NEGATION, NEGATIONS), (T.TARGET, TARGETS)) for t in some}
        self.table, marks = T.compose(T.negation(), T.reported_speech(), T.insult(), T.threat(), T.target())
        self.kinds = [self._kind(m) for m in marks]

    @staticmethod
    def _kind(marks: frozenset[str]) -> int | None:
        """The kind of a clause that ends with these marks."""
        if "plain" in marks:
            return 1 if "target" in marks else 0
        return 2 if "negated" in marks else 3 if "reported" in marks else 4 if {"threat", "target"} <= marks else None

    def token(self, token: str) -> tuple[int, float]:
        """The lexical transducer: a token's class and weight."""
        weight = self.words.get(token)
        for n in PREFIXES:
            if len(token) > n and (w := self.starts.get(token[:n])) is not None:
                weight = w if weight is None else max(weight, w)
        return (self.classes.get(token, T.OTHER), 0.0) if weight is None else (T.INSULT, weight)

    def clause(self, text: str) -> tuple[int, float] | None:
        """(kind, weight) of an accepted clause."""
        state, heaviest = 0, 0.0
        for token in TOKEN.findall(text):
            c, weight = self.token(token)
            state, heaviest = self.table[state][c], max(heaviest, weight)
        kind = self.kinds[state]
        return None if kind is None else (kind, heaviest)

    def features(self, text: str) -> np.ndarray | None:
        """log(1 + clauses) of each kind and the largest insult weight; None without an accepted clause."""
        low = text.lower()
        seen: set[int] = set()
        out = None
        for end, (size, whole) in self.automaton.iter(low):
            begin = end - size + 1
            if begin and low[begin - 1].isalpha() or whole and end + 1 < len(low) and low[end + 1].isalpha() and low[begin:end + 1] not in self.starts:
                continue
            a = max(low.rfind(c, 0, begin) for c in ".!?;\n") + 1
            if a in seen:
                continue
            seen.add(a)
            stop = CLAUSE.search(low, begin)
            if found := self.clause(low[a:stop.start() if stop else len(low)]):
                out = np.zeros(len(PRIOR) - 1) if out is None else out
                out[found[0]] += 1
                out[-1] = max(out[-1], found[1])
        if out is not None:
            out[:-1] = np.log1p(out[:-1])
        return out


def patterns(text: str) -> set[str]:
    """`=word` for each word of a text, and `word*` for each beginning of 4 to 6 letters of a longer one."""
    out = set()
    for word in set(TOKEN.findall(text.lower())):
        out.add("=" + word)
        out.update(word[:n] + "*" for n in PREFIXES if len(word) > n)
    return out


def choose(rows: list[tuple[int, list[int]]], names: list[str], chance: float) -> list[int]:
    """Indexes of the patterns to learn from (label, pattern indexes) of the sample."""
    m = len(names)
    label = np.array([r[0] for r in rows], bool)
    of = [[] for _ in range(m)]
    for i, (_, found) in enumerate(rows):
        for p in found:
            of[p].append(i)
    of = [np.array(x, np.int64) for x in of]
    open_ = label.copy()
    picked: list[int] = []
    # a beginning for which one word, or one longer beginning, accounts says no more than that
    longer: dict[str, int] = {}
    for p in range(m):
        text = names[p].strip("=*")
        for n in PREFIXES:
            if len(text) > n:
                longer[text[:n] + "*"] = max(longer.get(text[:n] + "*", 0), len(of[p]))
    useful = [p for p in range(m) if names[p][0] == "=" or longer.get(names[p], 0) < 0.95 * len(of[p])]
    live = list(useful)
    while live:
        gain = [(int(open_[of[p]].sum()) - 3 * int((~label[of[p]]).sum()), names[p][0] == "=", len(names[p]), names[p], p) for p in live]
        best = max(gain)
        if best[0] < 2:
            break
        picked.append(best[-1])
        open_[of[best[-1]]] = False
        live = [p for g, p in zip(gain, live, strict=True) if p != best[-1] and g[0] >= 2]
    share = max(1, label.sum()) / max(1, len(label))
    floor = max(3, 0.02 * label.sum())
    for p in useful:
        n, hits = len(of[p]), int(label[of[p]].sum())
        if p not in picked and n and hits >= floor and hits >= 0.995 * n and hits * np.log(share) + np.log(m) < np.log(chance):
            picked.append(p)
    return picked


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Logistic weights with a Gaussian prior, by Newton steps; classes weigh as they come."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + strength * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", sample: int = 12000, candidates: int = 4000, chance: float = 1e-3):
    """(Grammar, weights) from labelled rows whose crc32(id as text) mod 3 is not 1."""
    known = (labels.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("int").alias("y"))
             .where("id is not null and y in (0, 1) and crc32(cast(cast(id as string) as binary)) % 3 <> 1")
             .groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").select("id", "y"))
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample).toArrow() for y in (0, 1)]  # at most 2 * sample rows
    table = pa.concat_tables(chosen)
    if not table.num_rows:
        return Grammar(dict.fromkeys(INSULTS, 1.0), {}), PRIOR
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).join(F.broadcast(docs.sparkSession.createDataFrame(table)), "id").select("y", "text").where("text is not null")

    def count(batches):
        for batch in batches:
            held: dict[str, list[int]] = {}
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for p in patterns(text):
                    held.setdefault(p, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array([v[i] for v in held.values()], pa.int64()) for i in (0, 1))], ["pattern", "clean", "toxic"])

    rows = written(rows, "sample")
    total = {y: n for y, n in rows.groupBy("y").count().collect()}
    clean, toxic = total.get(0, 0), total.get(1, 0)
    counted = (rows.mapInArrow(count, "pattern string, clean long, toxic long").groupBy("pattern").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
               .where("toxic >= 2").where(F.col("toxic") * clean >= 20 * (F.col("clean") + 0.1) * toxic)
               .orderBy(F.desc(F.col("toxic") - 3 * F.col("clean")), "pattern").limit(candidates))
    stats = {r.pattern: (r.clean, r.toxic) for r in counted.collect()}
    names = sorted(stats)
    place = {p: i for i, p in enumerate(names)}

    def incidence(batches):
        for batch in batches:
            found = [sorted(place[p] for p in patterns(t) if p in place) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["y", "found"])

    met = [(r.y, r.found) for r in rows.mapInArrow(incidence, "y int, found array<int>").collect()]  # at most 2 * sample rows
    words, starts = dict.fromkeys(INSULTS, 1.0), {}
    for p in choose(met, names, chance):
        name, (c, t) = names[p], stats[names[p]]
        weight = float(np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)))
        (words if name[0] == "=" else starts)[name.strip("=*")] = weight
    grammar = Grammar(words, starts)

    def measure(batches):
        zero = np.zeros(len(PRIOR) - 1)
        for batch in batches:
            found = [grammar.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([(zero if f is None else f).tolist() for f in found], pa.list_(pa.float64()))], ["y", "f"])

    grammar_rows = rows.mapInArrow(measure, "y int, f array<double>").groupBy("y", "f").count().orderBy("y", "f").collect()
    x = np.array([r.f for r in grammar_rows for _ in range(r["count"])])
    y = np.array([r.y for r in grammar_rows for _ in range(r["count"])], float)
    return grammar, fit(x, y, PRIOR)


def score(docs: DataFrame, grammar: Grammar, weights: np.ndarray, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.7) -> DataFrame:
    """`docs` with score and predicted (these replace columns of that name)."""
    words, starts = grammar.words, grammar.starts
    base = float(1 / (1 + np.exp(-weights[-1])))

    def scored(batches):
        own = Grammar(words, starts)
        for batch in batches:
            out = np.full(batch.num_rows, base)
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if text and (f := own.features(text)) is not None:
                    out[i] = 1 / (1 + np.exp(-np.clip(f @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "score"])

    names = [c for c in docs.columns if c not in (text_column, "score", "predicted")]
    rows = small_batches(docs).select(*names, text_column)
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])
    return rows.mapInArrow(scored, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
