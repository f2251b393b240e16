"""Each stage of the pipeline against brute force on its own input, and the whole run."""

import json
from collections import Counter, defaultdict

import corpus_pipeline
from siltstone.llm import toxicity

from .cases import rows, table
from .test_operators import brute_components, brute_lines, fold, words

#: Names that operators use themselves.
CLASHES = ["n_words", "n_removed", "gone", "h", "h_", "score", "predicted", "n_lines", "n_dropped", "id", "node", "n", "rest", "carry", "bundle", "key", "start", "length", "parts"]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", *CLASHES, "seen"]


def folder(spark, path):
    some = rows()
    some += [(700 + i, f"Footer {i} all rights reserved\nown text {'abcdefghijklmnopqrstuvwxyz'[i]} " + " ".join(f"u{i}_{j}" for j in range(20)) + (" you zorgle" if i % 3 == 0 else ""), "en", "s", 1, 1, 1, "h") for i in range(24)]
    some += [(5, "another text that shares its id with an unrelated one", "en", "s", 1, 1, 1, "h"), (5, "a third\n  text\n\n    of that id", "fr", "s", 1, 1, 1, "h")]
    docs = table(spark, [r[:5] + (None, None, None) for r in some]).select(*COLUMNS[:5])
    for i, name in enumerate(CLASHES):
        docs = docs.selectExpr("*", f"concat('{i} ', lang) as {name}")
    docs.selectExpr("*", "timestamp_micros(1700000000123456 + coalesce(doc_id, 0)) as seen").write.parquet(f"{path}/documents.parquet")
    labels = [(700 + i, int(i % 3 == 0)) for i in range(24)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def others(found):
    """Columns that no stage may change, with the ids."""
    return Counter(json.dumps([r.doc_id, r.lang, r.source, *(r[c] for c in CLASHES), r.seen and r.seen.isoformat()]) for r in found)


def less(text, gone):
    """A text without the words of these numbers and the white space after each."""
    import re

    found = list(re.finditer(rb"[^\x20\x09-\x0D]+", text.encode()))
    out, at, raw = b"", 0, text.encode()
    for i in sorted(gone):
        out, at = out + raw[at:found[i].start()], found[i + 1].start() if i + 1 < len(found) else len(raw)
    return (out + raw[at:]).decode()


def test_stages(spark, tmp_path):
    path = folder(spark, tmp_path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    held = docs.collect()
    before = Counter((r.doc_id, r.text) for r in held)
    grammar, weights = toxicity.learn(docs, spark.read.parquet(f"{path}/labels.parquet"))
    toxic = Counter((r.doc_id, r.text) for r in toxicity.score(docs.select("doc_id", "text"), grammar, weights).where("predicted = 1").collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        found = out.collect()
        if name == "packing":
            assert Counter(r.doc_id for r in found if r.start == 0) == Counter(i for i, _ in before.elements())
            assert len({r.sequence_id for r in found}) == len(found)
            return
        assert out.columns == COLUMNS and out.schema["seen"].dataType.simpleString() == "timestamp"
        assert not others(found) - others(held)
        now = Counter((r.doc_id, r.text) for r in found)
        if name == "toxicity":
            assert toxic and now == before - toxic
        elif name == "line_dedup":
            assert now == Counter((i, t) for (i, _, _, t), n in brute_lines(list(before.elements()), 16).items() for _ in range(n))
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in found)
        elif name == "ngram_join":
            group = [(i, t, g) for (i, t), g in zip(before.elements(), brute_groups(list(before.elements())), strict=True)]
            kept = defaultdict(list)
            for i, t, g in group:
                kept[g].append((i is None, i or 0, t))
            assert not now - before
            assert Counter(i for i, t in now.elements() if words(t)) == Counter(None if (low := min(x))[0] else low[1] for g, x in kept.items() if words(x[0][2]))
            assert Counter(x for x in now.elements() if not words(x[1])) == Counter(x for x in before.elements() if not words(x[1]))
        else:
            seen = Counter(tuple(words(t)[i:i + 35]) for _, t in before.elements() for i in range(len(words(t)) - 34))
            want = Counter()
            for id_, text in before.elements():
                w = words(text)
                gone = {j for i in range(len(w) - 34) if seen[tuple(w[i:i + 35])] > 1 for j in range(i, i + 35)}
                want[id_, less(text, gone) if gone else text] += 1
            assert now == want
        before, held = now, found
        docs = spark.createDataFrame(found, out.schema)


def brute_groups(docs):
    """The group of each row: links by whole sets, whatever the ids."""
    numbered = brute_components([(n, t) for n, (_, t) in enumerate(docs)])
    low = {n: root for n, _, root in numbered}
    return [low[n] for n in range(len(docs))]


def test_run(spark, tmp_path):
    out = corpus_pipeline.run(spark, folder(spark, tmp_path)).collect()
    assert out and len({r.sequence_id for r in out}) == len(out)


def test_fold_is_the_join_s():
    assert fold("A b") == [b"a", b"b"]
