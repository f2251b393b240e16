"""Identity of words, units and sets, also where hashes agree."""

import random

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import bpe, ngram_join, packing
from siltstone.llm import textkernel as K
from siltstone.llm.queries import tokenizer_file

from .cases import thue_morse


def spans(words):
    data = np.frombuffer(b" ".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    start = np.cumsum(size + 1) - size - 1
    return data, start, start + size


def test_keys_agree_only_for_equal_words():
    rng = random.Random(2)
    words = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(1, 24))) for _ in range(4000)] + [b"a" * n for n in range(1, 40)] + [b"a" * 15 + b"\x00", b"a" * 7 + b"\x00" * 8]
    words += [thue_morse(1024).encode(), thue_morse(1024, "ba").encode()]
    one, two = K.span_keys(*spans(words))
    assert len({(a, b) for a, b in zip(one.tolist(), two.tolist(), strict=True)}) == len(set(words))
    for lane in (0, 1):
        assert len(set(K.hash_keys(one, two, lane).tolist())) == len(set(words))


@pytest.mark.parametrize("size", [1, 2, 3, 5, 15, 35])
def test_windows_agree_only_for_equal_runs(size):
    rng = random.Random(size)
    words = np.array([rng.choice([11, 12, 13]) for _ in range(3000)], np.uint64)
    of_row = np.array([0, 0, size - 1, 1500, 3000])
    at, value = K.window_hashes(words, of_row, size)
    rows = [(a, b) for a, b in zip(of_row[:-1], of_row[1:], strict=True)]
    assert at.tolist() == [i for a, b in rows for i in range(a, b - size + 1)]
    runs = [tuple(words[i:i + size].tolist()) for i in at]
    assert len(set(runs)) == len(set(value.tolist())) == len(set(zip(runs, value.tolist(), strict=True)))


@pytest.fixture
def few_hashes(monkeypatch):
    monkeypatch.setattr(K, "hash_keys", lambda one, two, lane=0: (one ^ two) % np.uint64(3))


def test_distinct_keys_where_hashes_agree(few_hashes):
    rng = random.Random(3)
    words = [rng.choice([b"alpha", b"beta", b"gamma", b"delta", b"a much longer word than sixteen", b"x"]) for _ in range(500)]
    one, two = K.span_keys(*spans(words))
    value, at, back = K.distinct_keys(one, two)
    assert len(at) == 6 and [words[at[i]] for i in back] == words and (np.diff(value.astype(np.int64)) >= 0).all()


def test_units_where_hashes_agree(few_hashes):
    path = tokenizer_file("byte_bpe_50k.json")
    encoder, rng = packing.UnitEncoder(path), random.Random(4)
    for _ in range(4):
        texts = [" ".join(rng.choice(["the", "storm", "harbour", "lasts", "until", "morning", "x" * 30]) for _ in range(rng.randrange(30))) for _ in range(20)]
        for _, data, offsets in K.chunks(pa.array(texts)):
            ids, edge = encoder.encode(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_bundles_where_hashes_agree(few_hashes):
    rng, bundle, texts = random.Random(5), bpe.Bundle(), []
    for part in range(3):
        some = [" ".join(rng.choice(["the", "storm", "harbour", "lasts", "until", "a word beyond sixteen bytes".replace(" ", "-")]) for _ in range(9)) for _ in range(5)]
        texts += some
        for _, data, offsets in K.chunks(pa.array(some)):
            bundle.add(pa.array(range(part * 5, part * 5 + 5), pa.int64()), K.Words(data, offsets))
    _, ids, counts, _, flat, first, size, places = bundle.close()
    words = [flat[a:a + n].tobytes().decode() for a, n in zip(first, size, strict=True)]
    assert len(words) == len(set(words)) and " ".join(words[p] for p in places) == " ".join(texts) and counts.tolist() == [9] * 15 and ids.to_pylist() == list(range(15))


def test_nodes_of_sets_that_share_half_a_digest():
    s = np.arange(5, dtype=np.uint64)
    node, other = K.set_digest(s)
    assert ngram_join._node(s, frozenset()) == node and ngram_join._node(s, frozenset([node])) == other != node
