"""Cross-tokenizer alignment against token-by-token Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import alignment
from siltstone.llm import textkernel as K
from siltstone.llm.queries import tokenizer_file

from .cases import empty, rows, table

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(tokenizer_file(A))
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(B)), alignment._byte_alphabet()


def brute(text, tools):
    """n_a, n_b, n_groups, links, groups of a text; None without tokens."""
    one, other, alphabet = tools
    if not text:
        return None
    a, b = one.encode(" " + text, add_special_tokens=False).ids, other.encode(text)
    bytes_a = [bytes(alphabet[c] for c in one.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(other.id_to_piece(i)[3:5], 16)]) if other.is_byte(i) else other.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    at_a, at_b = ([0, *np.cumsum([len(x) for x in y]).tolist()] for y in (bytes_a, bytes_b))
    links, j = [], 0
    for i in range(len(a)):
        while at_b[j + 1] <= at_a[i]:
            j += 1
        k = j
        while k < len(b) and at_b[k] < at_a[i + 1]:
            links.append((a[i], b[k]))
            k += 1
    place_a, place_b = ({x: i for i, x in enumerate(y)} for y in (at_a, at_b))
    cuts = sorted(set(at_a) & set(at_b))
    groups = [",".join(map(str, a[place_a[x]:place_a[y]])) + "|" + ",".join(map(str, b[place_b[x]:place_b[y]])) for x, y in zip(cuts, cuts[1:], strict=False)]
    return len(a), len(b), len(groups), links, ";".join(groups)


def told(texts, tools):
    """The result's rows for (id, text) rows."""
    found = [(i, brute(t, tools)) for i, t in texts]
    count = Counter(x for _, f in found if f for x in f[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return Counter((i, 0, 0, 0, 0, 0, 0, "") if f is None else (i, f[0], f[1], f[2], len(f[3]), sum(count[x] == best[x[1]] for x in f[3]), sum(count[x] for x in f[3]), f[4]) for i, f in found)


def test_rows_of_random_texts(tools):
    rng = random.Random(3)
    pool = [" ", "  ", "\n", "\t", "a", "the", "ing", "é", "漢", "🤣", "\xa0", "　", "\x00", "<|endoftext|>", "</s>", "123", "'s", "▁", ".", "ß", "\x1d", "Ա", "don't"]
    texts = ["", " ", "  ", "\n", " lead", "trail ", "a▁b", "x" * 3000, "ﬁ é 漢字", *("".join(rng.choice(pool) for _ in range(rng.randint(1, 25))) for _ in range(600))]
    at = alignment.aligner(tokenizer_file(A), tokenizer_file(B))
    for first, data, offsets in K.chunks(pa.array(texts, pa.string()), 1 << 12):
        counts, row, pair, text, ends = at.rows(data, offsets)
        for k in range(len(offsets) - 1):
            f = brute(texts[first + k], tools)
            want = (0, 0, 0, 0, [], "") if f is None else (f[0], f[1], f[2], len(f[3]), [x << 32 | y for x, y in f[3]], f[4])
            assert (*counts[:, k].tolist(), pair[row == k].tolist(), bytes(text[ends[k]:ends[k + 1]]).decode()) == want, texts[first + k]


def test_owner_arrays_in_windows():
    rng = np.random.default_rng(1)
    for _ in range(50):
        cuts = [np.sort(rng.choice(np.arange(1, 60), rng.integers(0, 30), replace=False)) for _ in range(2)]
        one, other = (np.diff(np.concatenate(([0], c, [60]))) for c in cuts)
        whole = alignment.overlaps(one, other)
        for window in (1, 7, 60, 1000):
            assert all((x == y).all() for x, y in zip(whole, alignment.overlaps(one, other, window), strict=True))


@pytest.mark.parametrize("groups", ["text", "sha256"])
def test_the_whole_table(spark, tools, groups):
    got = Counter(tuple(r) for r in alignment.align(table(spark), tokenizer_file(A), tokenizer_file(B), groups=groups).collect())
    want = told([r[:2] for r in rows()], tools)
    if groups == "sha256":
        want = Counter({(*k[:7], hashlib.sha256(k[7].encode()).hexdigest() if k[7] else ""): n for k, n in want.items()})
    assert got == want


def test_an_empty_table(spark):
    assert alignment.align(empty(spark), tokenizer_file(A), tokenizer_file(B)).count() == 0
