"""Small tables with the cases that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, node long, h string"


def thue_morse(size: int, letters: str = "ab") -> str:
    """A word and, with the letters swapped, its complement: polynomial hashes modulo 2**64 take them for one from 1024 letters on."""
    return "".join(letters[bin(i).count("1") % 2] for i in range(size))


def rows(seed: int = 7):
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies, and columns with clashing names."""
    rng = random.Random(seed)
    words = ["alpha", "beta,", "Gamma", "delta.", "é", "中文", "x1", "don't", "stop!", "you"] + [f"w{i}" for i in range(300)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage, base = text(60), text(150)
    near = base.split()
    near[10] = "changed"
    texts = [None, "", " ", "\n\t ", "one", "one two three", "One TWO three", text(34), text(35), base, base, " ".join(near), passage + "\n" + text(20), text(20) + "\n" + passage,
             passage + " " + passage, "tail space  ", "  lead\n\nmid \t x\r\n", text(4000), "long" * 5000, "nbsp and em <|endoftext|> end", "a\x1cb  c\x85d", "İIΣ finalΣ. é",
             "Hello you idiot. Not stupid!\nHe said you moron"]
    one, other = thue_morse(1024), thue_morse(1024, "ba")
    texts += [" ".join([w] + [f"tm{i}" for i in range(34)]) for w in (one, other)] + [f"{w} {w}x" for w in (one, other)] + [" ".join([w] * 40) for w in (one, other)]
    texts += ["sixteen bytes or", "sixteen-bytes-or fifteen-bytes-o sixteen-bytes-o"]
    out = [(i, t, "en", f"src{i % 3}", len(t or ""), None, i, "h") for i, t in enumerate(texts)]
    out += [out[9], out[9], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (5000, base, "en", None, 3, 1, 2, "x"), (4000, None, None, None, None, None, None, None)]
    return out


def table(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
