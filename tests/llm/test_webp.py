"""The WebP reader on images that a small writer of our own makes: every code and every transform."""

import random

import numpy as np
import pytest

from siltstone.llm import webp

ORDER = webp.CODE_ORDER


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n)]

    def symbol(self, codes, s):
        length, code = codes[s]
        self.bits += [code >> length - 1 - i & 1 for i in range(length)]


def canonical(lengths):
    used = sorted((n, s) for s, n in lengths.items() if n)
    if len(used) == 1:
        return {used[0][1]: (0, 0)}
    out, code, last = {}, 0, 0
    for n, s in used:
        code <<= n - last
        out[s] = (n, code)
        code, last = code + 1, n
    assert code == 1 << last
    return out


def flat(symbols, alphabet):
    """Lengths for a complete code over at least these symbols: unequal where their number allows it."""
    symbols = sorted(set(symbols))
    if len(symbols) == 1:
        return {symbols[0]: 1}
    n = len(symbols)
    if n <= 12:  # 1, 2, 3, ..., n - 1, n - 1
        return {s: min(i + 1, n - 1) for i, s in enumerate(symbols)}
    k = (n - 1).bit_length()
    rest = [s for s in range(alphabet) if s not in set(symbols)]
    return dict.fromkeys(symbols + rest[:(1 << k) - n], k)


def write_code(w, lengths, alphabet):
    codes = canonical(lengths)
    used = sorted(s for s, n in lengths.items() if n)
    if len(used) <= 2 and used[-1] < 256 and all(lengths[s] == 1 for s in used):
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(1, 1)
        w.put(used[0], 8)
        if len(used) == 2:
            w.put(used[1], 8)
        return codes
    row, tokens, i = [lengths.get(s, 0) for s in range(alphabet)], [], 0
    previous = 8
    while i < alphabet:
        run = 1
        while i + run < alphabet and row[i + run] == row[i]:
            run += 1
        if row[i] == 0 and run >= 3:
            run = min(run, 138)
            tokens.append((18, run - 11, 7) if run >= 11 else (17, run - 3, 3))
        elif row[i] and row[i] == previous and run >= 3:
            run = min(run, 6)
            tokens.append((16, run - 3, 2))
        else:
            run = 1
            tokens.append((row[i], 0, 0))
            previous = row[i] or previous
        i += run
    kinds = {t[0] for t in tokens}
    if len(kinds) == 1:
        kinds.add(0 if 0 not in kinds else 1)
    k = max(1, (len(kinds) - 1).bit_length())
    of = {s: k for s in sorted(kinds) + [s for s in range(19) if s not in kinds][:(1 << k) - len(kinds)]}
    small = canonical(of)
    w.put(0, 1)
    w.put(15, 4)
    for s in ORDER:
        w.put(of.get(s, 0), 3)
    w.put(0, 1)
    for s, extra, n in tokens:
        w.symbol(small, s)
        w.put(extra, n)
    return codes


def prefix(value):
    if value <= 4:
        return value - 1, 0, 0
    for code in range(4, 40):
        n = code - 2 >> 1
        low = (2 + (code & 1) << n) + 1
        if low <= value < low + (1 << n):
            return code, value - low, n
    raise AssertionError


def write_image(w, tokens, cache_bits, main, groups=None):
    """tokens: ('lit', argb), ('ref', length, distance code), ('cache', index)."""
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    size = 1 << cache_bits if cache_bits else 0
    green, red, blue, alpha, distance = [], [], [], [], []
    for t in tokens:
        if t[0] == "lit":
            green.append(t[1] >> 8 & 255)
            red.append(t[1] >> 16 & 255)
            blue.append(t[1] & 255)
            alpha.append(t[1] >> 24)
        elif t[0] == "ref":
            green.append(256 + prefix(t[1])[0])
            distance.append(prefix(t[2])[0])
        else:
            green.append(280 + t[1])
    codes = [write_code(w, flat(v or [0], n), n) for v, n in ((green, 280 + size), (red, 256), (blue, 256), (alpha, 256), (distance, 40))]
    for t in tokens:
        if t[0] == "lit":
            for code, v in zip(codes, (t[1] >> 8 & 255, t[1] >> 16 & 255, t[1] & 255, t[1] >> 24), strict=False):
                w.symbol(code, v)
        elif t[0] == "ref":
            for code, value, base in ((codes[0], t[1], 256), (codes[4], t[2], 0)):
                s, extra, n = prefix(value)
                w.symbol(code, base + s)
                w.put(extra, n)
        else:
            w.symbol(codes[0], 280 + t[1])


def wrap(w, width, height):
    bits = Writer()
    bits.put(width - 1, 14)
    bits.put(height - 1, 14)
    bits.put(1, 1)
    bits.put(0, 3)
    data = b"\x2f" + np.packbits(np.array(bits.bits + w.bits, np.uint8), bitorder="little").tobytes()
    pad = b"\0" * (len(data) & 1)
    return b"RIFF" + (12 + len(data) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data + pad


def argb(samples):
    s = samples.astype(np.int64)
    return (s[..., 3] << 24 | s[..., 0] << 16 | s[..., 1] << 8 | s[..., 2]).reshape(-1).tolist()


def literal(w, values, main=False, cache=1):
    write_image(w, [("lit", int(v)) for v in values], cache, main)


def test_references_and_cache():
    width, height = 7, 6
    rng = random.Random(4)
    palette = [rng.randrange(1 << 32) for _ in range(5)]
    out, tokens, cache = [], [], {}
    bits = 4

    def see(v):
        cache[(0x1E35A7BD * v & 0xFFFFFFFF) >> 32 - bits] = v

    while len(out) < width * height:
        choice = rng.random()
        left = width * height - len(out)
        if choice < 0.3 and out:
            code = rng.choice([c for c in range(1, 121) if 0 < max(1, webp.PLANE[c - 1][0] + webp.PLANE[c - 1][1] * width) <= len(out)] + [121 - 1 + d for d in range(1, len(out) + 1)])
            distance = code - 120 if code > 120 else max(1, webp.PLANE[code - 1][0] + webp.PLANE[code - 1][1] * width)
            length = rng.randrange(1, min(left, 9) + 1)
            tokens.append(("ref", length, code))
            for _ in range(length):
                out.append(out[-distance])
                see(out[-1])
        elif choice < 0.6 and cache:
            index = rng.choice(list(cache))
            tokens.append(("cache", index))
            out.append(cache[index])
        else:
            v = rng.choice(palette)
            tokens.append(("lit", v))
            out.append(v)
            see(v)
    w = Writer()
    w.put(0, 1)
    write_image(w, tokens, bits, True)
    got = webp.decode(wrap(w, width, height))
    assert got[:2] == (width, height) and argb(got[2]) == out


def test_plane_has_the_published_shape():
    assert len(webp.PLANE) == 120
    assert webp.PLANE[:12] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2)]
    assert webp.PLANE[-3:] == [(-7, 7), (8, 6), (8, 7)]


def predict(mode, left, top, corner, right):
    average = lambda a, b: a + b >> 1
    clamp = lambda v: max(0, min(255, v))
    if mode == 11:
        p = [left[c] + top[c] - corner[c] for c in range(4)]
        return left if sum(abs(p[c] - left[c]) for c in range(4)) < sum(abs(p[c] - top[c]) for c in range(4)) else top
    out = []
    for c, (a, b, d, e) in enumerate(zip(left, top, corner, right, strict=True)):
        half = average(a, b) - d
        out.append((255 if c == 3 else 0, a, b, e, d, average(average(a, e), b), average(a, d), average(a, b), average(d, b), average(b, e), average(average(a, d), average(b, e)), 0, clamp(a + b - d),
                    clamp(average(a, b) + (half // 2 if half >= 0 else -(-half // 2))))[mode])
    return out


def test_predictor():
    width, height, step = 37, 30, 2
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (height, width, 4))
    across, down = -(-width // 4), -(-height // 4)
    modes = rng.integers(0, 14, (down, across))
    rest = np.zeros_like(pixels)
    for y in range(height):
        for x in range(width):
            if not y:
                guess = pixels[0, x - 1] if x else [0, 0, 0, 255]
            elif not x:
                guess = pixels[y - 1, 0]
            else:
                right = pixels[y - 1, x + 1] if x + 1 < width else pixels[y, 0]
                # channels in the order red, green, blue, alpha; the select mode sums over all of them
                guess = predict(int(modes[y >> step, x >> step]), *(list(map(int, v)) for v in (pixels[y, x - 1], pixels[y - 1, x], pixels[y - 1, x - 1], right)))
            rest[y, x] = (pixels[y, x] - np.array(guess)) & 255
    w = Writer()
    w.put(1, 1)
    w.put(0, 2)
    w.put(step - 2, 3)
    literal(w, (modes.reshape(-1) << 8).tolist())
    w.put(0, 1)
    literal(w, argb(rest), main=True)
    assert (webp.decode(wrap(w, width, height))[2] == pixels).all()


def test_cross_colour_and_subtract_green():
    width, height, step = 11, 9, 3
    rng = np.random.default_rng(2)
    pixels = rng.integers(0, 256, (height, width, 4))
    elements = rng.integers(0, 256, (2, 2, 3))  # green to red, green to blue, red to blue
    signed = lambda v: v - 256 if v > 127 else v
    rest = pixels.copy()
    for y in range(height):
        for x in range(width):
            e = [signed(int(v)) for v in elements[y >> step, x >> step]]
            r, g, b, _ = map(int, pixels[y, x])
            rest[y, x, 0] = r - (e[0] * signed(g) >> 5) & 255
            rest[y, x, 2] = b - (e[1] * signed(g) >> 5) - (e[2] * signed(r) >> 5) & 255
    final = rest.copy()
    final[:, :, 0] = rest[:, :, 0] - rest[:, :, 1] & 255
    final[:, :, 2] = rest[:, :, 2] - rest[:, :, 1] & 255
    w = Writer()
    w.put(1, 1)
    w.put(1, 2)
    w.put(step - 2, 3)
    literal(w, [int(e[2]) << 16 | int(e[1]) << 8 | int(e[0]) for e in elements.reshape(-1, 3)])
    w.put(1, 1)
    w.put(2, 2)
    w.put(0, 1)
    literal(w, argb(final), main=True)
    assert (webp.decode(wrap(w, width, height))[2] == pixels).all()


@pytest.mark.parametrize("colours", [2, 4, 13, 200])
def test_palette(colours):
    width, height = 10, 5
    rng = np.random.default_rng(colours)
    table = rng.integers(0, 256, (colours, 4))
    index = rng.integers(0, colours, (height, width))
    pack = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    across = width + (1 << pack) - 1 >> pack
    packed = np.zeros((height, across), np.int64)
    for y in range(height):
        for x in range(width):
            packed[y, x >> pack] |= int(index[y, x]) << (8 >> pack) * (x & (1 << pack) - 1)
    steps = table.copy()
    steps[1:] = table[1:] - table[:-1] & 255
    w = Writer()
    w.put(1, 1)
    w.put(3, 2)
    w.put(colours - 1, 8)
    literal(w, argb(steps))
    w.put(0, 1)
    literal(w, (packed.reshape(-1) << 8).tolist(), main=True)
    assert (webp.decode(wrap(w, width, height))[2] == table[index]).all()


def test_round_trips():
    rng = np.random.default_rng(9)
    for kinds in (1, 2, 3, 17, 129, 256):
        samples = rng.choice(rng.permutation(256)[:kinds], (20, 30, 4)).astype(np.uint8)
        assert (webp.decode(webp.encode(samples))[2] == samples).all()


def test_damaged_files():
    good = webp.encode(np.zeros((2, 2, 4), np.uint8) + np.arange(4, dtype=np.uint8))
    for bad in (b"", good[:10], b"x" * 40):
        with pytest.raises((ValueError, IndexError)):
            webp.decode(bad)


def test_extended_file():
    samples = np.random.default_rng(2).integers(0, 256, (3, 5, 4), np.uint8)
    plain = webp.encode(samples)
    chunk = b"VP8X" + (10).to_bytes(4, "little") + bytes([0x10, 0, 0, 0, 4, 0, 0, 2, 0, 0]) + b"ICCP" + (3).to_bytes(4, "little") + b"abc\0" + plain[12:]
    extended = b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk
    width, height, got, used = webp.decode(extended + b"next")
    assert (width, height, used) == (5, 3, len(extended)) and (got == samples).all()


def test_writer_uses_the_format(monkeypatch):
    """A text's image has a predictor, back-references, cache hits and codes of several lengths; a plain one has a palette."""
    seen = set()
    for name in ("inverse_predictor", "inverse_palette", "_cache_keys", "_distances"):
        def spy(*a, real=getattr(webp, name), name=name):
            seen.add(name)
            return real(*a)

        monkeypatch.setattr(webp, name, spy)
    rng = random.Random(4)
    words = ["the ", "storm ", "over ", "a quiet ", "harbour ", "lasts ", "until morning "]
    text = "".join(rng.choice(words) for _ in range(900)).encode()
    payload = np.frombuffer(text + b"\xff" * (-len(text) % 576), np.uint8).reshape(-1, 144, 4)
    file = webp.encode(payload)
    seen.clear()
    assert (webp.decode(file)[2] == payload).all() and seen == {"inverse_predictor", "_cache_keys", "_distances"}
    assert len(file) < 0.6 * payload.size
    seen.clear()
    blank = np.full((1, 144, 4), 255, np.uint8)
    assert (webp.decode(webp.encode(blank))[2] == blank).all() and "inverse_palette" in seen


@pytest.mark.parametrize("skew", [1, 3, 40])
def test_lengths_are_complete(skew):
    rng = np.random.default_rng(skew)
    for n in range(3, 300, 7):
        counts = np.floor(rng.random(n) ** skew * 1e6).astype(np.int64)
        lengths = webp._lengths(counts)
        used = lengths[lengths > 0]
        assert (lengths > 0).sum() == (counts > 0).sum() and used.max(initial=0) <= 15
        assert len(used) < 3 or (2.0 ** -used).sum() == 1
        webp.PrefixCode(lengths)
