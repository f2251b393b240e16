"""Lossless WebP (VP8L): a reader of the whole format and a writer.

The reader follows the public bitstream specification: prefix codes (simple and
normal, in groups chosen by an entropy image), back-references with the plane
distances, the colour cache, and the inverses of the predictor, cross-colour,
subtract-green and palette transforms; in a plain file or in an extended one.  Where one
group of codes serves the whole image, the length of the symbol that would begin at each bit
is looked up for all bits at once, and the image is the chain of symbols from the first bit;
references are pointers, followed for all pixels at once.  Images with several groups go symbol
by symbol.  Codes that were read before are known by their bits.

The writer uses the palette transform for images of at most 16 colours, else the predictor
(black, left or top); then back-references of three pixels or more, the colour cache where it
is hit, and prefix codes.  Palettes and the predictor's modes have codes by their counts; pixels
have one of three sets of codes, made by rules for prose, differences and anything: mode and
set are those that cost the image least.  Equal images give equal files.  An image has at most 16,384 rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Fixed values of the format.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
SIGNATURE = 0x2F
MOST_SIDE = 1 << 14
CACHE_FACTOR = 0x1E35A7BD
LONGEST = 15
BLACK = 0xFF000000
FARTHEST = (1 << 20) - 120
MOST_COPY = 4096

#: Short distance codes, as (dx, dy): nearer first, then smaller |dx|, then dx before -dx.
PLANE = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
#: Bits that the reader looks at in one go.
SEGMENT = 1 << 15

_REVERSED = np.array([int(f"{i:015b}"[::-1], 2) for i in range(1 << LONGEST)], np.int64)


_EIGHT = np.arange(8, dtype=np.uint64)


class Bits:
    """Bits of a buffer, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.size, self.at = data + bytes(32), 8 * len(data), 0
        self.eight = np.ndarray((len(data) + 24,), "<u8", self.data, strides=(1,))

    def peek(self) -> int:
        first = self.at >> 3
        return int.from_bytes(self.data[first:first + 8], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        value = self.peek() & (1 << n) - 1
        self.at += n
        if self.at > self.size:
            raise ValueError("the image ends early")
        return value

    def windows(self, n: int) -> np.ndarray:
        """The bits from each of the next n positions on, 57 at least; zeros beyond the end."""
        first = self.at >> 3
        rows = self.eight[first:((self.at + n - 1) >> 3) + 1]
        return (rows[:, None] >> _EIGHT).reshape(-1)[self.at & 7:(self.at & 7) + n]


class PrefixCode:
    """A canonical prefix code, from the length of each symbol's code."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        used = np.flatnonzero(lengths)
        if len(used) < 2:
            self.longest, self.symbol, self.length = 0, np.array([used[0] if len(used) else 0]), np.zeros(1, np.int64)
            self.packed = self.length + 32 * (self.symbol > 255)
            return
        used = used[np.argsort(lengths[used], kind="stable")]
        of = lengths[used]
        self.longest = longest = int(of[-1])
        share = 1 << longest - of
        if share.sum() != 1 << longest:
            raise ValueError("a prefix code is not complete")
        row = np.repeat(np.arange(len(used)), share)[_REVERSED[:1 << longest] if longest == LONGEST else _REVERSED[:1 << longest] >> LONGEST - longest]
        self.symbol, self.length = used[row], of[row]
        self.packed = self.length + 32 * (self.symbol > 255)

    def read(self, bits: Bits) -> int:
        at = bits.peek() & (1 << self.longest) - 1
        bits.at += int(self.length[at])
        if bits.at > bits.size:
            raise ValueError("the image ends early")
        return int(self.symbol[at])

    def look(self, windows: np.ndarray):
        """(symbol, length) at the beginning of each window."""
        at = windows.view(np.int64) & (1 << self.longest) - 1
        return self.symbol.take(at), self.length.take(at)


def read_code(bits: Bits, alphabet: int) -> PrefixCode:
    lengths = np.zeros(alphabet, np.int64)
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return PrefixCode(lengths)
    of = np.zeros(19, np.int64)
    for i in range(bits.read(4) + 4):
        of[CODE_ORDER[i]] = bits.read(3)
    code = PrefixCode(of)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, previous = 0, 8
    symbol_of, length_of, mask = code.symbol.tolist(), code.length.tolist(), (1 << code.longest) - 1
    while at < alphabet and left:
        left -= 1
        window = bits.peek()
        symbol, n = symbol_of[window & mask], length_of[window & mask]
        bits.at += n
        if symbol < 16:
            lengths[at] = symbol
            previous = symbol or previous
            at += 1
            continue
        window >>= n
        if symbol == 16:
            value, run, n = previous, 3 + (window & 3), 2
        elif symbol == 17:
            value, run, n = 0, 3 + (window & 7), 3
        else:
            value, run, n = 0, 11 + (window & 127), 7
        bits.at += n
        if at + run > alphabet:
            raise ValueError("too many code lengths")
        lengths[at:at + run] = value
        at += run
    if bits.at > bits.size:
        raise ValueError("the image ends early")
    return PrefixCode(lengths)


_KNOWN: dict[int, list[tuple[int, int, list[PrefixCode]]]] = {}


def read_group(bits: Bits, cache_size: int) -> list[PrefixCode]:
    """The five codes of a group; the last 16 groups of each size are known by their bits."""
    first, shift = bits.at >> 3, bits.at & 7
    window = int.from_bytes(bits.data[first:first + 1024], "little") >> shift
    known = _KNOWN.setdefault(cache_size, [])
    for n, value, codes in known:
        if window & (1 << n) - 1 == value and bits.at + n <= bits.size:
            bits.at += n
            return codes
    begin = bits.at
    codes = [read_code(bits, n) for n in (256 + 24 + cache_size, 256, 256, 256, 40)]
    for i, j in ((2, 1), (3, 1), (3, 2)):  # equal codes are one object
        if np.array_equal(codes[i].symbol, codes[j].symbol) and np.array_equal(codes[i].length, codes[j].length):
            codes[i] = codes[j]
    if (n := bits.at - begin) < 8000:
        known.append((n, window & (1 << n) - 1, codes))
        del known[:-16]
    return codes


def _extra(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    more = symbol - 2 >> 1
    return (2 + (symbol & 1) << more) + bits.read(more) + 1


def _values(symbol: np.ndarray, windows: np.ndarray):
    """(value, extra bits) of length or distance symbols, the extra bits first in the windows."""
    more = np.where(symbol < 4, 0, symbol - 2 >> 1)
    extra = (windows & ((np.uint64(1) << more.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
    return np.where(symbol < 4, symbol + 1, (2 + (symbol & 1) << more) + extra + 1), more


def _distances(code: np.ndarray, width: int) -> np.ndarray:
    near = np.array([max(1, x + y * width) for x, y in PLANE])
    return np.where(code > 120, code - 120, near[np.minimum(code, 120) - 1])


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB values of an entropy-coded image, row by row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    cache_size = 1 << cache_bits if cache_bits else 0
    groups_of, step, groups = None, 0, 1
    if main and bits.read(1):
        step = bits.read(3) + 2
        across = (width + (1 << step) - 1) >> step
        groups_of = (read_pixels(bits, across, (height + (1 << step) - 1) >> step, False) >> 8 & 0xFFFF).reshape(-1, across)
        groups = int(groups_of.max()) + 1
    codes = [read_group(bits, cache_size) for _ in range(groups)]
    if groups == 1:
        return _by_chain(bits, codes[0], width, width * height, cache_bits)
    return _by_symbol(bits, codes, groups_of, step, width, width * height, cache_bits)


def _cache_keys(argb: np.ndarray, cache_bits: int) -> np.ndarray:
    return (argb * np.uint32(CACHE_FACTOR) >> np.uint32(32 - cache_bits)).astype(np.int64)


def _chain(step: memoryview, n: int, most: int, moves: bool) -> np.ndarray:
    """The places met from the first on, up to n; at most `most` of them where a step may stand still."""
    tokens, q = [], 0
    add = tokens.append
    if moves:
        while q < n:
            add(q)
            q = step[q]
    else:
        while q < n and len(tokens) < most:
            add(q)
            q = step[q]
    return np.array(tokens)


def _by_chain(bits: Bits, codes: list[PrefixCode], width: int, total: int, cache_bits: int) -> np.ndarray:
    """The pixels of an image with one group of codes."""
    if not any(c.longest for c in codes[:4]) and codes[0].symbol[0] < 256:  # one colour, no bits
        argb = sum(int(c.symbol[0]) << shift for c, shift in zip(codes, (8, 16, 0, 24), strict=False))
        return np.full(total, argb, np.uint32)
    out, at = np.zeros(total, np.uint32), 0
    copies_of, cached = [], []  # (place, length, distance); (places, indexes)
    while at < total:
        n = min(SEGMENT, bits.size - bits.at + 1)
        if n < 1:
            raise ValueError("the image ends early")
        windows = bits.windows(n + 64)
        low = windows.view(np.int64)
        green = codes[0].packed.take(low[:n] & (1 << codes[0].longest) - 1)
        after = np.arange(n) + (green & 31)
        far = np.flatnonzero(green & 32)
        jump, last, wide = after, None, None
        for code in codes[1:4]:
            if code is not last:
                wide, last = code.length.take(low & (1 << code.longest) - 1), code
            jump = jump + wide.take(jump)
        advance = None
        if len(far):
            jump[far] = after[far]
            symbol, _ = codes[0].look(windows[far])
            copy = symbol < 280
            copies, spot = far[copy], after[far[copy]]
            length, more = _values(symbol[copy] - 256, windows[spot])
            spot = spot + more
            found, wide = codes[4].look(windows[spot])
            spot += wide
            distance, more = _values(found, windows[spot])
            jump[copies] = spot + more
            if len(copies):
                advance, distances = np.ones(n, np.int64), np.zeros(n, np.int64)
                advance[copies], distances[copies] = length, _distances(distance, width)
        tokens = _chain(memoryview(jump), n, total - at, codes[0].longest > 0)
        took = np.ones(len(tokens), np.int64) if advance is None else advance.take(tokens)
        ends = np.cumsum(took)
        if len(ends) > (keep := int(np.searchsorted(ends, total - at)) + 1):  # what follows is no pixel
            tokens, took, ends = tokens[:keep], took[:keep], ends[:keep]
        if ends[-1] > total - at:
            raise ValueError("a back-reference leaves the image")
        bits.at += int(jump[tokens[-1]])
        if bits.at > bits.size:
            raise ValueError("the image ends early")
        places = at + ends - took
        symbol, wide = codes[0].look(windows.take(tokens))
        plain = symbol < 256
        spot = after.take(tokens[plain])
        value = symbol[plain].astype(np.uint32) << np.uint32(8)
        for code, shift in zip(codes[1:4], (16, 0, 24), strict=True):
            channel, wide = code.look(windows.take(spot))
            value |= channel.astype(np.uint32) << np.uint32(shift)
            spot += wide
        out[places[plain]] = value
        if advance is not None:
            some = np.flatnonzero(~plain & (symbol < 280))
            copies_of += zip(places[some].tolist(), took[some].tolist(), distances[tokens[some]].tolist(), strict=True)
        held = symbol >= 280
        if held.any():
            cached.append((places[held], symbol[held] - 280))
        at += int(ends[-1])
    if copies_of or cached:
        _resolve(out, copies_of, cached, cache_bits)
    return out


def _resolve(out: np.ndarray, copies: list[tuple[int, int, int]], cached: list, cache_bits: int) -> None:
    """Fills in what copies and cache hits stand for: each such pixel points to an earlier one, up to a literal.

    A pixel that came from the cache has its index as key, a copied one its source's key, so
    the pixel that a hit means is the last one before it with its key.
    """
    source = np.arange(len(out))
    keys = _cache_keys(out, cache_bits) if cached else None
    for places, index in cached:
        keys[places] = index
    for place, length, distance in copies:
        if distance > place:
            raise ValueError("a back-reference leaves the image")
        source[place:place + length] -= distance
        if cached:
            keys[place:place + length] = keys[place - distance:place - distance + length] if distance >= length else np.resize(keys[place - distance:place], length)
    if cached:
        order = np.argsort(keys.astype(np.uint16), kind="stable")
        before = np.full(len(out), -1)
        before[order[1:]] = np.where(keys[order[1:]] == keys[order[:-1]], order[:-1], -1)
        hits = np.concatenate([places for places, _ in cached])
        source[hits] = before[hits]
    empty = source < 0  # a cache slot that holds nothing yet is 0
    source[empty] = np.flatnonzero(empty)
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    out[:] = out[source]


def _by_symbol(bits: Bits, codes, groups_of: np.ndarray, step: int, width: int, total: int, cache_bits: int) -> np.ndarray:
    """The pixels of an image whose codes change from tile to tile."""
    cache = [0] * (1 << cache_bits)
    out, at = np.zeros(total, np.uint32), 0
    while at < total:
        group = codes[int(groups_of[at // width >> step, at % width >> step])]
        symbol = group[0].read(bits)
        if symbol < 256:
            red, blue, alpha = (c.read(bits) for c in group[1:4])
            run = [alpha << 24 | red << 16 | symbol << 8 | blue]
            out[at] = run[0]
            at += 1
        elif symbol < 280:
            length, code = _extra(bits, symbol - 256), _extra(bits, group[4].read(bits))
            distance = code - 120 if code > 120 else max(1, PLANE[code - 1][0] + PLANE[code - 1][1] * width)
            if distance > at or at + length > total:
                raise ValueError("a back-reference leaves the image")
            for i in range(at, at + length):
                out[i] = out[i - distance]
            run = out[at:at + length].tolist()
            at += length
        else:
            out[at] = cache[symbol - 280]
            run = [cache[symbol - 280]]
            at += 1
        if cache_bits:
            for argb in run:
                cache[(CACHE_FACTOR * argb & 0xFFFFFFFF) >> 32 - cache_bits] = argb
    return out


def _bytes(pixels: np.ndarray) -> np.ndarray:
    """Channels blue, green, red, alpha of ARGB values."""
    return pixels.astype("<u4").view(np.uint8).reshape(-1, 4)


def inverse_subtract_green(pixels: np.ndarray) -> np.ndarray:
    channels = _bytes(pixels).copy()
    channels[:, 0] += channels[:, 1]
    channels[:, 2] += channels[:, 1]
    return channels.view("<u4").reshape(-1)


def inverse_cross_colour(pixels: np.ndarray, width: int, elements: np.ndarray, step: int) -> np.ndarray:
    channels = _bytes(pixels).copy()
    across = (width + (1 << step) - 1) >> step
    at = np.arange(len(pixels))
    element = _bytes(elements)[(at // width >> step) * across + (at % width >> step)].view(np.int8).astype(np.int64)
    green = channels[:, 1].view(np.int8).astype(np.int64)
    red = channels[:, 2].astype(np.int64) + (element[:, 0] * green >> 5)
    channels[:, 2] = red & 0xFF
    blue = channels[:, 0].astype(np.int64) + (element[:, 1] * green >> 5) + (element[:, 2] * channels[:, 2].view(np.int8).astype(np.int64) >> 5)
    channels[:, 0] = blue & 0xFF
    return channels.view("<u4").reshape(-1)


def inverse_palette(pixels: np.ndarray, width: int, colours: np.ndarray, pack: int) -> np.ndarray:
    """Indexes, 2**pack of them in a pixel's green, to colours; `width` is the unpacked one."""
    across = (width + (1 << pack) - 1) >> pack
    green = (pixels >> 8 & 0xFF).reshape(-1, across)
    x = np.arange(width)
    size = 8 >> pack
    index = green[:, x >> pack] >> (size * (x & (1 << pack) - 1)).astype(np.uint32) & (1 << size) - 1
    table = np.zeros(256, np.uint32)
    table[:len(colours)] = colours
    return table[index].reshape(-1)


def _average(a, b):
    return (a + b) >> 1


def _clamp(x):
    return np.clip(x, 0, 255)


def _predict(mode: int, left, top, top_left, top_right):
    if mode == 0 or mode > 13:
        return np.array([0, 0, 0, 255])
    if mode < 5:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode < 10:
        return _average(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    if mode == 11:
        return left if np.abs(top - top_left).sum() < np.abs(left - top_left).sum() else top
    if mode == 12:
        return _clamp(left + top - top_left)
    middle = _average(left, top)
    half = middle - top_left
    return _clamp(middle + np.sign(half) * (np.abs(half) >> 1))


def _one_mode(rest: np.ndarray, mode: int) -> np.ndarray:
    """The whole image predicted by black, left or top: sums along its rows and columns."""
    out = rest.copy()
    out[0, 0, 3] += 255
    out[0] = np.cumsum(out[0], axis=0)
    if mode == 2:
        out = np.cumsum(out, axis=0)
    else:
        out[:, 0] = np.cumsum(out[:, 0], axis=0)
        if mode:
            out[1:] = np.cumsum(out[1:], axis=1)
        else:
            out[1:, 1:, 3] += 255
    return np.ascontiguousarray((out & 0xFF).astype(np.uint8)).view("<u4").reshape(-1)


def inverse_predictor(pixels: np.ndarray, width: int, modes: np.ndarray, step: int) -> np.ndarray:
    """Adds to each pixel what its decoded neighbours predict."""
    rest = _bytes(pixels).reshape(-1, width, 4).astype(np.int64)
    out = np.zeros_like(rest)
    across = (width + (1 << step) - 1) >> step
    mode_of = (modes >> 8 & 0xFF).reshape(-1, across)
    if (mode_of == mode_of[0, 0]).all() and mode_of[0, 0] < 3:
        return _one_mode(rest, int(mode_of[0, 0]))
    for y in range(len(rest)):
        for x in range(width):
            if not y:
                guess = out[0, x - 1] if x else np.array([0, 0, 0, 255])
            elif not x:
                guess = out[y - 1, 0]
            else:
                corner = out[y - 1, x + 1] if x + 1 < width else out[y, 0]
                guess = _predict(int(mode_of[y >> step, x >> step]), out[y, x - 1], out[y - 1, x], out[y - 1, x - 1], corner)
            out[y, x] = rest[y, x] + guess & 0xFF
    return np.ascontiguousarray(out.astype(np.uint8)).view("<u4").reshape(-1)


def decode(data: bytes) -> tuple[int, int, np.ndarray, int]:
    """(width, height, RGBA samples as height x width x 4, bytes of the file) of the file that `data` starts with."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    whole, at = 8 + int.from_bytes(data[4:8], "little"), 12
    while data[at:at + 4] != b"VP8L":  # an extended file holds other chunks as well
        if at + 8 > min(whole, len(data)) or data[at:at + 4] == b"VP8 ":
            raise ValueError("no lossless image")
        size = int.from_bytes(data[at + 4:at + 8], "little")
        at += 8 + size + (size & 1)
    if data[at + 8:at + 9] != bytes([SIGNATURE]):
        raise ValueError("not a lossless image")
    bits = Bits(data[at + 9:at + 8 + int.from_bytes(data[at + 4:at + 8], "little")])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    opaque = not bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, wide, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (0, 1):
            step = bits.read(3) + 2
            side = ((wide + (1 << step) - 1) >> step, (height + (1 << step) - 1) >> step)
            undo.append(((inverse_predictor, inverse_cross_colour)[kind], (wide, read_pixels(bits, *side, False), step)))
        elif kind == 2:
            undo.append((inverse_subtract_green, ()))
        else:
            n = bits.read(8) + 1
            steps = _bytes(read_pixels(bits, n, 1, False)).astype(np.int64)
            colours = np.ascontiguousarray((np.cumsum(steps, axis=0) & 0xFF).astype(np.uint8)).view("<u4").reshape(-1)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((inverse_palette, (wide, colours, pack)))
            wide = (wide + (1 << pack) - 1) >> pack
    pixels = read_pixels(bits, wide, height, True)
    for function, more in reversed(undo):
        pixels = function(pixels, *more)
    samples = _bytes(pixels).reshape(height, width, 4)[:, :, [2, 1, 0, 3]]
    if opaque:
        samples[:, :, 3] = 255
    return width, height, samples, whole + (whole & 1)


def _forward(argb: np.ndarray, width: int, mode: int) -> np.ndarray:
    """What the predictor leaves of an image: channels blue, green, red, alpha."""
    rows = _bytes(argb).reshape(-1, width, 4)
    out = rows.copy()
    out[0, 0, 3] += np.uint8(1)  # less 255
    out[0, 1:] -= rows[0, :-1]
    out[1:, 0] -= rows[:-1, 0]
    if mode == 0:
        out[1:, 1:, 3] += np.uint8(1)
    else:
        out[1:, 1:] -= rows[1:, :-1] if mode == 1 else rows[:-1, 1:]
    return out.reshape(-1, 4)


def _lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a complete prefix code of at most 15 bits: by each symbol's share, then shortened until nothing is left over."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 3:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(-counts[used], kind="stable")]
    share = np.maximum(counts[used], counts.sum() / (1 << LONGEST - 1))
    of = np.ceil(np.log2(share.sum() / share)).astype(np.int64)
    left = (1 << LONGEST) - int((1 << LONGEST - of).sum())
    while left:  # the shortest code that can lose a bit; ties go to the more frequent symbol
        at = int(np.argmax(of >= LONGEST + 1 - left.bit_length()))
        left -= 1 << LONGEST - int(of[at])
        of[at] -= 1
        if at and of[at] < of[at - 1]:  # stay in order
            to = int(np.searchsorted(of[:at], of[at], "right"))
            of[to], of[at] = of[at], of[to]
    lengths[used] = of
    return lengths


def _codes(lengths: np.ndarray) -> np.ndarray:
    """Each symbol's code, first bit lowest; a lone symbol's takes no bits."""
    out = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if len(used) > 1:
        used = used[np.argsort(lengths[used], kind="stable")]
        share = 1 << LONGEST - lengths[used]
        out[used] = _REVERSED[np.cumsum(share) - share]
    return out


# The code of code lengths: five bits for four rare lengths, four bits for others; 16 is not used.
_OF = np.array([5 if n in (1, 2, 14, 15) else 0 if n == 16 else 4 for n in range(19)])
_OF_CODES = _codes(_OF).tolist()
_OF_HEADER = [(0, 1), (15, 4), *((int(_OF[n]), 3) for n in CODE_ORDER), (0, 1)]


def _code_header(lengths: np.ndarray) -> list[tuple[int, int]]:
    """(value, bits) pairs that tell a code."""
    used = np.flatnonzero(lengths).tolist()
    if not used:
        return [(1, 4)]
    if len(used) <= 2 and used[-1] < 256:
        return [(1, 1), (len(used) - 1, 1), (1, 1), *((x, 8) for x in used)]
    out, at = list(_OF_HEADER), 0
    of, wide = lengths.tolist(), _OF.tolist()
    for symbol in [*used, len(of)]:
        gap = symbol - at
        while gap > 10:
            run = min(gap, 138)
            out += ((_OF_CODES[18], wide[18]), (run - 11, 7))
            gap -= run
        if gap > 2:
            out += ((_OF_CODES[17], wide[17]), (gap - 3, 3))
            gap = 0
        out += [(_OF_CODES[0], wide[0])] * gap
        if symbol < len(of):
            out.append((_OF_CODES[of[symbol]], wide[of[symbol]]))
        at = symbol + 1
    return out


def _shares() -> list[np.ndarray]:
    """How often each byte is expected: in prose, among differences, anywhere."""
    often = " enisratdhulcgombfpkvwz.,\n"
    rank = np.full(256, 90.0)
    rank[0x80:0xC0] = 45
    rank[0x20:0x7F] = 55
    rank[[0xC3, 0xFF]] = 22, 30
    rank[np.frombuffer(often.encode(), np.uint8)] = np.arange(len(often))
    prose, near = 1 / (rank + 1.5), 1 / (4.0 + np.abs(np.arange(256, dtype=np.uint8).view(np.int8).astype(float)))
    prose, near = prose / prose.sum(), near / near.sum()
    return [0.8 * prose + 0.2 * near, near, np.full(256, 1 / 256)]


_SHARES = _shares()
_SETS: dict[tuple[int, int], tuple] = {}


def _code_set(kind: int, cache_bits: int) -> tuple:
    """(codes, lengths, header) of one of the sets, for green, red, blue, alpha and distances."""
    if (kind, cache_bits) not in _SETS:
        share, size = _SHARES[kind], 1 << cache_bits if cache_bits else 0
        more = [0.04 / 24 * np.linspace(1.8, 0.2, 24), *([np.full(size, 0.08 / size)] if size else [])]
        alpha = np.roll(share, 1) if kind == 0 else share  # black leaves one more than the byte
        lengths = [_lengths(x * 1e9) for x in (np.concatenate((0.88 * share, *more)), share, share, alpha, np.linspace(0.2, 1.8, 40))]
        _SETS[kind, cache_bits] = [_codes(x) for x in lengths], lengths, np.array([pair for x in lengths for pair in _code_header(x)])
    return _SETS[kind, cache_bits]


def _costs() -> np.ndarray:
    """Bits of each byte of the four channels (blue, green, red, alpha) in each set."""
    out = []
    for kind in range(len(_SHARES)):
        _, (green, red, blue, alpha, _), _ = _code_set(kind, 0)
        out.append(np.concatenate((blue, green[:256], red, alpha)))
    return np.array(out)


def _matches(argb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, distance) of copies of three pixels or more from the nearest earlier place, first come first served."""
    n = len(argb)
    found: list[tuple[int, int, int]] = []
    if n > 5:
        key = argb.astype(np.uint64)
        key = (key[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ key[1:-1] * np.uint64(0xBF58476D1CE4E5B9)) + key[2:] * np.uint64(0x94D049BB133111EB)
        order = np.argsort((key >> np.uint64(48)).astype(np.uint16) if n < 4096 else key, kind="stable")  # short sorts by digits
        same = key[order[1:]] == key[order[:-1]]
        later, earlier = order[1:][same], order[:-1][same]
        keep = (later - earlier <= FARTHEST) & (argb[later] == argb[earlier]) & (argb[later + 1] == argb[earlier + 1]) & (argb[later + 2] == argb[earlier + 2])
        later, earlier = later[keep], earlier[keep]
        by = np.argsort(later)
        at = 0
        for place, source in zip(later[by].tolist(), earlier[by].tolist(), strict=True):
            if place < at:
                continue
            step = 64
            length = 3
            while True:
                end = min(n, place + min(length + step, MOST_COPY))
                differ = argb[place + length:end] != argb[source + length:source + end - place]
                first = int(differ.argmax()) if differ.any() else len(differ)
                length += first
                if first < len(differ) or place + length >= n or length >= MOST_COPY:
                    break
                step *= 4
            found.append((place, length, place - source))
            at = place + length
    return tuple(np.array([x[i] for x in found], np.int64) for i in range(3))


def _prefixed(value: np.ndarray):
    """(symbol, extra value, extra bits) of lengths or distance codes."""
    less = value - 1
    top = np.frexp(np.maximum(less, 1).astype(np.float64))[1] - 1
    more = np.where(value <= 4, 0, top - 1)
    symbol = np.where(value <= 4, less, 2 * top + (less >> np.maximum(top - 1, 0) & 1))
    return symbol, np.where(value <= 4, 0, less & (1 << more) - 1), more


@lru_cache(64)
def _short_codes(width: int) -> dict[int, int]:
    """Distances that have a short code."""
    short: dict[int, int] = {}
    for i, (x, y) in enumerate(PLANE):
        short.setdefault(max(1, x + y * width), i + 1)
    return short


def _near_codes(distance: np.ndarray, width: int) -> np.ndarray:
    """The code of each distance: a short one where the plane has it."""
    short = _short_codes(width)
    return np.array([short.get(d, d + 120) for d in distance.tolist()], np.int64)


def _written(argb: np.ndarray, width: int, main: bool, kind: int | None = None):
    """(values, bits) of an entropy-coded image, with a set of codes or, without `kind`, codes by counts."""
    n = len(argb)
    if (argb == argb[0]).all():  # five codes of one symbol, no bits for pixels
        one = [int(argb[0]) >> shift & 0xFF for shift in (8, 16, 0, 24)]
        head = np.array([(0, 1), *([(0, 1)] if main else []), *((5 | v << 3, 11) for v in (*one, 0))])
        return head[:, 0], head[:, 1]
    place, length, distance = _matches(argb)
    covered = np.zeros(n, bool)
    if len(place):
        step = np.zeros(n + 1, np.int64)
        step[place] += 1
        np.add.at(step, place + length, -1)
        covered = np.cumsum(step)[:n] > 0
    cache_bits = min(8, max(1, n.bit_length() - 3)) if n > 15 else 0
    hit = np.zeros(n, bool)
    if cache_bits:
        keys = _cache_keys(argb, cache_bits)
        order = np.argsort(keys.astype(np.uint16), kind="stable")
        hit[order[1:]] = (keys[order[1:]] == keys[order[:-1]]) & (argb[order[1:]] == argb[order[:-1]])
        hit &= ~covered
        if not hit.any():
            cache_bits = 0
    plain = ~(covered | hit)
    channels = _bytes(argb).astype(np.int64)
    green = np.where(plain, channels[:, 1], -1)
    if cache_bits:
        green[hit] = 280 + keys[hit]
    if len(place):
        long, long_extra, long_bits = _prefixed(length)
        far, far_extra, far_bits = _prefixed(_near_codes(distance, width))
        green[place] = 256 + long
    else:
        far = place
    head, more_head = [(1, 1), (cache_bits, 4)] if cache_bits else [(0, 1)], np.zeros((0, 2), np.int64)
    if main:
        head.append((0, 1))
    if kind is None:
        counts = [np.bincount(green[green >= 0], minlength=280 + (1 << cache_bits if cache_bits else 0)),
                  *(np.bincount(channels[plain, c], minlength=256) for c in (2, 0, 3)), np.bincount(far, minlength=40)]
        lengths = [_lengths(c) for c in counts]
        codes = [_codes(x) for x in lengths]
        for x in lengths:
            head += _code_header(x)
        lengths = [x if np.count_nonzero(x) > 1 else np.zeros_like(x) for x in lengths]
    else:
        codes, lengths, more_head = _code_set(kind, cache_bits)
    token = np.flatnonzero(green >= 0)
    values, bits = codes[0][green[token]], lengths[0][green[token]]
    which = plain[token]
    at = token[which]
    value, wide = values[which], bits[which]
    for code, of, c in zip(codes[1:4], lengths[1:4], (2, 0, 3), strict=True):
        channel = channels[at, c]
        value |= code[channel] << wide
        wide += of[channel]
    values[which], bits[which] = value, wide
    if len(place):
        which = np.searchsorted(token, place)
        for value, more in ((long_extra, long_bits), (codes[4][far], lengths[4][far]), (far_extra, far_bits)):
            values[which] |= value << bits[which]
            bits[which] += more
    head = np.concatenate((np.array(head), more_head))
    return np.concatenate((head[:, 0], values)), np.concatenate((head[:, 1], bits))


def _packed(values: np.ndarray, bits: np.ndarray) -> bytes:
    """The values' bits, one after the other; a slice of the values at a time, as bits are many."""
    out = []
    for at in range(0, len(values), 1 << 15):
        value, wide = values[at:at + (1 << 15)], bits[at:at + (1 << 15)]
        shift = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)
        out.append((np.repeat(value, wide) >> shift & 1).astype(np.uint8))
    return np.packbits(np.concatenate(out), bitorder="little").tobytes()


_CHANNELS = np.arange(0, 1024, 256)
_COSTS = _costs()


def encode(samples: np.ndarray) -> bytes:
    """A file of RGBA samples (height x width x 4), lossless."""
    height, width = samples.shape[:2]
    if max(height, width) > MOST_SIDE:
        raise ValueError("an image has at most 16,384 rows and columns")
    argb = np.ascontiguousarray(samples[:, :, [2, 1, 0, 3]]).view("<u4").reshape(-1)
    parts = [(np.array([width - 1, height - 1, 1, 0]), np.array([14, 14, 1, 3]))]
    some = set(argb[:64].tolist())
    colours = np.unique(argb) if len(some) <= 16 else argb[:17]
    kind = None
    if len(colours) <= 16:
        pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1
        parts.append((np.array([1, 3, len(colours) - 1]), np.array([1, 2, 8])))
        steps = np.diff(_bytes(colours).astype(np.uint8), axis=0, prepend=np.zeros((1, 4), np.uint8))
        parts.append(_written(np.ascontiguousarray(steps).view("<u4").reshape(-1), len(colours), False))
        across = (width + (1 << pack) - 1) >> pack
        index = np.zeros((height, across << pack), np.uint32)
        index[:, :width] = np.searchsorted(colours, argb).reshape(height, width)
        shifts = (8 >> pack) * np.arange(1 << pack, dtype=np.uint32) + np.uint32(8)
        pixels, wide = (index.reshape(height, across, -1) << shifts).sum(axis=2, dtype=np.uint32).reshape(-1), across
    else:
        rests = [_forward(argb, width, mode) for mode in (0, 1, 2)]
        counts = np.array([np.bincount((x + _CHANNELS).reshape(-1), minlength=1024) for x in rests])
        mode, kind = divmod(int(np.argmin(counts @ _COSTS.T)), len(_SHARES))
        tiles = ((width + 511) >> 9) * ((height + 511) >> 9)
        parts.append((np.array([1, 0, 7]), np.array([1, 2, 3])))
        parts.append(_written(np.full(tiles, BLACK | mode << 8, np.uint32), (width + 511) >> 9, False))
        pixels, wide = np.ascontiguousarray(rests[mode]).view("<u4").reshape(-1), width
    parts.append((np.array([0]), np.array([1])))
    parts.append(_written(pixels, wide, True, kind))
    data = bytes([SIGNATURE]) + _packed(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))
    odd = b"\0" * (len(data) & 1)
    return b"RIFF" + (12 + len(data) + len(odd)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data + odd
