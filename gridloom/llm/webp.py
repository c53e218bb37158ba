"""Lossless WebP (VP8L): a decoder for all of the format, a writer for payloads, and media columns.

``decode`` reads prefix codes, back-references and the colour cache and inverts
the predictor, cross-colour, subtract-green and palette transforms.  Images of
equal codes are decoded together: one numpy step gives the next pixel, be it a
literal, a copy or an entry of the cache, of every image of a batch.

``write_payloads`` chooses by content, for each payload the form with the fewest
bits: literals of text, copies with a colour cache, a palette, a predictor, or
subtracted green.
"""

import functools
import hashlib
import heapq
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 192  # payloads are padded to a multiple of this
MOST_SIDE = 1 << 14
BATCH_BYTES = 4 << 20
SHORT_CODE = 14  # longest code of the writer
WINDOW = 57  # bits that a 64-bit read holds wherever it starts
CACHE_BITS = 8  # of the writer's colour cache
FARTHEST = (1 << 20) - 120  # distance of a copy
LONGEST = 4096  # pixels of a copy
ALONE_STEP, STEP = 10, 65  # about the microseconds of a pixel read alone, and of a step over many images
# Fixed values of the format: order of code-length codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# Fixed values of the format: (columns to the left, rows up) of the 120 short distance codes.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class Bits:
    """Reader of a little-endian bit stream; beyond its end it reads zeros."""

    def __init__(self, data, at=0):
        self.data, self.at = data, at

    def peek(self, n):
        a = self.at >> 3
        return int.from_bytes(self.data[a : a + (n + 14 >> 3)], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n):
        out = self.peek(n)
        self.at += n
        return out


def canonical(lengths):
    """Codes of a canonical prefix code, first bit lowest: {symbol: (code, length)}."""
    code, out = 0, {}
    for n in range(1, max(lengths, default=0) + 1):
        for s, k in enumerate(lengths):
            if k == n:
                out[s] = int(f"{code:0{n}b}"[::-1], 2), n
                code += 1
        code <<= 1
    return out


class PrefixCode:
    """Lookup table of a prefix code: entry = symbol * 16 + length."""

    def __init__(self, lengths):
        used = [s for s, n in enumerate(lengths) if n]
        self.lengths, self.bits = list(lengths), max(lengths) if len(used) > 1 else 0
        self.table = np.zeros(1 << self.bits, dtype=np.int64)
        if len(used) > 1:
            filled = 0
            for s, (c, n) in canonical(lengths).items():
                self.table[c :: 1 << n] = s * 16 + n
                filled += 1 << self.bits - n
            if filled != 1 << self.bits:
                raise ValueError("prefix code is not complete")
        elif used:
            self.table[0] = used[0] * 16
        self.entries = self.table.tolist()

    def read(self, bits):
        e = self.entries[bits.peek(self.bits)] if self.bits else self.entries[0]
        bits.at += e & 15
        return e >> 4


@functools.lru_cache(maxsize=512)
def _prefix_code(lengths):
    return PrefixCode(lengths)


_KNOWN = {}  # codes by alphabet, bit count and bits: images of one form share theirs


def _read_code(bits, size):
    if bits.peek(1):
        return _parse_code(bits, size)
    known = _KNOWN.setdefault(size, {})
    for n, codes in known.items():
        if (got := codes.get(bits.peek(n))) is not None:
            bits.at += n
            return got
    start = bits.at
    code = _parse_code(bits, size)
    n, bits.at = bits.at - start, start
    if n <= 512:
        if sum(map(len, known.values())) > 16:
            known.clear()
        known.setdefault(n, {})[bits.peek(n)] = code
    bits.at += n
    return code


def _parse_code(bits, size):
    if bits.read(1):
        n, wide = bits.read(1) + 1, bits.read(1)
        lengths = [0] * max(size, 256)
        lengths[bits.read(8 if wide else 1)] = 1
        if n == 2:
            lengths[bits.read(8)] = 1
        return _prefix_code(tuple(lengths))
    own = [0] * 19
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        own[k] = bits.read(3)
    code, lengths, last = _prefix_code(tuple(own)), [], 8
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    while len(lengths) < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths.append(s)
            last = s or last
        elif s == 16:
            lengths += [last] * (3 + bits.read(2))
        else:
            lengths += [0] * (3 + bits.read(3) if s == 17 else 11 + bits.read(7))
    if len(lengths) > size:
        raise ValueError("code lengths beyond the alphabet")
    return _prefix_code(tuple(lengths + [0] * (size - len(lengths))))


def _span(bits, prefix):
    """Value of a length or distance prefix."""
    if prefix < 4:
        return prefix + 1
    extra = prefix - 2 >> 1
    return (2 + (prefix & 1) << extra) + bits.read(extra) + 1


def _codes(bits, w, h, main):
    """Colour-cache bits, block bits and the group of each block, and the groups of five codes."""
    cache = bits.read(4) if bits.read(1) else 0
    block, groups_at, count = 0, None, 1
    if main and bits.read(1):
        block = bits.read(3) + 2
        groups_at = _pixels(bits, (w + (1 << block) - 1) >> block, (h + (1 << block) - 1) >> block) >> 8 & 0xFFFF
        count = int(groups_at.max()) + 1
    sizes = (256 + 24 + (1 << cache if cache else 0), 256, 256, 256, 40)
    return cache, block, groups_at, [[_read_code(bits, n) for n in sizes] for _ in range(count)]


def _pixels(bits, w, h, main=False):
    """ARGB numbers (h, w) of an entropy-coded image."""
    return _stream(bits, w, h, *_codes(bits, w, h, main))


def _stream(bits, w, h, cache, block, groups_at, groups):
    out, n, i = [0] * (w * h), w * h, 0
    kept, shift = [0] * (1 << cache), 32 - cache
    green, red, blue, alpha, far = groups[0]
    while i < n:
        if groups_at is not None:
            green, red, blue, alpha, far = groups[groups_at[i // w >> block, i % w >> block]]
        s = green.read(bits)
        if s < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            new = (a << 24 | r << 16 | s << 8 | b,)
        elif s < 280:
            length, d = _span(bits, s - 256), _span(bits, far.read(bits))
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * w)
            if d > i:
                raise ValueError("back-reference before the first pixel")
            length = min(length, n - i)
            piece = out[max(0, i - d) : i - d + length if length < d else i]
            new = (piece * (length // len(piece) + 1))[:length]
        else:
            new = (kept[s - 280],)
        out[i : i + len(new)] = new
        i += len(new)
        if cache:
            for p in new:
                kept[(p * 0x1E35A7BD & 0xFFFFFFFF) >> shift] = p
    return np.array(out, dtype=np.int64).reshape(h, w)


def _channels(argb):
    return np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255, argb >> 24 & 255], axis=-1)


def _average(a, b):
    return a + b >> 1


def _clamp(x):
    return np.clip(x, 0, 255)


def _select(l, t, tl):
    toward_left, toward_top = np.abs(t - tl).sum(), np.abs(l - tl).sum()  # of l + t - tl from l and from t
    return l if toward_left < toward_top else t


#: Predictions from the left, top, top-left and top-right pixel.
PREDICT = (
    lambda l, t, tl, tr: np.array([0, 0, 0, 255]),
    lambda l, t, tl, tr: l,
    lambda l, t, tl, tr: t,
    lambda l, t, tl, tr: tr,
    lambda l, t, tl, tr: tl,
    lambda l, t, tl, tr: _average(_average(l, tr), t),
    lambda l, t, tl, tr: _average(l, tl),
    lambda l, t, tl, tr: _average(l, t),
    lambda l, t, tl, tr: _average(tl, t),
    lambda l, t, tl, tr: _average(t, tr),
    lambda l, t, tl, tr: _average(_average(l, tl), _average(t, tr)),
    lambda l, t, tl, tr: _select(l, t, tl),
    lambda l, t, tl, tr: _clamp(l + t - tl),
    lambda l, t, tl, tr: _clamp(_average(l, t) + np.trunc((_average(l, t) - tl) / 2).astype(np.int64)),
)


def unpredict(residual, modes, block):
    """Pixels (h, w, 4) from the residuals of the predictor transform."""
    h, w, _ = residual.shape
    out, kinds = residual.copy(), np.unique(modes)
    out[0, 0, 3] = out[0, 0, 3] + 255 & 255
    out[0, 1:] = np.cumsum(out[0], axis=0)[1:] & 255  # the first row is predicted from the left, the first column from above
    out[:, 0] = np.cumsum(out[:, 0], axis=0) & 255
    if len(kinds) == 1 and kinds[0] in (1, 2):  # all from the left or all from above
        rows = out[:, 1:] if kinds[0] == 2 else out[1:]
        rows[:] = np.cumsum(rows, axis=2 - kinds[0]) & 255
        return out
    for y in range(1, h):
        above = np.concatenate([out[y - 1], out[y, :1]])  # right of the last column stands this row's first pixel
        for x in range(1, w):
            p = PREDICT[min(13, int(modes[y >> block, x >> block]))](out[y, x - 1], above[x], above[x - 1], above[x + 1])
            out[y, x] = out[y, x] + p & 255
    return out


def _signed(x):
    return (x ^ 128) - 128


def uncross(pixels, elements, block):
    """Pixels from the cross-colour transform with elements (h', w') of ARGB numbers."""
    h, w, _ = pixels.shape
    e = elements[np.arange(h)[:, None] >> block, np.arange(w)[None] >> block]
    red_blue, green_blue, green_red = (_signed(e >> k & 255) for k in (16, 8, 0))
    out, g = pixels.copy(), _signed(pixels[..., 1])
    out[..., 0] = out[..., 0] + (green_red * g >> 5) & 255
    out[..., 2] = out[..., 2] + (green_blue * g >> 5) + (red_blue * _signed(out[..., 0]) >> 5) & 255
    return out


def unpalette(indices, palette, w, pack):
    """Pixels from palette indices in green, 2**pack of them in each stored pixel."""
    width = 8 >> pack
    g = indices[..., 1]
    flat = np.stack([g >> width * k & (1 << width) - 1 for k in range(1 << pack)], axis=-1).reshape(len(g), -1)[:, :w] if pack else g
    return np.concatenate([palette, np.zeros((256, 4), dtype=np.int64)])[flat]


def _image_data(data):
    """VP8L chunk of a file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the file")


def _head(bits):
    """(width, height) behind the signature."""
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless image")
    w, h, _, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise ValueError("unknown version")
    return w, h


class Opened:
    """What stands before an image's pixel stream: its place, size, codes, and the transforms to undo."""

    def __init__(self, data, w, h):
        bits = Bits(data, 40)
        self.names, self.undo, self.width = [], [], w
        while bits.read(1):
            kind, width = bits.read(2), self.width
            self.names.append(("predictor", "cross-colour", "subtract green", "palette")[kind])
            if kind in (0, 1):
                block = bits.read(3) + 2
                part = _pixels(bits, width + (1 << block) - 1 >> block, h + (1 << block) - 1 >> block)
                self.undo.append((lambda p, part=part, block=block: unpredict(p, part >> 8 & 255, block)) if kind == 0 else (lambda p, part=part, block=block: uncross(p, part, block)))
            elif kind == 2:
                self.undo.append(lambda p: np.stack([p[..., 0] + p[..., 1] & 255, p[..., 1], p[..., 2] + p[..., 1] & 255, p[..., 3]], axis=-1))
            else:
                n = bits.read(8) + 1
                palette = np.cumsum(_channels(_pixels(bits, n, 1))[0], axis=0) & 255
                pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                self.undo.append(lambda p, palette=palette, full=width, pack=pack: unpalette(p, palette, full, pack))
                self.width = width + (1 << pack) - 1 >> pack
        self.cache, self.block, self.groups_at, self.groups = _codes(bits, self.width, h, True)
        self.at = bits.at
        green, red, blue, alpha, far = self.groups[0]
        self.short = self.groups_at is None and max(green.bits + red.bits + blue.bits + alpha.bits, green.bits + 10 + far.bits + 18) <= WINDOW

    def read(self, data, h):
        """The stored pixels (h rows) as ARGB numbers."""
        return _stream(Bits(data, self.at), self.width, h, self.cache, self.block, self.groups_at, self.groups)

    def finish(self, argb):
        pixels = _channels(argb)
        for f in reversed(self.undo):
            pixels = f(pixels)
        return pixels.astype(np.uint8)


def decode(data):
    """Pixel array (h, w, 4) of red, green, blue and alpha of a lossless WebP file."""
    data = _image_data(data)
    w, h = _head(Bits(data))
    opened = Opened(data, w, h)
    return opened.finish(opened.read(data, h))


# ---- payloads -------------------------------------------------------------


def huffman_lengths(weights):
    """Code lengths of a Huffman code."""
    heap = [(w, s, (s,)) for s, w in enumerate(weights)]
    heapq.heapify(heap)
    lengths = [0] * len(weights)
    while len(heap) > 1:
        (a, i, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            lengths[s] += 1
        heapq.heappush(heap, (a + b, i, x + y))
    return lengths


TEXT = [64 if chr(b) in " abcdefghijklmnopqrstuvwxyz" else 8 if chr(b) in "\n.," else 2 if chr(b).isalnum() and b < 128 or b in (0xC3, 0xA9) else 0.5 for b in range(256)]
NEAR_ZERO = [1 / (1 + min(b, 256 - b) / 6) ** 2 for b in range(256)]


class Form:
    """A way of the writer to store pixels: header bits behind the size (a number and a count), and its static prefix codes.

    Literals expect the bytes of text: lower-case letters and the space most often,
    then line ends and marks, capitals and digits; what is left of a prediction is
    expected near zero.  ``distinct``: pixels of the palette (numbers), if any.
    """

    def __init__(self, weights=TEXT, copies=False, predictor=None, green=False, distinct=None):
        bits = []
        put = lambda value, n: bits.extend(value >> k & 1 for k in range(n))
        if green:
            put(1, 1), put(2, 2)
        if predictor:
            put(1, 1), put(0, 2), put(7, 3)  # blocks of 512
            put(0, 1)
            for only in (predictor, 0, 0, 0, 0):
                bits += _only_bits(only)
        self.wide = 1
        if distinct is not None:
            put(1, 1), put(3, 2), put(len(distinct) - 1, 8), put(0, 1)
            for size in (280, 256, 256, 256):
                bits += _code_bits((8,) * 256 + (0,) * (size - 256))
            bits += _only_bits(0)
            rows = np.stack([distinct >> k & 255 for k in (8, 16, 0, 24)], axis=1)
            bits += np.unpackbits((np.diff(rows, axis=0, prepend=0) & 255).astype(np.uint8)).tolist()  # flat codes, first bit first
            self.wide = _packed(len(distinct))
        put(0, 1)  # no more transforms
        put(1, 1) if copies else None
        put(CACHE_BITS, 4) if copies else put(0, 1)
        put(0, 1)  # one group of codes
        if distinct is not None:
            n = 8 if self.wide > 1 else (len(distinct) - 1).bit_length()
            main, other, far = [n] * (1 << n), None, None
        else:
            other = huffman_lengths(weights)
            main = other
            far = _complete([True] * 40) if copies else None
            if copies:
                total = sum(weights)
                main = huffman_lengths([w / total * 0.5 for w in weights] + [0.15 * 0.8**k + 0.0005 for k in range(24)][:24] + [0.4 / (1 << CACHE_BITS)] * (1 << CACHE_BITS))
        bits += _code_bits(tuple(main + [0] * (280 - len(main))))
        for _ in range(3):
            bits += _code_bits(tuple(other)) if other else _only_bits(0)
        bits += _code_bits(tuple(far)) if far else _only_bits(0)
        assert max(main + (other or [])) <= SHORT_CODE
        self.head, self.head_bits = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little"), len(bits)
        self.codes = [_arrays(x) for x in (tuple(main), tuple(other or [0]), tuple(far or [0]))]
        self.size8 = self.codes[1][1].astype(np.uint8)


def _packed(n):
    """Palette indices in one stored pixel."""
    return 8 if n <= 2 else 4 if n <= 4 else 2 if n <= 16 else 1


@functools.lru_cache(maxsize=64)
def _arrays(lengths):
    table = canonical(lengths)
    return np.array([table.get(s, (0, 0))[0] for s in range(len(lengths))], dtype=np.uint64), np.array(lengths, dtype=np.uint64)


def _only_bits(symbol):
    """A code of one symbol, which takes no bits."""
    return [1, 0, 1] + [symbol >> k & 1 for k in range(8)]


@functools.lru_cache(maxsize=64)
def _code_bits(lengths):
    """Bits of code lengths in runs: equal ones by symbol 16, zeros by 17 and 18."""
    steps, i = [], 0
    while i < len(lengths):
        n = 1
        while i + n < len(lengths) and lengths[i + n] == lengths[i]:
            n += 1
        i, v = i + n, lengths[i]
        if v:
            steps.append((v, 0, 0))
            n -= 1
        while n:
            k = min(n, 6 if v else 138)
            if k < 3:
                steps += [(v, 0, 0)] * k
            elif v:
                steps.append((16, k - 3, 2))
            else:
                steps.append((17, k - 3, 3) if k <= 10 else (18, k - 11, 7))
            n -= k
    plain = _complete([any(s == k for s, _, _ in steps) for k in range(19)])
    codes, bits = canonical(plain), []
    put = lambda value, n: bits.extend(value >> k & 1 for k in range(n))
    put(0, 1), put(len(LENGTH_ORDER) - 4, 4)
    for k in LENGTH_ORDER:
        put(plain[k], 3)
    put(0, 1)
    for s, extra, n in steps:
        put(*codes[s]), put(extra, n)
    return bits


@functools.lru_cache(maxsize=1)
def _forms():
    """The writer's forms but for palettes: literals, copies and cache, prediction from the left and from above, subtracted green."""
    return [Form(), Form(copies=True), Form(NEAR_ZERO, predictor=1), Form(NEAR_ZERO, predictor=2), Form(NEAR_ZERO, green=True)]


def _complete(marked):
    """Lengths of a complete code over the marked symbols, as even as possible."""
    used = [s for s, n in enumerate(marked) if n]
    low = len(used).bit_length() - 1
    long = 2 * (len(used) - (1 << low))
    return [0 if not n else low + (used.index(s) < long) for s, n in enumerate(marked)]


def padded(raw):
    """The payload of text bytes: spaces up to a positive multiple of 192."""
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def payload_shape(size):
    """(width, height) of the image of so many payload bytes, four a pixel; a last row may be partly unused."""
    w = UNIT // 4
    while -(-size // (4 * w)) > MOST_SIDE:
        w *= 2
    if w > MOST_SIDE:
        raise ValueError("payload too large for one image")
    return w, -(-size // (4 * w))


def _prefix(value):
    """Prefix symbols, extra bits and their numbers of lengths or distances."""
    u = value - 1
    k = np.maximum(np.frexp(u.astype(np.float64))[1] - 2, 0)
    small = u < 4
    return np.where(small, u, 2 * k + 2 + (u >> k & 1)), np.where(small, 0, u & (1 << k) - 1), np.where(small, 0, k)


def _earlier(key):
    """Index of the last earlier element of equal key, or -1."""
    order = np.argsort(key, kind="stable")
    out = np.full(len(key), -1)
    same = key[order[1:]] == key[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _copies(argb, image, first, widths):
    """Symbols of pixels with copies and cache: (index of the first pixel, kind, length, distance code); kinds: 0 literal, 1 copy, 2 cache."""
    n = len(argb)
    mixed = argb.astype(np.uint64)
    three = mixed.copy()
    three[:-2] = (mixed[:-2] * np.uint64(0x9E3779B97F4A7C15) + mixed[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + mixed[2:]
    before = _earlier(image.astype(np.uint64) << np.uint64(44) | three * np.uint64(0x94D049BB133111EB) >> np.uint64(20))
    here = np.arange(n)
    ends = np.append(first[1:], n)[image]
    same = (before >= 0) & (here + 2 < ends)
    for k in range(3):
        same &= argb[np.minimum(here + k, n - 1)] == argb[np.minimum(before + k, n - 1)]
    far = np.where(same & (here - before <= FARTHEST), here - before, 0)
    start = np.flatnonzero((far > 0) & ((far != np.concatenate([[0], far[:-1]])) | (here == first[image])))
    stop = np.flatnonzero((far > 0) & ((far != np.append(far[1:], 0)) | (here + 1 == ends))) + 3
    begin = np.maximum(start, np.concatenate([[0], stop[:-1]])) if len(start) else start
    good = stop - begin >= 2
    begin, length, far = begin[good], (stop - begin)[good], far[start[good]]
    parts = -(-length // LONGEST)
    part = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    begin, far = np.repeat(begin, parts) + part * LONGEST, np.repeat(far, parts)
    length = np.minimum(np.repeat(length, parts) - part * LONGEST, LONGEST)
    slot = (argb * np.uint32(0x1E35A7BD)) >> np.uint32(32 - CACHE_BITS)
    last = _earlier(image << CACHE_BITS | slot)
    kind = np.where((last >= 0) & (argb[last] == argb), 2, 0)
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, begin + 1, 1), np.add.at(step, begin + length, -1)
    kind[begin] = 1
    at = np.flatnonzero(np.cumsum(step)[:-1] == 0)  # pixels inside a copy have no symbol
    span, code = np.ones(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    span[begin] = length
    code[begin] = np.where(far == 1, 2, np.where(far == widths[image[begin]], 1, far + 120))
    return at, kind[at], span[at], code[at], slot[at]


def _literals(form, green_first):
    """Code words and sizes of whole pixels (rows of green, red, blue, alpha)."""
    (code, length), (code_c, length_c), _ = form.codes
    own, size = code[green_first[:, 0]], length[green_first[:, 0]]
    for k in (1, 2, 3):
        own = own | code_c[green_first[:, k]] << size
        size = size + length_c[green_first[:, k]]
    return own, size


def _symbols(form, green_first, found):
    """Code words and sizes of the symbols that ``_copies`` found."""
    at, kind, span, far, slot = found
    own, size = _literals(form, green_first[at])
    (code, length), _, (code_f, length_f) = form.codes
    hit = np.flatnonzero(kind == 2)
    own[hit], size[hit] = code[280 + slot[hit]], length[280 + slot[hit]]
    copy = np.flatnonzero(kind == 1)
    p, extra, n = _prefix(span[copy])
    word, bits = code[256 + p] | extra.astype(np.uint64) << length[256 + p], length[256 + p] + n.astype(np.uint64)
    p, extra, n = _prefix(far[copy])
    word |= code_f[p] << bits
    bits = bits + length_f[p]
    own[copy], size[copy] = word | extra.astype(np.uint64) << bits, bits + n.astype(np.uint64)
    return own, size


def _differences(rgba, image, first, widths, above):
    """What is left of pixels when each is predicted from its left neighbour, or from that above."""
    here = np.arange(len(rgba))
    place = here - first[image]
    w = widths[image]
    left = place % w > 0
    from_left = left & (place < w) if above else left
    of = here - np.where(from_left, 1, w)
    out = rgba - np.where((place > 0)[:, None], rgba[of], np.array([0, 0, 0, 255], dtype=np.uint8))
    return out


def _files(form, shapes, counts, own, size):
    """Lossless WebP files of one form; ``counts`` symbols of each image stand in ``own`` and ``size``."""
    head_bits = form.head_bits
    ends = np.cumsum(size).astype(np.int64)
    first = np.cumsum(counts) - counts
    before = np.concatenate([[0], ends])[first]
    bits = ends[first + counts - 1] - before + head_bits + 40
    words = -(-bits // 64) + 1
    region = np.cumsum(words) - words
    offset = ends - size.astype(np.int64) + np.repeat(region * 64 + head_bits + 40 - before, counts)
    word, shift = offset >> 6, (offset & 63).astype(np.uint64)
    buffer = np.zeros(int(words.sum()), dtype=np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    buffer[word[starts]] |= np.bitwise_or.reduceat(own << shift, starts)
    buffer[word[starts] + 1] |= np.bitwise_or.reduceat(np.where(shift > 0, own >> (np.uint64(64) - shift & np.uint64(63)), np.uint64(0)), starts)
    whole, out = buffer.tobytes(), []
    for (w, h), r, n in zip(shapes, region.tolist(), bits.tolist()):
        top = 0x2F | w - 1 << 8 | h - 1 << 22 | 1 << 36 | form.head << 40
        k = head_bits + 40 + 7 >> 3
        data = whole[8 * r : 8 * r + (n + 7 >> 3)].ljust(k, b"\0")
        data = (top | int.from_bytes(data[:k], "little")).to_bytes(k, "little") + data[k:]
        chunk = b"WEBPVP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)
        out.append(b"RIFF" + len(chunk).to_bytes(4, "little") + chunk)
    return out


def _palette_file(argb, w, h):
    distinct, index = np.unique(argb, return_inverse=True)
    form = Form(distinct=distinct.astype(np.int64))
    wide, across = form.wide, -(-w // form.wide)
    padded_index = np.zeros((h, across * wide), dtype=np.int64)
    padded_index[:, :w] = index.reshape(h, w)
    stored = (padded_index.reshape(h, across, wide) << np.arange(wide) * (8 // wide)).sum(axis=2).ravel()
    code, length = form.codes[0]
    return _files(form, [(w, h)], np.array([len(stored)]), code[stored], length[stored])[0]


def write_payloads(payloads):
    """Lossless WebP files of payloads, their bytes as red, green, blue, alpha; each in the form that takes the fewest bits."""
    if not payloads:
        return []
    forms = _forms()
    shapes = [payload_shape(len(p)) for p in payloads]
    full = [p.ljust(4 * w * h, b" ") for p, (w, h) in zip(payloads, shapes)]
    px = np.array([w * h for w, h in shapes])
    first, widths = np.cumsum(px) - px, np.array([w for w, _ in shapes])
    image = np.repeat(np.arange(len(px)), px)
    rgba = np.frombuffer(b"".join(full), dtype=np.uint8).reshape(-1, 4)
    parts = rgba.astype(np.uint32)
    argb = parts[:, 3] << 24 | parts[:, 0] << 16 | parts[:, 1] << 8 | parts[:, 2]
    order = [1, 0, 2, 3]  # green is coded first
    found = _copies(argb, image, first, widths)
    less_green = rgba.copy()
    less_green[:, [0, 2]] -= rgba[:, 1:2]
    rows = [rgba, rgba, _differences(rgba, image, first, widths, False), _differences(rgba, image, first, widths, True), less_green]
    copied = _symbols(forms[1], rgba[:, order], found)
    symbols = np.bincount(image[found[0]], minlength=len(px))
    begin = np.cumsum(symbols) - symbols
    bits = [form.head_bits + (np.add.reduceat(copied[1].astype(np.int64), begin) if k == 1 else np.add.reduceat(form.size8[x].ravel(), 4 * first, dtype=np.int64)) for k, (form, x) in enumerate(zip(forms, rows))]
    known = np.sort(image << 32 | argb)
    distinct = np.bincount((known[np.concatenate([[True], known[1:] != known[:-1]])] >> 32), minlength=len(px))
    wide = np.array([_packed(n) for n in distinct.tolist()])
    index_bits = np.where(wide > 1, 8, np.ceil(np.log2(np.maximum(distinct, 2))).astype(np.int64))
    bits.append(np.where(distinct <= 256, 450 + 32 * distinct + -(-widths // wide) * (px // widths) * index_bits, np.iinfo(np.int64).max))
    best, out = np.argmin(bits, axis=0), [None] * len(px)
    for k, form in enumerate(forms):
        mine = np.flatnonzero(best == k)
        if len(mine):
            n, start = (symbols[mine], begin[mine]) if k == 1 else (px[mine], first[mine])
            take = np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)
            own, size = (copied[0][take], copied[1][take]) if k == 1 else _literals(form, rows[k][take][:, order])
            for i, f in zip(mine.tolist(), _files(form, [shapes[i] for i in mine], n, own, size)):
                out[i] = f
    for i in np.flatnonzero(best == len(forms)).tolist():
        out[i] = _palette_file(argb[first[i] : first[i] + px[i]], *shapes[i])
    return out


_HEADS = {}  # opened headers by bit count and bits: images of one form share theirs


def _open(data, w, h):
    """The opened image; headers without a palette are kept."""
    for n, known in _HEADS.items():
        head = int.from_bytes(data[5 : 5 + (n + 7 >> 3)], "little") & (1 << n) - 1
        got = known.get((head, w, h)) or known.get((head, w, None))
        if got is not None:
            return got
    opened = Opened(data, w, h)
    if "palette" not in opened.names and opened.groups_at is None:
        n = opened.at - 40
        if sum(map(len, _HEADS.values())) > 512:
            _HEADS.clear()
        head = int.from_bytes(data[5 : 5 + (n + 7 >> 3)], "little") & (1 << n) - 1
        _HEADS.setdefault(n, {})[head, w, h if {"predictor", "cross-colour"} & set(opened.names) else None] = opened
    return opened


def decode_all(files):
    """Pixel arrays of lossless WebP files; those of equal codes are read side by side."""
    out, groups = [None] * len(files), {}
    for i, f in enumerate(files):
        data = _image_data(f)
        w, h = _head(Bits(data))
        opened = _open(data, w, h)
        key = (opened.cache, *map(id, opened.groups[0])) if opened.short else None
        groups.setdefault(key, []).append((opened.width * h, i, data, opened, h))
    for key, images in groups.items():
        images.sort(key=lambda x: (-x[0], x[1]))
        px = np.array([x[0] for x in images] + [0])
        alone = len(images) if key is None else int(np.argmin(ALONE_STEP * (np.cumsum(px) - px) + STEP * px))  # the longest images cost less one by one
        for _, i, data, opened, h in images[:alone]:
            out[i] = opened.finish(opened.read(data, h))
        if alone < len(images):
            for (_, i, _, opened, h), p in zip(images[alone:], _side_by_side(images[alone:])):
                out[i] = opened.finish(p.reshape(h, opened.width))
    return out


def _spans(prefix, bits, used):
    """Values of length or distance prefixes, and the bits behind them and used so far."""
    extra = np.maximum(prefix - 2 >> 1, 0)
    value = np.where(prefix < 4, prefix, (2 + (prefix & 1) << extra) + (bits & (1 << extra) - 1)) + 1
    return value, bits >> extra, used + extra


def _side_by_side(images):
    opened = images[0][3]
    px, widths = np.array([x[0] for x in images]), np.array([x[3].width for x in images])
    sizes = np.array([len(x[2]) + 8 for x in images])
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(x[2] + bytes(8) for x in images), dtype=np.uint8)
    window = np.lib.stride_tricks.as_strided(data[:8].view("<i8"), shape=(len(data) - 7,), strides=(1,))
    at, last = begin * 8 + np.array([x[3].at for x in images]), begin + sizes - 8
    pixels, place = np.empty(int(px.sum()), dtype=np.int64), np.cumsum(px) - px
    (green, low), *others, (far, low_far) = ((c.table, (1 << c.bits) - 1) for c in opened.groups[0])
    others = [(*x, k) for x, k in zip(others, (16, 0, 24))]
    near = np.array(NEAR)
    copying, cached = any(opened.groups[0][0].lengths[256:]), opened.cache > 0
    left, back = np.zeros(len(px), dtype=np.int64), np.zeros(len(px), dtype=np.int64)
    kept, shift, every = np.zeros((len(px), 1 << opened.cache), dtype=np.int64), 32 - opened.cache, np.arange(len(px))
    active = np.searchsorted(-px, -np.arange(int(px[0])), side="left").tolist()  # images with more pixels than the step's number
    for step in range(int(px[0])):
        n = active[step]
        row = place[:n] + step
        go = every[:n]
        if copying:
            free = left[:n] == 0
            go = free.nonzero()[0]
            if len(go) < n:
                busy = (~free).nonzero()[0]
                to = row[busy]
                pixels[to] = pixels[to - back[busy]]
                left[busy] -= 1
        if len(go):
            p = at[go]
            bits = window[np.minimum(p >> 3, last[go])] >> (p & 7)
            e = green[bits & low]
            s, used = e >> 4, e & 15
            bits >>= used
            plain = (s < 256).nonzero()[0] if copying else None
            whole = plain is None or len(plain) == len(go)
            b, u, value = (bits, used, s << 8) if whole else (bits[plain], used[plain], s[plain] << 8)
            for table, mask, k in others:
                e = table[b & mask]
                value |= e >> 4 << k
                e &= 15
                b = b >> e
                u = u + e
            if whole:
                pixels[row[go]], used = value, u
            else:
                pixels[row[go[plain]]], used[plain] = value, u
                hit = (s >= 280).nonzero()[0]
                if len(hit):
                    who = go[hit]
                    pixels[row[who]] = kept[who, s[hit] - 280]
                if len(plain) + len(hit) < len(go):
                    copy = ((s >= 256) & (s < 280)).nonzero()[0]
                    length, b, u = _spans(s[copy] - 256, bits[copy], used[copy])
                    e = far[b & low_far]
                    d, _, used[copy] = _spans(e >> 4, b >> (e & 15), u + (e & 15))
                    short, who = near[np.minimum(d, 120) - 1], go[copy]
                    d = np.where(d > 120, d - 120, np.maximum(1, short[:, 0] + short[:, 1] * widths[who]))
                    if (d > step).any():
                        raise ValueError("back-reference before the first pixel")
                    left[who], back[who] = length - 1, d
                    pixels[row[who]] = pixels[row[who] - d]
            at[go] = p + used
        if cached:
            kept[every[:n], (pixels[row] * 0x1E35A7BD & 0xFFFFFFFF) >> shift] = pixels[row]
    return np.split(pixels, np.cumsum(px)[:-1])


def payload_feature(pixels):
    """Size, channel means and mean absolute step along rows of a pixel array."""
    x = pixels.astype(np.int64)
    steps = np.abs(np.diff(x, axis=1)).mean() if x.shape[1] > 1 else 0.0
    return f"{x.shape[1]}x{x.shape[0]};" + ",".join(f"{m:.4f}" for m in x.reshape(-1, 4).mean(axis=0)) + f";{steps:.4f}"


def _batches(sizes):
    """Slices of a list of texts whose sizes are at most about ``BATCH_BYTES`` together."""
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if i > start and size + n > BATCH_BYTES:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def media(docs: DataFrame) -> DataFrame:
    """Media columns of texts: doc_id, n_bytes, media (a lossless WebP file of the padded UTF-8 bytes).

    Null and empty texts give one row of spaces; repeated rows give equal files;
    an empty table gives an empty result.
    """
    def write(batches):
        for b in batches:
            raw = [(t or "").encode("utf-8", "replace") for t in b.text]
            ids = b.doc_id.astype("Int64")
            for s in _batches([max(UNIT, len(r)) for r in raw]):
                yield pd.DataFrame({"doc_id": ids[s], "n_bytes": [len(r) for r in raw[s]], "media": write_payloads([padded(r) for r in raw[s]])})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(write, "doc_id long, n_bytes long, media binary")


def media_digest(rows: DataFrame) -> DataFrame:
    """Read media columns back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    columns = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

    def read(batches):
        for b in batches:
            ids, files, sizes = b.doc_id.astype("Int64"), list(b.media), list(b.n_bytes)
            for s in _batches([max(UNIT, int(n)) for n in sizes]):
                out = []
                for d, n, f, p in zip(ids[s], sizes[s], files[s], decode_all(files[s])):
                    payload = p.tobytes()[: max(UNIT, -(-int(n) // UNIT) * UNIT)]
                    out.append((d, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(f), hashlib.sha256(f).hexdigest(), payload_feature(p)))
                yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    return rows.mapInPandas(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
