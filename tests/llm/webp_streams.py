"""A plain writer of lossless WebP streams with any of the format's features, for tests of the decoder."""

import numpy as np

from gridloom.llm.webp import LENGTH_ORDER, NEAR, canonical


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n)]

    def data(self):
        return bytes(sum(b << k for k, b in enumerate(self.bits[i : i + 8])) for i in range(0, len(self.bits), 8))


def write_code(out, size, used):
    """A flat code over the used symbols; gives {symbol: (code, length)}."""
    used = sorted(used) or [0]
    if len(used) <= 2 and used[-1] < 256:
        out.put(1, 1), out.put(len(used) - 1, 1), out.put(1, 1), out.put(used[0], 8)
        if len(used) == 2:
            out.put(used[1], 8)
        return {used[0]: (0, 0)} if len(used) == 1 else {used[0]: (0, 1), used[1]: (1, 1)}
    if len(used) == 1:
        used.append((used[0] + 1) % size)
        used.sort()
    low = len(used).bit_length() - 1
    long = 2 * (len(used) - (1 << low))
    lengths = [0] * size
    for k, s in enumerate(used):
        lengths[s] = low + (k < long)
    # run lengths: zeros as 17 and 18, repeats as 16
    runs, i = [], 0
    last = 8
    while i < size:
        j = i
        while j < size and lengths[j] == lengths[i]:
            j += 1
        n = j - i
        if lengths[i] == 0 and n >= 3:
            n = min(n, 138)
            runs.append((18, n - 11, 7) if n >= 11 else (17, n - 3, 3))
        elif lengths[i] == last and n >= 3:
            n = min(n, 6)
            runs.append((16, n - 3, 2))
        else:
            n = 1
            runs.append((lengths[i], 0, 0))
            last = lengths[i] or last
        i += n
    own = sorted({r[0] for r in runs})
    if len(own) == 1:
        own.append(19 - 1 if own[0] != 18 else 0)
        own.sort()
    low = len(own).bit_length() - 1
    long = 2 * (len(own) - (1 << low))
    plain = [0] * 19
    for k, s in enumerate(own):
        plain[s] = low + (k < long)
    out.put(0, 1), out.put(15, 4)
    for k in LENGTH_ORDER:
        out.put(plain[k], 3)
    out.put(1, 1), out.put(4, 3), out.put(len(runs) - 2, 10)  # how many codes follow
    codes = canonical(plain)
    for s, extra, n in runs:
        out.put(*codes[s]), out.put(extra, n)
    return canonical(lengths)


def prefix(value):
    """Prefix number, extra bits and their count of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    for p in range(4, 40):
        extra = p - 2 >> 1
        base = (2 + (p & 1) << extra) + 1
        if base <= value < base + (1 << extra):
            return p, value - base, extra
    raise ValueError(value)


def tokens(argb, w, cache, copies):
    """Literals, copies and cache hits of a flat list of ARGB numbers."""
    kept, out, i = {}, [], 0
    while i < len(argb):
        length = 0
        if copies:
            for d in {1, 2, w, w + 1, 3 * w + 130} & set(range(1, i + 1)):
                n = 0
                while i + n < len(argb) and n < 300 and argb[i + n] == argb[i + n - d]:
                    n += 1
                if n > length:
                    length, far = n, d
        slot = (argb[i] * 0x1E35A7BD & 0xFFFFFFFF) >> 32 - cache if cache else None
        if length >= 3:
            code = next((k + 1 for k, (x, y) in enumerate(NEAR) if max(1, x + y * w) == far), far + 120)
            out.append(("copy", length, code))
        elif cache and kept.get(slot) == argb[i]:
            out.append(("cache", slot, 0))
            length = 1
        else:
            out.append(("pixel", argb[i], 0))
            length = 1
        for p in argb[i : i + length]:
            if cache:
                kept[(p * 0x1E35A7BD & 0xFFFFFFFF) >> 32 - cache] = p
        i += length
    return out


def write_image(out, argb, main=False, cache=0, copies=False, block=None):
    h, w = argb.shape
    out.put(int(cache > 0), 1)
    if cache:
        out.put(cache, 4)
    groups = np.zeros((h, w), dtype=int)
    if main:
        out.put(int(block is not None), 1)
        if block is not None:
            out.put(block - 2, 3)
            part = np.array([[(y + x) % 3 for x in range(w + (1 << block) - 1 >> block)] for y in range(h + (1 << block) - 1 >> block)])
            write_image(out, part << 8)
            groups = part[np.arange(h)[:, None] >> block, np.arange(w)[None] >> block]
    stream, at, used = tokens(argb.ravel().tolist(), w, cache, copies), 0, {}
    placed = []
    for kind, a, b in stream:
        g = int(groups.ravel()[at])
        sets = used.setdefault(g, [set() for _ in range(5)])
        if kind == "pixel":
            for k, s in enumerate((a >> 8 & 255, a >> 16 & 255, a & 255, a >> 24)):
                sets[k].add(s)
            at += 1
        elif kind == "copy":
            sets[0].add(256 + prefix(a)[0]), sets[4].add(prefix(b)[0])
            at += a
        else:
            sets[0].add(280 + a)
            at += 1
        placed.append((g, kind, a, b))
    sizes = (280 + (1 << cache if cache else 0), 256, 256, 256, 40)
    codes = {g: [write_code(out, n, s) for n, s in zip(sizes, used.get(g, [set()] * 5))] for g in range(groups.max() + 1)}
    for g, kind, a, b in placed:
        c = codes[g]
        if kind == "pixel":
            for k, s in enumerate((a >> 8 & 255, a >> 16 & 255, a & 255, a >> 24)):
                out.put(*c[k][s])
        elif kind == "copy":
            p, e, n = prefix(a)
            out.put(*c[0][256 + p]), out.put(e, n)
            p, e, n = prefix(b)
            out.put(*c[4][p]), out.put(e, n)
        else:
            out.put(*c[0][280 + a])


def numbers(pixels):
    p = pixels.astype(np.int64)
    return p[..., 3] << 24 | p[..., 0] << 16 | p[..., 1] << 8 | p[..., 2]


def start(w, h):
    out = Writer()
    out.put(0x2F, 8), out.put(w - 1, 14), out.put(h - 1, 14), out.put(1, 1), out.put(0, 3)
    return out


def finish(out):
    data = out.data()
    chunk = b"WEBPVP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)
    return b"RIFF" + len(chunk).to_bytes(4, "little") + chunk
