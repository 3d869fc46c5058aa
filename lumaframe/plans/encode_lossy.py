"""Writes lossy key frames, so that their decoder can be held against plain arithmetic. Test data only; the
probabilities are made up by a rule, as any tables do if writer and reader share them."""

from __future__ import annotations

import functools

import numpy as np

from lumaframe.kernels import vp8


@functools.cache
def made_up_tables() -> vp8.Tables:
    return vp8.Tables.parse(" ".join(str(1 + (97 * i + 13) % 254) for i in range(3012)))


class Writer:
    """The boolean encoder: the interval's low end as one whole number."""

    def __init__(self):
        self.low, self.range, self.shift = 0, 255, 0

    def bit(self, v, p=128):
        split = 1 + ((self.range - 1) * p >> 8)
        if v:
            self.low += split
            self.range -= split
        else:
            self.range = split
        while self.range < 128:
            self.range, self.low, self.shift = self.range * 2, self.low * 2, self.shift + 1

    def literal(self, v, n):
        for k in range(n - 1, -1, -1):
            self.bit(v >> k & 1)

    def optional(self, v, n, signed=True):
        self.bit(v != 0)
        if v:
            self.literal(abs(v), n)
            if signed:
                self.bit(v < 0)

    def tree(self, nodes, probs, leaf):
        def path(at):
            for side, to in enumerate(nodes[at >> 1]):
                if to <= 0 and -to == leaf:
                    return [(at, side)]
                if to > 0 and (rest := path(to)):
                    return [(at, side), *rest]

        for at, side in path(0):
            self.bit(side, probs[at >> 1])

    def bytes(self):
        n = self.shift + 8
        return (self.low << -n % 8).to_bytes(-(-n // 8), "big")


def write_tokens(w, probs, context, first, values):
    """values in zigzag order, without steps."""
    last = max((k for k in range(first, 16) if values[k]), default=first - 1)
    p, after_zero = probs[vp8.BANDS[first]][context], False
    for k in range(first, last + 1):
        v = int(abs(values[k]))
        if not after_zero:
            w.bit(1, p[0])
        w.bit(v > 0, p[1])
        if v:
            w.bit(v > 1, p[2])
        if v > 1:
            w.bit(v > 4, p[3])
            if v <= 4:
                w.bit(v > 2, p[4])
                if v > 2:
                    w.bit(v - 3, p[5])
            else:
                kind = max(c for c in range(6) if vp8.CATEGORIES[c][0] <= v)
                w.bit(kind > 1, p[6])
                if kind < 2:
                    w.bit(kind, p[7])
                else:
                    w.bit(kind > 3, p[8])
                    w.bit(kind & 1, p[9 + (kind > 3)])
                low, more = vp8.CATEGORIES[kind]
                for i, q in enumerate(more):
                    w.bit((v - low) >> len(more) - 1 - i & 1, q)
        if v:
            w.bit(values[k] < 0)
        after_zero = not v
        if k < 15:
            p = probs[vp8.BANDS[k + 1]][min(v, 2)]
    if last < 15:
        w.bit(0, p[0])
    return int(last >= first)


def frame(tables, width, height, blocks, parts=1, level=0, sharpness=0, simple=False, step=20, skip_prob=None):
    """A key frame. blocks: (mode, submodes, chroma mode, 25 x 16 values in zigzag order or None to skip)."""
    w = Writer()
    for bit in (0, 0, 0, simple):
        w.bit(bit)
    w.literal(level, 6), w.literal(sharpness, 3), w.bit(0)
    w.literal(parts.bit_length() - 1, 2)
    w.literal(step, 7)
    for _ in range(5):
        w.bit(0)
    w.bit(0)
    for at in np.ndindex(tables.updates.shape):
        w.bit(0, int(tables.updates[at]))
    w.bit(skip_prob is not None)
    if skip_prob is not None:
        w.literal(skip_prob, 8)
    columns, probs = width + 15 >> 4, tables.tokens.tolist()
    out, above, modes = [Writer() for _ in range(parts)], [[0] * 9 for _ in range(columns)], [[0] * 4 for _ in range(columns)]
    for k, (mode, submodes, chroma, values) in enumerate(blocks):
        y, x = divmod(k, columns)
        if x == 0:
            left, left_modes = [0] * 9, [0] * 4
        if skip_prob is not None:
            w.bit(values is None, skip_prob)
        w.tree(vp8.LUMA_TREE, vp8.LUMA_PROBS, mode)
        for i in range(16):
            r, c = divmod(i, 4)
            m = submodes[i] if mode == vp8.SPLIT else vp8.SUBMODE[mode]
            if mode == vp8.SPLIT:
                w.tree(vp8.SUBMODE_TREE, tables.submodes[modes[x][c]][left_modes[r]], m)
            modes[x][c] = left_modes[r] = m
        w.tree(vp8.CHROMA_TREE, vp8.CHROMA_PROBS, chroma)
        if values is None:
            for side in (above[x], left):
                side[:8] = [0] * 8
                if mode != vp8.SPLIT:
                    side[8] = 0
            continue
        p, a = out[y % parts], above[x]
        if mode != vp8.SPLIT:
            a[8] = left[8] = write_tokens(p, probs[1], a[8] + left[8], 0, values[24])
        for i in range(24):
            r, c, kind = (i >> 2, i & 3, 3 if mode == vp8.SPLIT else 0) if i < 16 else ((4 if i < 20 else 6) + (i >> 1 & 1), (4 if i < 20 else 6) + (i & 1), 2)
            a[c] = left[r] = write_tokens(p, probs[kind], a[c] + left[r], int(kind == 0), values[i])
    first, rest = w.bytes(), [p.bytes() for p in out]
    head = (len(first) << 5 | 1 << 4).to_bytes(3, "little") + b"\x9d\x01\x2a" + width.to_bytes(2, "little") + height.to_bytes(2, "little")
    return head + first + b"".join(len(p).to_bytes(3, "little") for p in rest[:-1]) + b"".join(rest)


def flat_frame(number: int) -> bytes:
    """Two macroblocks side by side, each of one colour: only first coefficients, luma by its own block."""
    y, u, v = tokens(number)
    blocks = []
    for k in range(2):
        values = np.zeros((25, 16), int)
        values[24, 0], values[16:20, 0], values[20:24, 0] = y[k], u[k], v[k]
        blocks.append((number % 4 if k else vp8.DC, None, number // 4 % 4 if k else vp8.DC, values))
    return frame(made_up_tables(), 32, 16, blocks, parts=1 << number % 3, step=20)


def tokens(n: int) -> tuple[tuple[int, int], ...]:
    """First coefficients of luma, U and V of the two macroblocks."""
    return (n * 7 % 121 - 60, n % 41 - 20), (n * 3 % 31 - 15, n % 7 - 3), (n * 5 % 71 - 35, 4 - n % 9)
