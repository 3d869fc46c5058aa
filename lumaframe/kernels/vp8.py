"""Lossy key frames: boolean decoder, headers, tokens, transforms, prediction, loop filter, colour.

Tokens are read first, then all blocks are transformed at once, predicted in raster order and filtered at the end.
The three long probability tables of the format (3,012 values without a rule) are a parameter, see Tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .vp8l import ImageError

# Fixed values of the format.
ZIGZAG = (0, 1, 4, 8, 5, 2, 3, 6, 9, 12, 13, 10, 7, 11, 14, 15)
BANDS = (0, 1, 2, 3, 6, 4, 5, 6, 6, 6, 6, 6, 6, 6, 6, 7)
DC_STEP = (
    4, 5, 6, 7, 8, 9, 10, 10, 11, 12, 13, 14, 15, 16, 17, 17, 18, 19, 20, 20, 21, 21, 22, 22, 23, 23, 24, 25, 25, 26, 27, 28,
    29, 30, 31, 32, 33, 34, 35, 36, 37, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58,
    59, 60, 61, 62, 63, 64, 65, 66, 67, 68, 69, 70, 71, 72, 73, 74, 75, 76, 76, 77, 78, 79, 80, 81, 82, 83, 84, 85, 86, 87, 88, 89,
    91, 93, 95, 96, 98, 100, 101, 102, 104, 106, 108, 110, 112, 114, 116, 118, 122, 124, 126, 128, 130, 132, 134, 136, 138, 140, 143, 145, 148, 151, 154, 157,
)
AC_STEP = (
    4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35,
    36, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58, 60, 62, 64, 66, 68, 70, 72, 74, 76,
    78, 80, 82, 84, 86, 88, 90, 92, 94, 96, 98, 100, 102, 104, 106, 108, 110, 112, 114, 116, 119, 122, 125, 128, 131, 134, 137, 140, 143, 146, 149, 152,
    155, 158, 161, 164, 167, 170, 173, 177, 181, 185, 189, 193, 197, 201, 205, 209, 213, 217, 221, 225, 229, 234, 239, 245, 249, 254, 259, 264, 269, 274, 279, 284,
)
CATEGORIES = (  # first value, probabilities of the further bits
    (5, (159,)), (7, (165, 145)), (11, (173, 148, 140)), (19, (176, 155, 140, 135)), (35, (180, 157, 141, 134, 130)),
    (67, (254, 254, 243, 230, 196, 177, 153, 140, 133, 130, 129)),
)
DC, V, H, TM, SPLIT = range(5)
B_DC, B_TM, B_VE, B_HE, B_LD, B_RD, B_VR, B_VL, B_HD, B_HU = range(10)
SUBMODE = (B_DC, B_VE, B_HE, B_TM)
LUMA_TREE, LUMA_PROBS = ((-SPLIT, 2), (4, 6), (-DC, -V), (-H, -TM)), (145, 156, 163, 128)
CHROMA_TREE, CHROMA_PROBS = ((-DC, 2), (-V, 4), (-H, -TM)), (142, 114, 183)
SUBMODE_TREE = ((-B_DC, 2), (-B_TM, 4), (-B_VE, 6), (8, 12), (-B_HE, 10), (-B_RD, -B_VR), (-B_LD, 14), (-B_VL, 16), (-B_HD, -B_HU))
SEGMENT_TREE = ((2, 4), (0, -1), (-2, -3))


@dataclass
class Tables:
    """The format's default token probabilities and their update probabilities (each 4 x 8 x 3 x 11) and the
    probabilities of sub-block modes (10 above x 10 left x 9)."""

    tokens: np.ndarray
    updates: np.ndarray
    submodes: list

    @staticmethod
    def parse(text: str) -> Tables:
        """3,012 whole numbers in the order above, apart by spaces or commas."""
        v = np.array([int(x) for x in text.replace(",", " ").split()])
        if len(v) != 3012 or v.min() < 0 or v.max() > 255:
            raise ValueError("3,012 probabilities from 0 to 255 are wanted")
        shape = (4, 8, 3, 11)
        return Tables(v[:1056].reshape(shape), v[1056:2112].reshape(shape), v[2112:].reshape(10, 10, 9).tolist())


class Bools:
    """Arithmetic decoder. One byte after the end reads as zero; more is an error at check()."""

    def __init__(self, data: bytes):
        self.data, self.at, self.range, self.value, self.bits = data, 0, 255, 0, 0

    def bit(self, p: int) -> int:
        if self.bits < 8:
            self.value = self.value << 32 | int.from_bytes(self.data[self.at : self.at + 4].ljust(4, b"\0"), "big")
            self.at, self.bits = self.at + 4, self.bits + 32
        split = 1 + ((self.range - 1) * p >> 8)
        big = split << self.bits - 8
        out = self.value >= big
        if out:
            self.value -= big
            split = self.range - split
        n = 8 - split.bit_length()
        self.range, self.bits = split << n, self.bits - n
        return int(out)

    def check(self) -> None:
        if 8 * self.at - self.bits > 8 * len(self.data):
            raise ImageError("a partition ends early")

    def flag(self) -> bool:
        return bool(self.bit(128))

    def literal(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = 2 * v + self.bit(128)
        return v

    def optional(self, n: int, signed: bool = True, default: int = 0) -> int:
        if not self.flag():
            return default
        v = self.literal(n)
        return -v if signed and self.flag() else v

    def tree(self, nodes: tuple, probs) -> int:
        at = 0
        while True:
            at = nodes[at >> 1][self.bit(probs[at >> 1])]
            if at <= 0:
                return -at


@dataclass
class Header:
    width: int
    height: int
    segmented: bool = False
    maps: bool = False
    absolute: bool = False
    segment_step: list = field(default_factory=lambda: [0] * 4)
    segment_level: list = field(default_factory=lambda: [0] * 4)
    segment_probs: list = field(default_factory=lambda: [255] * 3)
    simple: bool = False
    level: int = 0
    sharpness: int = 0
    adjusts: bool = False
    reference_delta: int = 0
    split_delta: int = 0
    partitions: list = field(default_factory=list)
    steps: tuple = ()
    tokens: list = field(default_factory=list)
    skip_prob: int | None = None


def _clip(x: int, low: int, high: int) -> int:
    return low if x < low else high if x > high else x


def read_header(payload: bytes, tables: Tables) -> tuple[Header, Bools]:
    """The frame's header and the decoder of the first partition, standing at the first macroblock."""
    if len(payload) < 10 or payload[0] & 1 or payload[3:6] != b"\x9d\x01\x2a":
        raise ImageError("not a lossy key frame")
    first = int.from_bytes(payload[:3], "little") >> 5
    h = Header(int.from_bytes(payload[6:8], "little") & 0x3FFF, int.from_bytes(payload[8:10], "little") & 0x3FFF)
    if not h.width or not h.height or 10 + first > len(payload):
        raise ImageError("a lossy frame without size, or cut short")
    b = Bools(payload[10 : 10 + first])
    if b.flag():
        raise ImageError("an unknown colour space")
    b.flag()
    h.segmented = b.flag()
    if h.segmented:
        h.maps, data = b.flag(), b.flag()
        if data:
            h.absolute = b.flag()
            h.segment_step = [b.optional(7) for _ in range(4)]
            h.segment_level = [b.optional(6) for _ in range(4)]
        if h.maps:
            h.segment_probs = [b.optional(8, False, 255) for _ in range(3)]
    h.simple, h.level, h.sharpness, h.adjusts = b.flag(), b.literal(6), b.literal(3), b.flag()
    if h.adjusts and b.flag():
        deltas = [b.optional(6) for _ in range(8)]
        h.reference_delta, h.split_delta = deltas[0], deltas[4]
    h.partitions = _partitions(payload, 10 + first, 1 << b.literal(2))
    h.steps = (b.literal(7), *[b.optional(4) for _ in range(5)])
    b.flag()
    tokens = tables.tokens.copy()
    for at in np.ndindex(tokens.shape):
        if b.bit(int(tables.updates[at])):
            tokens[at] = b.literal(8)
    h.tokens = tokens.tolist()
    h.skip_prob = b.literal(8) if b.flag() else None
    b.check()
    return h, b


def _partitions(payload: bytes, at: int, n: int) -> list[Bools]:
    """n - 1 sizes of three bytes, then the partitions; the last takes the rest."""
    start, out = at + 3 * (n - 1), []
    for k in range(n):
        size = int.from_bytes(payload[at + 3 * k : at + 3 * k + 3], "little") if k < n - 1 else max(0, len(payload) - start)
        if start + size > len(payload):
            raise ImageError("a partition outside its frame")
        out.append(Bools(payload[start : start + size]))
        start += size
    return out


def steps(h: Header, segment: int) -> tuple:
    """(DC, AC) steps of luma, of the luma DCs' own block, and of chroma."""
    base, y, y2, y2a, uv, uva = h.steps
    if h.segmented:
        base = h.segment_step[segment] + (0 if h.absolute else base)
    dc, ac = (lambda d: DC_STEP[_clip(base + d, 0, 127)]), (lambda d: AC_STEP[_clip(base + d, 0, 127)])
    return (dc(y), ac(0)), (2 * dc(y2), max(8, ac(y2a) * 155 // 100)), (min(132, dc(uv)), ac(uva))


def read_block(b: Bools, probs: list, context: int, first: int, step: tuple, out: np.ndarray) -> bool:
    """Read one block's tokens into out; whether it had any."""
    bit, at, p = b.bit, first, probs[BANDS[first]][context]
    while at < 16 and bit(p[0]):
        while not bit(p[1]):
            at += 1
            if at == 16:
                return True
            p = probs[BANDS[at]][0]
        if not bit(p[2]):
            v = 1
        elif not bit(p[3]):
            v = 3 + bit(p[5]) if bit(p[4]) else 2
        else:
            if not bit(p[6]):
                low, more = CATEGORIES[bit(p[7])]
            else:
                high = bit(p[8])
                low, more = CATEGORIES[2 + 2 * high + bit(p[9 + high])]
            v = 0
            for q in more:
                v = 2 * v + bit(q)
            v += low
        out[ZIGZAG[at]] = (-v if bit(128) else v) * step[at > 0]
        at += 1
        if at < 16:
            p = probs[BANDS[at]][min(v, 2)]
    return at > first


def inverse_dct(c: np.ndarray) -> np.ndarray:
    """Blocks (..., 4, 4) of coefficients to residuals."""

    def once(x, axis):
        a, b, c, d = np.moveaxis(x, axis, 0)
        even, odd = a + c, a - c
        low = (b * 35468 >> 16) - d - (d * 20091 >> 16)
        high = b + (b * 20091 >> 16) + (d * 35468 >> 16)
        return np.stack([even + high, odd + low, odd - low, even - high], axis)

    return once(once(c, -2), -1) + 4 >> 3


def inverse_wht(c: np.ndarray) -> np.ndarray:
    def once(x, axis):
        a, b, c, d = np.moveaxis(x, axis, 0)
        return np.stack([a + d + b + c, b - c + a - d, a + d - b - c, a - d - b + c], axis)

    return once(once(c, -2), -1) + 3 >> 3


def predict_block(mode: int, above: list, left: list, corner: int) -> np.ndarray:
    """A 4 x 4 block from 8 pixels above, 4 at the left and the corner."""
    e = [*left[::-1], corner, *above]
    mid = lambda k: e[k - 1] + 2 * e[k] + e[k + 1] + 2 >> 2
    two = lambda k: e[k] + e[k + 1] + 1 >> 1
    if mode == B_DC:
        return np.full((4, 4), sum(above[:4]) + sum(left) + 4 >> 3)
    if mode == B_TM:
        return np.clip(np.array(left)[:, None] + np.array(above[:4]) - corner, 0, 255)
    if mode == B_VE:
        return np.array([[mid(5 + c) for c in range(4)]] * 4)
    if mode == B_HE:
        rows = [mid(3), mid(2), mid(1), e[1] + 3 * e[0] + 2 >> 2]
        return np.repeat(rows, 4).reshape(4, 4)
    if mode == B_LD:
        e.append(e[-1])
        value = lambda r, c: mid(6 + r + c)
    elif mode == B_RD:
        value = lambda r, c: mid(4 + c - r)
    elif mode == B_VR:
        value = lambda r, c: mid(5 + 2 * c - r) if 2 * c < r else mid(4 + (2 * c - r + 1) // 2) if r & 1 else two(4 + c - r // 2)
    elif mode == B_VL:
        value = lambda r, c: mid(8 + r) if c == 3 and r > 1 else mid(6 + c + r // 2) if r & 1 else two(5 + c + r // 2)
    elif mode == B_HD:
        value = lambda r, c: mid(3 + c - 2 * r) if 2 * r < c else mid(4 - (2 * r - c + 1) // 2) if c & 1 else two(3 - r + c // 2)
    else:
        far = [*left, left[3], left[3], left[3], left[3], left[3]]
        value = lambda r, c: (far[r + c // 2] + 2 * far[r + c // 2 + 1] + far[r + c // 2 + 2] + 2 >> 2) if c & 1 else far[r + c // 2] + far[r + c // 2 + 1] + 1 >> 1
    return np.array([[value(r, c) for c in range(4)] for r in range(4)])


def predict_square(plane: np.ndarray, mode: int, y: int, x: int, n: int) -> np.ndarray:
    """An n x n block at row y, column x of a plane with a border of one row above and one column at the left."""
    above, left = plane[y - 1, x : x + n], plane[y : y + n, x - 1]
    if mode == V:
        return np.tile(above, (n, 1))
    if mode == H:
        return np.tile(left[:, None], (1, n))
    if mode == TM:
        return np.clip(left[:, None] + above - plane[y - 1, x - 1], 0, 255)
    seen = [s for s, known in ((above, y > 1), (left, x > 1)) if known]
    return np.full((n, n), (sum(int(s.sum()) for s in seen) + n * len(seen) // 2) // (n * len(seen)) if seen else 128)


def bordered(rows: int, columns: int) -> np.ndarray:
    p = np.full((rows + 1, columns + 1), 129, np.int64)
    p[0] = 127
    return p


@dataclass
class Macroblock:
    segment: int
    mode: int
    submodes: list
    chroma: int
    coded: bool


def _read_macroblocks(h: Header, b: Bools, tables: Tables):
    rows, columns = h.height + 15 >> 4, h.width + 15 >> 4
    coefficients = np.zeros((rows, columns, 25, 16), np.int64)
    blocks, above_modes = [], [[B_DC] * 4 for _ in range(columns)]
    above = np.zeros((columns, 9), int).tolist()
    for y in range(rows):
        part, left, left_modes = h.partitions[y % len(h.partitions)], [0] * 9, [B_DC] * 4
        for x in range(columns):
            segment = b.tree(SEGMENT_TREE, h.segment_probs) if h.maps else 0
            skip = bool(b.bit(h.skip_prob)) if h.skip_prob is not None else False
            mode = b.tree(LUMA_TREE, LUMA_PROBS)
            sub = []
            for k in range(16):
                r, c = divmod(k, 4)
                m = b.tree(SUBMODE_TREE, tables.submodes[above_modes[x][c]][left_modes[r]]) if mode == SPLIT else SUBMODE[mode]
                above_modes[x][c] = left_modes[r] = m
                sub.append(m)
            chroma = b.tree(CHROMA_TREE, CHROMA_PROBS)
            coded = False
            if skip:
                above[x][:8], left[:8] = [0] * 8, [0] * 8
                if mode != SPLIT:
                    above[x][8] = left[8] = 0
            else:
                coded = _read_residual(part, h.tokens, steps(h, segment), mode, above[x], left, coefficients[y, x])
            blocks.append(Macroblock(segment, mode, sub, chroma, coded))
        b.check()
        part.check()
    return blocks, coefficients


def _read_residual(part: Bools, probs: list, step: tuple, mode: int, above: list, left: list, out: np.ndarray) -> bool:
    """Read a macroblock's 25 blocks: 16 of luma, 4 + 4 of chroma and the luma DCs' own. Whether any had tokens."""
    kind, first, coded = 3, 0, False
    if mode != SPLIT:
        kind, first = 0, 1
        coded = read_block(part, probs[1], above[8] + left[8], 0, step[1], out[24])
        above[8] = left[8] = int(coded)
    for k in range(24):
        if k < 16:
            (r, c), p, at, s = divmod(k, 4), probs[kind], first, step[0]
        else:
            base = 4 if k < 20 else 6
            r, c, p, at, s = base + (k >> 1 & 1), base + (k & 1), probs[2], 0, step[2]
        got = read_block(part, p, above[c] + left[r], at, s, out[k])
        above[c] = left[r] = int(got)
        coded |= got
    return coded


def _residuals(blocks: list[Macroblock], coefficients: np.ndarray) -> np.ndarray:
    rows, columns = coefficients.shape[:2]
    own = inverse_wht(coefficients[:, :, 24].reshape(rows, columns, 4, 4)).reshape(rows, columns, 16)
    split = np.array([m.mode == SPLIT for m in blocks]).reshape(rows, columns, 1)
    coefficients[:, :, :16, 0] = np.where(split, coefficients[:, :, :16, 0], own)
    return inverse_dct(coefficients[:, :, :24].reshape(rows, columns, 24, 4, 4))


def _square(blocks: np.ndarray, n: int) -> np.ndarray:
    return blocks.reshape(n, n, 4, 4).swapaxes(1, 2).reshape(4 * n, 4 * n)


def _luma_blocks(plane: np.ndarray, m: Macroblock, residual: np.ndarray, top: int, at: int, last: bool) -> None:
    """Predict and add block by block. The fourth column's blocks see the row above the macroblock at their right."""
    over = plane[top - 1]
    right = [int(over[at + 15])] * 4 if last else over[at + 16 : at + 20].tolist()
    for k, mode in enumerate(m.submodes):
        y, x = top + 4 * (k >> 2), at + 4 * (k & 3)
        above = plane[y - 1, x : x + 4].tolist() + (right if k & 3 == 3 else plane[y - 1, x + 4 : x + 8].tolist())
        made = predict_block(mode, above, plane[y : y + 4, x - 1].tolist(), int(plane[y - 1, x - 1]))
        plane[y : y + 4, x : x + 4] = np.clip(made + residual[k], 0, 255)


def _reconstruct(blocks: list[Macroblock], residual: np.ndarray) -> list[np.ndarray]:
    rows, columns = residual.shape[:2]
    luma, *chroma = bordered(16 * rows, 16 * columns), bordered(8 * rows, 8 * columns), bordered(8 * rows, 8 * columns)
    for k, m in enumerate(blocks):
        y, x = divmod(k, columns)
        own, top, at = residual[y, x], 16 * y + 1, 16 * x + 1
        if m.mode == SPLIT:
            _luma_blocks(luma, m, own, top, at, x == columns - 1)
        else:
            luma[top : top + 16, at : at + 16] = np.clip(predict_square(luma, m.mode, top, at, 16) + _square(own[:16], 4), 0, 255)
        top, at = 8 * y + 1, 8 * x + 1
        for plane, part in zip(chroma, (own[16:20], own[20:24]), strict=True):
            plane[top : top + 8, at : at + 8] = np.clip(predict_square(plane, m.chroma, top, at, 8) + _square(part, 2), 0, 255)
    return [p[1:, 1:] for p in (luma, *chroma)]


def filter_limits(h: Header, m: Macroblock) -> tuple[int, int, int]:
    """(level, interior limit, threshold of high variance) of a macroblock."""
    level = h.level
    if h.segmented:
        level = _clip(h.segment_level[m.segment] + (0 if h.absolute else level), 0, 63)
    if h.adjusts:
        level = _clip(level + h.reference_delta + (h.split_delta if m.mode == SPLIT else 0), 0, 63)
    inner = level >> (2 if h.sharpness > 4 else 1) if h.sharpness else level
    if h.sharpness:
        inner = min(inner, 9 - h.sharpness)
    return level, max(inner, 1), (level >= 15) + (level >= 40)


def filter_edge(p: np.ndarray, kind: str, edge: int, inner: int = 0, high: int = 0) -> None:
    """Smooth, in place, the rows of p: four pixels before an edge and four after it. kind: simple, block or macro."""
    gaps = np.abs(np.diff(p, axis=1))
    go = 2 * gaps[:, 3] + (np.abs(p[:, 2] - p[:, 5]) >> 1) <= edge
    varied = np.ones(len(p), bool)
    if kind != "simple":
        go &= (np.delete(gaps, 3, 1) <= inner).all(1)
        varied = (gaps[:, 2] > high) | (gaps[:, 4] > high)
    if not go.any():
        return
    s = p - 128
    outer = np.clip(s[:, 2] - s[:, 5], -128, 127)
    w = np.clip(3 * (s[:, 4] - s[:, 3]) + (outer * varied if kind == "block" else outer), -128, 127)
    after, before = np.minimum(w + 4, 127) >> 3, np.minimum(w + 3, 127) >> 3
    near, soft = go & varied if kind == "macro" else go, go & ~varied
    s[:, 4] -= after * near
    s[:, 3] += before * near
    if kind == "block":
        s[:, 5] -= (after + 1 >> 1) * soft
        s[:, 2] += (after + 1 >> 1) * soft
    elif kind == "macro":
        for k, weight in enumerate((27, 18, 9)):
            a = np.clip(weight * w + 63 >> 7, -128, 127) * soft
            s[:, 4 + k] -= a
            s[:, 3 - k] += a
    p[:] = np.clip(s, -128, 127) + 128


def _loop_filter(h: Header, blocks: list[Macroblock], planes: list[np.ndarray]) -> None:
    """Macroblocks in raster order; in each the left edge, inner columns, the top edge, inner rows."""
    columns = h.width + 15 >> 4
    sized = [(planes[0], 16)] if h.simple else list(zip(planes, (16, 8, 8), strict=True))
    for k, m in enumerate(blocks):
        (y, x), (level, inner, high) = divmod(k, columns), filter_limits(h, m)
        if not level:
            continue
        strong, weak = 2 * (level + 2) + inner, 2 * level + inner
        for plane, n in sized:
            square = plane[n * y : n * y + n], plane[:, n * x : n * x + n].T
            for lines, at, start in ((square[0], n * x, x), (square[1], n * y, y)):
                if start:
                    filter_edge(lines[:, at - 4 : at + 4], "simple" if h.simple else "macro", strong, inner, high)
                for step in range(4, n, 4) if m.coded or m.mode == SPLIT else ():
                    filter_edge(lines[:, at + step - 4 : at + step + 4], "simple" if h.simple else "block", weak, inner, high)


def decode_planes(payload: bytes, tables: Tables) -> tuple[Header, list[np.ndarray]]:
    """Y, U and V, padded to whole macroblocks."""
    h, b = read_header(payload, tables)
    blocks, coefficients = _read_macroblocks(h, b, tables)
    planes = _reconstruct(blocks, _residuals(blocks, coefficients))
    if h.level:
        _loop_filter(h, blocks, planes)
    return h, planes


def upsample(plane: np.ndarray, width: int, height: int, fancy: bool) -> np.ndarray:
    """Chroma of each pixel: that of its 2 x 2 square or, if fancy, 9:3:3:1 of the nearest four."""
    rows, columns = np.arange(height), np.arange(width)
    near = plane[rows[:, None] >> 1, columns >> 1]
    if not fancy:
        return near
    y = np.clip((rows >> 1) + 2 * (rows & 1) - 1, 0, (height - 1) >> 1)[:, None]
    x = np.clip((columns >> 1) + 2 * (columns & 1) - 1, 0, (width - 1) >> 1)
    return 9 * near + 3 * plane[y, columns >> 1] + 3 * plane[rows[:, None] >> 1, x] + plane[y, x] + 8 >> 4


def to_argb(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    part = lambda x, k: x * k >> 8
    base = part(y, 19077)
    r, g, b = base + part(v, 26149) - 14234, base - part(u, 6419) - part(v, 13320) + 8708, base + part(u, 33050) - 17685
    r, g, b = (np.clip(x >> 6, 0, 255) for x in (r, g, b))
    return (255 << 24 | r << 16 | g << 8 | b).astype(np.uint32)


def rgb_bytes(argb: np.ndarray) -> bytes:
    """Three bytes a pixel, red first."""
    return np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255], axis=-1).astype(np.uint8).tobytes()


def decode(payload: bytes, tables: Tables, fancy: bool = False) -> np.ndarray:
    """Pixels (height, width), 0xAARRGGBB."""
    h, (y, u, v) = decode_planes(payload, tables)
    return to_argb(y[: h.height, : h.width], *(upsample(p, h.width, h.height, fancy) for p in (u, v)))
