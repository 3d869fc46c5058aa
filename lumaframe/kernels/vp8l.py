"""Lossless image payloads, after the public VP8L bitstream specification."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


class ImageError(ValueError):
    """The bytes are not a well-formed image."""


# Fixed values of the specification: the order in which lengths of the code-length code are stored, and the
# places (to the left, above) that the first 120 distance codes mean.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
OPAQUE = 0xFF000000


class Bits:
    """Reads from the least significant bit of each byte on."""

    def __init__(self, data: bytes):
        self.data, self.at, self.have, self.count = data, 0, 0, 0

    def peek(self, n: int) -> int:
        while self.count < n:
            part = self.data[self.at : self.at + 8]
            self.have |= int.from_bytes(part, "little") << self.count
            self.count += 64  # zeros after the end; skip() notices their use
            self.at += 8
        return self.have & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.have >>= n
        self.count -= n
        if 8 * self.at - self.count > 8 * len(self.data):
            raise ImageError("the payload ends early")

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.skip(n)
        return value


#: Bits of one byte in the other order.
TURNED = tuple(int(f"{k:08b}"[::-1], 2) for k in range(256))


@lru_cache(maxsize=64)
def _table(lengths: bytes) -> tuple[tuple[int, int], ...]:
    """(symbol, bits) for every value of the longest word's bits, of a complete code; symbols by length, then number. Files of
    one writer often have equal codes, so the last few tables (of up to 2**15 entries) stay."""
    longest = max(lengths)
    table, code, before = [(0, 0)] * (1 << longest), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - before
        before = n
        turned = (TURNED[code & 255] << 8 | TURNED[code >> 8]) >> 16 - n
        if n == longest:
            table[turned] = (s, n)
        else:
            table[turned :: 1 << n] = [(s, n)] * (1 << longest - n)
        code += 1
    return tuple(table)


class Code:
    """Canonical prefix code. With one symbol, reading it takes no bits."""

    @classmethod
    def pair(cls, first: int, second: int) -> Code:
        """Bit 0 is the first symbol, bit 1 the second; a bit is read even if they are equal."""
        code = cls.__new__(cls)
        code.bits, code.only, code.table = 1, None, [(first, 1), (second, 1)]
        return code

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        self.bits, self.only = max(lengths, default=0), used[0] if len(used) == 1 else None
        if not used:
            raise ImageError("a prefix code without symbols")
        if self.only is not None:
            self.bits, self.table = 0, [(self.only, 0)]
            return
        if sum(1 << (15 - lengths[s]) for s in used) != 1 << 15:
            raise ImageError("a prefix code that isn't complete")
        self.table = _table(bytes(lengths))

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        symbol, n = self.table[bits.peek(self.bits)]
        bits.skip(n)
        return symbol


def _read_code(bits: Bits, symbols: int) -> Code:
    lengths = [0] * symbols
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        named = [bits.read(8 if wide else 1), *([bits.read(8)] if two else [])]
        if max(named) >= symbols:
            raise ImageError("a symbol beyond its alphabet")
        if two:
            return Code.pair(*named)
        lengths[named[0]] = 1
        return Code(lengths)
    own = [0] * 19
    for k in range(4 + bits.read(4)):
        own[LENGTH_ORDER[k]] = bits.read(3)
    code = Code(own)
    left = symbols
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
        if left > symbols:
            raise ImageError("more code lengths than symbols")
    if code.only is not None and code.only < 16:  # every length is the same and takes no bits
        return Code([code.only] * left + [0] * (symbols - left))
    at, last = 0, 8
    table, mask, end = code.table, (1 << code.bits) - 1, 8 * len(bits.data)
    while at < symbols and left:
        left -= 1
        if bits.count < 16:
            bits.peek(16)
        s, used = table[bits.have & mask]
        bits.have >>= used
        bits.count -= used
        if 8 * bits.at - bits.count > end:
            raise ImageError("the payload ends early")
        if s < 16:
            lengths[at] = s
            last = s or last
            at += 1
            continue
        n, value = {16: (2, last), 17: (3, 0), 18: (7, 0)}[s]
        times = (11 if s == 18 else 3) + bits.read(n)
        if at + times > symbols:
            raise ImageError("code lengths run over their alphabet")
        lengths[at : at + times] = [value] * times
        at += times
    return Code(lengths)


def _extended(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + bits.read(n) + 1


def _pixels(bits: Bits, width: int, height: int, top: bool) -> list[int]:
    """An entropy-coded image; the top one may choose among groups of codes by block."""
    cached = bits.read(1)
    cache_bits = bits.read(4) if cached else 0
    if cached and not 1 <= cache_bits <= 11:
        raise ImageError("a colour cache of a size that isn't allowed")
    cache = [0] * (1 << cache_bits) if cache_bits else []
    groups, block, blocks, per_row = 1, 0, [0], 1
    if top and bits.read(1):
        block = bits.read(3) + 2
        per_row, rows = subsample(width, block), subsample(height, block)
        blocks = [(p >> 8) & 0xFFFF for p in _pixels(bits, per_row, rows, False)]
        groups = max(blocks) + 1
    sizes = (280 + len(cache), 256, 256, 256, 40)
    codes = [[_read_code(bits, n) for n in sizes] for _ in range(groups)]
    out = _entropy_coded(bits, [[(c.table, (1 << c.bits) - 1) for c in g] for g in codes], width, width * height, cache, cache_bits, blocks, block, per_row)
    bits.skip(0)
    return out


def _entropy_coded(bits: Bits, codes: list, width: int, total: int, cache: list[int], cache_bits: int, blocks: list[int], block: int, per_row: int) -> list[int]:
    """The pixels themselves. The bit buffer lives in local names here: this loop is most of the time that a
    lossless image takes."""
    data, pos, have, count, end = bits.data, bits.at, bits.have, bits.count, 8 * len(bits.data)
    out: list[int] = []
    n, entered = 0, 0
    group, change = codes[blocks[0]], total if not block else 0
    (green, green_mask), (red, red_mask), (blue, blue_mask), (alpha, alpha_mask), (far_code, far_mask) = group
    if not green_mask | red_mask | blue_mask | alpha_mask and not block and green[0][0] < 256:
        return [alpha[0][0] << 24 | red[0][0] << 16 | green[0][0] << 8 | blue[0][0]] * total  # one pixel, no bits
    while n < total:
        if n >= change:
            y, x = divmod(n, width)
            (green, green_mask), (red, red_mask), (blue, blue_mask), (alpha, alpha_mask), (far_code, far_mask) = codes[blocks[(y >> block) * per_row + (x >> block)]]
            change = min(n - x + width, n + (1 << block) - (x & (1 << block) - 1))
        if count < 64:
            if 8 * pos - count > end:
                raise ImageError("the data ends early")
            have |= int.from_bytes(data[pos : pos + 8], "little") << count
            pos, count = pos + 8, count + 64
        s, used = green[have & green_mask]
        have >>= used
        count -= used
        if s < 256:
            r, used = red[have & red_mask]
            have >>= used
            count -= used
            b, used = blue[have & blue_mask]
            have >>= used
            count -= used
            a, used = alpha[have & alpha_mask]
            have >>= used
            count -= used
            out.append(a << 24 | r << 16 | s << 8 | b)
            n += 1
        elif s < 280:
            bits.have, bits.count, bits.at = have, count, pos
            length = _extended(bits, s - 256)
            s, used = far_code[bits.peek(15) & far_mask]
            bits.skip(used)
            far = _extended(bits, s)
            have, count, pos = bits.have, bits.count, bits.at
            if far > 120:
                far -= 120
            else:
                dx, dy = NEAR[far - 1]
                far = max(1, dx + dy * width)
            if far > n or n + length > total:
                raise ImageError("a copy from outside the image")
            start = n - far
            if far >= length:
                out += out[start : start + length]
            else:
                out += (out[start:] * (length // far + 1))[:length]
            n += length
        else:
            for p in out[entered:]:
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            entered = n
            out.append(cache[s - 280])
            n += 1
    bits.have, bits.count, bits.at = have, count, pos
    return out


def subsample(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


def _sum(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _mean(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _parts(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _joined(parts) -> int:
    a, r, g, b = (min(max(x, 0), 255) for x in parts)
    return a << 24 | r << 16 | g << 8 | b


def _select(left: int, top: int, corner: int) -> int:
    to_left = sum(abs(t - c) for t, c in zip(_parts(top), _parts(corner), strict=True))
    to_top = sum(abs(x - c) for x, c in zip(_parts(left), _parts(corner), strict=True))
    return left if to_left < to_top else top


def _full(left: int, top: int, corner: int) -> int:
    return _joined(x + t - c for x, t, c in zip(_parts(left), _parts(top), _parts(corner), strict=True))


def _half(mean: int, corner: int) -> int:
    return _joined(m + int((m - c) / 2) for m, c in zip(_parts(mean), _parts(corner), strict=True))


#: By mode, from left, top, top right and top left.
PREDICTORS = (
    lambda x, t, tr, tl: OPAQUE,
    lambda x, t, tr, tl: x,
    lambda x, t, tr, tl: t,
    lambda x, t, tr, tl: tr,
    lambda x, t, tr, tl: tl,
    lambda x, t, tr, tl: _mean(_mean(x, tr), t),
    lambda x, t, tr, tl: _mean(x, tl),
    lambda x, t, tr, tl: _mean(x, t),
    lambda x, t, tr, tl: _mean(tl, t),
    lambda x, t, tr, tl: _mean(t, tr),
    lambda x, t, tr, tl: _mean(_mean(x, tl), _mean(t, tr)),
    lambda x, t, tr, tl: _select(x, t, tl),
    lambda x, t, tr, tl: _full(x, t, tl),
    lambda x, t, tr, tl: _half(_mean(x, t), tl),
)


def _in_blocks(plane: np.ndarray, bits: int, height: int, width: int) -> np.ndarray:
    """A value of each block to one of each pixel."""
    return np.repeat(np.repeat(plane, 1 << bits, axis=0)[:height], 1 << bits, axis=1)[:, :width]


def _halves(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a & b) + ((a ^ b) >> 1)


#: Modes that need nothing of their own row: from top left, top, top right.
BY_ROW = {2: lambda tl, t, tr: t, 3: lambda tl, t, tr: tr, 4: lambda tl, t, tr: tl, 8: lambda tl, t, tr: _halves(tl, t), 9: lambda tl, t, tr: _halves(t, tr)}


def _chosen(x: np.ndarray, t: np.ndarray, tl: np.ndarray) -> np.ndarray:
    far = lambda a: np.abs(a.astype(np.int16) - tl).sum(1)
    return np.where((far(t) < far(x))[:, None], x, t)


def _half_of(m: np.ndarray, tl: np.ndarray) -> np.ndarray:
    d = m.astype(np.int16) - tl
    return np.clip(m + (d + (d < 0) >> 1), 0, 255).astype(np.uint8)


#: Modes that need the pixel at the left, on rows of channels: from left, top, top right, top left.
BY_WAVE = {
    5: lambda x, t, tr, tl: _halves(_halves(x, tr), t), 6: lambda x, t, tr, tl: _halves(x, tl), 7: lambda x, t, tr, tl: _halves(x, t),
    10: lambda x, t, tr, tl: _halves(_halves(x, tl), _halves(t, tr)), 11: lambda x, t, tr, tl: _chosen(x, t, tl),
    12: lambda x, t, tr, tl: np.clip(x.astype(np.int16) + t - tl, 0, 255).astype(np.uint8), 13: lambda x, t, tr, tl: _half_of(_halves(x, t), tl),
}
#: Pixels from which on waves pay.
WAVES_FROM = 1 << 14


def _unpredict_by_waves(c: np.ndarray, bits: int, by_block: np.ndarray) -> None:
    """Rows after the first: what a pixel needs lies at a smaller x + 2 y, so all of one sum are done at once."""
    height, width = c.shape[:2]
    c[:, 0] = np.cumsum(c[:, 0], axis=0, dtype=np.uint8)
    flat, present = c.reshape(-1, 4), np.unique(by_block).tolist()
    for wave in range(3, width + 2 * height - 2):
        y = np.arange(max(1, (wave - width + 2) // 2), min(height - 1, (wave - 1) // 2) + 1)
        x = wave - 2 * y
        at, mode = y * width + x, by_block[y >> bits, x >> bits]
        for m in present:
            own = at if len(present) == 1 else at[mode == m]
            if not len(own) or m > 13:
                continue
            if m == 0:
                flat[own, 3] += np.uint8(255)
            elif m == 1:
                flat[own] += flat[own - 1]
            elif m in BY_ROW:
                flat[own] += BY_ROW[m](flat[own - width - 1], flat[own - width], flat[own - width + 1])
            else:
                flat[own] += BY_WAVE[m](flat[own - 1], flat[own - width], flat[own - width + 1], flat[own - width - 1])


def unpredict(p: np.ndarray, bits: int, modes: np.ndarray) -> None:
    """In place. Row 0 adds the pixel at the left, column 0 the one above; then the block's mode rules, and modes
    above 13 add nothing. Modes that don't need the row itself go by runs of equal blocks, mode 1 as a sum; of large
    pictures with other modes, all pixels of one x + 2 y go together."""
    height, width = p.shape
    c = p.view(np.uint8).reshape(height, width, 4)
    c[0, 0, 3] = (int(c[0, 0, 3]) + 255) & 255
    c[0] = np.cumsum(c[0], axis=0, dtype=np.uint8)
    by_row = (modes >> 8 & 255).astype(np.int64)
    if p.size >= WAVES_FROM and np.isin(by_row, list(BY_WAVE)).any():
        _unpredict_by_waves(c, bits, by_row)
        return
    for y in range(1, height):
        c[y, 0] += c[y - 1, 0]
        of = by_row[y >> bits]
        starts = np.flatnonzero(np.r_[True, np.diff(of) != 0])
        for k, end in zip(starts.tolist(), [*starts[1:].tolist(), len(of)], strict=True):
            a, b, mode = max(1, k << bits), min(width, end << bits), int(of[k])
            if a >= b or mode > 13:
                continue
            if mode == 0:
                c[y, a:b, 3] += np.uint8(255)
            elif mode == 1:
                c[y, a:b] = np.cumsum(c[y, a - 1 : b], axis=0, dtype=np.uint8)[1:]
            elif mode in BY_ROW:
                # right of the last column the next place in memory is this row's first pixel
                right = c[y - 1, a + 1 : b + 1] if b < width else np.concatenate((c[y - 1, a + 1 :], c[y, :1]))
                c[y, a:b] += BY_ROW[mode](c[y - 1, a - 1 : b - 1], c[y - 1, a:b], right)
            else:
                row, above = p[y, a - 1 : b].tolist(), [*p[y - 1, a - 1 :].tolist(), int(p[y, 0])]
                guess = PREDICTORS[mode]
                for x in range(1, len(row)):
                    row[x] = _sum(row[x], guess(row[x - 1], above[x], above[x + 1], above[x - 1]))
                p[y, a:b] = row[1:]


def uncolour(p: np.ndarray, bits: int, blocks: np.ndarray) -> np.ndarray:
    s8 = lambda v: (v & 255 ^ 128) - 128
    t = _in_blocks(blocks.astype(np.int64), bits, *p.shape)
    wide = p.astype(np.int64)
    green = s8(wide >> 8)
    red = (wide >> 16) + (s8(t) * green >> 5) & 255
    blue = wide + (s8(t >> 8) * green >> 5) + (s8(t >> 16) * s8(red) >> 5) & 255
    return (wide & 0xFF00FF00 | red << 16 | blue).astype(np.uint32)


def add_green(p: np.ndarray) -> np.ndarray:
    wide = p.astype(np.int64)
    green = wide >> 8 & 255
    return (wide & 0xFF00FF00 | ((wide >> 16) + green & 255) << 16 | wide + green & 255).astype(np.uint32)


def unindex(p: np.ndarray, width: int, palette: np.ndarray) -> np.ndarray:
    """Several pixels a byte for palettes of at most 16; an index beyond the palette is transparent."""
    n = len(palette)
    bits = 0 if n > 16 else 1 if n > 4 else 2 if n > 2 else 3
    size, x = 8 >> bits, np.arange(width)
    index = (p >> np.uint32(8) & np.uint32(255))[:, x >> bits].astype(np.int64) >> (x & (1 << bits) - 1) * size & (1 << size) - 1
    return np.r_[palette, np.zeros(256, np.uint32)].astype(np.uint32)[index]


def palette_of(deltas: np.ndarray) -> np.ndarray:
    """Each entry adds to the one before, channel by channel."""
    return np.cumsum(deltas.astype(np.uint32).view(np.uint8).reshape(-1, 4), axis=0, dtype=np.uint8).view(np.uint32).ravel()


def decode(payload: bytes, width: int, height: int, headless: bool = False) -> np.ndarray:
    """(height, width) of unsigned 32-bit pixels. headless: without signature and size, as in alpha planes.

    Raises ImageError for anything malformed."""
    bits = Bits(payload)
    if not headless:
        size = (bits.read(8), bits.read(14) + 1, bits.read(14) + 1)
        bits.read(1)
        if size != (0x2F, width, height) or bits.read(3):
            raise ImageError("not a lossless payload of this size")
    steps, seen, now = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ImageError("a transform twice")
        seen.add(kind)
        if kind in (0, 1):
            block = bits.read(3) + 2
            data = _pixels(bits, subsample(now, block), subsample(height, block), False)
            steps.append((kind, now, block, np.array(data, np.uint32).reshape(-1, subsample(now, block))))
        elif kind == 2:
            steps.append((kind, now, 0, None))
        else:
            n = bits.read(8) + 1
            steps.append((kind, now, 0, palette_of(np.array(_pixels(bits, n, 1, False), np.uint32))))
            now = subsample(now, 0 if n > 16 else 1 if n > 4 else 2 if n > 2 else 3)
    p = np.array(_pixels(bits, now, height, True), np.uint32).reshape(height, now)
    for kind, w, block, data in reversed(steps):
        if kind == 0:
            unpredict(p, block, data)
        elif kind == 1:
            p = uncolour(p, block, data)
        elif kind == 2:
            p = add_green(p)
        else:
            p = unindex(p, w, data)
    return p
