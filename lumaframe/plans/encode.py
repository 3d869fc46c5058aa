"""Writes small image files from pixels, so that readers and decoders can be held against tables: lossless
payloads with every transform, copies and the colour cache; still and animated containers. Test data only."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from lumaframe.kernels import container, vp8l


class BitWriter:
    """From the least significant bit of each byte on."""

    def __init__(self):
        self.done, self.value, self.count = bytearray(), 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.count
        self.count += n
        while self.count >= 64:
            self.done += (self.value & (1 << 64) - 1).to_bytes(8, "little")
            self.value, self.count = self.value >> 64, self.count - 64

    def bytes(self) -> bytes:
        return bytes(self.done) + self.value.to_bytes(self.count // 8 + 1, "little")


class FlatCode:
    """A complete prefix code of n symbols of which the first are one bit shorter. Words and description are made once."""

    def __init__(self, n: int):
        self.n, self.top = n, (n - 1).bit_length()
        self.short = (1 << self.top) - n
        self.words = [self._word(s) for s in range(n)]
        self.described = self._described()

    def length(self, symbol: int) -> int:
        return self.top - (symbol < self.short)

    def _word(self, symbol: int) -> tuple[int, int]:
        n = self.length(symbol)
        code = symbol if symbol < self.short else 2 * self.short + symbol - self.short
        return int(f"{code:0{n}b}"[::-1], 2), n

    def _described(self) -> tuple[int, int]:
        used = sorted({self.length(0), self.length(self.n - 1)})
        count = max(4, max(vp8l.LENGTH_ORDER.index(x) for x in used) + 1)
        parts = [(0, 1), (count - 4, 4), *((int(vp8l.LENGTH_ORDER[k] in used), 3) for k in range(count)), (0, 1)]
        if len(used) > 1:
            parts += [(int(self.length(s) == used[1]), 1) for s in range(self.n)]
        value, bits = 0, 0
        for v, n in parts:
            value, bits = value | v << bits, bits + n
        return value, bits

    def describe(self, out: BitWriter) -> None:
        out.put(*self.described)

    def put(self, out: BitWriter, symbol: int) -> None:
        out.put(*self.words[symbol])


flat_code = lru_cache(maxsize=32)(FlatCode)


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix symbol, further bits, their number) of a length or distance code."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    return 2 * high + (v >> high - 1 & 1), v & (1 << high - 1) - 1, high - 1


def entropy(out: BitWriter, pixels: list[int], width: int, top: bool, cache_bits: int = 0, copies: bool = False) -> None:
    """Literals, hits of the cache and, with copies, rows equal to the row above as one copy of that row."""
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if top:
        out.put(0, 1)
    codes = [flat_code(n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]
    for code in codes:
        code.describe(out)
    cache, at = {}, 0
    key = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> 32 - cache_bits
    while at < len(pixels):
        if copies and at >= width and at % width == 0 and pixels[at : at + width] == pixels[at - width : at]:
            for code, value in ((codes[0], width), (codes[4], 1)):  # distance code 1 is the place above
                symbol, more, n = _prefix(value)
                code.put(out, symbol + (256 if code is codes[0] else 0))
                out.put(more, n)
            done = pixels[at : at + width]
        elif cache_bits and cache.get(key(pixels[at])) == pixels[at]:
            codes[0].put(out, 280 + key(pixels[at]))
            done = pixels[at : at + 1]
        else:
            p = pixels[at]
            for code, shift in zip(codes, (8, 16, 0, 24), strict=False):
                code.put(out, p >> shift & 255)
            done = pixels[at : at + 1]
        if cache_bits:
            cache.update((key(p), p) for p in done)
        at += len(done)


def _less(a: int, b: int) -> int:
    return sum(((a >> s & 255) - (b >> s & 255) & 255) << s for s in (0, 8, 16, 24))


def predicted(pixels: list[int], width: int, mode: int) -> list[int]:
    """What is left of the pixels after prediction by one mode."""
    out = []
    for at, p in enumerate(pixels):
        y, x = divmod(at, width)
        if at == 0:
            guess = vp8l.OPAQUE
        elif y == 0 or x == 0:
            guess = pixels[at - 1] if y == 0 else pixels[at - width]
        else:
            guess = vp8l.PREDICTORS[mode](pixels[at - 1], pixels[at - width], pixels[at - width + 1], pixels[at - width - 1])
        out.append(_less(p, guess))
    return out


def without_green(p: int) -> int:
    g = p >> 8 & 255
    return _less(p, g << 16 | g)


def recoloured(p: int, element: int) -> int:
    s8 = lambda v: (v & 255 ^ 128) - 128
    green, red = s8(p >> 8), s8(p >> 16)
    to_red = s8(element) * green >> 5
    to_blue = (s8(element >> 8) * green >> 5) + (s8(element >> 16) * red >> 5)
    return _less(p, (to_red & 255) << 16 | to_blue & 255)


def lossless(pixels: list[int], width: int, height: int, kind: str = "plain", value: int = 0) -> bytes:
    """kind: predict (value: the mode), colour (value: the element, subtract-green after it), palette, copies (value:
    bits of the cache) or plain."""
    out = BitWriter()
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(v, n)
    blocks = vp8l.subsample(width, 2) * vp8l.subsample(height, 2)
    if kind == "predict":
        for v, n in ((1, 1), (0, 2), (0, 3)):
            out.put(v, n)
        entropy(out, [value << 8] * blocks, vp8l.subsample(width, 2), False)
        pixels = predicted(pixels, width, value)
    elif kind == "colour":
        for v, n in ((1, 1), (1, 2), (0, 3)):
            out.put(v, n)
        entropy(out, [value] * blocks, vp8l.subsample(width, 2), False)
        for v, n in ((1, 1), (2, 2)):
            out.put(v, n)
        pixels = [without_green(recoloured(p, value)) for p in pixels]
    elif kind == "palette":
        colours = sorted(set(pixels))
        for v, n in ((1, 1), (3, 2), (len(colours) - 1, 8)):
            out.put(v, n)
        entropy(out, [colours[0], *(_less(b, a) for a, b in zip(colours, colours[1:], strict=False))], len(colours), False)
        bits = 0 if len(colours) > 16 else 1 if len(colours) > 4 else 2 if len(colours) > 2 else 3
        size, index = 8 >> bits, [colours.index(p) for p in pixels]
        rows = [index[y * width : (y + 1) * width] for y in range(height)]
        pixels = [sum(v << k * size for k, v in enumerate(r[x : x + (1 << bits)])) << 8 for r in rows for x in range(0, width, 1 << bits)]
        width = vp8l.subsample(width, bits)
    out.put(0, 1)
    entropy(out, pixels, width, True, value if kind == "copies" else 0, kind == "copies")
    return out.bytes()


def chunk(code: bytes, data: bytes) -> bytes:
    return code + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)


def riff(*parts: bytes) -> bytes:
    body = b"WEBP" + b"".join(parts)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def extended(width: int, height: int, flags: int) -> bytes:
    return chunk(b"VP8X", bytes([flags, 0, 0, 0]) + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little"))


def animation(loops: int, background: bytes = b"\1\2\3\4") -> bytes:
    return chunk(b"ANIM", background + loops.to_bytes(2, "little"))


def frame(x: int, y: int, width: int, height: int, ms: int, blend: bool, dispose: bool, *parts: bytes) -> bytes:
    head = b"".join(v.to_bytes(3, "little") for v in (x // 2, y // 2, width - 1, height - 1, ms))
    return chunk(b"ANMF", head + bytes([(not blend) << 1 | dispose]) + b"".join(parts))


def lossy_head(width: int, height: int) -> bytes:
    """The start of a lossy key frame: enough for readers of headers."""
    return b"\x10\0\0\x9d\x01\x2a" + width.to_bytes(2, "little") + height.to_bytes(2, "little")


def sample_file(number: int, pixels: list[int]) -> bytes:
    """One of six kinds of files, by the number: simple lossless, simple lossy (its head), still with metadata,
    animation, frames without the animation flag, and one cut short. pixels: 8 x 8."""
    kind, still = number % 6, chunk(b"VP8L", lossless(pixels, 8, 8))
    part = chunk(b"VP8L", lossless(pixels[:16], 4, 4))
    if kind == 0:
        return riff(still) + b"trailing"
    if kind == 1:
        return riff(chunk(b"VP8 ", lossy_head(number % 1000 + 1, number % 77 + 1)))
    if kind == 2:
        flags = container.ALPHA | container.ICC | (container.EXIF if number % 4 == 0 else 0)
        return riff(extended(8, 8, flags), chunk(b"ICCP", b"i" * (number % 5)), chunk(b"JUNK", b"j"), still, chunk(b"EXIF", b"e" * 3), chunk(b"XMP ", b"x"))
    if kind == 3:
        return riff(
            extended(8, 8, container.ANIMATED | container.ALPHA), animation(number % 9), frame(0, 0, 8, 8, 40, True, False, still),
            frame(2, 4, 4, 4, number % 300, number % 2 == 0, True, part),
        )
    if kind == 4:
        return riff(extended(8, 8, 0), frame(0, 0, 4, 4, 70, True, False, chunk(b"ALPH", b"\0" * 17), part))
    return riff(extended(8, 8, 0), still)[: 30 + number % 40]


def composed_file(number: int, pixels: list[int]) -> bytes:
    """Three frames over one canvas of 8 x 8: all of it, a square at (2, 2), the lower half."""
    first, square, half = (chunk(b"VP8L", lossless(p, w, h)) for p, w, h in ((pixels, 8, 8), (pixels[:16], 4, 4), (pixels[16:48], 8, 4)))
    return riff(
        extended(8, 8, container.ANIMATED | container.ALPHA), animation(0), frame(0, 0, 8, 8, 10, True, False, first),
        frame(2, 2, 4, 4, 20, number % 2 == 0, number % 3 == 0, square), frame(0, 4, 8, 4, 30, True, False, half),
    )
