"""Pixel arithmetic as Column expressions.

A pixel is 32 bits, alpha, red, green, blue from the top. Arithmetic is done in BIGINT and masked, as
INT overflow is an error under ANSI; `signed` gives the INT form of a pixel at the edges.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 0xFFFFFFFF


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def wide(x) -> Column:
    """The pixel as a non-negative BIGINT."""
    return _c(x).cast("long").bitwiseAND(F.lit(WORD))


def signed(x) -> Column:
    """The pixel as a signed INT."""
    x = wide(x)
    return F.when(x > 0x7FFFFFFF, x - (1 << 32)).otherwise(x).cast("int")


def byte(x) -> Column:
    return _c(x).cast("long").bitwiseAND(F.lit(255))


def pack(a, r, g, b) -> Column:
    """P1; channels wrap modulo 256."""
    return byte(a) * (1 << 24) + byte(r) * (1 << 16) + byte(g) * (1 << 8) + byte(b)


def opaque(r, g, b) -> Column:
    """P2."""
    return pack(F.lit(255), r, g, b)


def alpha(p) -> Column:
    """P3."""
    return F.shiftright(wide(p), 24)


def red(p) -> Column:
    """P4."""
    return byte(F.shiftright(wide(p), 16))


def green(p) -> Column:
    """P5."""
    return byte(F.shiftright(wide(p), 8))


def blue(p) -> Column:
    """P6."""
    return byte(wide(p))


CHANNELS = (alpha, red, green, blue)


def with_alpha(p, a) -> Column:
    """P7."""
    return wide(p) % (1 << 24) + byte(a) * (1 << 24)


def by_channel(f, *pixels) -> Column:
    return pack(*[f(*[channel(p) for p in pixels]) for channel in CHANNELS])


def add(left, right) -> Column:
    """P8; each channel modulo 256."""
    return by_channel(lambda x, y: x + y, left, right)


def average(left, right) -> Column:
    """P9; each channel, rounded down."""
    return by_channel(lambda x, y: F.shiftright(x + y, 1), left, right)


def avg2(a, b) -> Column:
    """P10; rounded up."""
    return F.shiftright(_c(a) + _c(b) + 1, 1)


def avg3(left, mid, right) -> Column:
    """P11."""
    return F.shiftright(_c(left) + 2 * _c(mid) + _c(right) + 2, 2)


def clamp(x) -> Column:
    return F.least(F.greatest(_c(x), F.lit(0)), F.lit(255))


def halved(x) -> Column:
    """x / 2 rounded towards zero."""
    x = _c(x)
    return F.when(x < 0, -F.shiftright(-x, 1)).otherwise(F.shiftright(x, 1))


def add_subtract_full(a, b, c) -> Column:
    """P12."""
    return clamp(_c(a) + _c(b) - _c(c))


def add_subtract_half(a, b) -> Column:
    """P13."""
    return clamp(_c(a) + halved(_c(a) - _c(b)))


def int8(x) -> Column:
    return byte(x).bitwiseXOR(F.lit(128)) - 128


def colour_delta(t, c) -> Column:
    """P14; both are signed bytes."""
    return F.shiftright(int8(t) * int8(c), 5)


def subsample(size, bits: int) -> Column:
    """P15; size / 2**bits rounded up."""
    return F.shiftright(_c(size) + ((1 << bits) - 1), bits)


def _mul(x, k: int) -> Column:
    return F.shiftright(_c(x).cast("long") * k, 8)


def _clip(x: Column) -> Column:
    return clamp(F.shiftright(x, 6))


def yuv_to_r(y, v) -> Column:
    """P16."""
    return _clip(_mul(y, 19077) + _mul(v, 26149) - 14234)


def yuv_to_g(y, u, v) -> Column:
    """P17."""
    return _clip(_mul(y, 19077) - _mul(u, 6419) - _mul(v, 13320) + 8708)


def yuv_to_b(y, u) -> Column:
    """P18."""
    return _clip(_mul(y, 19077) + _mul(u, 33050) - 17685)


def fancy_chroma(main, side1, side2, far) -> Column:
    """P19; weights 9, 3, 3, 1."""
    return F.shiftright(9 * _c(main) + 3 * _c(side1) + 3 * _c(side2) + _c(far) + 8, 4)


def clamp_signed(x) -> Column:
    """P21."""
    return F.least(F.greatest(_c(x), F.lit(-128)), F.lit(127))


def div255(x) -> Column:
    """x / 255 rounded to nearest, for products of two bytes."""
    x = _c(x) + 128
    return F.shiftright(x + F.shiftright(x, 8), 8)


def blend(src, dst) -> Column:
    """F8; src over dst, neither premultiplied, rounded down after the common scale. Catalyst computes the
    parts that the channels share once."""
    sa, da = alpha(src), alpha(dst)
    kept = div255(da * (255 - sa))
    both = sa + kept
    scale = F.floor(F.lit(1 << 24) / F.greatest(both, F.lit(1)))
    mixed = [F.shiftright((c(src) * sa + c(dst) * kept) * scale, 24) for c in CHANNELS[1:]]
    return F.when(sa == 0, wide(dst)).when((sa == 255) | (da == 0), wide(src)).otherwise(pack(both, *mixed))


def rgb_to_y(r, g, b) -> Column:
    """P20, luma."""
    return byte(F.shiftright(16839 * _c(r) + 33059 * _c(g) + 6420 * _c(b) + ((16 << 16) + (1 << 15)), 16))


def rgb_to_u(r, g, b) -> Column:
    """P20, chroma of a square of four pixels; r, g, b are sums over the square."""
    return byte(F.shiftright(-9719 * _c(r) - 19081 * _c(g) + 28800 * _c(b) + (128 << 18), 18))


def rgb_to_v(r, g, b) -> Column:
    return byte(F.shiftright(28800 * _c(r) - 24116 * _c(g) - 4684 * _c(b) + (128 << 18), 18))


def byte_of_signed(x) -> Column:
    """P21; a signed number, clamped, as an unsigned byte."""
    return clamp_signed(x) + 128


def signed_of_byte(x) -> Column:
    """P21; an unsigned byte around 128 as a signed number."""
    return byte(x) - 128


def difference(a, b) -> Column:
    """P21; of two bytes, without its sign."""
    return F.abs(byte(a) - byte(b))
