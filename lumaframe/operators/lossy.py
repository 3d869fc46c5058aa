"""Steps of the lossy format as Column expressions on arrays (V7, V14, V15, V19-V32, V35, V37-V40, V42-V44); each takes
and gives one array a row, and no row leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumaframe.functions import pixels as px
from lumaframe.kernels import vp8


def _column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _longs(values: list[Column]) -> Column:
    return F.array(*(v.cast("long") for v in values))


def _two_passes(values, once: Callable, last: Callable[[Column], Column]) -> Column:
    """A 4-point step over the columns of 4 x 4 values, then over the rows."""

    def across(d: Column) -> Column:
        return _longs([last(x) for k in range(4) for x in once(*(F.get(d, F.lit(4 * k + j)) for j in range(4)))])

    def down(c: Column) -> Column:
        columns = [once(*(F.get(c, F.lit(4 * j + k)).cast("long") for j in range(4))) for k in range(4)]
        return _let(_longs([columns[k][i] for i in range(4) for k in range(4)]), across)

    return _let(_column(values), down)


def inverse_dct(values) -> Column:
    """16 coefficients to 16 residuals."""
    part = lambda x, k: F.shiftright(x * k, 16)

    def once(a: Column, b: Column, c: Column, d: Column) -> list[Column]:
        low, high = part(b, 35468) - d - part(d, 20091), b + part(b, 20091) + part(d, 35468)
        return [a + c + high, a - c + low, a - c - low, a + c - high]

    return _two_passes(values, once, lambda x: F.shiftright(x + 4, 3))


def inverse_wht(values) -> Column:
    """16 coefficients to the 16 first coefficients of luma."""
    return _two_passes(values, lambda a, b, c, d: [a + b + c + d, a + b - c - d, a - b - c + d, a - b + c - d], lambda x: F.shiftright(x + 3, 3))


def predicted_block(mode, edge) -> Column:
    """4 x 4 pixels by a mode (0 to 9) from 13 around them: left from the lowest up, corner, 8 above."""

    def blocks(e: Column) -> Column:
        at = lambda k: F.get(e, F.lit(min(k, 12))).cast("long")  # noqa: E731 beyond the last its neighbour is itself
        down = lambda k: at(3 - min(k, 3))  # noqa: E731 the left, from the top; below the lowest likewise
        mean = lambda a, b: F.shiftright(a + b + 1, 1)
        bent = lambda a, b, c: F.shiftright(a + 2 * b + c + 2, 2)
        two, mid = (lambda k: mean(at(k), at(k + 1))), (lambda k: bent(at(k - 1), at(k), at(k + 1)))
        flat = F.shiftright(sum((at(k) for k in (0, 1, 2, 3, 5, 6, 7)), at(8)) + 4, 3)

        def right_of_vertical(r: int, c: int) -> Column:
            if 2 * c < r:
                return mid(5 + 2 * c - r)
            return mid(4 + (2 * c - r + 1) // 2) if r % 2 else two(4 + c - r // 2)

        def left_of_vertical(r: int, c: int) -> Column:
            if c == 3 and r > 1:
                return mid(8 + r)
            return mid(6 + c + r // 2) if r % 2 else two(5 + c + r // 2)

        def below_horizontal(r: int, c: int) -> Column:
            if 2 * r < c:
                return mid(3 + c - 2 * r)
            return mid(4 - (2 * r - c + 1) // 2) if c % 2 else two(3 - r + c // 2)

        def above_horizontal(r: int, c: int) -> Column:
            k = r + c // 2
            return bent(down(k), down(k + 1), down(k + 2)) if c % 2 else mean(down(k), down(k + 1))

        by_mode = {
            vp8.B_DC: lambda r, c: flat, vp8.B_TM: lambda r, c: px.clamp(down(r) + at(5 + c) - at(4)), vp8.B_VE: lambda r, c: mid(5 + c),
            vp8.B_HE: lambda r, c: mid(3 - r) if r < 3 else F.shiftright(at(1) + 3 * at(0) + 2, 2), vp8.B_LD: lambda r, c: mid(6 + r + c), vp8.B_RD: lambda r, c: mid(4 + c - r),
            vp8.B_VR: right_of_vertical, vp8.B_VL: left_of_vertical, vp8.B_HD: below_horizontal, 9: above_horizontal,
        }
        out = F.lit(None).cast("array<bigint>")
        for m, value in by_mode.items():
            out = F.when(_column(mode) == m, _longs([value(r, c) for r in range(4) for c in range(4)])).otherwise(out)
        return out

    return _let(_column(edge), blocks)


def filtered(kind, line, edge: int, inner: int, high: int) -> Column:
    """Eight pixels across an edge. kind: simple, block or macro."""
    kind = _column(kind)
    simple, block, macro = (kind == k for k in ("simple", "block", "macro"))
    held = px.clamp_signed

    def smoothed(p: Column) -> Column:
        at = [F.get(p, F.lit(k)).cast("long") for k in range(8)]
        gap = [F.abs(at[k + 1] - at[k]) for k in range(7)]
        go = (2 * gap[3] + F.shiftright(F.abs(at[2] - at[5]), 1) <= edge) & (simple | (F.greatest(*(gap[k] for k in (0, 1, 2, 4, 5, 6))) <= inner))
        varied = simple | (gap[2] > high) | (gap[4] > high)
        outer = F.when(block & ~varied, F.lit(0).cast("long")).otherwise(held(at[2] - at[5]))
        known = F.struct(go.alias("go"), varied.alias("varied"), held(3 * (at[4] - at[3]) + outer).alias("w"))

        def moved(s: Column) -> Column:
            go, varied, w = s["go"], s["varied"], s["w"]
            after, before = (F.shiftright(F.least(w + d, F.lit(127)), 3) for d in (4, 3))
            half, zero = F.shiftright(after + 1, 1), F.lit(0).cast("long")
            wide = [held(F.shiftright(k * w + 63, 7)) for k in (27, 18, 9)]
            soft = lambda b, m: F.when(~go | varied, zero).when(block, b).when(macro, m).otherwise(zero)
            near = lambda x: F.when(~go, zero).when(macro & ~varied, wide[0]).otherwise(x)
            less = [near(after), soft(half, wide[1]), soft(zero, wide[2])]
            more = [near(before), soft(half, wide[1]), soft(zero, wide[2])]
            new = lambda x: held(x - 128) + 128
            return _longs([at[0], *(new(at[3 - k] + more[k]) for k in (2, 1, 0)), *(new(at[4 + k] - less[k]) for k in range(3)), at[7]])

        return _let(known, moved)

    return _let(_column(line), smoothed)


def filter_limits(level, sharpness) -> Column:
    """Level, interior limit and the threshold of high variance of an undivided key frame."""
    level, sharp = _column(level).cast("long"), _column(sharpness).cast("long")
    eased = F.least(F.when(sharp > 4, F.shiftright(level, 2)).otherwise(F.shiftright(level, 1)), 9 - sharp)
    inner = F.greatest(F.when(sharp == 0, level).otherwise(eased), F.lit(1))
    return _longs([level, inner, (level >= 15).cast("long") + (level >= 40).cast("long")])


def quantizer_steps(index) -> Column:
    """V7: first and further steps of luma, of luma's own block and of chroma."""
    at = F.least(F.greatest(_column(index), F.lit(0)), F.lit(127))
    dc, ac = (F.get(F.array(*map(F.lit, steps)), at).cast("long") for steps in (vp8.DC_STEP, vp8.AC_STEP))
    return _longs([dc, ac, 2 * dc, F.greatest(F.lit(8), F.floor(ac * 155 / 100)), F.least(F.lit(132), dc), ac])


def pixels(y, u, v, width: int, fancy: bool) -> Column:
    """Planes to pixels of 32 bits. Chroma planes have half as many columns and rows, rounded up."""
    planes = F.struct(*(_column(p).alias(n) for n, p in (("y", y), ("u", u), ("v", v))))
    return _let(planes, lambda p: _pixels(p["y"], p["u"], p["v"], width, fancy))


def _pixels(y: Column, u: Column, v: Column, width: int, fancy: bool) -> Column:
    across = width + 1 >> 1

    def one(luma: Column, i: Column) -> Column:
        row, column = F.floor(i / width).cast("int"), (i % width).cast("int")
        near = lambda p, r, c: F.get(p, (r * across + c).cast("int"))
        half_row, half_column = F.shiftright(row, 1), F.shiftright(column, 1)

        def chroma(p: Column) -> Column:
            if not fancy:
                return near(p, half_row, half_column)
            last = F.shiftright((F.size(y) / width).cast("int") - 1, 1)
            far_row = F.least(F.greatest(half_row + 2 * (row % 2) - 1, F.lit(0)), last)
            far_column = F.least(F.greatest(half_column + 2 * (column % 2) - 1, F.lit(0)), F.lit(width - 1 >> 1))
            return px.fancy_chroma(near(p, half_row, half_column), near(p, far_row, half_column), near(p, half_row, far_column), near(p, far_row, far_column))

        colour = F.struct(luma.alias("y"), chroma(u).alias("u"), chroma(v).alias("v"))
        return _let(colour, lambda c: px.opaque(px.yuv_to_r(c["y"], c["v"]), px.yuv_to_g(c["y"], c["u"], c["v"]), px.yuv_to_b(c["y"], c["u"])))

    return F.transform(y, one)


def rgb_bytes(y, u, v, width: int, fancy: bool) -> Column:
    """Planes to three bytes a pixel, red first."""
    return F.unhex(F.array_join(F.transform(pixels(y, u, v, width, fancy), lambda p: F.lpad(F.hex(p % (1 << 24)), 6, "0")), ""))
