"""Target sizes and resampling (Z1-Z4) of arrays of pixels, one image a row: nothing is shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from lumaframe.kernels import compose


def _dimension(v: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(v + 0.5)).cast("int")


def target_size(width, height, want_width, want_height, preserve_ratio: bool) -> tuple[Column, Column]:
    """Z1; a wanted size of 0 or less is unset."""
    own = [F.col(c) if isinstance(c, str) else c for c in (width, height, want_width, want_height)]
    w, h, tw, th = (c.cast("double") for c in own)
    by_w, by_h = tw / w, th / h
    if not preserve_ratio:
        return F.when(tw > 0, _dimension(tw)).otherwise(own[0]), F.when(th > 0, _dimension(th)).otherwise(own[1])
    both = F.least(by_w, by_h)
    size = lambda own, wanted, ratio, side: (
        F.when((tw > 0) & (th > 0), _dimension(own * both)).when(wanted, _dimension(side)).when(ratio > 0, _dimension(own * ratio))
    )
    return (
        size(w, tw > 0, by_h, tw).otherwise(own[0]),
        size(h, (th > 0) & ~(tw > 0), by_w, th).otherwise(own[1]),
    )


def nearest(values, width, height, target_width, target_height) -> Column:
    """Z3 on an array of rows of any size, in place of a join: no pixel leaves its row."""
    w, h, tw, th = (F.col(c) if isinstance(c, str) else F.lit(c) for c in (width, height, target_width, target_height))
    at = lambda t, own, target: F.least(own - 1, F.floor(t * own / target).cast("int"))
    x, y = (lambda i: at(i % tw, w, tw)), (lambda i: at(F.floor(i / tw), h, th))
    return F.transform(F.sequence(F.lit(0), tw * th - 1), lambda i: F.get(values, y(i) * w + x(i)))


def bilinear(values, width, height, target_width, target_height) -> Column:
    """Z4 on an array of pixels: corner to corner, in single precision, each channel by itself."""
    sizes = [F.col(c) if isinstance(c, str) else F.lit(c) for c in (width, height, target_width, target_height)]
    return _bilinear(F.transform(values, lambda p: p.cast("long")), *sizes)


@F.arrow_udf(ArrayType(LongType()))
def _bilinear(values: pa.Array, width: pa.Array, height: pa.Array, target_width: pa.Array, target_height: pa.Array) -> pa.Array:
    out = []
    for v, w, h, tw, th in zip(values, *(c.to_pylist() for c in (width, height, target_width, target_height)), strict=True):
        p = (v.values.to_numpy(zero_copy_only=False) & 0xFFFFFFFF).astype(np.uint32).reshape(h, w)
        out.append(compose.bilinear(p, tw, th).ravel().astype(np.int64))
    return pa.array(out, pa.list_(pa.int64()))


def by_place(rows: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """(key, x, y, value): an array of rows of `width` values, one value a row."""
    one = rows.select(key, F.posexplode(values).alias("at", "value"))
    return one.select(key, (F.col("at") % width).cast("long").alias("x"), F.floor(F.col("at") / width).alias("y"), "value")
