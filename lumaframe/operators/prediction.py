"""Predictors undone on arrays (F3-F6, L15-L29), one image a row, by the arithmetic that decodes files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from lumaframe.kernels import compose, vp8l


@F.arrow_udf(ArrayType(LongType()))
def _alpha(values: pa.Array, width: pa.Array, kind: pa.Array) -> pa.Array:
    out = []
    for v, w, k in zip(values, width.to_pylist(), kind.to_pylist(), strict=True):
        d = v.values.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, w)
        out.append(compose.unfilter(d, k).ravel().astype(np.int64))
    return pa.array(out, pa.list_(pa.int64()))


@F.arrow_udf(ArrayType(LongType()))
def _predicted(values: pa.Array, width: pa.Array, mode: pa.Array) -> pa.Array:
    out = []
    for v, w, m in zip(values, width.to_pylist(), mode.to_pylist(), strict=True):
        p = (v.values.to_numpy(zero_copy_only=False) & 0xFFFFFFFF).astype(np.uint32).reshape(-1, w)
        blocks = np.full((vp8l.subsample(len(p), 9), vp8l.subsample(w, 9)), m << 8, np.uint32)
        vp8l.unpredict(p, 9, blocks)
        out.append(p.ravel().astype(np.int64))
    return pa.array(out, pa.list_(pa.int64()))


def alpha(values, width, kind) -> Column:
    """A filtered alpha plane (array of bytes) as it was; kind: 0 none, 1 horizontal, 2 vertical, 3 gradient."""
    w, k = (F.lit(x) if isinstance(x, int) else x for x in (width, kind))
    return _alpha(F.transform(values, lambda v: v.cast("long")), w, k)


def predicted(values, width, mode) -> Column:
    """Pixels (array of BIGINT) of a picture that is all predicted by one mode, 0 to 13."""
    w, m = (F.lit(x) if isinstance(x, int) else x for x in (width, mode))
    return _predicted(values, w, m)
