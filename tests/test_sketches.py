"""Sketches against exact values; the order and the grain of merging don't matter beyond the stated bounds."""

import numpy as np
from pyspark.sql import functions as F

from lumaframe.operators import sketches as S


def test_errors_and_merging(spark):
    d = spark.range(120_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 8).alias("w"), (F.col("id") * 7919 % (F.col("id") % 3 * 9000 + 31)).cast("int").alias("argb"))
    d = d.select("k", "w", "argb", *[F.shiftright("argb", s).bitwiseAND(255).cast("int").alias(c) for c, s in zip("argb", (24, 16, 8, 0), strict=True)])
    values = {}
    for r in d.select("k", "argb", "b").collect():
        values.setdefault(r.k, ([], []))[0].append(r.argb)
        values[r.k][1].append(r.b)
    fine = S.sketched(d, "k", "w")
    ways = [S.sketched(d, "k"), S.merged(fine, "k"), S.merged(fine.orderBy(F.desc("w")).coalesce(1), "k"), S.merged(S.merged(fine, "k", (F.col("w") % 2).alias("w")), "k")]
    distinct = []
    for way in ways:
        rows = way.select("k", "n", S.distinct_colours().alias("c"), *[S.quantile("b", q).alias(f"q{i}") for i, q in enumerate((0.01, 0.5, 0.9))]).collect()
        distinct.append({r.k: r.c for r in rows})
        assert len(rows) == 3
        for r in rows:
            colours, b = len(set(values[r.k][0])), np.sort(values[r.k][1])
            assert r.n == len(b) and abs(r.c - colours) <= colours * S.COLOUR_ERROR + 1
            for i, q in enumerate((0.01, 0.5, 0.9)):
                low, high = (np.searchsorted(b, r[f"q{i}"], side) / len(b) for side in ("left", "right"))
                assert low - S.RANK_ERROR <= q <= high + S.RANK_ERROR
    assert all(abs(a[k] - distinct[0][k]) <= 2 for a in distinct for k in a)


def test_nulls_and_nothing(spark):
    d = spark.createDataFrame([(1, None, None, None, None, None), (2, 5, 0, 0, 0, 5)], "k int, argb int, a int, r int, g int, b int")
    rows = S.sketched(d, "k").select("k", "n", S.distinct_colours().alias("c")).orderBy("k").collect()
    assert [(r.k, r.n, r.c or 0) for r in rows] == [(1, 0, 0), (2, 1, 1)]
    assert S.merged(S.sketched(d.limit(0), "k"), "k").count() == 0


def test_bounds_hold_for_every_group(spark):
    """With 2**12 registers about one merged group in sixty was outside the bound of distinct colours."""
    d = spark.range(2_400_000).select((F.col("id") % 400).alias("k"), (F.col("id") % 7).alias("w"), F.hash("id").alias("argb"), *[F.lit(0).alias(c) for c in "arg"], (F.xxhash64("id") % 128).cast("int").alias("b"))
    found = S.merged(S.sketched(d, "k", "w"), "k").select("k", S.distinct_colours().alias("c"), S.quantile("b", 0.5).alias("m"))
    rows = d.join(found, "k").groupBy("k").agg(F.countDistinct("argb").alias("n"), F.first("c").alias("c"), F.avg((F.col("b") < F.col("m")).cast("int")).alias("low"), F.avg((F.col("b") <= F.col("m")).cast("int")).alias("high")).collect()
    assert len(rows) == 400
    assert all(abs(r.c - r.n) <= r.n * 3 * 0.83 / 2**6 for r in rows)
    assert all(r.low <= 0.5 + 0.0085 and r.high >= 0.5 - 0.0085 for r in rows)
