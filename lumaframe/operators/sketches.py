"""Summaries of pixels that can be merged: distinct colours and quantiles of a channel by any key, such as image and time
window, from partial summaries of any parts and in any order; built of Spark's own sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the distinct sketch's registers, and the quantile sketch's size.
REGISTERS, SIZE = 15, 1000
#: Bounds of distinct colours relative to their number, of a quantile's rank relative to 1. Merged distinct sketches have a
#: standard error of 1.04 / sqrt(registers) (0.83 is that of one that was never merged), quantile sketches one of about
#: 0.9 / size ** 0.9723: the bounds are 6.7 and 7.9 of them, so that they hold for all of many groups, not for most.
COLOUR_ERROR, RANK_ERROR = 0.0389, 0.0085


def sketched(pixels: DataFrame, *keys: str | Column) -> DataFrame:
    """(keys, n, colours, and a, r, g, b): the summaries of pixels (argb, a, r, g, b) by keys. Null pixels are left out;
    a group of none has null summaries. Partial summaries are made before anything is shuffled, so a hot key sends
    one row a task."""
    channels = [F.kll_sketch_agg_bigint(F.col(c).cast("long"), SIZE).alias(c) for c in "argb"]
    return pixels.groupBy(*keys).agg(F.count("argb").alias("n"), F.hll_sketch_agg(F.col("argb").cast("long"), REGISTERS).alias("colours"), *channels)


def merged(summaries: DataFrame, *keys: str | Column) -> DataFrame:
    """Summaries of coarser keys from finer ones: as if all their pixels had been sketched together, up to the bounds above."""
    channels = [F.kll_merge_agg_bigint(c, SIZE).alias(c) for c in "argb"]
    return summaries.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("colours").alias("colours"), *channels)


def distinct_colours(name: str = "colours") -> Column:
    return F.hll_sketch_estimate(name)


def quantile(channel: str, rank: float) -> Column:
    """The smallest value of which about `rank` of all are not above it."""
    return F.kll_sketch_get_quantile_bigint(channel, F.lit(float(rank)))
