"""Deterministic pixels from ordinary tables, so that raster operators can be held against SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.functions import pixels as px


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, x, y, l): each 64-float vector as an 8 x 8 tile of luminances."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "v"))
    level = F.floor((F.col("v").cast("double") + 0.5) * 255)
    return rows.select(
        "vec_id", "label", (F.col("pos") % 8).cast("long").alias("x"), F.floor(F.col("pos") / 8).alias("y"),
        F.least(F.greatest(level, F.lit(0)), F.lit(255)).cast("long").alias("l"),
    )


TILES = """tiles AS (SELECT vec_id, label, CAST(pos % 8 AS BIGINT) AS x, CAST(pos // 8 AS BIGINT) AS y,
  CAST(least(greatest(floor((CAST(embedding[pos + 1] AS DOUBLE) + 0.5) * 255), 0), 255) AS BIGINT) AS l
  FROM (SELECT vec_id, label, embedding, unnest(range(len(embedding))) AS pos FROM embeddings))"""


def pixel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, p, q): two pixels per line item."""
    rows = _table(spark, sf_dir, "lineitem")
    ok, pk, sk, ln = (F.col(c).cast("long") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    p = px.pack(ok * 11, pk, sk * 3, ln * 37)
    q = px.pack(pk * 7, sk * 13, ok * 3, F.col("l_quantity").cast("long") * 5)
    return rows.select("l_orderkey", "l_linenumber", p.alias("p"), q.alias("q"))


PAIRS = """pairs AS (SELECT l_orderkey, l_linenumber,
  ((l_orderkey * 11) % 256) * 16777216 + (l_partkey % 256) * 65536 + ((l_suppkey * 3) % 256) * 256 + (CAST(l_linenumber AS BIGINT) * 37) % 256 AS p,
  ((l_partkey * 7) % 256) * 16777216 + ((l_suppkey * 13) % 256) * 65536 + ((l_orderkey * 3) % 256) * 256 + (CAST(l_quantity AS BIGINT) * 5) % 256 AS q
  FROM lineitem)"""


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, frame_no, duration_ms, lossless, has_alpha): events as frames of their user's animation."""
    return _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("image_id"), F.col("event_id").alias("frame_no"), F.floor(F.abs("value")).cast("long").alias("duration_ms"),
        (F.col("event_id") % 3 == 0).alias("lossless"), (F.col("event_id") % 7 == 0).alias("has_alpha"),
    )


TIMELINE = """timeline AS (SELECT user_id AS image_id, event_id AS frame_no, CAST(floor(abs(value)) AS BIGINT) AS duration_ms,
  event_id % 3 = 0 AS lossless, event_id % 7 = 0 AS has_alpha FROM events)"""


def pictures(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(vec_id, argb): each vector as an 8 x 8 picture, an array of pixels in BIGINT; and more columns."""
    levels = F.transform("embedding", lambda v: F.least(F.greatest(F.floor((v.cast("double") + 0.5) * 255), F.lit(0)), F.lit(255)).cast("long"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", *more, levels.alias("l"))
    return rows.select("vec_id", *more, F.transform("l", lambda l, i: px.pack(l * 3 + i, l, l + i * 17, l * 7 + F.col("vec_id"))).alias("argb"))


PICTURES = TILES + """, pictures AS (SELECT vec_id, x, y, l, ((l * 3 + y * 8 + x) % 256) * 16777216 + l * 65536
  + ((l + (y * 8 + x) * 17) % 256) * 256 + (l * 7 + vec_id) % 256 AS p FROM tiles)"""


def encoded(rows: DataFrame, write) -> DataFrame:
    """(image_id, content): pictures (vec_id, argb) as files, by write(vec_id, pixels)."""

    @F.arrow_udf("binary")
    def of(ids: pa.Array, argb: pa.Array) -> pa.Array:
        return pa.array([write(i, p) for i, p in zip(ids.to_pylist(), argb.to_pylist(), strict=True)], pa.binary())

    dealt = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "vec_id")  # small tables have one part
    return dealt.select(F.col("vec_id").cast("string").alias("image_id"), of("vec_id", "argb").alias("content"))
