"""Helpers that the training-data operators share: tables, staged results, hashes and components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (spark.checkpoint.dir).

    Only a local session may lack the setting; it gets a temporary folder, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_made: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    _made.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: later reads neither compute it again nor
    depend on the executors that computed it."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a staged DataFrame that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def sweep(spark: SparkSession) -> None:
    """Delete all that this driver has staged and not yet forgotten. A result that reads a staged table must
    have been written elsewhere before."""
    while _made:
        _delete(spark, _made.pop())


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs now: it does so when the driver's JVM
    collects its garbage, which a nearly idle driver may not do before the executors' disks are full."""
    gc.collect()
    spark._jvm.System.gc()


def crc_mod(col: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo modulus; null for null."""
    return F.crc32(col.cast("string").cast("binary")) % modulus


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) long pairs -> (node, component), component being the smallest node of each component.

    Alternates the large-star and small-star steps; each is a grouped minimum (combined before the
    shuffle) and a join, so a node with very many neighbours is never gathered in one task. Each round
    is written to the shared folder. Nodes without an edge aren't returned."""
    e = staged(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = staged(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(e)
        e = after
        state = e.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")
        ).first()
        if state == before or state[0] == 0:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(e.select("v", "v").distinct().toDF("node", "component"))
