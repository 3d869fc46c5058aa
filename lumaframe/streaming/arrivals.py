"""Image files as they arrive, with Structured Streaming: parsed once each, appended to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumaframe.sources import images


def arriving(spark: SparkSession, path: str, files_per_batch: int = 10_000) -> DataFrame:
    """(image_id, content, arrived) of the image files that appear in path."""
    read = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.[wW][eE][bB][pP]").option("maxFilesPerTrigger", files_per_batch)
    read = read.schema("path string, modificationTime timestamp, length long, content binary")
    return read.load(path).select(F.col("path").alias("image_id"), "content", F.col("modificationTime").alias("arrived"))


def keep_images(raw: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the image row of each file that arrives to the Parquet folder `table`. A restart with the same
    checkpoint goes on where the last run ended; once: stop when what is there has been read."""
    write = images.images(raw).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
    return (write.trigger(availableNow=True) if once else write).start()


def totals_by_window(raw: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Files, malformed files and frames by window of their time; files later than `late` are left out."""
    parsed = images._parsed(False, images.container.MOST_PIXELS)("content")
    rows = raw.withWatermark("arrived", late).select("arrived", parsed.alias("p"))
    return rows.groupBy(F.window("arrived", width)).agg(
        F.count("*").alias("files"), F.count("p._corrupt").alias("malformed"), F.coalesce(F.sum("p.head.frame_count"), F.lit(0)).alias("frames")
    )
