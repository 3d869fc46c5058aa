"""Binary rows as files of a folder that driver and executors share, and the folder itself."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the one that the cluster shares (spark.checkpoint.dir). Only a local session may lack the
    setting; it gets a temporary one, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def write_files(rows: DataFrame, folder: str, suffix: str = ".webp") -> int:
    """Write each row (image_id, content) to folder/image_id + suffix, from the tasks; gives their number. A file appears
    under its name when it is whole, so a task that is run again or twice changes nothing. A null content is an
    empty file; image_id must be a file name and not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inside = store_of(folder)
        store.create_dir(inside, recursive=True)
        n = 0
        for batch in batches:
            for i in range(batch.num_rows):
                name, part = f"{inside}/{batch.column('image_id')[i].as_py()}{suffix}", f"{inside}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(batch.column("content")[i].as_py() or b"")
                store.move(part, name)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return rows.select("image_id", "content").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: what follows neither computes it again nor depends on the
    executors that computed it."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
