"""Incremental reading: only files that are new, changed or read by other rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def to_read(files: DataFrame, done: DataFrame, signature: str) -> DataFrame:
    """Files without a finished reading of the same path, content and rule signature."""
    same = done.filter((F.col("signature") == signature) & F.col("error").isNull()).select("source_file", "file_hash")
    return files.join(same, ["source_file", "file_hash"], "left_anti")


def reusable(candidates: DataFrame, files: DataFrame, signature: str) -> DataFrame:
    """Candidates of files that are still there, unchanged, under the same rules."""
    return candidates.filter(F.col("signature") == signature).join(files.select("source_file", "file_hash"), ["source_file", "file_hash"], "left_semi")


def current_sources(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates with source_current: whether their file still has the hash that was read."""
    now = files.select("source_file", F.col("file_hash").alias("_now"))
    return candidates.join(now, "source_file", "left").withColumn("source_current", F.coalesce(F.col("_now") == F.col("file_hash"), F.lit(False))).drop("_now")


def removed(done: DataFrame, files: DataFrame) -> DataFrame:
    return done.select("source_file").distinct().join(files.select("source_file"), "source_file", "left_anti")


def once_per_content(images: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run an expensive reader once for equal bytes, and give its result to every file that has them."""
    distinct = images.dropDuplicates(["file_hash"]).drop("source_file")
    return images.select("source_file", "file_hash").join(read(distinct), "file_hash")


def stream_files(spark: SparkSession, root: str, out: str, checkpoint: str, handle: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Read files as they arrive; each batch is handled and appended under its id, so that a repeated batch replaces itself."""
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)

    def batch(files: DataFrame, number: int) -> None:
        handle(files).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
