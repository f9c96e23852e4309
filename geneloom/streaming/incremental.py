"""Resumable batches: skip finished keys, and file streams that stop when drained."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not finished yet.

    The finished keys are made distinct first, so the join sees one row per key.
    """
    return todo.join(done.select(key).distinct(), key, "left_anti")


def done_keys(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """Keys already in a sink, reading only the key column; None before the first batch."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop_path):
        return None
    return spark.read.parquet(path).select(key)


def resume(todo: DataFrame, key: str, sink: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Process the unfinished keys and append them to the sink; returns the whole sink.

    Resuming goes by key, not by position, so partial runs never misalign rows.
    The append commits atomically per job.
    """
    spark = todo.sparkSession
    done = done_keys(spark, sink, key)
    todo = todo if done is None else remaining(todo, done, key)
    work(todo).write.mode("append").parquet(sink)
    return spark.read.parquet(sink)


BITS = 32768  # rows of one bitmap: 4 KB


def done_bitmaps(rows: DataFrame, row: str) -> DataFrame:
    """``[bucket, mask]``: finished row numbers as one bitmap for each ``BITS`` rows."""
    return rows.select((F.bitmap_bucket_number(F.col(row) + 1)).alias("bucket"), F.bitmap_bit_position(F.col(row) + 1).alias("_bit")).groupBy("bucket").agg(
        F.bitmap_construct_agg("_bit").alias("mask"))


def _is_set(mask, bit):
    """Whether a bit of a bitmap is set, lowest bit of the first byte first."""
    byte = F.conv(F.hex(F.substring(mask, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1


def resume_rows(todo: DataFrame, row: str, shape: dict, sink: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Process the rows whose number is not in the sink's done masks, append them and their masks; returns the whole sink.

    Only bitmaps are read on resume, an eighth of a byte per row. ``shape``
    (say, rows and width) is stored at the first run; another one is refused,
    since the numbers would mean other rows. Results are written before their
    masks, so a run that dies in between leaves a batch without masks; the next
    run makes that batch anew in its place.
    """
    spark = todo.sparkSession
    stored = spark.createDataFrame([(json.dumps(shape, sort_keys=True),)], "value string")
    first = done_keys(spark, f"{sink}/shape", "value")
    if first is None:
        stored.write.parquet(f"{sink}/shape")
    elif first.first()["value"] != stored.first()["value"]:
        raise ValueError(f"{sink} holds another shape: {first.first()['value']}")
    masks = done_keys(spark, f"{sink}/masks", "*")
    batch = 0
    if masks is not None:
        batch = (masks.agg(F.max("batch").alias("b")).first()["b"] or 0) + 1
        one = masks.groupBy("bucket").agg(F.bitmap_or_agg("mask").alias("mask"))
        bit = F.bitmap_bit_position(F.col(row) + 1)
        todo = todo.withColumn("bucket", F.bitmap_bucket_number(F.col(row) + 1)).join(one, "bucket", "left")
        todo = todo.where(F.col("mask").isNull() | ~_is_set(F.col("mask"), bit)).drop("bucket", "mask")
    work(todo).withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(
        f"{sink}/rows")
    written = spark.read.parquet(f"{sink}/rows").where(F.col("batch") == batch)
    done_bitmaps(written, row).withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{sink}/masks")
    return spark.read.parquet(f"{sink}/rows").drop("batch")


def drain_files(spark: SparkSession, source_dir: str, glob: str, schema, work: Callable[[DataFrame], DataFrame],
                sink: str, checkpoint: str, max_files: int = 100) -> DataFrame:
    """Run a file stream until all present files are processed, then stop.

    Exactly-once per file through the stream checkpoint; a second call picks up
    only files that arrived since.
    """
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", glob)
              .option("maxFilesPerTrigger", max_files).parquet(source_dir))
    running = (work(stream).writeStream.format("parquet").option("path", sink)
               .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    running.awaitTermination()
    return spark.read.parquet(sink)


def append_failures(failed: DataFrame, path: str) -> None:
    failed.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)
