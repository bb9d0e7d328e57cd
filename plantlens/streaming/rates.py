"""Hourly run rate and alarm counts as a stream, and streams that write each result once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.intervals import split_by
from ..session import fresh_path
from ..sources.sinks import existing


def hourly_counts(status: DataFrame, delay: str | None = None) -> DataFrame:
    """Run seconds and alarms per machine and hour; with ``delay`` the input is a stream and late rows are dropped.

    ``status``: machine_code, occur_date, operate_period, status. An interval counts in every hour it covers.
    """
    rows = status.filter("status in ('1', '2') and operate_period > 0")
    run = split_by(rows, "hour").select(
        "machine_code", F.col("window_start").alias("hour"), F.when(F.col("status") == "1", F.col("seconds")).otherwise(0).alias("s"),
        ((F.col("status") == "2") & (F.col("occur_date") >= F.col("window_start"))).cast("bigint").alias("a"),
    )
    run = run.withWatermark("hour", delay) if delay else run
    return run.groupBy("machine_code", "hour").agg(F.sum("s").alias("run_seconds"), F.sum("a").alias("n_alarms"))


def read_stream(spark: SparkSession, folder: str, name: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A table as a stream, be it one file or a folder of files; by default one trigger takes all files that are there."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader
    return reader.parquet(f"{folder}/{name}.parque[t]")  # a pattern: a plain path would have to be a folder


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read the result back from its sink table."""
    spark = stream.sparkSession
    out, state = fresh_path(spark, label), fresh_path(spark, f"{label}-state")
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return existing(spark, out, stream.schema)


def run_updates(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Run an update-mode aggregation; the newest batch of a key wins, so a repeated batch changes nothing."""
    spark = stream.sparkSession
    out, state = fresh_path(spark, label), fresh_path(spark, f"{label}-state")

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch_no={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(store).trigger(availableNow=True).start()
    query.awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    newest = [F.max_by(v, "batch").alias(v) for v in values]
    return existing(spark, out, StructType([*stream.schema, StructField("batch", IntegerType())])).groupBy(*keys).agg(*newest)


def run_partials(stream: DataFrame, label: str, partial: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Partial results of every micro-batch, each in a folder of its own; a batch that runs again replaces its own folder,
    so what is read back can be combined and counts each input row once."""
    spark = stream.sparkSession
    out, state = fresh_path(spark, label), fresh_path(spark, f"{label}-state")

    def store(batch: DataFrame, number: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{out}/batch_no={number}")

    query = stream.writeStream.option("checkpointLocation", state).foreachBatch(store).trigger(availableNow=True).start()
    query.awaitTermination()
    empty = spark.createDataFrame([], stream.schema)
    return existing(spark, out, partial(empty).schema)
