"""Sinks: stores, search tables, write-if-changed, insert-if-absent reports, published versions.

Every sink writes complete new files; a reader never sees half of a table.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.catalog import explode_machines
from ..operators.vectors import unit_vectors


def existing(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stored table, empty when nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def write_store(chunks: DataFrame, path: str, partitions=("site_id", "machine_code")) -> None:
    chunks.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_if_changed(df: DataFrame, path: str) -> DataFrame:
    """Append the rows whose content is not stored yet, addressed by the hash of the row; returns the whole store."""
    spark = df.sparkSession
    keyed = df.withColumn("content_hash", F.sha2(F.to_json(F.struct(*df.columns)), 256)).dropDuplicates(["content_hash"])
    stored = existing(spark, path, keyed.schema).select("content_hash").distinct()
    keyed.join(stored, "content_hash", "left_anti").select(*keyed.columns).write.mode("append").parquet(path)
    return spark.read.schema(keyed.schema).parquet(path)


def export_search(chunks: DataFrame, vectors: DataFrame, path: str) -> None:
    """Per-machine search tables: chunks (with machine and text) and unit vectors, partitioned by machine."""
    held = explode_machines(chunks.filter(F.trim("page_content") != ""), "machine_code", "machine").drop("machine_code")
    held.write.mode("overwrite").partitionBy("machine").parquet(os.path.join(path, "chunks"))
    vecs = unit_vectors(vectors, "vec").join(held.select("id", "machine"), "id")
    vecs.write.mode("overwrite").partitionBy("machine").parquet(os.path.join(path, "vectors"))


def claimable(reports: DataFrame, stored: DataFrame, now, minutes: int = 10, force: bool = False) -> DataFrame:
    """Reports to write: days not stored, or stored as unfinished for more than ``minutes``; with ``force`` also finished days.

    ``reports``: report_day, ...; ``stored``: report_day, status, started_at, one row for each day.
    """
    limit = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {minutes} MINUTES")
    done = F.col("status") == "done"
    blocked = stored.filter((done & F.lit(not force)) | (~done & (F.col("started_at") > limit)))
    return reports.join(blocked.select("report_day").distinct(), "report_day", "left_anti")


def read_reports(spark: SparkSession, path: str, schema) -> DataFrame:
    """One row for each report day. Where rows carry started_at, the newest claim of a day wins and its finished row before its
    running one; two writers that claimed a day at once therefore leave one report."""
    rows = existing(spark, path, schema)
    if "started_at" not in rows.columns:
        return rows
    order = F.struct("started_at", (F.col("status") == "done").alias("done"))
    return rows.groupBy("report_day").agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def upsert_report(reports: DataFrame, path: str, now=None, minutes: int = 10, force: bool = False) -> None:
    """Insert one row for each report day that may be written. Running it twice changes nothing.

    Without ``now`` only days not stored are written. With it rows have status and started_at, and days that are
    ``claimable`` at that time are written as a newer version: a stale unfinished report is replaced, with ``force`` a finished one too.
    """
    stored = read_reports(reports.sparkSession, path, reports.schema)
    one = reports.dropDuplicates(["report_day"])
    fresh = one.join(stored.select("report_day"), "report_day", "left_anti") if now is None else claimable(one, stored, now, minutes, force)
    fresh.select(*reports.columns).write.mode("append").parquet(path)


def publish(df: DataFrame, root: str, version: str, fingerprint: DataFrame) -> None:
    """Write a version to its own folder, then its status row; readers only accept versions with a status row."""
    df.write.mode("overwrite").parquet(os.path.join(root, "data", f"version={version}"))
    ready = fingerprint.select(F.lit(version).alias("version"), "fingerprint", "n", F.lit("ready").alias("status"))
    ready.write.mode("append").parquet(os.path.join(root, "status"))


def read_ready(spark: SparkSession, root: str, version: str, fingerprint) -> DataFrame:
    """The version's rows; fails unless it is ready and its rows still have the published fingerprint and count."""
    df = spark.read.parquet(os.path.join(root, "data", f"version={version}"))
    status = spark.read.parquet(os.path.join(root, "status")).filter((F.col("version") == version) & (F.col("status") == "ready"))
    if status.join(fingerprint(df), ["fingerprint", "n"]).isEmpty():
        raise RuntimeError(f"version {version} is not ready")
    return df
