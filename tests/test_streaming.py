"""Streams against their batch twins and the hand-made alarm case."""

import json
import os
import tempfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plantlens.sources import readers, sinks
from plantlens.streaming import alarms, rates

T0 = datetime(2026, 1, 1, 8, 0, 0)
SNAPS = [(0, ["A"]), (5, ["A", "B"]), (10, []), (15, ["B"])]  # the third is rejected as stale


def accepted(spark):
    rows = [("m", T0 + timedelta(seconds=s), keys, T0 + timedelta(seconds=s + (60 if s == 10 else 1)), True) for s, keys in SNAPS]
    df = spark.createDataFrame(rows, "machine string, at timestamp, keys array<string>, arrived timestamp, connected boolean")
    return alarms.accept_fresh(df, "at", "arrived", "connected").select("machine", "at", "keys")


def test_rejected_snapshot_closes_nothing(spark):
    got = sorted((r["key"], (r["detected_at"] - T0).seconds, r["cleared_at"] and (r["cleared_at"] - T0).seconds) for r in alarms.episodes(accepted(spark)).collect())
    assert got == [("A", 0, 15), ("B", 5, None)]
    top = alarms.latest_entries(alarms.episodes(accepted(spark)), 1).collect()
    assert [r["key"] for r in top] == ["B"]


def test_stream_gives_the_same_episodes_over_several_batches(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    snaps = accepted(spark)
    for i, row in enumerate(snaps.orderBy("at").collect()):
        spark.createDataFrame([row], snaps.schema).coalesce(1).write.mode("append").parquet(os.path.join(folder, "in"))
    stream = spark.readStream.schema(snaps.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(folder, "in"))
    out = rates.run_to_table(alarms.episode_stream(stream), "test-episodes").collect()
    got = sorted((r["key"], r["event"], (r["at"] - T0).seconds) for r in out)
    assert got == [("A", "clear", 15), ("A", "open", 0), ("B", "open", 5)]


def test_unchanged_snapshot_is_no_event(spark):
    rows = [("m", T0 + timedelta(seconds=5 * i), k) for i, k in enumerate([[], ["A"], ["A"], ["A", "B"], ["B", "A"], []])]
    df = spark.createDataFrame(rows, "machine string, at timestamp, keys array<string>")
    assert sorted((r["at"] - T0).seconds for r in alarms.changed_snapshots(df).collect()) == [5, 15, 25]


def test_symbol_file_in_its_own_encoding(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), "symbols.txt")
    with open(path, "wb") as f:
        f.write("X008.4\tCLT\t절삭유\t펌프 기동\nbad\tX\ty\tz\nR10\tRUN\n".encode("cp949"))
    got = sorted(tuple(r) for r in readers.read_symbols(spark, path).collect())
    assert got == [("R10", "RUN", "", ""), ("X8.4", "CLT", "절삭유", "펌프 기동")]


def test_assets_and_hashes(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    for name in ("a.pdf", "b.pdf", "c.txt"):
        with open(os.path.join(folder, name), "w") as f:
            f.write(name)
    assert sorted(r["name"] for r in readers.list_assets(spark, folder, "*.pdf").collect()) == ["a.pdf", "b.pdf"]
    manifest = readers.file_hashes(spark, folder, "*.pdf").withColumn("sha", F.when(F.col("name") == "a.pdf", "0").otherwise(F.col("sha")))
    files = readers.file_hashes(spark, folder, "*")
    assert [r["name"] for r in readers.hash_mismatch(files, manifest).collect()] == ["a.pdf"]


def test_chunk_file_with_byte_order_mark(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), "chunks.jsonl")
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write(json.dumps({"id": "a", "page_content": "x", "metadata": {"n": 1}}) + "\n\n")
    rows = readers.read_chunks(spark, path)
    assert [tuple(r) for r in rows.select("id", F.variant_get("metadata", "$.n", "int")).collect()] == [("a", 1)]


def test_reader_refuses_an_unpublished_version(spark):
    import pytest

    from plantlens.operators.assembly import fingerprint

    root = tempfile.mkdtemp(prefix="run-")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    finger = lambda d: fingerprint(d, "id", ["id", "t"])
    sinks.publish(df, root, "v1", finger(df))
    assert sinks.read_ready(spark, root, "v1", finger).count() == 2
    df.limit(1).write.mode("overwrite").parquet(os.path.join(root, "data", "version=v1"))
    with pytest.raises(RuntimeError):
        sinks.read_ready(spark, root, "v1", finger)


def test_streams_read_a_table_of_several_files(spark, tmp_path):
    from plantlens.plans import load_all
    from plantlens.session import Tables

    whole = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{whole}/events.parquet")
    folder = str(tmp_path / "t")
    events.repartitionByRange(4, "ts").write.parquet(f"{folder}/events.parquet")
    assert len(Tables(spark, folder).events.inputFiles()) == 4
    for name in ("episode_stream_s1b", "hourly_stream_s6b", "stream_upsert_s8"):
        run = load_all()[name].run
        assert sorted(map(tuple, run(spark, folder).collect())) == sorted(map(tuple, run(spark, whole).collect())), name
    one_by_one = rates.read_stream(spark, folder, "events", events.schema, files_per_trigger=1).select("ts", F.lit(1).alias("n"))
    total = lambda rows: rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("n").alias("n"))
    partials = rates.run_partials(one_by_one, "days", total)
    assert partials.agg(F.sum("n")).first()[0] == events.count()


def test_nothing_streamed_is_an_empty_table(spark, tmp_path):
    schema = spark.createDataFrame([(1, "a")], "n long, day string").schema
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in" / "x.parquet"))
    stream = rates.read_stream(spark, str(tmp_path / "in"), "x", schema)
    assert rates.run_partials(stream, "none", lambda rows: rows.groupBy("day").agg(F.sum("n").alias("n"))).count() == 0


def test_stale_report_is_replaced_and_a_finished_one_only_by_force(spark, tmp_path):
    path = str(tmp_path / "reports")
    at = lambda minute: datetime(2026, 1, 1, 8, minute)
    schema = "report_day string, status string, started_at timestamp, n int"
    row = lambda *r: spark.createDataFrame([r], schema)
    state = lambda: [(r.status, r.n) for r in sinks.read_reports(spark, path, row("d", "x", at(0), 0).schema).collect()]
    sinks.upsert_report(row("d", "running", at(0), 1), path, at(0))
    sinks.upsert_report(row("d", "running", at(5), 2), path, at(5))  # still fresh
    assert state() == [("running", 1)]
    sinks.upsert_report(row("d", "done", at(20), 3), path, at(20))
    sinks.upsert_report(row("d", "done", at(50), 4), path, at(50))
    assert state() == [("done", 3)]
    sinks.upsert_report(row("d", "done", at(55), 5), path, at(55), force=True)
    assert state() == [("done", 5)]
