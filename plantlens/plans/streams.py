"""Bindings of the streaming operators and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import fresh_path
from ..sources import sinks
from ..streaming import alarms, rates, signals
from .bindings import status_history
from .catalog import bins_sql
from .registry import query

SNAP_SQL = """(SELECT user_id AS machine, ts, CASE event_type WHEN 'error' THEN ['E' || (CAST(json_extract_string(props, '$.k') AS INT) % 3)]
    WHEN 'purchase' THEN ['E' || (CAST(json_extract_string(props, '$.k') AS INT) % 3), 'P'] WHEN 'view' THEN ['P'] ELSE [] END AS keys FROM events)"""


def snapshots(events):
    k = F.concat(F.lit("E"), (F.get_json_object("props", "$.k").cast("int") % 3).cast("string"))
    kind = F.col("event_type")
    keys = F.when(kind == "error", F.array(k)).when(kind == "purchase", F.array(k, F.lit("P"))).when(kind == "view", F.array(F.lit("P"))).otherwise(F.array().cast("array<string>"))
    return events.select(F.col("user_id").alias("machine"), F.col("ts").cast("timestamp").alias("at"), keys.alias("keys"))


STEP_SQL = f"(SELECT machine, ts, keys, coalesce(lag(keys) OVER w, []) AS pk FROM {SNAP_SQL} WINDOW w AS (PARTITION BY machine ORDER BY ts))"
EVENT_SQL = f"""(SELECT machine, unnest(list_filter(keys, lambda k: NOT list_contains(pk, k))) AS key, 'open' AS event, ts FROM {STEP_SQL}
    UNION ALL SELECT machine, unnest(list_filter(pk, lambda k: NOT list_contains(keys, k))), 'clear', ts FROM {STEP_SQL})"""
STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
EPISODE_SQL = f"""(SELECT machine, key, o.ts AS detected_at, (SELECT min(c.ts) FROM {EVENT_SQL} c WHERE c.machine = o.machine AND c.key = o.key AND c.event = 'clear' AND c.ts > o.ts) AS cleared_at
    FROM {EVENT_SQL} o WHERE o.event = 'open')"""


def stamp(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


@query("episodes_s1", f"SELECT machine, key, {STAMP.format('detected_at')} AS detected_at, coalesce({STAMP.format('cleared_at')}, '-') AS cleared_at FROM {EPISODE_SQL}")
def episodes_s1(t):
    out = alarms.episodes(snapshots(t.events))
    return out.select("machine", "key", stamp("detected_at"), F.coalesce(stamp("cleared_at"), F.lit("-")).alias("cleared_at"))


@query("episode_stream_s1b", f"SELECT machine, key, event, {STAMP.format('ts')} AS at FROM {EVENT_SQL}")
def episode_stream_s1b(t):
    stream = rates.read_stream(t.spark, t.sf_dir, "events", t.events.schema)
    out = rates.run_to_table(alarms.episode_stream(snapshots(stream)), "episodes")
    return out.select("machine", "key", "event", stamp("at"))


@query(
    "latest_entries_s2",
    f"""SELECT machine, key, entry_no, {STAMP.format('detected_at')} AS detected_at FROM (SELECT *, CAST(row_number() OVER (PARTITION BY machine ORDER BY cleared_at IS NOT NULL, cleared_at DESC, detected_at DESC, key) AS INT) AS entry_no FROM {EPISODE_SQL}) WHERE entry_no <= 5""",
)
def latest_entries_s2(t):
    return alarms.latest_entries(alarms.episodes(snapshots(t.events))).select("machine", "key", "entry_no", stamp("detected_at"))


@query(
    "accept_fresh_s3",
    "SELECT event_id FROM events WHERE event_type <> 'signup' AND CAST(json_extract_string(props, '$.k') AS INT) % 30 - 8 BETWEEN -5 AND 15",
)
def accept_fresh_s3(t):
    late = F.get_json_object("props", "$.k").cast("int") % 30 - 8
    arrived = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + late.cast("bigint") * 1000000)
    e = t.events.withColumn("arrived", arrived).withColumn("connected", F.col("event_type") != "signup")
    return alarms.accept_fresh(e, "ts", "arrived", "connected").select("event_id")


@query("changed_snapshots_s4", f"SELECT machine, {STAMP.format('ts')} AS at, array_to_string(list_sort(keys), ',') AS keys FROM {STEP_SQL} WHERE list_sort(keys) <> list_sort(pk)")
def changed_snapshots_s4(t):
    out = alarms.changed_snapshots(snapshots(t.events))
    return out.select("machine", stamp("at"), F.array_join(F.array_sort("keys"), ",").alias("keys"))


@query(
    "signal_bits_s5",
    """SELECT machine, 'R' || (k + i) || '.' || b AS address, CASE WHEN event_type = 'view' THEN -1 ELSE (CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1 + 2 * CAST(i AS INT), 2) AS INT) >> CAST(b AS INT)) & 1 END AS value
       FROM (SELECT event_id AS machine, event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), range(3) x(i), range(8) y(b)""",
)
def signal_bits_s5(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    digits = F.when(F.col("event_type") == "view", 8).otherwise(6)
    data = F.unhex(F.substring(F.md5(F.col("event_id").cast("string")), F.lit(1), digits))
    r = t.events.select(F.col("event_id").alias("machine"), F.lit("R").alias("area"), k.alias("start"), (k + 2).alias("end"), data.alias("data"))
    return signals.signal_bits(r).select("machine", "address", F.coalesce("value", F.lit(-1)).alias("value"))


HOURLY_SQL = f"""SELECT machine_code, strftime(w, '%Y-%m-%d %H') AS hour, CAST(sum(CASE WHEN status = '1' THEN seconds ELSE 0 END) AS BIGINT) AS run_seconds, count(*) FILTER (WHERE status = '2' AND occur_date >= w) AS n_alarms
    FROM {bins_sql('hour')} WHERE status IN ('1', '2') GROUP BY machine_code, w"""


@query("hourly_counts_s6", HOURLY_SQL)
def hourly_counts_s6(t):
    return rates.hourly_counts(status_history(t)).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


class _Stream:
    """The events table as a stream, under the same attribute the batch bindings use."""

    def __init__(self, t):
        self.events = rates.read_stream(t.spark, t.sf_dir, "events", t.events.schema)


@query("hourly_stream_s6b", HOURLY_SQL)
def hourly_stream_s6b(t):
    counts = rates.hourly_counts(status_history(_Stream(t)), "1 day")
    out = rates.run_updates(counts, ["machine_code", "hour"], "hourly")
    return out.select("machine_code", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "run_seconds", "n_alarms")


@query(
    "stream_upsert_s8",
    "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS report_day, count(*) AS n FROM events GROUP BY 1",
)
def stream_upsert_s8(t):
    """Day totals of all micro-batches go through the insert-if-absent sink, twice, as after a restart."""
    days = _Stream(t).events.select(F.date_format("ts", "yyyy-MM-dd").alias("report_day"), F.lit(1).cast("bigint").alias("n"))
    total = lambda rows: rows.groupBy("report_day").agg(F.sum("n").alias("n"))
    totals = total(rates.run_partials(days, "day-totals", total))
    path = fresh_path(t.spark, "upsert")
    sinks.upsert_report(totals, path)
    sinks.upsert_report(totals, path)
    return sinks.read_reports(t.spark, path, totals.schema)
