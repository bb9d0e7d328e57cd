"""Alarm snapshots: cleaning, freshness, episodes as a stream and as its batch twin."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordered import neighbour, topk

OLDEST_SECONDS, AHEAD_SECONDS = 15, 5  # fixed values


def clean_tag(raw: Column, control: str = "\\x00") -> Column:
    """Alarm tag without control characters; ``-`` means no alarm; a missing tag is a problem, not a clear."""
    text = F.trim(F.regexp_replace(raw, control, ""))
    return F.struct(
        F.when(raw.isNull(), "missing").alias("problem"),
        F.when(~text.isin("", "-"), text).alias("code"),
    )


def accept_fresh(snapshots: DataFrame, collected: str, arrived: str, connected: str) -> DataFrame:
    """Snapshots of connected machines that are neither too old nor too far ahead on arrival."""
    age = (F.unix_micros(F.col(arrived).cast("timestamp")) - F.unix_micros(F.col(collected).cast("timestamp"))) / 1_000_000
    return snapshots.filter(F.col(connected) & (age <= OLDEST_SECONDS) & (age >= -AHEAD_SECONDS))


def changed_snapshots(snapshots: DataFrame) -> DataFrame:
    """Snapshots whose key set differs from the machine's previous one; an unchanged state is no event.
    ``snapshots``: machine, at (ordered), keys (array)."""
    d = snapshots.withColumn("__k", F.array_join(F.array_sort(F.array_distinct("keys")), "\x1f"))
    d = neighbour(d, ["machine"], ["at"], F.date_trunc("hour", "at"), {"__p": F.col("__k")})
    return d.filter(F.col("__k") != F.coalesce("__p", F.lit(""))).drop("__k", "__p")


def episodes(snapshots: DataFrame) -> DataFrame:
    """Batch twin: every alarm opens at the snapshot that first shows it and clears at the first accepted one without.

    ``snapshots``: machine, at, keys. Positions of a machine's snapshots are counted once; a key's run ends where
    the next snapshot of the machine lacks it.
    """
    hour = F.date_trunc("hour", "at")
    before = {"__pk": F.col("keys")}
    d = neighbour(snapshots, ["machine"], ["at"], hour, before)
    d = neighbour(d, ["machine"], ["at"], hour, {"__next_at": F.col("at"), "__nk": F.col("keys")}, step=1)
    held = d.select("machine", "at", "__pk", "__nk", "__next_at", F.explode(F.array_distinct("keys")).alias("key"))
    opens = ~F.coalesce(F.array_contains("__pk", F.col("key")), F.lit(False))
    last = ~F.coalesce(F.array_contains("__nk", F.col("key")), F.lit(False))
    marks = held.select("machine", "key", "at", opens.alias("opens"), last.alias("last"), F.when(last, F.col("__next_at")).alias("cleared_at"))
    # an episode's opening and closing rows alternate per (machine, key): only those rows are paired
    ends = marks.filter("opens or last")
    ends = neighbour(ends, ["machine", "key"], ["at"], hour, {"__last": F.col("last"), "__clear": F.col("cleared_at")}, step=1)
    cleared = F.when(F.col("last"), F.col("cleared_at")).otherwise(F.col("__clear"))
    return ends.filter("opens").select("machine", "key", F.col("at").alias("detected_at"), cleared.alias("cleared_at"))


def latest_entries(found: DataFrame, k: int = 5) -> DataFrame:
    """k entries per machine: open ones first, then the most recently cleared."""
    order = [F.col("cleared_at").isNotNull(), F.col("cleared_at").desc(), F.col("detected_at").desc(), F.col("key")]
    return topk(found, ["machine"], order, k, "entry_no")


def episode_stream(snapshots: DataFrame) -> DataFrame:
    """Opening and closing events of a stream of accepted snapshots (machine, at, keys), state kept per machine.

    A rejected snapshot never reaches this step, so it cannot close an alarm. Snapshots arriving late (older than the
    machine's newest one) are ignored, as a poller ignores an answer it already passed.
    """
    machine = snapshots.schema["machine"].dataType.simpleString()
    out = f"machine {machine}, key string, event string, at timestamp"

    def step(group, frames, state: GroupState):
        newest, held = state.get if state.exists else (None, "[]")
        open_keys = set(json.loads(held))
        rows = []
        for snap in pd.concat(list(frames)).sort_values("at").itertuples():
            if newest is not None and snap.at <= pd.Timestamp(newest):
                continue
            keys = set(snap.keys)
            rows += [(group[0], key, "open", snap.at) for key in sorted(keys - open_keys)]
            rows += [(group[0], key, "clear", snap.at) for key in sorted(open_keys - keys)]
            newest, open_keys = snap.at.isoformat(), keys
        state.update((newest, json.dumps(sorted(open_keys))))
        yield pd.DataFrame(rows, columns=["machine", "key", "event", "at"])

    return snapshots.groupBy("machine").applyInPandasWithState(
        step, out, "newest string, held string", "append", GroupStateTimeout.NoTimeout
    )
