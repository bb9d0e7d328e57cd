"""Status intervals: clipping to days and hours, definitions, neighbours, as-of lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import carry_last


def with_definitions(status: DataFrame, machines: DataFrame, definitions: DataFrame) -> DataFrame:
    """Status rows of known machines with their alarm definition on (system, version, code), when registered."""
    known = status.join(machines.select("machine_code", "machine_sys", "machine_ver"), "machine_code")
    return known.join(definitions, ["machine_sys", "machine_ver", "alarm_code"], "left")


def _end(start: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(start) + seconds * 1_000_000)


def _clipped(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Whole seconds of [start, end) inside [low, high)."""
    micros = F.unix_micros(F.least(end, high)) - F.unix_micros(F.greatest(start, low))
    return F.floor(F.greatest(micros, F.lit(0)) / 1_000_000)


def split_by(status: DataFrame, unit: str, shift_hours: int = 0) -> DataFrame:
    """One row per interval and day or hour it touches, with the clipped seconds in ``seconds``.

    A work day starts ``shift_hours`` after midnight. Each interval yields only the bins it covers.
    """
    step = {"day": "INTERVAL 1 DAY", "hour": "INTERVAL 1 HOUR"}[unit]
    shift = F.expr(f"INTERVAL {shift_hours} HOURS")
    start = F.col("occur_date")
    end = _end(start, F.col("operate_period"))
    bins = F.sequence(
        F.date_trunc(unit, start - shift), F.date_trunc(unit, F.timestamp_micros(F.unix_micros(end) - 1) - shift), F.expr(step)
    )
    rows = status.filter(F.col("operate_period") > 0).withColumn("__end", end).withColumn("__bin", F.explode(bins))
    low = F.col("__bin") + shift
    return rows.withColumn("window_start", low).withColumn(
        "seconds", _clipped(start, F.col("__end"), low, low + F.expr(step))
    ).drop("__end", "__bin")


def previous_user_message(messages: DataFrame, session: str, order: str, role: str, text: str) -> DataFrame:
    """Answers with the latest earlier question of the session, if any."""
    asked = F.when(F.col(role) == "user", F.struct(F.col(order).alias("q_order"), F.col(text).alias("q_text")))
    out = carry_last(messages, [session], [order], F.floor(F.col(order) / 512), {"__q": asked}, include_current=False)
    return out.filter(F.col(role) == "assistant").select(
        *messages.columns, F.col("__q.q_order").alias("question_order"), F.col("__q.q_text").alias("question")
    )


def next_pages(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """Links from each page to the next one of the same document."""
    p = pages.select(doc, page).distinct()
    return p.join(p.select(doc, (F.col(page) - 1).alias(page)), [doc, page], "left_semi").select(
        doc, page, (F.col(page) + 1).alias("next_page")
    )


def nearest_pictures(captions: DataFrame, pictures: DataFrame, reach: int = 150) -> DataFrame:
    """The picture nearest to each caption on its page: horizontal overlap, vertical gap at most ``reach``,
    strictly nearer than the runner-up.

    Both: doc, page, id, x0, y0, x1, y1. Vertical bands of ``reach`` keep the join to nearby blocks.
    """
    band = lambda y: F.floor(y / reach).cast("bigint")
    caps = captions.select(
        "doc", "page", F.col("id").alias("cid"), *[F.col(c).alias(f"c{c}") for c in ("x0", "y0", "x1", "y1")]
    ).withColumn("band", F.explode(F.sequence(band(F.col("cy0") - reach), band(F.col("cy1") + reach))))
    pics = pictures.select("doc", "page", F.col("id").alias("pid"), "x0", "y0", "x1", "y1").withColumn(
        "band", F.explode(F.sequence(band(F.col("y0")), band(F.col("y1"))))
    )
    gap = F.greatest(F.lit(0), F.col("cy0") - F.col("y1"), F.col("y0") - F.col("cy1"))
    overlap = F.least("cx1", "x1") - F.greatest("cx0", "x0")
    near = caps.join(pics, ["doc", "page", "band"]).filter(overlap > 0).withColumn("gap", gap).filter(F.col("gap") <= reach)
    keys = ["doc", "page", "cid"]
    best = near.groupBy(*keys, "pid").agg(F.min("gap").alias("gap"))
    top = best.groupBy(*keys).agg(F.min("gap").alias("gap"))
    return (
        best.join(top, [*keys, "gap"]).groupBy(*keys, "gap").agg(F.count("*").alias("n"), F.min("pid").alias("pid"))
        .filter("n = 1").select(*keys, "pid", "gap")
    )
