"""Bands, labels, durations and report days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def band(c: Column, cuts: Sequence[tuple[float, str]], rest: str) -> Column:
    """First label whose upper bound lies above the value."""
    out = F.lit(rest)
    for limit, label in reversed(list(cuts)):
        out = F.when(c < limit, label).otherwise(out)
    return out


def round_even(c: Column, places: int = 0) -> Column:
    """Half to even on the binary value, as the reports round; sums in any order give the same result."""
    scale = 10.0**places
    return F.rint(F.round(c, 9) * scale) / scale


def report_band(rate: Column) -> Column:
    return band(rate, [(30, "danger"), (50, "warning")], "good")


def equipment_band(rate: Column) -> Column:
    return F.when(rate == 0, "idle").otherwise(band(rate, [(30, "warn"), (70, "watch")], "good"))


def risk_label(days: Column) -> Column:
    text = F.abs(days).cast("string")
    return (
        F.when(days < 0, F.concat(F.lit("+"), text, F.lit("일")))
        .when(days == 0, F.lit("D-DAY"))
        .otherwise(F.concat(F.lit("D-"), text))
    )


def risk_tone(days: Column) -> Column:
    return F.when(days < 0, "overdue").when(days <= 7, "danger").otherwise("watch")


def progress_tone(done: Column, total: Column) -> Column:
    share = F.try_divide(done, total)
    return (
        F.when((done == 0) | (total == 0), "not-started")
        .when(share >= 0.8, "near-complete")
        .when(share >= 0.5, "progress")
        .otherwise("early")
    )


def hours_text(seconds: Column) -> Column:
    """Whole minutes, half to even, as hours and minutes."""
    minutes = F.bround(seconds / 60).cast("bigint")
    return F.concat(F.floor(minutes / 60).cast("string"), F.lit("시간 "), (minutes % 60).cast("string"), F.lit("분"))


def duration_text(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    h, m = F.floor(s / 3600), F.floor((s % 3600) / 60)
    return (
        F.when(h > 0, F.concat(h.cast("string"), F.lit("시간 "), m.cast("string"), F.lit("분")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("분 "), (s % 60).cast("string"), F.lit("초")))
        .otherwise(F.concat((s % 60).cast("string"), F.lit("초")))
    )


def delta_direction(change: Column, increase_is_good: bool) -> Column:
    better = change > 0 if increase_is_good else change < 0
    return F.when(change.isNull() | (change == 0), "neutral").when(better, "good").otherwise("danger")


def delta_text(change: Column, unit: str) -> Column:
    """Change against the day before with its sign: ``point`` in percent points, ``hours`` in hours and minutes."""
    sign = F.when(change > 0, "+").when(change < 0, "-").otherwise("")
    minutes = F.floor(F.abs(change) * 60 + 0.5)
    hours = F.concat(F.format_number(F.floor(minutes / 60), 0), F.lit("시간 "), (minutes % 60).cast("string"), F.lit("분"))
    points = F.concat(F.format_string("%.1f", F.abs(change).cast("double")), F.lit("%p"))
    return F.when(change.isNull(), "전일 데이터 없음").otherwise(F.concat(sign, points if unit == "point" else hours))


def kst_label(text: Column) -> Column:
    """ISO time with zone -> label in UTC+9; missing, unreadable and zoneless texts get their own marker."""
    zoned = text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    instant = F.try_to_timestamp(text)
    local = F.from_utc_timestamp(F.to_utc_timestamp(instant, F.current_timezone()), "+09:00")
    clock = F.date_format(local, "yyyy년 M월 d일 ")
    half = F.when(F.hour(local) < 12, "오전 ").otherwise("오후 ")
    label = F.concat(clock, half, F.date_format(local, "h시 mm분 ss초"), F.lit(" (한국 시간)"))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "미확인")
        .when(instant.isNull(), "시각 확인 불가")
        .when(~zoned, "시간대 확인 불가")
        .otherwise(label)
    )


def report_date_allowed(day: Column, now: Column) -> Column:
    """Reports exist up to yesterday in UTC+9; ``now`` is an instant."""
    return day < F.to_date(F.from_utc_timestamp(F.to_utc_timestamp(now, F.current_timezone()), "+09:00"))


def prev_report_date(day: Column) -> Column:
    """The day before; Monday looks back to Friday."""
    return F.when(F.dayofweek(day) == 2, F.date_sub(day, 3)).otherwise(F.date_sub(day, 1))
