"""Machine, production, delivery and quality reports over daily facts.

Raw facts are reduced to days, hours, machines or codes before any window runs; those tables stay small
however large one machine's history is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.bands import equipment_band, report_band, risk_tone, round_even
from .intervals import split_by
from .ordered import topk

# Fixed values
STATES = {"0": "stop", "1": "operate", "2": "alarm", "3": "off"}
DEFAULT_ALARM = "비상정지"
SECTIONS = (  # code, step, domain, section
    ("PROD", 1, "prod", "summary"),
    ("PROD", 2, "prod", "underperform"),
    ("PROD", 3, "prod", "processBottleneck"),
    ("PROD", 4, "prod", "equipmentBottleneck"),
    ("PROD", 5, "prod", "equipmentResult"),
    ("PROD", 6, "prod", "workerEfficiency"),
    ("PROD", 7, "prod", "equipmentUtilization"),
    ("SHIP", 1, "ship", "summary"),
    ("SHIP", 2, "ship", "customerShipment"),
    ("SHIP", 3, "ship", "shipmentStatus"),
    ("SHIP", 4, "ship", "delayCause"),
    ("DELV", 1, "delv", "summary"),
    ("DELV", 2, "delv", "riskAnalysis"),
    ("DELV", 3, "delv", "impactAnalysis"),
    ("DELV", 4, "delv", "riskCurrent"),
    ("DELV", 5, "delv", "actions"),
    ("DELV", 6, "delv", "issues"),
    ("QUAL", 1, "qual", "summary"),
    ("QUAL", 2, "qual", "processQuality"),
    ("QUAL", 3, "qual", "defectComposition"),
    ("QUAL", 4, "qual", "equipmentQuality"),
    ("QUAL", 5, "qual", "workerQuality"),
    ("QUAL", 6, "qual", "qualityIssues"),
    ("QUAL", 7, "qual", "customerImpact"),
    ("EQUIP", 1, "equip", "statusSummary"),
    ("EQUIP", 2, "equip", "alarmAnalysis"),
    ("EQUIP", 3, "equip", "downtimeImpact"),
    ("ATT", 1, "att", "summary"),
    ("ATT", 2, "att", "absenceImpact"),
    ("ATT", 3, "att", "overtimeStatus"),
)


def day_status(status: DataFrame, shift_hours: int = 0) -> DataFrame:
    """Seconds per machine, work day and state, clipped to the day."""
    parts = split_by(status, "day", shift_hours).withColumn("work_date", F.to_date(F.col("window_start") - F.expr(f"INTERVAL {shift_hours} HOURS")))
    sums = [F.sum(F.when(F.col("status") == s, F.col("seconds")).otherwise(0)).alias(f"{n}_seconds") for s, n in STATES.items()]
    return parts.groupBy("machine_code", "work_date").agg(*sums)


def planned_rate(days: DataFrame, capacity: DataFrame) -> DataFrame:
    """Run time as a share of the planned time; null without a plan. ``capacity``: machine_code, planned_seconds."""
    rate = round_even(F.try_divide(F.col("operate_seconds") * 100, F.col("planned_seconds")), 2)
    return days.join(capacity, "machine_code", "left").withColumn("planned_rate", F.when(F.col("planned_seconds") != 0, rate))


def hourly_rate(status: DataFrame) -> DataFrame:
    """Run share of every machine hour that holds run time."""
    run = split_by(status.filter("status = '1'"), "hour")
    return run.groupBy("machine_code", F.col("window_start").alias("hour")).agg(
        round_even(F.sum("seconds") / 3600 * 100, 1).alias("rate"), F.sum("seconds").alias("seconds")
    )


def alarm_groups(status: DataFrame, shift_hours: int = 0) -> DataFrame:
    """Alarms per machine, work day and code with their position: count descending, then code.

    The single events stay rows of the status table (joined by these keys), so no group is gathered.
    """
    day = F.to_date(F.col("occur_date") - F.expr(f"INTERVAL {shift_hours} HOURS"))
    code = F.coalesce(F.when(F.col("alarm_code") != "", F.col("alarm_code")), F.lit(DEFAULT_ALARM))
    timed = F.when(F.col("operate_period") > 0, F.col("operate_period"))
    groups = status.filter("status = '2'").groupBy("machine_code", day.alias("work_date"), code.alias("code")).agg(
        F.count("*").alias("n_events"), F.min("occur_date").alias("first_at"), F.max("occur_date").alias("last_at"), F.sum(timed).alias("total_seconds")
    )
    w = Window.partitionBy("machine_code", "work_date").orderBy(F.col("n_events").desc(), "code")
    return groups.withColumn("position", F.row_number().over(w))


def weekday(day: Column) -> Column:
    return ~F.dayofweek(day).isin(1, 7)


def machine_trend(rates: DataFrame) -> DataFrame:
    """Weekday observations per machine: count, mean, first, latest, change, lowest, highest.
    ``rates``: machine, day, rate."""
    r = F.col("rate")
    on = weekday(F.col("day"))
    value, at = F.when(on, r), F.when(on, F.col("day"))
    first, last = F.min_by(r, at), F.max_by(r, at)
    return rates.groupBy("machine").agg(
        F.count(value).alias("n_days"),
        round_even(F.avg(value), 1).alias("mean_rate"),
        first.alias("first_rate"),
        last.alias("latest_rate"),
        round_even(last - first, 1).alias("change"),
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
    )


def daily_average(rates: DataFrame) -> DataFrame:
    return rates.groupBy("day").agg(round_even(F.avg("rate"), 1).alias("mean_rate"), F.count("*").alias("n_machines")).withColumn(
        "weekend", ~weekday(F.col("day"))
    )


def latest_bands(rates: DataFrame) -> DataFrame:
    """Machines per band on the latest day, and the mean over those running."""
    latest = rates.agg(F.max("day").alias("d")).scalar()
    r = F.col("rate")
    counts = [F.count_if(equipment_band(r) == b).alias(b) for b in ("idle", "warn", "watch", "good")]
    return rates.filter(F.col("day") == latest).agg(F.max("day").alias("day"), *counts, F.round(F.avg(F.when(r > 0, r)), 6).alias("running_mean"))


def alarm_pareto(status: DataFrame, k: int = 5, listed: int = 10) -> DataFrame:
    """Most frequent alarm codes with their share of all alarms."""
    counts = status.filter("status = '2'").groupBy(F.coalesce("alarm_code", F.lit(DEFAULT_ALARM)).alias("code")).agg(F.count("*").alias("n_events"))
    total = counts.agg(F.sum("n_events").alias("n")).scalar()
    top = counts.orderBy(F.col("n_events").desc(), "code").limit(min(k, listed))
    return top.withColumn("share", F.round(F.col("n_events") / total * 100, 6))


def state_share(status: DataFrame) -> DataFrame:
    """Seconds per state and their share of all seconds; 0 when there are none."""
    sums = status.filter("operate_period > 0").groupBy("status").agg(F.sum("operate_period").alias("seconds"))
    total = sums.agg(F.sum("seconds").alias("s")).scalar()
    return sums.withColumn("share", F.round(F.coalesce(F.try_divide(F.col("seconds") * 100.0, total), F.lit(0.0)), 6))


def day_change(days: DataFrame, metrics: Mapping[str, bool]) -> DataFrame:
    """Value, change to the previous day and its direction per metric (True when an increase is good).
    ``days``: one row per day."""
    w = Window.orderBy("work_date")
    rows = None
    for name, good in metrics.items():
        change = F.round(F.col(name) - F.lag(name).over(w), 6)
        better = change > 0 if good else change < 0
        tone = F.when(change.isNull() | (change == 0), "neutral").when(better, "good").otherwise("danger")
        one = days.select("work_date", F.lit(name).alias("metric"), F.col(name).cast("double").alias("value"), change.cast("double").alias("change"), tone.alias("tone"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def last_observations(rates: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Last k weekday observations per key with weights 1..n, oldest first."""
    d = topk(rates.filter(weekday(F.col("day"))), keys, [F.col("day").desc()], k, "__r")
    n = F.count("*").over(Window.partitionBy(*keys))
    return d.withColumn("weight", n - F.col("__r") + 1).drop("__r")


def top_alarm_machines(status: DataFrame, k: int = 3) -> DataFrame:
    counts = status.filter("status = '2'").groupBy("machine_code").agg(F.count("*").alias("n_events"))
    return _numbered(counts, [F.col("n_events").desc(), F.col("machine_code")], k)


def longest_alarms(status: DataFrame, k: int = 3) -> DataFrame:
    order = [F.col("operate_period").desc(), F.col("event_id")]
    return _numbered(status.filter("status = '2'").select("event_id", "machine_code", "alarm_code", "operate_period"), order, k)


def _numbered(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Top k of a whole table: a distributed limit first, numbers afterwards."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def hour_extremes(rates: DataFrame, low: float = 30) -> DataFrame:
    """Busiest and quietest hour per machine and day (the earlier one on ties) and the hours below the limit."""
    day, hour = F.to_date("hour"), F.hour("hour")
    r = F.col("rate")
    return rates.groupBy("machine_code", day.alias("work_date")).agg(
        F.min_by(hour, F.struct(-r, hour)).alias("max_hour"),
        F.min_by(hour, F.struct(r, hour)).alias("min_hour"),
        F.count_if(r < low).alias("low_hours"),
    )


def all_machine_days(status: DataFrame, capacity: DataFrame, shift_hours: int = 0) -> DataFrame:
    """Totals of all machines per work day and the run share of the planned time of the machines seen that day."""
    d = planned_rate(day_status(status, shift_hours), capacity)
    names = [f"{n}_seconds" for n in STATES.values()]
    sums = d.groupBy("work_date").agg(*[F.sum(n).alias(n) for n in names], F.sum("planned_seconds").alias("planned_seconds"))
    return sums.withColumn("planned_rate", round_even(F.try_divide(F.col("operate_seconds") * 100, F.col("planned_seconds")), 2))


def cms_report(status: DataFrame, capacity: DataFrame, day: str, shift_hours: int = 0) -> DataFrame:
    """Daily report of all machines as (section, position, label, value): the last seven days, state totals and
    evaluation of the day, hourly run time, most frequent alarms, top machines, longest alarms."""
    the_day = F.lit(day).cast("date")
    days = all_machine_days(status, capacity, shift_hours)
    start = F.lit(day).cast("timestamp") + F.expr(f"INTERVAL {shift_hours} HOURS")
    inside = status.filter((F.col("occur_date") >= start) & (F.col("occur_date") < start + F.expr("INTERVAL 1 DAY")))
    row = lambda df, section, position, label, value: df.select(
        F.lit(section).alias("section"), position.cast("int").alias("position"), label.cast("string").alias("label"), value.cast("double").alias("value")
    )
    week = days.filter(F.col("work_date").between(F.date_sub(the_day, 6), the_day))
    series = row(week, "weekly_rate", F.date_diff(F.col("work_date"), F.date_sub(the_day, 6)) + 1, F.col("work_date"), F.col("planned_rate"))
    today = days.filter(F.col("work_date") == the_day)
    totals = today.select(F.posexplode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"{n}_seconds").alias("v")) for n in ("planned", *STATES.values())])).alias("p", "x"))
    total_rows = row(totals, "total", F.col("p") + 1, F.col("x.n"), F.col("x.v"))
    evaluation = row(today, "evaluation", F.lit(1), report_band(F.col("planned_rate")), F.col("planned_rate"))
    hours = split_by(status.filter("status = '1'"), "hour").filter((F.col("window_start") >= start) & (F.col("window_start") < start + F.expr("INTERVAL 1 DAY")))
    by_hour = hours.groupBy("window_start").agg(F.sum("seconds").alias("s"))
    hour_rows = row(by_hour, "hour", F.hour("window_start") + 1, F.date_format("window_start", "HH:mm"), F.col("s"))
    alarm_rows = row(_rank(alarm_pareto(inside, 10), [F.col("n_events").desc(), F.col("code")]), "alarm", F.col("rank"), F.col("code"), F.col("n_events"))
    machine_rows = row(top_alarm_machines(inside), "machine", F.col("rank"), F.col("machine_code"), F.col("n_events"))
    long_rows = row(longest_alarms(inside), "longest", F.col("rank"), F.coalesce("alarm_code", F.lit(DEFAULT_ALARM)), F.col("operate_period"))
    out = series
    for part in (total_rows, evaluation, hour_rows, alarm_rows, machine_rows, long_rows):
        out = out.unionByName(part)
    return out


def _rank(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Numbers for an already limited table."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def report_context(report: DataFrame, sections: Sequence[str] = ("weekly_rate", "total", "alarm", "machine")) -> DataFrame:
    """One JSON text per section for a question about the report, in order and without dates."""
    label = F.when(F.col("section") == "weekly_rate", F.lit(None)).otherwise(F.col("label"))
    entry = F.struct("position", label.alias("label"), "value")
    kept = report.filter(F.col("section").isin(*sections) & (F.col("position") <= 10))
    grouped = kept.groupBy("section").agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    return grouped.select("section", F.to_json("rows").alias("context"))


def production_trend(daily: DataFrame, days: int = 14, low: float = 0.6) -> DataFrame:
    """Last ``days`` daily results with mean, highest and lowest, and a flag for days below ``low`` of the mean.
    ``daily``: day, result_count."""
    last = daily.orderBy(F.col("day").desc()).limit(days)
    whole = Window.partitionBy()
    mean = F.avg("result_count").over(whole)
    count = F.col("result_count")
    return last.select(
        "day", "result_count", round_even(mean, 1).alias("mean_count"), F.max("result_count").over(whole).alias("max_count"),
        F.min("result_count").over(whole).alias("min_count"), ((count > 0) & (count < mean * low)).alias("low"),
    )


def forecast_weekday(daily: DataFrame, days: int = 14, ahead: int = 7) -> DataFrame:
    """Next days' results: mean of the same weekday among the last ``days`` observations, else their overall mean."""
    last = daily.orderBy(F.col("day").desc()).limit(days)
    base = last.agg(F.max("day").alias("latest"), F.avg("result_count").alias("overall"))
    future = base.select("overall", F.explode(F.sequence(F.date_add("latest", 1), F.date_add("latest", ahead))).alias("day"))
    same = last.groupBy(F.dayofweek("day").alias("dow")).agg(F.avg("result_count").alias("mean"))
    out = future.withColumn("dow", F.dayofweek("day")).join(same, "dow", "left")
    return out.select("day", F.round(F.coalesce("mean", "overall"), 6).alias("forecast"))


def forecast_weighted(rates: DataFrame, k: int = 5) -> DataFrame:
    """Next rate per machine: the last k weekday rates, clamped to 0..100, weighted 1..n."""
    obs = last_observations(rates, ["machine"], k)
    r = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("rate")))
    return obs.groupBy("machine").agg(F.round(F.sum(r * F.col("weight")) / F.sum("weight"), 6).alias("forecast"))


def forecast_summary(forecast: DataFrame, low: float = 30) -> DataFrame:
    f = F.col("forecast")
    return forecast.agg(
        F.count_if(f < low).alias("low_count"), F.round(F.avg(f), 6).alias("mean"), F.min_by("machine", F.struct("forecast", "machine")).alias("lowest_machine"), F.min(f).alias("lowest")
    )


def delivery_risk(orders: DataFrame, steps: DataFrame, day: str, overdue_days: int = 30, horizon: int = 30) -> DataFrame:
    """Open orders overdue (at most ``overdue_days``) or due within the horizon, with process progress and first
    open step. ``orders``: order_id, delivery_date; ``steps``: order_id, step_no, done."""
    progress = steps.groupBy("order_id").agg(
        F.count("*").alias("total_steps"), F.count_if("done").alias("done_steps"), F.min(F.when(~F.col("done"), F.col("step_no"))).alias("first_open")
    )
    left = F.date_diff("delivery_date", F.lit(day).cast("date"))
    near = orders.withColumn("remaining_days", left).filter(F.col("remaining_days").between(-overdue_days, horizon))
    open_ = near.join(progress, "order_id").filter("done_steps < total_steps")
    return open_.withColumn("tone", risk_tone(F.col("remaining_days")))


def risk_counts(risks: DataFrame) -> DataFrame:
    d = F.col("remaining_days")
    return risks.agg(
        F.count_if(d < 0).alias("overdue"), F.count_if(d.between(0, 7)).alias("due_7"), F.count_if(d.between(8, 30)).alias("due_8_30"), F.count("*").alias("total")
    )


def nearest_due(risks: DataFrame, k: int = 5) -> DataFrame:
    """k overdue and k imminent orders, nearest due date first."""
    band = F.when(F.col("remaining_days") < 0, "overdue").when(F.col("remaining_days") <= 7, "imminent")
    return topk(risks.withColumn("band", band).filter("band is not null"), ["band"], [F.col("remaining_days"), F.col("order_id")], k)


def depletion(df: DataFrame) -> DataFrame:
    """Days until the open work is done, without and with new work arriving.
    ``df``: scope, remaining, done_per_day, new_per_day."""
    net = F.col("done_per_day") - F.col("new_per_day")
    status = F.when(F.col("done_per_day") == 0, "NO_COMPLETION").when(net <= 0, "NOT_DEPLETING").otherwise("DEPLETING")
    return df.withColumn("status", status).withColumn("gross_days", F.round(F.try_divide(F.col("remaining"), F.col("done_per_day")), 6)).withColumn(
        "net_days", F.when(net > 0, F.round(F.col("remaining") / net, 6))
    )


def quality_card(rows: DataFrame, day: str) -> DataFrame:
    """Inspections of the last seven days, accepted and defect quantities, calibration due bands, latest defect.
    ``rows``: scope, at (date), kind, qty, defect, due (date)."""
    d = F.lit(day).cast("date")
    recent = F.col("at").between(F.date_sub(d, 6), d)
    until = F.date_diff("due", d)
    last = F.when(F.col("defect") & (F.col("at") <= d), F.struct("at", "qty"))
    return rows.groupBy("scope").agg(
        F.count_if(recent).alias("inspections_7d"),
        F.sum(F.when(recent & ~F.col("defect"), F.col("qty")).otherwise(0)).alias("accepted"),
        F.sum(F.when(recent & F.col("defect"), F.col("qty")).otherwise(0)).alias("defects"),
        F.count_if(until < 0).alias("expired"),
        F.count_if(until.between(0, 30)).alias("due_30"),
        F.max(last).alias("__l"),
    ).select("*", F.col("__l.at").alias("latest_defect"), F.col("__l.qty").alias("latest_qty")).drop("__l")


def route_sections(df: DataFrame) -> DataFrame:
    """Rows of the report feed placed by (DOMAIN_CD, STEP_NO); unmapped pairs drop out, empty sections stay as
    one row without data. ``df``: domain_cd, step_no and payload columns."""
    template = df.sparkSession.createDataFrame(SECTIONS, "code string, no int, domain string, section string")
    keyed = df.withColumn("code", F.upper(F.trim("domain_cd"))).withColumn("no", F.trim(F.col("step_no").cast("string")).try_cast("int"))
    return template.join(keyed, ["code", "no"], "left").drop("code", "no")


def summary_pair(rows: DataFrame, current: str, previous: str) -> DataFrame:
    """First row per domain for the current and the previous report day, side by side.
    ``rows``: domain, day, position, value."""
    days = rows.filter(F.col("day").isin(F.lit(current).cast("date"), F.lit(previous).cast("date")))
    first = days.groupBy("domain", "day").agg(F.min_by("value", "position").alias("value"))
    pick = lambda day: F.max(F.when(F.col("day") == F.lit(day).cast("date"), F.col("value")))
    out = first.groupBy("domain").agg(pick(current).alias("current"), pick(previous).alias("previous"))
    return out.withColumn("change", F.round(F.col("current") - F.col("previous"), 6))


def metric_cards(df: DataFrame) -> DataFrame:
    """Result as a share of the plan with its band. ``df``: domain, plan_qty, qty."""
    rate = F.coalesce(F.try_divide(F.col("qty") * 100.0, F.when(F.col("plan_qty") > 0, F.col("plan_qty"))), F.lit(0.0))
    band = F.when(F.col("rate") < 30, "WARN").when(F.col("rate") < 70, "WATCH").otherwise("GOOD")
    return df.withColumn("rate", F.round(rate, 6)).withColumn("badge", band)


def check_report_date(df: DataFrame, scope: str, day: str, wanted: str) -> DataFrame:
    """Scopes whose newest data day differs from the wanted report day."""
    newest = df.groupBy(scope).agg(F.max(F.to_date(day)).alias("newest"))
    return newest.filter(F.col("newest") != F.lit(wanted).cast("date"))
