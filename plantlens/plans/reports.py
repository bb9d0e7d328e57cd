"""Bindings of the report operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from ..functions.parse import project_spec
from .bindings import STATUS_SQL, status_history, top_sql
from .catalog import bins_sql
from .registry import query

CAP_SQL = "(SELECT DISTINCT user_id AS machine_code, CASE WHEN user_id % 10 = 9 THEN NULL ELSE (8 + user_id % 9) * 3600 END AS planned_seconds FROM events)"


def capacity(t):
    plan = F.when(F.col("user_id") % 10 != 9, (F.col("user_id") % 9 + 8) * 3600)
    return t.events.select(F.col("user_id").alias("machine_code"), plan.alias("planned_seconds")).distinct()


def day_sql(shift: int = 8) -> str:
    s = lambda code: f"CAST(sum(CASE WHEN status = '{code}' THEN seconds ELSE 0 END) AS BIGINT)"
    return f"""(SELECT machine_code, CAST(w - INTERVAL {shift} HOUR AS DATE) AS work_date, {s(0)} AS stop_seconds, {s(1)} AS operate_seconds, {s(2)} AS alarm_seconds, {s(3)} AS off_seconds
      FROM {bins_sql('day', shift)} GROUP BY ALL)"""


DAY = "strftime(work_date, '%Y-%m-%d') AS work_date"


def iso(name: str = "work_date"):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


@query("day_status_e2", f"SELECT machine_code, {DAY}, stop_seconds, operate_seconds, alarm_seconds, off_seconds FROM {day_sql()}")
def day_status_e2(t):
    return R.day_status(status_history(t), 8).withColumn("work_date", iso())


@query(
    "planned_rate_e3",
    f"SELECT machine_code, {DAY}, coalesce(round_even(round(operate_seconds * 100 / planned_seconds, 9), 2), -1) AS planned_rate FROM {day_sql()} JOIN {CAP_SQL} USING (machine_code)",
)
def planned_rate_e3(t):
    out = R.planned_rate(R.day_status(status_history(t), 8), capacity(t))
    return out.select("machine_code", iso(), F.coalesce("planned_rate", F.lit(-1.0)).alias("planned_rate"))


HOUR_SQL = f"(SELECT machine_code, w AS hour, round_even(round(sum(seconds) / 3600 * 100, 9), 1) AS rate, CAST(sum(seconds) AS BIGINT) AS seconds FROM {bins_sql('hour')} WHERE status = '1' GROUP BY ALL)"


@query("hourly_rate_e3b", f"SELECT machine_code, strftime(hour, '%Y-%m-%d %H') AS hour, rate, seconds FROM {HOUR_SQL}")
def hourly_rate_e3b(t):
    return R.hourly_rate(status_history(t)).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


@query(
    "alarm_groups_e4",
    f"""SELECT machine_code, {DAY}, code, n_events, total_seconds, CAST(row_number() OVER (PARTITION BY machine_code, work_date ORDER BY n_events DESC, code) AS INT) AS position FROM (
        SELECT machine_code, CAST(occur_date - INTERVAL 8 HOUR AS DATE) AS work_date, coalesce(alarm_code, '비상정지') AS code, count(*) AS n_events,
          CAST(coalesce(sum(operate_period) FILTER (WHERE operate_period > 0), 0) AS BIGINT) AS total_seconds FROM {STATUS_SQL} WHERE status = '2' GROUP BY ALL)""",
)
def alarm_groups_e4(t):
    out = R.alarm_groups(status_history(t), 8)
    return out.select("machine_code", iso(), "code", "n_events", F.coalesce("total_seconds", F.lit(0)).alias("total_seconds"), "position")


RATES_SQL = """(SELECT 'M' || (o_custkey % 40) AS machine, CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) % 1010 AS DOUBLE) / 10 AS rate FROM orders GROUP BY ALL)"""


def rates(t):
    return t.orders.groupBy(
        F.concat(F.lit("M"), (F.col("o_custkey") % 40).cast("string")).alias("machine"), F.to_date("o_orderdate").alias("day")
    ).agg(((F.sum(F.floor("o_totalprice")) % 1010).cast("double") / 10).alias("rate"))


@query(
    "machine_trend_e5",
    f"""SELECT machine, count(*) AS n_days, round_even(round(avg(rate), 9), 1) AS mean_rate, arg_min(rate, day) AS first_rate, arg_max(rate, day) AS latest_rate,
          round_even(arg_max(rate, day) - arg_min(rate, day), 1) AS change, min(rate) AS lowest, max(rate) AS highest FROM {RATES_SQL} WHERE isodow(day) < 6 GROUP BY machine""",
)
def machine_trend_e5(t):
    return R.machine_trend(rates(t))


@query(
    "daily_average_e6",
    f"SELECT strftime(day, '%Y-%m-%d') AS day, round_even(round(avg(rate), 9), 1) AS mean_rate, count(*) AS n_machines, isodow(day) >= 6 AS weekend FROM {RATES_SQL} GROUP BY day",
)
def daily_average_e6(t):
    out = R.daily_average(rates(t))
    return out.withColumn("day", iso("day"))


@query(
    "latest_bands_e7",
    f"""SELECT strftime(max(day), '%Y-%m-%d') AS day, count(*) FILTER (WHERE rate = 0) AS idle, count(*) FILTER (WHERE rate > 0 AND rate < 30) AS warn, count(*) FILTER (WHERE rate >= 30 AND rate < 70) AS watch,
          count(*) FILTER (WHERE rate >= 70) AS good, round(avg(rate) FILTER (WHERE rate > 0), 6) AS running_mean FROM {RATES_SQL} WHERE day = (SELECT max(day) FROM {RATES_SQL})""",
)
def latest_bands_e7(t):
    return R.latest_bands(rates(t)).withColumn("day", iso("day"))


@query(
    "alarm_pareto_e8",
    f"""WITH c AS (SELECT coalesce(alarm_code, '비상정지') AS code, count(*) AS n_events FROM {STATUS_SQL} WHERE status = '2' GROUP BY 1)
        SELECT code, n_events, round(n_events / (SELECT sum(n_events) FROM c) * 100, 6) AS share FROM c ORDER BY n_events DESC, code LIMIT 5""",
)
def alarm_pareto_e8(t):
    return R.alarm_pareto(status_history(t))


@query(
    "state_share_e9",
    f"""WITH c AS (SELECT status, CAST(sum(operate_period) AS BIGINT) AS seconds FROM {STATUS_SQL} WHERE operate_period > 0 GROUP BY 1)
        SELECT status, seconds, round(CAST(seconds AS DOUBLE) * 100 / (SELECT sum(seconds) FROM c), 6) AS share FROM c""",
)
def state_share_e9(t):
    return R.state_share(status_history(t))


ALL_DAYS_SQL = f"""(SELECT *, round_even(round(operate_seconds * 100 / planned_seconds, 9), 2) AS planned_rate FROM (
    SELECT work_date, CAST(sum(stop_seconds) AS BIGINT) AS stop_seconds, CAST(sum(operate_seconds) AS BIGINT) AS operate_seconds, CAST(sum(alarm_seconds) AS BIGINT) AS alarm_seconds,
      CAST(sum(off_seconds) AS BIGINT) AS off_seconds, CAST(sum(planned_seconds) AS BIGINT) AS planned_seconds FROM {day_sql()} JOIN {CAP_SQL} USING (machine_code) GROUP BY work_date))"""


@query(
    "cms_snapshot_m1",
    f"SELECT {DAY}, stop_seconds, operate_seconds, alarm_seconds, off_seconds, planned_seconds, planned_rate FROM {ALL_DAYS_SQL}",
)
def cms_snapshot_m1(t):
    return R.all_machine_days(status_history(t), capacity(t), 8).withColumn("work_date", iso())


CHANGES = {"planned_rate": True, "operate_seconds": True, "alarm_seconds": False, "stop_seconds": False, "off_seconds": False}


def _change_sql(name: str, good: bool) -> str:
    sign = ">" if good else "<"
    c = f"round({name} - lag({name}) OVER (ORDER BY work_date), 6)"
    return f"""SELECT {DAY}, '{name}' AS metric, CAST({name} AS DOUBLE) AS value, CAST(coalesce({c}, -999) AS DOUBLE) AS change,
      CASE WHEN {c} IS NULL OR {c} = 0 THEN 'neutral' WHEN {c} {sign} 0 THEN 'good' ELSE 'danger' END AS tone FROM {ALL_DAYS_SQL}"""


@query("day_change_m3", " UNION ALL ".join(_change_sql(n, g) for n, g in CHANGES.items()))
def day_change_m3(t):
    out = R.day_change(R.all_machine_days(status_history(t), capacity(t), 8), CHANGES)
    return out.withColumn("work_date", iso()).withColumn("change", F.coalesce("change", F.lit(-999.0)))


@query(
    "day_change_f3",
    f"""SELECT machine, strftime(day, '%Y-%m-%d') AS day, rate, coalesce(round(rate - lag(rate) OVER (PARTITION BY machine ORDER BY day), 6), -999) AS change FROM {RATES_SQL}""",
)
def day_change_f3(t):
    from ..operators.ordered import neighbour

    out = neighbour(rates(t), ["machine"], ["day"], F.date_trunc("year", "day"), {"previous": F.col("rate")})
    return out.select("machine", iso("day"), "rate", F.coalesce(F.round(F.col("rate") - F.col("previous"), 6), F.lit(-999.0)).alias("change"))


LAST5_SQL = f"""(SELECT machine, day, rate, count(*) OVER (PARTITION BY machine) - r + 1 AS weight FROM (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY day DESC) AS r
    FROM {RATES_SQL} WHERE isodow(day) < 6) WHERE r <= 5)"""


@query("last_observations_f7", f"SELECT machine, strftime(day, '%Y-%m-%d') AS day, rate, weight FROM {LAST5_SQL}")
def last_observations_f7(t):
    return R.last_observations(rates(t), ["machine"], 5).withColumn("day", iso("day"))


@query(
    "top_alarm_machines_f8",
    f"""SELECT machine_code, n_events, CAST(row_number() OVER (ORDER BY n_events DESC, machine_code) AS INT) AS rank FROM (
        SELECT machine_code, count(*) AS n_events FROM {STATUS_SQL} WHERE status = '2' GROUP BY 1) QUALIFY rank <= 3""",
)
def top_alarm_machines_f8(t):
    return R.top_alarm_machines(status_history(t))


@query(
    "longest_alarms_f8b",
    f"""SELECT event_id, machine_code, operate_period, CAST(row_number() OVER (ORDER BY operate_period DESC, event_id) AS INT) AS rank FROM {STATUS_SQL} WHERE status = '2' QUALIFY rank <= 3""",
)
def longest_alarms_f8b(t):
    return R.longest_alarms(status_history(t)).drop("alarm_code")


@query(
    "hour_extremes_f9",
    f"""SELECT machine_code, strftime(d, '%Y-%m-%d') AS work_date, CAST(first(h ORDER BY rate DESC, h) AS INT) AS max_hour, CAST(first(h ORDER BY rate, h) AS INT) AS min_hour,
          count(*) FILTER (WHERE rate < 30) AS low_hours FROM (SELECT machine_code, CAST(hour AS DATE) AS d, hour(hour) AS h, rate FROM {HOUR_SQL}) GROUP BY machine_code, d""",
)
def hour_extremes_f9(t):
    return R.hour_extremes(R.hourly_rate(status_history(t))).withColumn("work_date", iso())


REPORT_DAY = "2024-01-20"
INSIDE_SQL = f"(SELECT * FROM {STATUS_SQL} WHERE occur_date >= TIMESTAMP '{REPORT_DAY} 08:00:00' AND occur_date < TIMESTAMP '{REPORT_DAY} 08:00:00' + INTERVAL 1 DAY)"
REPORT_SQL = f"""(SELECT 'weekly_rate' AS section, CAST(date_diff('day', DATE '{REPORT_DAY}' - 6, work_date) + 1 AS INT) AS position, strftime(work_date, '%Y-%m-%d') AS label, planned_rate AS value
     FROM {ALL_DAYS_SQL} WHERE work_date BETWEEN DATE '{REPORT_DAY}' - 6 AND DATE '{REPORT_DAY}'
   UNION ALL SELECT 'total', p, n, CAST(v AS DOUBLE) FROM (SELECT unnest([1, 2, 3, 4, 5]) AS p, unnest(['planned', 'stop', 'operate', 'alarm', 'off']) AS n,
       unnest([planned_seconds, stop_seconds, operate_seconds, alarm_seconds, off_seconds]) AS v FROM {ALL_DAYS_SQL} WHERE work_date = DATE '{REPORT_DAY}')
   UNION ALL SELECT 'evaluation', 1, CASE WHEN planned_rate < 30 THEN 'danger' WHEN planned_rate < 50 THEN 'warning' ELSE 'good' END, planned_rate FROM {ALL_DAYS_SQL} WHERE work_date = DATE '{REPORT_DAY}'
   UNION ALL SELECT 'hour', CAST(hour(w) + 1 AS INT), strftime(w, '%H:%M'), CAST(sum(seconds) AS DOUBLE) FROM {bins_sql('hour')} WHERE status = '1' AND w >= TIMESTAMP '{REPORT_DAY} 08:00:00' AND w < TIMESTAMP '{REPORT_DAY} 08:00:00' + INTERVAL 1 DAY GROUP BY w
   UNION ALL (SELECT 'alarm', CAST(row_number() OVER (ORDER BY count(*) DESC, coalesce(alarm_code, '비상정지')) AS INT) AS rk, coalesce(alarm_code, '비상정지') AS c, CAST(count(*) AS DOUBLE) FROM {INSIDE_SQL} WHERE status = '2' GROUP BY c QUALIFY rk <= 10)
   UNION ALL (SELECT 'machine', CAST(row_number() OVER (ORDER BY count(*) DESC, machine_code) AS INT) AS rk, CAST(machine_code AS VARCHAR), CAST(count(*) AS DOUBLE) FROM {INSIDE_SQL} WHERE status = '2' GROUP BY machine_code QUALIFY rk <= 3)
   UNION ALL (SELECT 'longest', CAST(row_number() OVER (ORDER BY operate_period DESC, event_id) AS INT) AS rk, coalesce(alarm_code, '비상정지'), CAST(operate_period AS DOUBLE) FROM {INSIDE_SQL} WHERE status = '2' QUALIFY rk <= 3))"""


@query("cms_report_m2", f"SELECT section, position, label, value FROM {REPORT_SQL}")
def cms_report_m2(t):
    return R.cms_report(status_history(t), capacity(t), REPORT_DAY, 8)


@query(
    "report_context_m13",
    f"""SELECT section, '[' || string_agg('{{"position":' || position || CASE WHEN section = 'weekly_rate' THEN '' ELSE ',"label":"' || label || '"' END || ',"value":' || CAST(value AS VARCHAR) || '}}', ',' ORDER BY position) || ']' AS context
        FROM {REPORT_SQL} WHERE section IN ('weekly_rate', 'alarm', 'machine') AND position <= 10 GROUP BY section""",
)
def report_context_m13(t):
    return R.report_context(R.cms_report(status_history(t), capacity(t), REPORT_DAY, 8), ("weekly_rate", "alarm", "machine"))


DAILY_SQL = "(SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS result_count FROM orders GROUP BY 1)"
LAST14_SQL = f"(SELECT * FROM {DAILY_SQL} ORDER BY day DESC LIMIT 14)"


def daily(t):
    return t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("result_count"))


@query(
    "production_trend_m4",
    f"""SELECT strftime(day, '%Y-%m-%d') AS day, result_count, round_even(round(avg(result_count) OVER (), 9), 1) AS mean_count, max(result_count) OVER () AS max_count, min(result_count) OVER () AS min_count,
          result_count > 0 AND result_count < avg(result_count) OVER () * 0.6 AS low FROM {LAST14_SQL}""",
)
def production_trend_m4(t):
    return R.production_trend(daily(t)).withColumn("day", iso("day"))


@query(
    "forecast_weekday_m5",
    f"""SELECT strftime(d, '%Y-%m-%d') AS day, round(coalesce((SELECT avg(result_count) FROM {LAST14_SQL} l WHERE isodow(l.day) = isodow(d)), (SELECT avg(result_count) FROM {LAST14_SQL})), 6) AS forecast
        FROM (SELECT (SELECT max(day) FROM {DAILY_SQL}) + CAST(i AS INT) AS d FROM range(1, 8) r(i))""",
)
def forecast_weekday_m5(t):
    return R.forecast_weekday(daily(t)).withColumn("day", iso("day"))


FORECAST_SQL = f"(SELECT machine, round(sum(greatest(0, least(100, rate)) * weight) / sum(weight), 6) AS forecast FROM {LAST5_SQL} GROUP BY machine)"


@query("forecast_weighted_m6", f"SELECT machine, forecast FROM {FORECAST_SQL}")
def forecast_weighted_m6(t):
    return R.forecast_weighted(rates(t))


@query(
    "forecast_summary_m6b",
    f"SELECT count(*) FILTER (WHERE forecast < 30) AS low_count, round(avg(forecast), 6) AS mean, first(machine ORDER BY forecast, machine) AS lowest_machine, min(forecast) AS lowest FROM {FORECAST_SQL}",
)
def forecast_summary_m6b(t):
    return R.forecast_summary(R.forecast_weighted(rates(t)))


RISK_DAY = "1998-06-01"
RISK_SQL = f"""(SELECT o_orderkey AS order_id, date_diff('day', DATE '{RISK_DAY}', CAST(o_orderdate AS DATE)) AS remaining_days, total_steps, done_steps, first_open FROM orders
    JOIN (SELECT l_orderkey, count(*) AS total_steps, count(*) FILTER (WHERE l_linestatus = 'F') AS done_steps, min(l_linenumber) FILTER (WHERE l_linestatus <> 'F') AS first_open FROM lineitem GROUP BY 1)
      ON l_orderkey = o_orderkey WHERE done_steps < total_steps AND date_diff('day', DATE '{RISK_DAY}', CAST(o_orderdate AS DATE)) BETWEEN -30 AND 30)"""


def risks(t):
    orders = t.orders.select(F.col("o_orderkey").alias("order_id"), F.to_date("o_orderdate").alias("delivery_date"))
    steps = t.lineitem.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("step_no"), (F.col("l_linestatus") == "F").alias("done"))
    return R.delivery_risk(orders, steps, RISK_DAY)


@query(
    "delivery_risk_m7",
    f"SELECT order_id, CAST(remaining_days AS INT) AS remaining_days, total_steps, done_steps, first_open, CASE WHEN remaining_days < 0 THEN 'overdue' WHEN remaining_days <= 7 THEN 'danger' ELSE 'watch' END AS tone FROM {RISK_SQL}",
)
def delivery_risk_m7(t):
    return risks(t).drop("delivery_date")


@query(
    "risk_counts_m7b",
    f"SELECT count(*) FILTER (WHERE remaining_days < 0) AS overdue, count(*) FILTER (WHERE remaining_days BETWEEN 0 AND 7) AS due_7, count(*) FILTER (WHERE remaining_days BETWEEN 8 AND 30) AS due_8_30, count(*) AS total FROM {RISK_SQL}",
)
def risk_counts_m7b(t):
    return R.risk_counts(risks(t))


@query(
    "nearest_due_g5",
    f"""SELECT band, order_id, CAST(remaining_days AS INT) AS remaining_days, rank FROM {top_sql("(SELECT *, CASE WHEN remaining_days < 0 THEN 'overdue' WHEN remaining_days <= 7 THEN 'imminent' END AS band FROM " + RISK_SQL + " WHERE remaining_days <= 7)", 5, 'band', 'remaining_days, order_id')}""",
)
def nearest_due_g5(t):
    return R.nearest_due(risks(t)).select("band", "order_id", "remaining_days", "rank")


@query(
    "depletion_m8",
    """SELECT scope, remaining, status, round(remaining / NULLIF(done, 0), 6) AS gross_days, CASE WHEN done > new THEN round(remaining / (done - new), 6) END AS net_days FROM (
         SELECT *, CASE WHEN done = 0 THEN 'NO_COMPLETION' WHEN done <= new THEN 'NOT_DEPLETING' ELSE 'DEPLETING' END AS status FROM (
           SELECT o_custkey AS scope, count(*) FILTER (WHERE o_orderstatus = 'O') AS remaining, count(*) FILTER (WHERE o_orderstatus = 'F') / 28 AS done, count(*) FILTER (WHERE o_orderstatus = 'P') / 28 AS new FROM orders GROUP BY 1))""",
)
def depletion_m8(t):
    s = F.col("o_orderstatus")
    df = t.orders.groupBy(F.col("o_custkey").alias("scope")).agg(
        F.count_if(s == "O").alias("remaining"), (F.count_if(s == "F") / 28).alias("done_per_day"), (F.count_if(s == "P") / 28).alias("new_per_day")
    )
    return R.depletion(df).drop("done_per_day", "new_per_day")


QDAY = "1999-01-15"


@query(
    "quality_card_m9",
    f"""SELECT l_suppkey AS scope, count(*) FILTER (WHERE rec) AS inspections_7d, coalesce(sum(l_quantity) FILTER (WHERE rec AND NOT bad), 0) AS accepted, coalesce(sum(l_quantity) FILTER (WHERE rec AND bad), 0) AS defects,
          count(*) FILTER (WHERE due < 0) AS expired, count(*) FILTER (WHERE due BETWEEN 0 AND 30) AS due_30, strftime(max(d_at) FILTER (WHERE bad AND d_at <= DATE '{QDAY}'), '%Y-%m-%d') AS latest_defect
        FROM (SELECT *, CAST(l_shipdate AS DATE) AS d_at, l_returnflag = 'R' AS bad, CAST(l_shipdate AS DATE) BETWEEN DATE '{QDAY}' - 6 AND DATE '{QDAY}' AS rec,
          date_diff('day', DATE '{QDAY}', CAST(l_shipdate AS DATE) + 365) AS due FROM lineitem) GROUP BY l_suppkey""",
)
def quality_card_m9(t):
    at = F.to_date("l_shipdate")
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("scope"), at.alias("at"), F.col("l_quantity").alias("qty"), (F.col("l_returnflag") == "R").alias("defect"), F.date_add(at, 365).alias("due")
    )
    return R.quality_card(rows, QDAY).drop("latest_qty").withColumn("latest_defect", iso("latest_defect"))


FEED_SQL = """(SELECT o_orderkey, list_extract(['prod ', 'SHIP', 'delv', 'QUAL', 'EQUIP', 'ATT', 'NONE'], CAST(o_custkey % 7 + 1 AS INT)) AS domain_cd, o_orderkey % 9 AS step_no FROM orders)"""
MAP_SQL = "(VALUES " + ", ".join(
    f"('{code}', {n}, '{domain}', '{section}')" for code, n, domain, section in R.SECTIONS
) + ") m(code, no, domain, section)"


def feed(t):
    codes = F.array(*map(F.lit, ("prod ", "SHIP", "delv", "QUAL", "EQUIP", "ATT", "NONE")))
    return t.orders.select(
        "o_orderkey", F.element_at(codes, (F.col("o_custkey") % 7 + 1).cast("int")).alias("domain_cd"), (F.col("o_orderkey") % 9).alias("step_no"),
        "o_totalprice", "o_orderpriority",
    )


@query(
    "route_sections_a11",
    f"SELECT domain, section, coalesce(o_orderkey, -1) AS o_orderkey FROM {MAP_SQL} LEFT JOIN {FEED_SQL} f ON upper(trim(domain_cd)) = code AND step_no = no",
)
def route_sections_a11(t):
    return R.route_sections(feed(t)).select("domain", "section", F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"))


@query(
    "daily_sections_m10",
    f"""SELECT domain, section, count(o_orderkey) AS n_rows, coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)), 0)::BIGINT AS amount FROM {MAP_SQL}
        LEFT JOIN (SELECT f.*, o_totalprice FROM {FEED_SQL} f JOIN orders USING (o_orderkey)) f ON upper(trim(domain_cd)) = code AND step_no = no GROUP BY ALL""",
)
def daily_sections_m10(t):
    spec = {
        "domain": {"source": "domain"}, "section": {"source": "section"}, "order_no": {"source": "o_orderkey", "type": "int", "default": None},
        "amount": {"source": ["amount", "o_totalprice"], "type": "int", "default": 0},
    }
    rows = project_spec(R.route_sections(feed(t)), spec)
    return rows.groupBy("domain", "section").agg(F.count("order_no").alias("n_rows"), F.sum("amount").alias("amount"))


@query(
    "summary_pair_e17",
    """WITH f AS (SELECT o_orderpriority AS domain, CAST(o_orderdate AS DATE) AS d, arg_min(o_totalprice, o_orderkey) AS v FROM orders GROUP BY ALL),
         x AS (SELECT domain, max(v) FILTER (WHERE d = DATE '1997-03-10') AS cur, max(v) FILTER (WHERE d = DATE '1997-03-07') AS prev FROM f WHERE d IN (DATE '1997-03-10', DATE '1997-03-07') GROUP BY domain)
       SELECT domain, coalesce(cur, -1) AS "current", coalesce(prev, -1) AS previous, coalesce(round(cur - prev, 6), -1) AS change FROM x""",
)
def summary_pair_e17(t):
    rows = t.orders.select(F.col("o_orderpriority").alias("domain"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("position"), F.col("o_totalprice").alias("value"))
    out = R.summary_pair(rows, "1997-03-10", "1997-03-07")
    return out.select("domain", *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("current", "previous", "change")])


@query(
    "metric_cards_m11",
    """SELECT domain, plan_qty, qty, rate, CASE WHEN rate < 30 THEN 'WARN' WHEN rate < 70 THEN 'WATCH' ELSE 'GOOD' END AS badge FROM (
         SELECT *, CASE WHEN plan_qty > 0 THEN round(qty * 100.0 / plan_qty, 6) ELSE 0 END AS rate FROM (
           SELECT l_partkey AS domain, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS plan_qty, sum(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS qty FROM lineitem GROUP BY 1))""",
)
def metric_cards_m11(t):
    n = F.col("l_returnflag") == "N"
    df = t.lineitem.groupBy(F.col("l_partkey").alias("domain")).agg(
        F.sum(F.when(n, F.col("l_quantity")).otherwise(0.0)).alias("plan_qty"), F.sum(F.when(n & (F.col("l_linestatus") == "F"), F.col("l_quantity")).otherwise(0.0)).alias("qty")
    )
    return R.metric_cards(df)


@query(
    "check_report_date_m12",
    "SELECT o_custkey, strftime(max(CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS newest FROM orders GROUP BY 1 HAVING max(CAST(o_orderdate AS DATE)) <> DATE '2001-06-01'",
)
def check_report_date_m12(t):
    return R.check_report_date(t.orders, "o_custkey", "o_orderdate", "2001-06-01").withColumn("newest", iso("newest"))
