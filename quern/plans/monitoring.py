"""Metrics, calibration and alerts on events: value stands for latency, the type ``error`` for a failure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import monitor
from quern.plans.registry import Registry
from quern.sources.tables import table
from quern.streaming import replay

Q = Registry()


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@Q.query("metrics_snapshot", """SELECT count(*) AS requests, round(count(*) FILTER (event_type <> 'error') / greatest(count(*), 1), 4) AS success_rate, round(avg(value), 2) AS avg_latency, count(DISTINCT user_id) AS users, round(count(*) FILTER (event_type = 'purchase') / greatest(count(*), 1), 4) AS purchase_rate FROM events""")
def metrics_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    return events(spark, sf_dir).agg(n.alias("requests"), monitor.rate(F.count_if(F.col("event_type") != "error"), n).alias("success_rate"), F.round(F.avg("value"), 2).alias("avg_latency"), F.countDistinct("user_id").alias("users"), monitor.rate(F.count_if(F.col("event_type") == "purchase"), n).alias("purchase_rate"))


@Q.query("intent_counts", "SELECT coalesce(nullif(event_type, ''), 'unknown') AS intent, count(*) AS n FROM events GROUP BY 1")
def intent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.coalesce(F.nullif("event_type", F.lit("")), F.lit("unknown")).alias("intent")).agg(F.count("*").alias("n"))


@Q.query("group_count", "SELECT event_type, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).rollup("event_type").agg(F.count("*").alias("n"))


HIST = ", ".join(f"({b})" for b in monitor.LATENCY_BOUNDS)


@Q.query("latency_histogram", f"SELECT event_type, le::DOUBLE AS le, count(*) FILTER (value <= le::DOUBLE) AS n FROM events, (VALUES {HIST}) t(le) GROUP BY event_type, le")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.histogram(events(spark, sf_dir), "event_type", "value", monitor.LATENCY_BOUNDS)


@Q.query("p95_by_type", "SELECT event_type, round(list_sort(list(value))[least(CAST(floor(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1], 6) AS p95 FROM events GROUP BY event_type")
def p95_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.p95(events(spark, sf_dir), "event_type", "value")


STATS = """WITH b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events),
s AS (SELECT user_id, count(*) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, list_reduce(list(value ORDER BY ts, event_id), lambda s, x: 0.3::DOUBLE * x + 0.7::DOUBLE * s) AS ewma FROM b WHERE back <= 100 GROUP BY user_id)
"""


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.window_stats(events(spark, sf_dir), "user_id", "value", ["ts", "event_id"])


@Q.query("ewma_by_user", STATS + "SELECT user_id, n, round(mean, 6) AS mean, round(std, 6) AS std, round(ewma, 6) AS ewma FROM s")
def ewma_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(spark, sf_dir).select("user_id", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "ewma")])


@Q.query("rolling_stats", "SELECT event_id, round(sum(value) OVER w, 2) AS total, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def rolling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-99, 0)
    return events(spark, sf_dir).select("event_id", F.round(F.sum("value").over(w), 2).alias("total"), F.count("*").over(w).alias("n"))


@Q.query("calibrate", STATS + "SELECT user_id, round(CASE WHEN n >= 50 THEN greatest(ewma + 3 * std, ewma * 2.0, 5.0) ELSE 5.0 END, 4)::DOUBLE AS latency_warning, round(CASE WHEN n >= 50 THEN greatest(ewma + 6 * std, ewma * 4.0, 15.0) ELSE 15.0 END, 4)::DOUBLE AS latency_critical FROM s")
def calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.latency_thresholds(stats(spark, sf_dir)).select("user_id", F.round("latency_warning", 4).alias("latency_warning"), F.round("latency_critical", 4).alias("latency_critical"))


DAILY = """d AS (SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, max(value) AS top, avg(value) AS mean FROM events GROUP BY ALL),
e AS (SELECT date_trunc('day', ts) AS day, count(*) FILTER (event_type = 'error') / count(*) AS error_rate, max(value) AS top FROM events GROUP BY 1)"""


@Q.query("rollback_decision", """WITH d AS (SELECT CAST(ts AS DATE) AS day, max(value) * 100 AS p95, avg((event_type = 'error')::INT::DOUBLE) AS error_rate, avg((event_type <> 'view')::INT::DOUBLE) AS pass_rate, avg((event_type = 'signup')::INT::DOUBLE) AS made_up FROM events GROUP BY 1),
b AS (SELECT day, (p95 / 1000 > 30)::INT + (error_rate > 0.25)::INT + (pass_rate < 0.85)::INT + (made_up > 0.15)::INT AS breached FROM d) SELECT strftime(day, '%Y-%m-%d') AS day, CAST(breached AS INT) AS breached, breached >= 2 AS rollback FROM b""")
def rollback_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days against the critical bounds: the largest value stands for latency, shares of event types for the rates."""
    share = lambda held: F.avg(held.cast("int").cast("double"))
    kind = F.col("event_type")
    daily = events(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg((F.max("value") * 100).alias("p95"), share(kind == "error").alias("error_rate"), share(kind != "view").alias("pass_rate"), share(kind == "signup").alias("made_up"))
    breached = monitor.critical(F.col("p95"), F.col("error_rate"), F.col("pass_rate"), F.col("made_up"))
    return daily.select(F.col("day").cast("string").alias("day"), breached.alias("breached"), (breached >= 2).alias("rollback"))


@Q.query("alert_windows", """WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n FROM events GROUP BY ALL), o AS (SELECT *, n >= 2 AS over FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY hour) - row_number() OVER (PARTITION BY event_type, over ORDER BY hour) AS run FROM o)
SELECT event_type, CAST(min(hour) AS TIMESTAMP) AS started, CAST(max(hour) AS TIMESTAMP) AS ended, count(*) AS periods FROM r WHERE over GROUP BY event_type, run HAVING count(*) >= 3""")
def alert_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = events(spark, sf_dir).groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
    runs = monitor.firing(hours, "event_type", "hour", F.col("n") >= 2, 3)
    return runs.select("event_type", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "periods")


@Q.query("dashboard_alerts", """WITH m AS (SELECT user_id, avg((event_type = 'error')::INT::DOUBLE) AS fallback, avg((event_type = 'signup')::INT::DOUBLE) AS human, count(*) FILTER (event_type IN ('click', 'purchase')) AS tools, coalesce(avg((event_type = 'click')::INT::DOUBLE) FILTER (event_type IN ('click', 'purchase')), 0) AS tool_rate, count(*) FILTER (event_type = 'view') AS checks, coalesce(avg((value > 20)::INT::DOUBLE) FILTER (event_type = 'view'), 0) AS pass_rate FROM events GROUP BY user_id)
SELECT user_id, concat_ws(',', CASE WHEN fallback > 0.25 THEN 'fallback_rate' END, CASE WHEN human > 0.15 THEN 'human_fallback_rate' END, CASE WHEN tool_rate < 0.9 AND tools > 0 THEN 'tool_success_rate' END, CASE WHEN pass_rate < 0.85 AND checks > 0 THEN 'verification_pass_rate' END) AS alerts FROM m""")
def dashboard_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as a service's: errors fall back, signups go to people, clicks among clicks and purchases succeed, views are checks."""
    kind = F.col("event_type")
    share = lambda held, among: F.coalesce(F.avg(F.when(among, held.cast("int").cast("double"))), F.lit(0.0))
    calls, checks, all_ = kind.isin("click", "purchase"), kind == "view", F.lit(True)
    rates = {"fallback_rate": share(kind == "error", all_), "human_fallback_rate": share(kind == "signup", all_), "tool_success_rate": share(kind == "click", calls), "verification_pass_rate": share(F.col("value") > 20, checks)}
    counted = events(spark, sf_dir).groupBy("user_id").agg(*[c.alias(n) for n, c in rates.items()], F.count_if(calls).alias("calls"), F.count_if(checks).alias("checks"))
    alerts = monitor.dashboard_alerts({n: F.col(n) for n in rates}, {"tool_success_rate": F.col("calls"), "verification_pass_rate": F.col("checks")})
    return counted.select("user_id", F.array_join(F.transform(alerts, lambda x: x["name"]), ",").alias("alerts"))


@Q.query("canary_bucket", "SELECT event_id, CAST(CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS BIGINT) AS bucket, CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 10 AS canary FROM events")
def canary_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = monitor.canary_bucket(F.col("user_id").cast("string"))
    return events(spark, sf_dir).select("event_id", bucket.alias("bucket"), (bucket < 10).alias("canary"))


@Q.query("canary_delta", """WITH g AS (SELECT event_type, avg(value) FILTER (user_id % 10 = 0) AS canary, avg(value) FILTER (user_id % 10 <> 0) AS base FROM events GROUP BY event_type)
SELECT event_type, round(canary / base - 1, 4) AS increase, canary / base - 1 <= 0.2 AS passes FROM g""")
def canary_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda on: F.avg(F.when(on, F.col("value")))
    ratio = mean(F.col("user_id") % 10 == 0) / mean(F.col("user_id") % 10 != 0) - 1
    return events(spark, sf_dir).groupBy("event_type").agg(F.round(ratio, 4).alias("increase"), (ratio <= 0.2).alias("passes"))


@Q.query("event_rows", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp_iso FROM events")
def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "k long")
    return events(spark, sf_dir).select("event_id", props["k"].alias("k"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp_iso"))


@Q.query("tumbling_window", "SELECT CAST(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS TIMESTAMP) AS started, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("started"), "event_type", "n", "total")


@Q.query("session_window", """WITH g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 4 HOUR AS gap FROM events), s AS (SELECT *, sum(coalesce(gap, false)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS started, count(*) AS n FROM s GROUP BY user_id, session""")
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "4 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


@Q.query("rate_limit_replay")
def rate_limit_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission depends on earlier admissions: held against a plain loop in the tests."""
    return replay.rate_limit(events(spark, sf_dir).select("user_id", "ts", "event_id"), 3, 86400.0)


@Q.query("breaker_replay")
def breaker_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A breaker's state depends on its past: held against a plain loop in the tests."""
    return replay.circuit_breaker(events(spark, sf_dir).select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("ok")), 2, 3600.0)


@Q.query("cache_replay")
def cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is held depends on what was evicted: held against a plain loop in the tests."""
    return replay.cache_hits(events(spark, sf_dir).select("event_id", "user_id", "ts", F.col("props").alias("key")), 86400.0 * 3, 20)
