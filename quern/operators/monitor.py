"""Metrics, thresholds and alerts over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the latency histogram, the weight of a new value in the running mean.
LATENCY_BOUNDS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)
ALPHA = 0.3


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(part / F.greatest(whole, F.lit(1)), digits)


def histogram(rows: DataFrame, key: str, value: str, bounds: tuple[float, ...]) -> DataFrame:
    """(key, le, n): how many values are at most each bound."""
    counts = rows.groupBy(key).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    pairs = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]))
    return counts.select(key, pairs.alias("x")).select(key, "x.le", "x.n")


def ranked_values(rows: DataFrame, key: str, value: str) -> DataFrame:
    """rows with the place of each value within its key, from 0, and how many there are."""
    own = Window.partitionBy(key)
    return rows.withColumn("place", F.row_number().over(own.orderBy(value)) - 1).withColumn("n", F.count("*").over(own))


def p95(rows: DataFrame, key: str, value: str, digits: int = 6) -> DataFrame:
    """(key, p95): the value at place int(0.95 n), the last at most. Sorted by a window, so a key may have any number of values."""
    at = F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1)
    return ranked_values(rows, key, value).filter(F.col("place") == at).select(key, F.round(value, digits).alias("p95"))


def last_window(rows: DataFrame, key: str, order: list[str], size: int = 100) -> DataFrame:
    """The last ``size`` rows of each key."""
    back = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= size)


def ewma(values: Column, alpha: float = ALPHA) -> Column:
    """Running mean of an ordered array; the first value starts it."""
    return F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(1))), F.element_at(values, 1), lambda s, x: alpha * x + (1 - alpha) * s)


def window_stats(rows: DataFrame, key: str, value: str, order: list[str], size: int = 100) -> DataFrame:
    """(key, n, mean, std, ewma) of the last ``size`` values of each key, an array of bounded length."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("v"))))
    held = last_window(rows, key, order, size).groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.transform(listed, lambda x: x["v"]).alias("vs"))
    return held.select(key, "n", "mean", "std", ewma(F.col("vs")).alias("ewma"))


def latency_thresholds(stats: DataFrame) -> DataFrame:
    """Warning and critical latency of windows of 50 values or more; the defaults for others."""
    ready, b, s = F.col("n") >= 50, F.col("ewma"), F.col("std")
    return stats.withColumn("latency_warning", F.when(ready, F.greatest(b + 3 * s, b * 2.0, F.lit(5.0))).otherwise(5.0)).withColumn("latency_critical", F.when(ready, F.greatest(b + 6 * s, b * 4.0, F.lit(15.0))).otherwise(15.0))


def rate_thresholds(stats: DataFrame) -> DataFrame:
    """Warning and critical error rate, least pass rate and largest share of made-up claims, by the same window."""
    b, s = F.col("ewma"), F.col("std")
    return (
        stats.withColumn("error_warning", F.least(F.lit(0.5), F.greatest(b + 3 * s, F.lit(0.05))))
        .withColumn("error_critical", F.least(F.lit(0.75), F.greatest(b + 5 * s, F.lit(0.15))))
        .withColumn("pass_min", F.greatest(F.lit(0.6), F.least(F.lit(0.95), b - 2 * s)))
        .withColumn("made_up_max", F.least(F.lit(0.5), F.greatest(F.lit(0.05), b + 3 * s)))
    )


def breaches(*flags: Column) -> Column:
    """How many thresholds are breached; two call for a rollback."""
    total = F.lit(0)
    for flag in flags:
        total = total + F.when(flag, 1).otherwise(0)
    return total


def firing(rows: DataFrame, key: str, time: str, over: Column, least: int) -> DataFrame:
    """(key, started, ended, periods): runs of periods over a threshold that last at least so many periods."""
    order = Window.partitionBy(key).orderBy(time)
    marked = rows.withColumn("over", over).withColumn("run", F.row_number().over(order) - F.row_number().over(Window.partitionBy(key, "over").orderBy(time)))
    runs = marked.filter("over").groupBy(key, "run").agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count("*").alias("periods"))
    return runs.filter(F.col("periods") >= least).drop("run")


def canary_bucket(value: Column) -> Column:
    """0 to 99, from the first eight hex digits of the MD5."""
    return (F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long") % 100).cast("long")


#: Rates that call for an alert of the dashboard: name, level, bound, and whether rates above or below it do.
DASHBOARD = (("fallback_rate", "warning", 0.25, True), ("human_fallback_rate", "warning", 0.15, True), ("tool_success_rate", "error", 0.9, False), ("verification_pass_rate", "warning", 0.85, False))
#: Bounds beyond which a release is critical: seconds, and shares.
CRITICAL = {"p95_latency": 30.0, "error_rate": 0.25, "verification_pass_rate": 0.85, "hallucination_rate": 0.15}


def dashboard_alerts(rates: dict[str, Column], attempts: dict[str, Column]) -> Column:
    """array of struct(name, level, rate): rates that are out of bounds. Rates with attempts count only if there were any."""
    found = []
    for name, level, bound, above in DASHBOARD:
        out = rates[name] > bound if above else rates[name] < bound
        found.append(F.when(out & (attempts[name] > 0) if name in attempts else out, F.struct(F.lit(name).alias("name"), F.lit(level).alias("level"), rates[name].alias("rate"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def critical(p95_ms: Column, error_rate: Column, pass_rate: Column, hallucination_rate: Column, bounds: dict[str, float] = CRITICAL) -> Column:
    """How many of the four bounds of a release are breached; two call for a rollback."""
    return breaches(p95_ms / 1000 > bounds["p95_latency"], error_rate > bounds["error_rate"], pass_rate < bounds["verification_pass_rate"], hallucination_rate > bounds["hallucination_rate"])


#: Alert rules by group: name, severity, what is measured, over how many minutes, the side of the bound that calls, the bound,
#: and for how many minutes it must hold.
ALERTS = {
    "latency": (("HighP95Latency", "warning", "p95_latency", 5, ">", 10.0, 5), ("CriticalP95Latency", "critical", "p95_latency", 5, ">", 30.0, 3)),
    "errors": (
        ("HighErrorRate", "warning", "errors/requests", 5, ">", 0.10, 5),
        ("CriticalErrorRate", "critical", "errors/requests", 5, ">", 0.25, 3),
        ("HighToolFailureRate", "warning", "tool_errors/tool_calls", 5, ">", 0.15, 5),
    ),
    "retrieval": (
        ("LowRetrievalQuality", "warning", "top_score", 1, "<", 0.05, 10),
        ("HighNoDocRate", "warning", "no_docs/retrievals", 10, ">", 0.20, 10),
        ("HighFallbackRate", "warning", "fallbacks/requests", 10, ">", 0.25, 10),
    ),
    "verification": (("LowVerificationPassRate", "warning", "passes/checks", 10, "<", 0.85, 10), ("HighHallucinationRate", "critical", "hallucination_rate", 1, ">", 0.15, 10)),
    "system": (
        ("ServiceDown", "critical", "up", 1, "=", 0.0, 1),
        ("HighMemoryUsage", "warning", "memory_gb", 1, ">", 20.0, 5),
        ("CacheHitRateDrop", "info", "cache_hits/cache_requests", 10, "<", 0.3, 10),
    ),
}


def bucket_quantile(counts: list[Column], bounds: tuple[float, ...], q: float = 0.95) -> Column:
    """A quantile from the counts of each bucket, one more than bounds: linear within its bucket, the last bound beyond it; null without values."""
    upto = [counts[0]]
    for n in counts[1:]:
        upto.append(upto[-1] + n)
    target, found = upto[-1] * F.lit(q), F.when(upto[-1] == 0, F.lit(None).cast("double"))
    for i, bound in enumerate(bounds):
        low, before = (bounds[i - 1], upto[i - 1]) if i else (0.0, F.lit(0))
        found = found.when(upto[i] >= target, F.lit(low) + F.lit(bound - low) * F.try_divide(target - before, counts[i].cast("double")))
    return found.otherwise(float(bounds[-1]))


def alert_rules(samples: DataFrame, key: str, minute: str, bounds: tuple[float, ...] = LATENCY_BOUNDS) -> DataFrame:
    """(key, group, alert, severity, started, ended): runs of minutes in which a rule's condition held, long enough to fire.

    samples has one row for each key and minute (a whole number): counters of that minute, b0, b1, ... of latencies by
    bucket, and gauges. A minute without a row, a rate without attempts and a null gauge end a run.
    """
    past = lambda n: Window.partitionBy(key).orderBy(minute).rangeBetween(1 - n, 0)
    total = lambda c, n: F.sum(c).over(past(n))

    def measured(what: str, n: int) -> Column:
        if what == "p95_latency":
            return bucket_quantile([total(f"b{i}", n) for i in range(len(bounds) + 1)], bounds)
        if "/" in what:
            part, whole = what.split("/")
            return F.try_divide(total(part, n).cast("double"), total(whole, n).cast("double"))
        return F.col(what)

    rules = [(group, *rule) for group, listed in ALERTS.items() for rule in listed]
    held = {">": lambda c, b: c > b, "<": lambda c, b: c < b, "=": lambda c, b: c == b}
    flags = samples.select(key, minute, *[F.coalesce(held[side](measured(what, n), F.lit(bound)), F.lit(False)).alias(name) for _, name, _, what, n, side, bound, _ in rules])
    rows = F.array(*[F.struct(F.lit(g).alias("group"), F.lit(name).alias("alert"), F.lit(level).alias("severity"), F.lit(lasts).alias("lasts"), F.col(name).alias("over")) for g, name, level, _, _, _, _, lasts in rules])
    over = flags.select(key, minute, F.explode(F.filter(rows, lambda x: x["over"])).alias("x")).select(key, minute, "x.*")
    run = F.col(minute) - F.row_number().over(Window.partitionBy(key, "alert").orderBy(minute))
    runs = over.withColumn("run", run).groupBy(key, "group", "alert", "severity", "lasts", "run").agg(F.min(minute).alias("started"), F.max(minute).alias("ended"))
    return runs.filter(F.col("ended") - F.col("started") >= F.col("lasts")).select(key, "group", "alert", "severity", "started", "ended")
