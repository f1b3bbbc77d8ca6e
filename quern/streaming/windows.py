"""Metric windows on a stream, with thresholds that are calibrated anew as values come.

State is kept by ``transformWithState``: the last values of a metric as a list, the running mean and the count as one row.
It needs the RocksDB state store: ``spark.sql.streaming.stateStore.providerClass`` =
``org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: How many values a window holds, after how many it is calibrated, the weight of a new value, least thresholds.
SIZE, EVERY, ALPHA, LEAST_WARNING, LEAST_CRITICAL = 100, 50, 0.3, 5.0, 15.0
CALIBRATION = "metric string, n long, mean double, std double, ewma double, warning double, critical double"


class Calibrator(StatefulProcessor):
    """Takes (metric, at, id, value) and gives a calibration after every 50th value of a metric.

    The values of a batch are taken in the order of at and id. A metric that is silent for ``ttl_ms`` of processing time is forgotten.
    """

    def __init__(self, ttl_ms: int = 0):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getListState("values", "value double")
        self.running = handle.getValueState("running", "n long, ewma double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [x[0] for x in self.values.get()]
        n, ewma = self.running.get() if self.running.exists() else (0, 0.0)
        out = []
        for value in pd.concat(rows).sort_values(["at", "id"]).value.astype(float):
            ewma = value if n == 0 else ALPHA * value + (1 - ALPHA) * ewma
            held, n = (held + [value])[-SIZE:], n + 1
            if n % EVERY == 0:
                mean = math.fsum(held) / len(held)
                std = math.sqrt(math.fsum((x - mean) ** 2 for x in held) / (len(held) - 1))
                out.append((key[0], n, mean, std, ewma, max(ewma + 3 * std, 2 * ewma, LEAST_WARNING), max(ewma + 6 * std, 4 * ewma, LEAST_CRITICAL)))
        self.values.put([(x,) for x in held])
        self.running.update((n, ewma))
        if self.ttl_ms:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CALIBRATION.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.values.clear()
        self.running.clear()
        return iter(())

    def close(self) -> None:
        pass


def calibration_stream(values: DataFrame, ttl_ms: int = 0) -> DataFrame:
    """Calibrations of a stream (metric string, at timestamp, id long, value double). Rows with a null value are left out."""
    rows = values.filter("value IS NOT NULL")
    return rows.groupBy("metric").transformWithStateInPandas(Calibrator(ttl_ms), CALIBRATION, "append", "ProcessingTime" if ttl_ms else "None")


def calibrations(values: DataFrame) -> DataFrame:
    """The same of a table. What lies more than 200 values back counts for less than 1e-30 of a running mean and is left out."""
    order = Window.partitionBy("metric").orderBy("at", "id")
    last = lambda n: order.rowsBetween(1 - n, 0)
    rows = values.filter("value IS NOT NULL").withColumn("n", F.row_number().over(order).cast("long"))
    rows = rows.withColumns({"mean": F.avg("value").over(last(SIZE)), "std": F.stddev_samp("value").over(last(SIZE)), "vs": F.collect_list("value").over(last(2 * SIZE))}).filter(F.col("n") % EVERY == 0)
    tail = F.slice("vs", F.lit(2), F.greatest(F.size("vs") - 1, F.lit(1)))
    rows = rows.withColumn("ewma", F.aggregate(tail, F.element_at("vs", 1), lambda s, x: ALPHA * x + (1 - ALPHA) * s))
    bound = lambda k, m, least: F.greatest(F.col("ewma") + k * F.col("std"), F.col("ewma") * m, F.lit(least))
    return rows.select("metric", "n", "mean", "std", "ewma", bound(3, 2, LEAST_WARNING).alias("warning"), bound(6, 4, LEAST_CRITICAL).alias("critical"))
