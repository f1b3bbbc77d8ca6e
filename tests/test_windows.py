"""Calibrations on a stream equal those of the table, over many batches and a restart."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quern.streaming import windows

STORE = "spark.sql.streaming.stateStore.providerClass"


def test_stream_equals_table(spark, tmp_path):
    rnd, start = random.Random(4), datetime.datetime(2024, 1, 1)
    rows = [(rnd.choice(["latency", "latency", "errors"]), start + datetime.timedelta(seconds=i // 3), i, None if i % 97 == 0 else rnd.gauss(3, 1)) for i in range(900)]
    for part in range(6):  # each file is a batch; a metric that is seen once has no calibration
        own = rows[part * 150 : (part + 1) * 150] + [(f"rare{part}", start, part, 1.0)]
        rnd.shuffle(own)
        spark.createDataFrame(own, "metric string, at timestamp, id long, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{part}")
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for upto in (3, 6):  # stopped after three files, and started again from its checkpoint
            for p in range(upto - 3, upto):
                spark.read.parquet(f"{tmp_path}/in/{p}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/all")
            stream = spark.readStream.schema("metric string, at timestamp, id long, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/all")
            query = windows.calibration_stream(stream).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").format("parquet").option("path", f"{tmp_path}/out").start()
            assert query.awaitTermination(120)
            assert query.exception() is None
    finally:
        spark.conf.unset(STORE)
    found = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    table = spark.read.parquet(*(f"{tmp_path}/in/{p}" for p in range(6)))
    want = sorted(tuple(r) for r in windows.calibrations(table).collect())
    assert len(want) > 10 and [f[:2] for f in found] == [w[:2] for w in want]
    for f, w in zip(found, want, strict=True):
        assert f[2:] == pytest.approx(w[2:], rel=1e-9)
    assert windows.calibrations(table.filter(F.lit(False))).count() == 0
