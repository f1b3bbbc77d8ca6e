"""Stateful rules by key: the same steps run over a table in order, or over a stream with state."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Limiter:
    """Admits a request if fewer than limit were admitted within the last window seconds; denied ones don't count."""

    def __init__(self, limit: int, window: float, admitted: list[float] | None = None):
        self.limit, self.window, self.admitted = limit, window, deque(admitted or [])

    def step(self, at: float) -> bool:
        while self.admitted and self.admitted[0] <= at - self.window:
            self.admitted.popleft()
        if len(self.admitted) >= self.limit:
            return False
        self.admitted.append(at)
        return True


class Breaker:
    """Opens for ``pause`` seconds after so many failures in a row; a success closes it."""

    def __init__(self, failures: int, pause: float, failed: int = 0, until: float = float("-inf")):
        self.failures, self.pause, self.failed, self.until = failures, pause, failed, until

    def step(self, at: float, ok: bool) -> bool:
        """Whether the call is let through."""
        if at < self.until:
            return False
        if ok:
            self.failed = 0
        else:
            self.failed += 1
            if self.failed >= self.failures:
                self.until, self.failed = at + self.pause, 0
        return True


def by_key(rows: DataFrame, key: str, run, schema: str) -> DataFrame:
    """rows in order within each key, streamed through run(key, iterator of rows): no key is held in memory as a whole."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        for frame in batches:
            out = []
            for k, group in frame.groupby(key, sort=False):
                if k not in state:
                    state.clear()  # keys follow one another, so the last one's state is enough
                out.append(run(state, k, group))
            yield pd.concat(out) if out else frame

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key).sortWithinPartitions(key, "ts", "event_id").mapInPandas(go, schema)


def seconds(ts: pd.Series) -> list[float]:
    return [x.timestamp() for x in ts]


def rate_limit(rows: DataFrame, limit: int, window: float) -> DataFrame:
    """(event_id, user_id, admitted) by a sliding window for each user."""

    def run(state: dict, key, group: pd.DataFrame) -> pd.DataFrame:
        limiter = state.setdefault(key, Limiter(limit, window))
        return pd.DataFrame({"event_id": group.event_id, "user_id": group.user_id, "admitted": [limiter.step(at) for at in seconds(group.ts)]})

    return by_key(rows.select("event_id", "user_id", "ts"), "user_id", run, "event_id long, user_id long, admitted boolean")


def circuit_breaker(rows: DataFrame, failures: int, pause: float) -> DataFrame:
    """(event_id, user_id, passed) by a breaker for each user."""

    def run(state: dict, key, group: pd.DataFrame) -> pd.DataFrame:
        breaker = state.setdefault(key, Breaker(failures, pause))
        return pd.DataFrame({"event_id": group.event_id, "user_id": group.user_id, "passed": [breaker.step(at, ok) for at, ok in zip(seconds(group.ts), group.ok, strict=True)]})

    return by_key(rows.select("event_id", "user_id", "ts", "ok"), "user_id", run, "event_id long, user_id long, passed boolean")


def rate_limit_stream(rows: DataFrame, limit: int, window: float) -> DataFrame:
    """The same rule on a stream (event_id, user_id, ts), with the admitted times as state."""

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        limiter = Limiter(limit, window, list(state.get[0]) if state.exists else [])
        for frame in frames:
            frame = frame.sort_values(["ts", "event_id"])
            yield pd.DataFrame({"event_id": frame.event_id, "user_id": frame.user_id, "admitted": [limiter.step(at) for at in seconds(frame.ts)]})
        state.update((list(limiter.admitted),))

    return rows.groupBy("user_id").applyInPandasWithState(run, "event_id long, user_id long, admitted boolean", "admitted array<double>", "append", "NoTimeout")


def windowed_counts(stream: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts and sums by event time and type; rows later than the watermark allows are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def new_suffix(states: DataFrame, order) -> DataFrame:
    """(session, at, delta): what each snapshot of a growing text adds to the one before."""
    before = F.coalesce(F.lag("text").over(order), F.lit(""))
    return states.withColumn("delta", F.when(F.startswith("text", before), F.substring(F.col("text"), F.length(before) + 1, F.length("text"))).otherwise(F.col("text")))


class Cache:
    """Keeps keys for ``ttl`` seconds after they were stored, ``capacity`` of them at most; the one used longest ago goes first."""

    def __init__(self, ttl: float, capacity: int, held: dict[str, tuple[float, float]] | None = None):
        self.ttl, self.capacity, self.held = ttl, capacity, dict(held or {})

    def step(self, key: str, at: float) -> bool:
        """Whether the key is held; it is stored if not."""
        stored = self.held.get(key)
        if stored and at - stored[0] < self.ttl:
            self.held[key] = (stored[0], at)
            return True
        self.held.pop(key, None)
        if len(self.held) >= self.capacity:
            del self.held[min(self.held, key=lambda k: (self.held[k][1], k))]
        self.held[key] = (at, at)
        return False


def cache_hits(rows: DataFrame, ttl: float, capacity: int) -> DataFrame:
    """(event_id, user_id, hit) of lookups (event_id, user_id, ts, key), with a cache for each user."""

    def run(state: dict, key, group: pd.DataFrame) -> pd.DataFrame:
        cache = state.setdefault(key, Cache(ttl, capacity))
        return pd.DataFrame({"event_id": group.event_id, "user_id": group.user_id, "hit": [cache.step(k, at) for k, at in zip(group.key, seconds(group.ts), strict=True)]})

    return by_key(rows.select("event_id", "user_id", "ts", "key"), "user_id", run, "event_id long, user_id long, hit boolean")


def session_stream(turns: DataFrame, last: int = 10, ttl_seconds: int = 24 * 3600) -> DataFrame:
    """(session_id, n, texts) after each batch of a stream (session_id, ts, text): the last turns; a silent session is forgotten."""

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        texts = list(state.get[0]) if state.exists else []
        for frame in frames:
            texts = (texts + frame.sort_values("ts").text.tolist())[-last:]
        state.update((texts,))
        state.setTimeoutDuration(ttl_seconds * 1000)
        yield pd.DataFrame({"session_id": [key[0]], "n": [len(texts)], "texts": [texts]})

    return turns.groupBy("session_id").applyInPandasWithState(run, "session_id string, n int, texts array<string>", "texts array<string>", "update", "ProcessingTimeTimeout")


def append_batches(stream: DataFrame, target: str):
    """A writer that puts each batch into a folder of its own under target; a batch that comes twice replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    return stream.writeStream.foreachBatch(write)


def newest(batches: DataFrame, key: str) -> DataFrame:
    """Of what append_batches wrote the last row of each key."""
    return batches.groupBy(key).agg(F.max_by(F.struct(*[c for c in batches.columns if c != key]), "batch").alias("x")).select(key, "x.*")
