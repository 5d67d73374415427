"""Structured Streaming forms of the stateful behaviours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, schema: str = EVENTS, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def access_counts(events: DataFrame, key: str = "user_id") -> DataFrame:
    return events.groupBy(key).agg(F.min("ts").alias("first_accessed"), F.max("ts").alias("last_accessed"), F.count("*").alias("access_count"))


def windowed(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour", key: str = "event_type") -> DataFrame:
    """Counts and sums a window, late rows within the watermark included."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def bucket_rows(rows: pd.DataFrame, state: tuple[float, float] | None, capacity: float, rate: float) -> tuple[pd.DataFrame, tuple[float, float]]:
    """Token bucket over rows (ts, event_id) in order: state is (tokens, last second)."""
    rows = rows.sort_values(["ts", "event_id"])
    tokens, last = state if state else (capacity, None)
    allowed = []
    for t in rows.ts:
        now = t.timestamp()
        if last is not None:
            tokens = min(capacity, tokens + max(0.0, now - last) * rate)
        last = now if last is None else max(now, last)
        ok = tokens >= 1
        tokens -= 1 if ok else 0
        allowed.append(ok)
    return rows.assign(allowed=allowed), (tokens, last)


def token_bucket(events: DataFrame, capacity: float, rate: float, key: str = "user_id") -> DataFrame:
    """Each event with whether a bucket of ``capacity`` refilled at ``rate`` a second lets it pass; state a key."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        frame = pd.concat(list(frames))
        out, now = bucket_rows(frame, now, capacity, rate)
        state.update(now)
        yield pd.DataFrame({key: k[0], "event_id": out.event_id, "ts": out.ts, "allowed": out.allowed})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, "event_id", "ts").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id long, ts timestamp, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def token_bucket_batch(events: DataFrame, capacity: float, rate: float, key: str = "user_id") -> DataFrame:
    """The same over a table."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        return bucket_rows(pdf, None, capacity, rate)[0][[key, "event_id", "ts", "allowed"]]

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, "event_id", "ts").groupBy(key).applyInPandas(step, f"{key} {kind}, event_id long, ts timestamp, allowed boolean")


def upsert_facts(table: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the current state of facts (key, content, ts) in a Parquet folder, a version a batch."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("key").agg(F.max_by(F.struct("content", "ts"), "ts").alias("s")).select("key", "s.*")
        if number == 0:
            new.write.mode("overwrite").parquet(f"{table}/v0")
            return
        old = spark.read.parquet(f"{table}/v{number - 1}")
        kept = old.join(new.select("key"), "key", "left_anti")
        kept.unionByName(new).write.mode("overwrite").parquet(f"{table}/v{number}")

    return run


def to_memory(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now into a table in memory; for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
