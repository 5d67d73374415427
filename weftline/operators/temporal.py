"""Facts over time, access histories, versions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weftline.functions import numbers as num


def scd2(observations: DataFrame, key: tuple[str, ...] = ("doc_id", "fact_id"), content: str = "content", at: str = "observed_at", seq: str = "arrival_seq") -> DataFrame:
    """Versions with validity [observed_at, invalidated_at) from observations in arrival order; an unchanged content keeps its version."""
    w = W.partitionBy(*key).orderBy(seq)
    before = F.lag(content).over(w)
    changed = observations.withColumn("_new", (before.isNull() | ~F.col(content).eqNullSafe(before)).cast("int"))
    runs = changed.withColumn("version", F.sum("_new").over(w)).filter("_new = 1")
    v = W.partitionBy(*key).orderBy(seq)
    end = F.lead(at).over(v)
    return runs.withColumn("invalidated_at", end).withColumn("invalidation_reason", F.when(end.isNotNull(), "superseded")).drop("_new")


def removed(previous: DataFrame, current: DataFrame, key: tuple[str, ...] = ("doc_id", "fact_id")) -> DataFrame:
    """Active facts of the previous snapshot that the current one lacks."""
    return previous.join(current.select(*key).distinct(), list(key), "left_anti")


def active_as_of(versions: DataFrame, t: Column, at: str = "observed_at") -> DataFrame:
    return versions.filter((F.col(at) <= t) & (F.col("invalidated_at").isNull() | (F.col("invalidated_at") > t)))


def latest_before(versions: DataFrame, t: Column, key: tuple[str, ...] = ("doc_id", "fact_id"), at: str = "observed_at", seq: str = "arrival_seq") -> DataFrame:
    """Of each fact the version that arrived last among those observed by ``t``: arrival counts, not the time observed."""
    seen = versions.filter(F.col(at) <= t)
    cols = [c for c in versions.columns if c not in key]
    return seen.groupBy(*key).agg(F.max_by(F.struct(*cols), seq).alias("s")).select(*key, "s.*")


def invalidate(versions: DataFrame, targets: DataFrame, t: Column, reason: str, key: tuple[str, ...] = ("doc_id", "fact_id")) -> DataFrame:
    """``versions`` with the open interval of each target fact closed at ``t``."""
    hit = versions.join(targets.select(*key, F.lit(True).alias("_hit")).distinct(), list(key), "left")
    close = F.col("_hit").isNotNull() & F.col("invalidated_at").isNull()
    return hit.withColumns({"invalidation_reason": F.when(close, F.lit(reason)).otherwise(F.col("invalidation_reason")), "invalidated_at": F.when(close, t).otherwise(F.col("invalidated_at"))}).drop("_hit")


def timeline(*events: DataFrame, since: Column | None = None, until: Column | None = None, contains: str | None = None, limit: int | None = None) -> DataFrame:
    """All events (ts, event_type, doc_id, fact_id, summary) of several logs, filtered, newest first."""
    rows = events[0]
    for e in events[1:]:
        rows = rows.unionByName(e, allowMissingColumns=True)
    if since is not None:
        rows = rows.filter(F.col("ts") >= since)
    if until is not None:
        rows = rows.filter(F.col("ts") <= until)
    if contains:
        rows = rows.filter(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in rows.columns if c != "ts"])).contains(contains.lower()))
    rows = rows.orderBy(F.desc("ts"), "event_type", "doc_id")
    return rows.limit(limit) if limit else rows


def access_stats(events: DataFrame, key: str = "doc_id", at: str = "ts") -> DataFrame:
    return events.groupBy(key).agg(F.min(at).alias("first_accessed"), F.max(at).alias("last_accessed"), F.count("*").alias("access_count"))


def decay(stats: DataFrame, now: Column, half_life: float, importance: Column | None = None) -> DataFrame:
    age = now.cast("double") - F.col("last_accessed").cast("timestamp").cast("double")
    return stats.withColumn("score", num.decay_score(importance if importance is not None else F.lit(1.0), age, F.col("access_count"), half_life))


def stale(stats: DataFrame, now: Column, max_age: float) -> DataFrame:
    age = now.cast("double") - F.col("last_accessed").cast("timestamp").cast("double")
    return stats.withColumn("age", age).filter(F.col("age") > max_age)


def merged_diff(old: Column, new: Column) -> Column:
    """Lines only in the old and only in the new text, marked - and +."""
    a, b = F.split(old, "\n"), F.split(new, "\n")
    return F.concat(F.transform(F.array_except(a, b), lambda x: F.concat(F.lit("-"), x)), F.transform(F.array_except(b, a), lambda x: F.concat(F.lit("+"), x)))


def unified_diff(versions: DataFrame, key: str = "doc_id", order: str = "version_id", text: str = "content", context: int = 3) -> DataFrame:
    """Each version with its unified diff against the one before."""
    @F.pandas_udf("string")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import unified_diff as ud

        return pd.Series(["\n".join(ud((x or "").split("\n"), (y or "").split("\n"), lineterm="", n=context)) for x, y in zip(a, b, strict=True)])

    before = F.lag(text).over(W.partitionBy(key).orderBy(order))
    return versions.withColumn("_before", before).withColumn("diff", F.when(F.col("_before").isNotNull(), diff(F.col("_before"), F.col(text)))).drop("_before")


def file_sync(known: DataFrame, found: DataFrame, key: str = "path") -> DataFrame:
    """(path, status): deleted, added, changed or unchanged, by modification time first and checksum then."""
    k = known.select(key, F.col("modified").alias("k_m"), F.col("checksum").alias("k_c"), F.lit(True).alias("k"))
    f = found.select(key, F.col("modified").alias("f_m"), F.col("checksum").alias("f_c"), F.lit(True).alias("f"))
    status = F.when(F.col("f").isNull(), "deleted").when(F.col("k").isNull(), "added").when((F.col("k_m") == F.col("f_m")) | (F.col("k_c") == F.col("f_c")), "unchanged").otherwise("changed")
    return k.join(f, key, "full_outer").select(key, status.alias("status"))


def coerced_timestamp(value: Column, now: Column) -> Column:
    """Seconds as a number from a number or an ISO text; null gives ``now``."""
    as_time = F.try_to_timestamp(F.regexp_replace(value, "Z$", "+00:00"))
    return F.coalesce(value.try_cast("double"), F.unix_micros(as_time) / 1e6, now)


def formatted_timestamp(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
