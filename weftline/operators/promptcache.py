"""Prompt-cache analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weftline.functions import text as tx

#: Sections of a prompt from stable to volatile.
SECTIONS = ["system", "tools", "policies", "examples", "context", "history", "user"]
VOLATILE = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}|\b\d{10,13}\b|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|(?i)\b(?:request|session|trace)[_-]?id\b"


def section_audit(sections: Column, text: Column) -> tuple[Column, Column]:
    """(score, cacheable): 100, less 25 for sections out of order and 20 for volatile text; 80 passes."""
    known = F.array(*[F.lit(s) for s in SECTIONS])
    places = F.transform(sections, lambda s: F.array_position(known, s))
    score = 100 - F.when(F.array_sort(places) == places, 0).otherwise(25) - F.when(text.rlike(VOLATILE), 20).otherwise(0)
    return score, score >= 80


def stability(text: Column, window: int = 5000) -> dict[str, Column]:
    head = F.substring(text, 1, window)
    return {"stable": ~head.rlike(VOLATILE), "first_volatile": F.regexp_instr(head, F.lit(VOLATILE)), "prefix_hash": F.sha2(head, 256)}


def drift(before: Column, after: Column) -> Column:
    """none, whitespace, json or semantic: how far two prefixes differ."""
    flat = lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))
    shape = lambda t: F.to_json(tx.json_value(t))
    return F.when(before.eqNullSafe(after), "none").when(flat(before) == flat(after), "whitespace").when(shape(before).isNotNull() & (shape(before) == shape(after)), "json").otherwise("semantic")


def first_difference(a: Column, b: Column) -> Column:
    """The first place (from 0) where two texts differ, -1 if nowhere; by halving, not by character."""
    n = F.least(F.length(a), F.length(b))
    start = F.struct(F.lit(0).alias("lo"), n.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        m = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        same = F.substring(a, F.lit(1), m) == F.substring(b, F.lit(1), m)
        return F.when(s["lo"] >= s["hi"], s).when(same, F.struct(m.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), (m - 1).alias("hi")))

    return F.when(a == b, -1).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(31)), start, halve, lambda s: s["lo"]))


def cache_sessions(telemetry: DataFrame, *keys: str, read: str = "cache_read", total: str = "input_tokens") -> DataFrame:
    hit = F.col(read) > 0
    return telemetry.groupBy(*keys).agg(F.count("*").alias("requests"), F.count(F.when(hit, 1)).alias("hits"), F.round(F.avg(hit.cast("double")), 4).alias("hit_ratio"), F.sum(read).alias("cached_tokens"), F.sum(total).alias("tokens"))


def churn(creations: DataFrame, least: int, *keys: str) -> DataFrame:
    return creations.groupBy(*keys).agg(F.count("*").alias("creations")).filter(F.col("creations") >= least)


def prefix_trend(events: DataFrame, key: str, order: str, hashed: str, least: int = 3, share: float = 0.5) -> DataFrame:
    """Each event with the share of drifted prefixes so far, systematic from ``least`` observations and ``share`` on."""
    w = W.partitionBy(key).orderBy(order)
    moved = F.coalesce((F.lag(hashed).over(w) != F.col(hashed)).cast("int"), F.lit(0))
    rows = events.withColumn("_moved", moved)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    n = F.count("*").over(upto)
    rate = F.sum("_moved").over(upto) / n
    return rows.withColumns({"drift_rate": F.round(rate, 4), "systematic": (n >= least) & (rate >= share)}).drop("_moved")


def siblings(prompts: DataFrame, hashed: str = "prefix_hash", id_col: str = "prompt_id") -> DataFrame:
    """(hash, n, first, last) of prefixes that several prompts share."""
    return prompts.groupBy(hashed).agg(F.count("*").alias("n"), F.min(id_col).alias("first"), F.max(id_col).alias("last")).filter("n > 1")


def coherence(telemetry: DataFrame, hashed: str, label: str, least: int, skew: float, read: str = "cache_read") -> DataFrame:
    """(hash, labels, spread, skewed): largest difference of hit ratios among labels that share a prefix and have enough events."""
    by = telemetry.groupBy(hashed, label).agg(F.count("*").alias("n"), F.avg((F.col(read) > 0).cast("double")).alias("ratio")).filter(F.col("n") >= least)
    return by.groupBy(hashed).agg(F.count("*").alias("labels"), F.round(F.max("ratio") - F.min("ratio"), 4).alias("spread")).withColumn("skewed", F.col("spread") >= skew)


def threshold_advice(tokens: Column, minimum: int = 1024, step: int = 128) -> Column:
    """Tokens that a cache covers: none under the minimum, else whole steps."""
    return F.when(tokens < minimum, 0).otherwise(F.floor(tokens / step) * step)


def cache_key(model: Column, workflow: Column, prefix: Column) -> Column:
    return F.concat_ws(":", model, workflow, F.substring(F.sha2(prefix, 256), 1, 16))


def diagnosis(rows: DataFrame) -> DataFrame:
    """The first cause of a miss of (expected_hash, seen_hash, tokens, minimum, age, ttl)."""
    cause = F.when(F.col("tokens") < F.col("minimum"), "below_minimum").when(F.col("expected_hash") != F.col("seen_hash"), "prefix_changed").when(F.col("age") > F.col("ttl"), "expired").otherwise("unknown")
    return rows.withColumn("cause", cause)
