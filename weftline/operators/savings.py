"""Savings, cost and service metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weftline.functions import numbers as num
from weftline.staging import staged


def dashboard(events: DataFrame, tool: str = "tool_name", at: str = "ts", original: str = "original_tokens", kept: str = "compressed_tokens", price: float = 3.0) -> DataFrame:
    """(tool, day, operations, tokens_saved, dollars): by tool, by day and in all, from one pass over grouping sets."""
    rows = events.select(F.col(tool).alias("tool"), F.to_date(at).alias("day"), (F.col(original) - F.col(kept)).alias("saved"))
    out = rows.groupingSets([[F.col("tool")], [F.col("day")], []], F.col("tool"), F.col("day")).agg(F.count("*").alias("operations"), F.sum("saved").alias("tokens_saved"))
    return out.withColumn("dollars", F.round(F.col("tokens_saved") * price / 1e6, 6))


def session_report(events: DataFrame, group: str, at: str = "ts", original: str = "original_tokens", kept: str = "compressed_tokens") -> DataFrame:
    """Totals of a session, weighted savings, ratio, and operations a month at its rate (spans under a minute count a hundredfold)."""
    g = events.groupBy(group).agg(F.count("*").alias("operations"), F.sum(original).alias("original"), F.sum(kept).alias("kept"), (F.max(at).cast("timestamp").cast("double") - F.min(at).cast("timestamp").cast("double")).alias("span"))
    monthly = F.when(F.col("span") < 60, F.col("operations") * 100.0).otherwise(F.col("operations") / F.col("span") * 86400 * 30)
    return g.select(group, "operations", "original", "kept", F.round(num.savings_percent(F.col("original"), F.col("kept")), 4).alias("savings_pct"), F.round(F.col("original") / F.greatest(F.col("kept"), F.lit(1)), 4).alias("ratio"), F.round(monthly, 4).alias("monthly_operations"))


def replay_insights(records: DataFrame, kind: str = "content_type", ratio: str = "ratio", fidelity: str = "fidelity_score", tokens: str = "input_tokens", order: str = "event_id") -> DataFrame:
    """Per content type: ratio at the best fidelity (the first such record), best fidelity, mean ratio, count, mean input."""
    best = F.max_by(F.col(ratio), F.struct(F.col(fidelity), -F.col(order)))
    return records.groupBy(kind).agg(best.alias("best_ratio"), F.max(fidelity).alias("best_fidelity"), F.round(F.avg(ratio), 4).alias("avg_ratio"), F.count("*").alias("samples"), F.floor(F.avg(tokens)).cast("long").alias("avg_input"))


def recommended_ratio(records: DataFrame, least: float, kind: str = "content_type", ratio: str = "ratio", fidelity: str = "fidelity_score", order: str = "event_id") -> DataFrame:
    return records.filter(F.col(fidelity) >= least).groupBy(kind).agg(F.max_by(F.col(ratio), F.struct(F.col(fidelity), -F.col(order))).alias("ratio"))


def percentiles(events: DataFrame, group: str, value: str, shares: dict[str, float] | None = None) -> DataFrame:
    """Elements at int(n * q) of each group's sorted values.

    Values are counted and staged in ranges; only the ranges that hold an element asked for are ranked, each on its own: no group is gathered or sorted.
    """
    shares = shares or {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    at = {k: F.least(F.floor(F.col("n") * F.lit(q)), F.col("n") - 1) for k, q in shares.items()}
    counts = events.select(F.col(group).alias("g"), F.col(value).alias("v")).filter("v IS NOT NULL").groupBy("g", "v").agg(F.count("*").alias("m"))
    counts = staged(counts.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()), "percentile-counts")
    sums, w = counts.groupBy("g", "part").agg(F.sum("m").alias("s")), W.partitionBy("g")
    parts = sums.withColumns({"before": F.sum("s").over(w.orderBy("part")) - F.col("s"), "n": F.sum("s").over(w)})
    holds = reduce(lambda a, b: a | b, [(r >= F.col("before")) & (r < F.col("before") + F.col("s")) for r in at.values()])
    parts = parts.filter(holds).select(F.col("g").alias("_g"), F.col("part").alias("_part"), "before", "n")
    rows = counts.join(F.broadcast(parts), counts["g"].eqNullSafe(F.col("_g")) & (counts["part"] == F.col("_part")))
    rows = rows.withColumn("upto", F.col("before") + F.sum("m").over(W.partitionBy("g", "part").orderBy("v")))
    return rows.groupBy("g").agg(*[F.max(F.when((r < F.col("upto")) & (r >= F.col("upto") - F.col("m")), F.col("v"))).alias(k) for k, r in at.items()]).withColumnRenamed("g", group)


def error_rates(events: DataFrame, group: str, failed: Column) -> DataFrame:
    return events.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(failed.cast("double")), 4).alias("error_rate"))


def histogram(events: DataFrame, group: str, value: str, bounds: list[float]) -> DataFrame:
    """(group, le, n): cumulative counts up to each bound, and all."""
    bins = F.array(*[F.lit(float(b)) for b in bounds], F.lit(float("inf")))
    at = F.aggregate(bins, F.lit(0), lambda a, b: a + (F.col(value) > b).cast("int"))
    counts = events.filter(F.col(value).isNotNull()).groupBy(group, F.get(bins, at).alias("le")).agg(F.count("*").alias("c"))
    grid = counts.select(group).distinct().select(group, F.explode(bins).alias("le"))
    w = W.partitionBy(group).orderBy("le")
    return grid.join(counts, [group, "le"], "left").withColumn("n", F.sum(F.coalesce("c", F.lit(0))).over(w)).drop("c")


def discovery(files: DataFrame, id_col: str = "doc_id", size: str = "n_chars", skip: int = 100, direct: int = 500, ratio: float = 0.2) -> DataFrame:
    """(id, action, tokens, saved): under ``skip`` characters skip, under ``direct`` read as it is, else compress."""
    tokens = F.floor(F.col(size) / 4)
    action = F.when(F.col(size) < skip, "skip").when(F.col(size) < direct, "direct").otherwise("compress")
    return files.select(F.col(id_col).alias("id"), action.alias("action"), tokens.alias("tokens"), F.when(action == "compress", F.floor(tokens * (1 - ratio))).otherwise(0).alias("saved"))


def discovery_report(files: DataFrame, **how) -> DataFrame:
    found = discovery(files, **how)
    return found.groupBy("action").agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens"), F.sum("saved").alias("saved"))


def team(events: DataFrame, user: str = "user_id", original: str = "original_tokens", kept: str = "compressed_tokens") -> DataFrame:
    """Sums a member and in all (member null)."""
    out = events.rollup(user).agg(F.count("*").alias("operations"), F.sum(original).alias("original"), F.sum(kept).alias("kept"))
    return out.withColumn("saved", F.col("original") - F.col("kept"))


def priced(events: DataFrame, prices: DataFrame, model: str = "model", default: str = "default", digits: int = 6) -> DataFrame:
    """``events`` with input and output dollars; a model without a price takes the default row. ``prices`` is a dimension of models."""
    base = prices.filter(F.col(model) == default).select(F.col("input").alias("d_in"), F.col("output").alias("d_out"))
    rows = events.join(F.broadcast(prices.select(model, "input", "output")), model, "left").crossJoin(F.broadcast(base))
    dollars = (F.col("input_tokens") * F.coalesce("input", "d_in") + F.col("output_tokens") * F.coalesce("output", "d_out")) / 1_000_000
    return rows.withColumn("cost", F.round(dollars, digits)).drop("input", "output", "d_in", "d_out")


def roi(members: DataFrame, tokens_per_day: str = "tokens_per_day", team_size: str = "team_size", savings: float = 0.6, dollars: float = 3.0, plan: float = 20.0, days: int = 22) -> DataFrame:
    """Dollars a month that savings are worth against the price of the plan."""
    worth = F.col(tokens_per_day) * F.col(team_size) * days * savings * dollars / 1e6
    price = F.col(team_size) * plan
    return members.withColumns({"monthly_savings": F.round(worth, 4), "plan_cost": F.round(price, 4), "roi": F.round(F.when(price > 0, (worth - price) / price).otherwise(0.0), 4)})


def projection(events: DataFrame, group: str, dollars: str, at: str = "ts", price: float = 29.0) -> DataFrame:
    """(group, operations, saved, monthly, breakeven): savings a month at a group's rate, and operations that pay the plan's ``price``.

    Up to a minute of events tells no rate: then 100 times what was saved.
    """
    seconds = F.col(at).cast("timestamp").cast("double")
    rows = events.groupBy(group).agg(F.count("*").alias("operations"), F.sum(dollars).alias("saved"), (F.max(seconds) - F.min(seconds)).alias("_span"))
    monthly = F.when(F.col("_span") > 60, F.col("saved") / F.col("_span") * (30 * 24 * 3600)).otherwise(F.col("saved") * 100)
    pays = F.when(F.col("saved") > 0, F.floor(price / (F.col("saved") / F.col("operations"))))
    return rows.select(group, "operations", F.round("saved", 4).alias("saved"), F.round(monthly, 2).alias("monthly"), pays.alias("breakeven"))


def budget(events: DataFrame, limit: float, key: str = "user_id", at: str = "ts", value: str = "value", order: str = "event_id", digits: int = 4) -> DataFrame:
    """Running use of a budget, to ``digits`` places, with its alert level after each event; the level goes by the use as shown."""
    w = W.partitionBy(key).orderBy(at, order).rowsBetween(W.unboundedPreceding, 0)
    rows = events.withColumn("used", F.round(F.sum(value).over(w), digits))
    return rows.withColumn("level", num.alert_level(F.col("used") / limit))


def session_summary(journal: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, events, first, last, tools, saved) of journal rows (session_id, id, event_type, timestamp, data_json)."""
    get = lambda k: F.get_json_object("data_json", f"$.{k}")
    saved = F.when(F.col("event_type") == "ingest", F.greatest(F.lit(0.0), get("original_tokens").cast("double") - get("compressed_tokens").cast("double"))).otherwise(0.0)
    return journal.groupBy(session).agg(F.count("*").alias("events"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.countDistinct(get("tool")).alias("tools"), F.sum(saved).alias("saved"), F.max_by(get("profile"), F.when(get("profile").isNotNull(), F.col("id"))).alias("profile"))


def context_advice(docs: DataFrame, windows: DataFrame, margin: float = 0.75, tokens: str = "tokens") -> DataFrame:
    """(model, window, total, fits): the models (a small dimension) whose window the documents fill no more than ``margin`` of."""
    total = docs.agg(F.sum(tokens).alias("total"))
    return windows.crossJoin(F.broadcast(total)).select("model", "window", "total", (F.col("total") <= F.col("window") * margin).alias("fits"))


def share_of_total(docs: DataFrame, value: str, to: str = "pct") -> DataFrame:
    total = docs.agg(F.sum(value).alias("_total"))
    return docs.crossJoin(F.broadcast(total)).withColumn(to, F.round(F.col(value) / F.col("_total") * 100, 4)).drop("_total")


def repeats(runs: DataFrame, *keys: str, value: str = "tokens") -> DataFrame:
    """Least, middle and largest of repeated runs."""
    return runs.groupBy(*keys).agg(F.min(value).alias("low"), F.percentile(value, 0.5).alias("median"), F.max(value).alias("high"), F.count("*").alias("n"))
