"""Queries over events and the order tables: savings, service metrics, time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.operators import dedup, promptcache, quality as ql, savings, temporal
from weftline.plans.base import query
from weftline.session import table
from weftline.streaming import jobs

NOW = "2024-01-31 00:00:00"
AS_OF = "2024-01-15 00:00:00"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as compressions: value as thousands of tokens, a third kept."""
    original = F.floor(F.col("value") * 100).cast("long")
    return _events(spark, sf_dir).withColumns({"original_tokens": original, "compressed_tokens": F.floor(original / 3).cast("long")})


TOKENS = "t AS (SELECT *, CAST(floor(value * 100) AS BIGINT) AS o, CAST(floor(value * 100) AS BIGINT) // 3 AS k FROM events)"


@query(f"WITH {TOKENS} SELECT event_type AS tool, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS operations, sum(o - k)::BIGINT AS tokens_saved, round(sum(o - k) * 3.0::DOUBLE / 1e6, 6) AS dollars FROM t GROUP BY GROUPING SETS ((event_type), (CAST(ts AS DATE)), ())")
def savings_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return savings.dashboard(_tokens(spark, sf_dir), tool="event_type").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"""
WITH {TOKENS}, g AS (SELECT user_id, count(*) AS operations, sum(o)::BIGINT AS original, sum(k)::BIGINT AS kept, epoch(max(ts)) - epoch(min(ts)) AS span FROM t GROUP BY user_id)
SELECT user_id, operations, original, kept, round(CASE WHEN original > 0 THEN (original - kept) / original * 100 ELSE 0 END, 4) AS savings_pct, round(original / greatest(kept, 1), 4) AS ratio, round(CASE WHEN span < 60 THEN operations * 100.0::DOUBLE ELSE operations / span * 86400 * 30 END, 4) AS monthly_operations FROM g""")
def session_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return savings.session_report(_tokens(spark, sf_dir), "user_id")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _tokens(spark, sf_dir)
    return e.select("event_id", F.col("event_type").alias("content_type"), F.round(F.col("value") / 100, 4).alias("ratio"), (F.col("user_id") % 100 / 100.0).alias("fidelity_score"), F.col("original_tokens").alias("input_tokens"))


RECORDS = "r AS (SELECT event_id, event_type AS content_type, round(value / 100, 4) AS ratio, user_id % 100 / 100.0::DOUBLE AS fid, CAST(floor(value * 100) AS BIGINT) AS tokens FROM events)"


@query(f"WITH {RECORDS} SELECT content_type, first(ratio ORDER BY fid DESC, event_id) AS best_ratio, max(fid) AS best_fidelity, round(avg(ratio), 4) AS avg_ratio, count(*) AS samples, CAST(floor(avg(tokens)) AS BIGINT) AS avg_input FROM r GROUP BY content_type")
def replay_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return savings.replay_insights(_records(spark, sf_dir))


@query(f"WITH {RECORDS} SELECT content_type, first(ratio ORDER BY fid DESC, event_id) AS ratio FROM r WHERE fid >= 0.05 GROUP BY content_type")
def recommended_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return savings.recommended_ratio(_records(spark, sf_dir), 0.05)


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (r = least(floor(n * 0.5), n - 1)) AS p50, max(value) FILTER (r = least(floor(n * 0.95), n - 1)) AS p95, max(value) FILTER (r = least(floor(n * 0.99), n - 1)) AS p99 FROM r GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return savings.percentiles(_events(spark, sf_dir), "event_type", "value")


@query("SELECT event_type, count(*) AS n, round(avg(CASE WHEN value > 400 THEN 1.0::DOUBLE ELSE 0 END), 4) AS error_rate FROM events GROUP BY event_type")
def error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return savings.error_rates(_events(spark, sf_dir), "event_type", F.col("value") > 400)


@query("WITH b AS (SELECT unnest([10.0, 50.0, 100.0, 250.0, 'inf'::DOUBLE]) AS le), t AS (SELECT DISTINCT event_type FROM events) SELECT t.event_type, b.le, (SELECT count(*) FROM events e WHERE e.event_type = t.event_type AND e.value <= b.le) AS n FROM t, b")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return savings.histogram(_events(spark, sf_dir), "event_type", "value", [10, 50, 100, 250])


@query(f"WITH {TOKENS} SELECT user_id, count(*) AS operations, sum(o)::BIGINT AS original, sum(k)::BIGINT AS kept, sum(o - k)::BIGINT AS saved FROM t GROUP BY ROLLUP (user_id)")
def team_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return savings.team(_tokens(spark, sf_dir))


PRICES = [("click", 5.0, 25.0), ("view", 0.15, 0.6), ("default", 3.0, 15.0)]


@query(f"WITH {TOKENS}, p AS (SELECT * FROM (VALUES ('click', 5.0::DOUBLE, 25.0::DOUBLE), ('view', 0.15, 0.6)) v(model, i, x)) SELECT event_id, round((o * coalesce(i, 3.0) + k * coalesce(x, 15.0)) / 1000000, 9) AS cost FROM t LEFT JOIN p ON event_type = model")
def priced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame(PRICES, "model string, input double, output double")
    rows = _tokens(spark, sf_dir).select("event_id", F.col("event_type").alias("model"), F.col("original_tokens").alias("input_tokens"), F.col("compressed_tokens").alias("output_tokens"))
    return savings.priced(rows, prices, digits=9).select("event_id", "cost")


@query("WITH m AS (SELECT user_id, sum(value) * 1000 / 30 AS tpd, 5 AS size FROM events GROUP BY user_id) SELECT user_id, round(tpd * size * 22 * 0.6 * 3.0::DOUBLE / 1e6, 4) AS monthly_savings, round(size * 20.0::DOUBLE, 4) AS plan_cost, round((tpd * size * 22 * 0.6 * 3.0::DOUBLE / 1e6 - size * 20.0::DOUBLE) / (size * 20.0::DOUBLE), 4) AS roi FROM m")
def team_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy("user_id").agg((F.sum("value") * 1000 / 30).alias("tokens_per_day")).withColumn("team_size", F.lit(5))
    return savings.roi(rows).select("user_id", "monthly_savings", "plan_cost", "roi")


@query("WITH r AS (SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS used FROM events) SELECT event_id, user_id, used, CASE WHEN used / 4000 >= 0.9 THEN 'critical' WHEN used / 4000 >= 0.75 THEN 'warning' WHEN used / 4000 >= 0.5 THEN 'notice' ELSE 'none' END AS level FROM r")
def budget_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return savings.budget(_events(spark, sf_dir), 4000).select("event_id", "user_id", "used", "level")


@query("WITH t AS (SELECT sum(n_chars // 4)::BIGINT AS total FROM documents) SELECT model, win AS \"window\", total, total <= win * 0.75 AS fits FROM (VALUES ('small', 100000::BIGINT), ('middle', 1000000), ('large', 100000000)) v(model, win), t")
def context_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = spark.createDataFrame([("small", 100_000), ("middle", 1_000_000), ("large", 100_000_000)], "model string, window long")
    return savings.context_advice(table(spark, sf_dir, "documents").select(F.floor(F.col("n_chars") / 4).alias("tokens")), windows)


@query("SELECT user_id, event_type, min(value) AS low, median(value) AS median, max(value) AS high, count(*) AS n FROM events GROUP BY user_id, event_type")
def repeat_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return savings.repeats(_events(spark, sf_dir), "user_id", "event_type", value="value")


ACCESS = "a AS (SELECT user_id, min(ts) AS first_accessed, max(ts) AS last_accessed, count(*) AS access_count FROM events GROUP BY user_id)"


@query(f"WITH {ACCESS} SELECT * FROM a")
def access_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.access_stats(_events(spark, sf_dir), "user_id")


@query(f"WITH {ACCESS} SELECT user_id, round(least(greatest(pow(0.5, (epoch(TIMESTAMP '{NOW}') - epoch(last_accessed)) / 604800) * 0.8 + least(0.2, ln(1 + access_count) * 0.05), 0), 1), 5) AS score FROM a")
def decay_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = temporal.access_stats(_events(spark, sf_dir), "user_id")
    return temporal.decay(stats, F.lit(NOW).cast("timestamp"), 604_800.0, F.lit(0.8)).select("user_id", F.round("score", 5).alias("score"))


@query(f"WITH {ACCESS} SELECT user_id, round(epoch(TIMESTAMP '{NOW}') - epoch(last_accessed), 3) AS age FROM a WHERE epoch(TIMESTAMP '{NOW}') - epoch(last_accessed) > 86400")
def stale_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = temporal.access_stats(_events(spark, sf_dir), "user_id")
    return temporal.stale(stats, F.lit(NOW).cast("timestamp"), 86_400.0).select("user_id", F.round("age", 3).alias("age"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("fact_id"), F.floor(F.col("value") / 100).cast("string").alias("content"), F.col("ts").alias("observed_at"), F.col("event_id").alias("arrival_seq"))


SCD = """
o AS (SELECT user_id AS doc_id, event_type AS fact_id, CAST(CAST(floor(value / 100) AS BIGINT) AS VARCHAR) AS content, ts AS observed_at, event_id AS arrival_seq FROM events),
c AS (SELECT *, CASE WHEN lag(content) OVER (PARTITION BY doc_id, fact_id ORDER BY arrival_seq) = content THEN 0 ELSE 1 END AS new FROM o),
n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, fact_id ORDER BY arrival_seq) AS version FROM c),
v AS (SELECT doc_id, fact_id, content, observed_at, arrival_seq, version::BIGINT AS version, lead(observed_at) OVER (PARTITION BY doc_id, fact_id ORDER BY arrival_seq) AS invalidated_at FROM n WHERE new = 1)"""


@query(f"WITH {SCD} SELECT *, CASE WHEN invalidated_at IS NOT NULL THEN 'superseded' END AS invalidation_reason FROM v")
def fact_scd2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.scd2(_facts(spark, sf_dir))


@query(f"WITH {SCD} SELECT doc_id, fact_id, content, version FROM v WHERE observed_at <= TIMESTAMP '{AS_OF}' AND (invalidated_at IS NULL OR invalidated_at > TIMESTAMP '{AS_OF}')")
def facts_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.active_as_of(temporal.scd2(_facts(spark, sf_dir)), F.lit(AS_OF).cast("timestamp")).select("doc_id", "fact_id", "content", "version")


@query(f"WITH {SCD} SELECT doc_id, fact_id, first(content ORDER BY arrival_seq DESC) AS content, max(arrival_seq) AS arrival_seq FROM v WHERE observed_at <= TIMESTAMP '{AS_OF}' GROUP BY doc_id, fact_id")
def latest_fact_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.latest_before(temporal.scd2(_facts(spark, sf_dir)), F.lit(AS_OF).cast("timestamp")).select("doc_id", "fact_id", "content", "arrival_seq")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id, event_type FROM r WHERE k <= 10")
def latest_n_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.latest(_events(spark, sf_dir), 10, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""
WITH u AS (SELECT ts, event_type, user_id AS doc_id, 'event' AS summary FROM events UNION ALL SELECT max(ts), 'last_access', user_id, 'access' FROM events GROUP BY user_id)
SELECT ts, event_type, doc_id, summary FROM u WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20'""")
def merged_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    one = e.select("ts", "event_type", F.col("user_id").alias("doc_id"), F.lit("event").alias("summary"))
    two = e.groupBy("user_id").agg(F.max("ts").alias("ts")).select("ts", F.lit("last_access").alias("event_type"), F.col("user_id").alias("doc_id"), F.lit("access").alias("summary"))
    return temporal.timeline(one, two, since=F.lit("2024-01-10").cast("timestamp"), until=F.lit("2024-01-20").cast("timestamp"))


@query("""
WITH b AS (SELECT user_id, event_id, sha256(event_type || '|' || CAST(event_id AS VARCHAR)) AS content_hash FROM events),
p AS (SELECT *, coalesce(lag(content_hash) OVER (PARTITION BY user_id ORDER BY event_id), '') AS previous_hash FROM b)
SELECT user_id, event_id, content_hash, previous_hash, sha256(previous_hash || content_hash) AS link_hash FROM p""")
def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat_ws("|", "event_type", F.col("event_id").cast("string"))
    return ql.chained(_events(spark, sf_dir), "user_id", "event_id", body).select("user_id", "event_id", "content_hash", "previous_hash", "link_hash")


@query("SELECT user_id, count(*) AS rows, 0::BIGINT AS broken FROM events GROUP BY user_id")
def chain_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat_ws("|", "event_type", F.col("event_id").cast("string"))
    chain = ql.chained(_events(spark, sf_dir), "user_id", "event_id", body).select("user_id", "event_id", "event_type", "content_hash", "previous_hash", "link_hash")
    return ql.verified(chain, "user_id", "event_id", body)


REWARD = "c AS (SELECT event_id, least(value / 500, 1) AS ratio, user_id % 11 / 10.0::DOUBLE AS fidelity, event_id % 7 / 6.0::DOUBLE AS speed, 0.5::DOUBLE AS memory, 0.9::DOUBLE AS coherence FROM events)"


@query(f"WITH {REWARD}, t AS (SELECT *, ratio * 0.15 + fidelity * 0.35 + speed * 0.20 + memory * 0.15 + coherence * 0.15 AS total, least(ratio, fidelity, speed, memory, coherence) AS low FROM c) SELECT event_id, round(total, 8) AS total, CASE low WHEN ratio THEN 'ratio' WHEN fidelity THEN 'fidelity' WHEN speed THEN 'speed' WHEN memory THEN 'memory' ELSE 'coherence' END AS weakest FROM t")
def reward_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", F.least(F.col("value") / 500, F.lit(1.0)).alias("ratio"), (F.col("user_id") % 11 / 10.0).alias("fidelity"), (F.col("event_id") % 7 / 6.0).alias("speed"), F.lit(0.5).alias("memory"), F.lit(0.9).alias("coherence"))
    return ql.reward(rows).select("event_id", F.round("total", 8).alias("total"), "weakest")


@query("WITH v AS (SELECT 'baseline' AS mode, event_type AS case_id, round(avg(value), 4) AS value FROM events GROUP BY event_type) SELECT mode, case_id, 'avg' AS metric, 245.0::DOUBLE AS floor, value FROM v WHERE value < 245.0")
def benchmark_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _events(spark, sf_dir).groupBy(F.col("event_type").alias("case_id")).agg(F.round(F.avg("value"), 4).alias("value")).withColumns({"mode": F.lit("baseline"), "metric": F.lit("avg")})
    floors = report.select("mode", "case_id", "metric", F.lit(245.0).alias("floor"))
    return ql.guard(report, floors)


@query("SELECT event_type AS operation, count(*) AS n, round(avg(value), 4) AS avg_ratio, round(avg(CASE WHEN value > 100 THEN 1.0::DOUBLE ELSE 0 END), 4) AS pass_rate, min(ts) AS first, max(ts) AS last FROM events GROUP BY event_type")
def evidence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.evidence_stats(_events(spark, sf_dir).select(F.col("event_type").alias("operation"), F.col("value").alias("ratio"), (F.col("value") > 100).alias("passed"), "ts"))


@query("WITH c AS (SELECT user_id, event_type, CASE WHEN value > 200 THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS r, CAST(floor(value * 2) AS BIGINT) AS t FROM events) SELECT user_id, event_type, count(*) AS requests, count(*) FILTER (r > 0) AS hits, round(avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit_ratio, sum(r)::BIGINT AS cached_tokens, sum(t)::BIGINT AS tokens FROM c GROUP BY user_id, event_type")
def cache_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", "event_type", F.when(F.col("value") > 200, F.floor("value")).otherwise(0).cast("long").alias("cache_read"), F.floor(F.col("value") * 2).cast("long").alias("input_tokens"))
    return promptcache.cache_sessions(rows, "user_id", "event_type")


@query("SELECT user_id, event_type, count(*) AS creations FROM events WHERE value > 100 GROUP BY user_id, event_type HAVING count(*) >= 3")
def creation_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promptcache.churn(_events(spark, sf_dir).filter("value > 100"), 3, "user_id", "event_type")


@query("""
WITH m AS (SELECT user_id, event_id, CASE WHEN lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS moved FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, count(*) OVER w AS n, sum(moved) OVER w / count(*) OVER w AS rate FROM m WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, round(rate, 4) AS drift_rate, n >= 3 AND rate >= 0.5 AS systematic FROM r""")
def prefix_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promptcache.prefix_trend(_events(spark, sf_dir), "user_id", "event_id", "event_type").select("user_id", "event_id", "drift_rate", "systematic")


@query("SELECT event_id, CASE WHEN t < 1024 THEN 0 ELSE t // 128 * 128 END AS covered FROM (SELECT event_id, CAST(floor(value * 10) AS BIGINT) AS t FROM events)")
def cache_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", promptcache.threshold_advice(F.floor(F.col("value") * 10)).cast("long").alias("covered"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, (date_trunc('day', ts) + INTERVAL 1 DAY)::TIMESTAMP AS \"end\", event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def stream_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events read as a stream, counted by day in one run over what is there."""
    import uuid

    # a stream reads folders: the file's own folder, this file only
    one = _is_file(spark, f"{sf_dir}/events.parquet")
    reader = spark.readStream.schema(_events(spark, sf_dir).schema).option("pathGlobFilter", "events.parquet" if one else "*.parquet")
    stream = reader.parquet(sf_dir if one else f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    found = jobs.to_memory(jobs.windowed(stream), f"days_{uuid.uuid4().hex}")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", F.round("total", 3).alias("total"))


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


@query()
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.token_bucket_batch(_events(spark, sf_dir), 3.0, 1 / 86_400)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def lineitem_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_returnflag"), F.col("l_linestatus")
    return table(spark, sf_dir, "lineitem").groupingSets([[a, b], [a], []], a, b).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT l_returnflag, max(v) FILTER (r = least(floor(n * 0.5), n - 1)) AS p50, max(v) FILTER (r = least(floor(n * 0.95), n - 1)) AS p95, max(v) FILTER (r = least(floor(n * 0.99), n - 1)) AS p99 FROM r GROUP BY l_returnflag")
def price_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return savings.percentiles(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) SELECT o_custkey, o_orderkey, o_orderdate FROM r WHERE k <= 3")
def latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.latest(table(spark, sf_dir, "orders"), 3, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderdate")
