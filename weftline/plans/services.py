"""Queries over the state tables of a service: events, turns, documents and vectors stand for memories, caches, evidence and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions import numbers, text as tx
from weftline.operators import advice, promptcache, registry as reg, retrieval, rewards, savings, skeleton, temporal
from weftline.plans.base import query
from weftline.plans.documents import BM25, QUESTION
from weftline.session import table

NOW, AS_OF = "2024-01-31 00:00:00", "2024-01-15 00:00:00"
T = "TIMESTAMP '{}'".format


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# -- memories, bullets, registries


@query("SELECT event_id, user_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def memory_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.memory_list(_events(spark, sf_dir), 100, "ts", "event_id").select("event_id", "user_id", "event_type", "value")


@query("SELECT event_id, floor(value / 100) AS score FROM events ORDER BY floor(value / 100) DESC, ts DESC, event_id DESC LIMIT 50")
def memory_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _events(spark, sf_dir).withColumn("score", F.floor(F.col("value") / 100).cast("double"))
    return reg.memory_hits(scored, 50, "score", "ts", "event_id").select("event_id", "score")


@query("SELECT event_id, ts, value FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY ts DESC, event_id DESC LIMIT 40")
def replay_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    kind = events.agg(F.min("event_type").alias("event_type"))
    return reg.newest(events.join(F.broadcast(kind), "event_type"), [F.desc("ts"), F.desc("event_id")], 40).select("event_id", "ts", "value")


@query("SELECT source, doc_id, n_chars, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents) WHERE place <= 5")
def longest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.top_per_group(_docs(spark, sf_dir), "source", [F.desc("n_chars"), F.col("doc_id")], 5).select("source", "doc_id", "n_chars", "place")


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS p FROM events) WHERE p <= 60")
def pruned_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.pruned(_events(spark, sf_dir), 60, "event_type", "value", "event_id").select("event_type", "event_id", "value")


@query("SELECT event_id, value FROM events WHERE value >= 200 AND event_type = 'click'")
def filtered_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.filtered_bullets(_events(spark, sf_dir), 200.0, "click", "value", "event_type").select("event_id", "value")


@query("WITH l AS (SELECT event_type, user_id, max(ts) AS ts FROM events GROUP BY event_type, user_id) SELECT event_type, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, user_id) AS p FROM l) WHERE p <= 20")
def capped_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.capped(_events(spark, sf_dir), "user_id", 20, "event_type")


@query(f"SELECT event_id, epoch({T(NOW)}) - epoch(ts) AS age, epoch({T(NOW)}) - epoch(ts) <= 864000 AS hit FROM events")
def cache_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.cache_lookup(_events(spark, sf_dir), NOW, 864_000).select("event_id", "age", "hit")


@query("""
SELECT user_id, count(*) AS total, count(*) FILTER (value > 50) AS done, count(*) FILTER (value > 400) AS failed, round(count(*) FILTER (value > 50) / count(*) * 100, 4) AS percent,
       round(CASE WHEN count(*) FILTER (value > 50) > 0 THEN (count(*) FILTER (value > 50) - count(*) FILTER (value > 400)) / count(*) FILTER (value > 50) * 100 ELSE 0.0::DOUBLE END, 4) AS success_rate
FROM events GROUP BY user_id""")
def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.batch_progress(_events(spark, sf_dir), "user_id", F.col("value") > 50, F.col("value") > 400)


# -- stores and nodes


@query("SELECT count(*) AS documents, count(DISTINCT source) AS sessions, CAST(sum(strlen(text)) AS BIGINT) AS bytes, round(sum(strlen(text)) / 1048576, 4) AS megabytes, round(sum(strlen(text)) / 1048576 / 100 * 100, 4) AS percent_used FROM documents")
def storage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.storage_summary(_docs(spark, sf_dir), limit_mb=100)


@query("SELECT count(DISTINCT source) AS files, count(*) AS nodes, CAST(sum(n_chars // 4) AS BIGINT) AS tokens FROM documents")
def global_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.global_stats(_docs(spark, sf_dir).withColumn("tokens", F.floor(F.col("n_chars") / 4)), "source")


@query("SELECT count(DISTINCT source) AS files, count(*) AS nodes, CAST(sum(n_chars // 4) AS BIGINT) AS tokens FROM documents WHERE lang = 'en'")
def scoped_global_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.global_stats(_docs(spark, sf_dir).filter("lang = 'en'").withColumn("tokens", F.floor(F.col("n_chars") / 4)), "source")


SUFFIXES = [".png", ".WAV", ".md", ".docx", ".zip", ""]


@query("""
WITH p AS (SELECT 'a.b/' || doc_id || list_extract(['.png', '.WAV', '.md', '.docx', '.zip', ''], CAST(doc_id % 6 + 1 AS INT)) AS path, text FROM documents),
k AS (SELECT lower(regexp_extract(path, '[^/.](\\.[^./]+)$', 1)) AS s, text FROM p)
SELECT CASE WHEN s = '.png' THEN 'image' WHEN s = '.wav' THEN 'audio' WHEN s IN ('.md', '.docx') THEN 'document' ELSE 'unknown' END AS kind, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM k GROUP BY 1""")
def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.get(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("doc_id") % 6).cast("int"))
    rows = _docs(spark, sf_dir).withColumn("kind", reg.media_kind(F.concat(F.lit("a.b/"), F.col("doc_id").cast("string"), suffix)))
    return rows.groupBy("kind").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"))


MODELS = ["claude-x", "Haiku", "gemini-pro", "gpt-4o", "o3-mini", "codex", "groq/a", "grok-2", "Local-llm", "ollama", "other"]


@query(f"""
WITH m AS (SELECT DISTINCT list_extract({MODELS}, CAST(user_id % 11 + 1 AS INT)) AS model FROM events)
SELECT model, CASE WHEN regexp_matches(lower(model), '^(claude|haiku)') THEN 'anthropic' WHEN starts_with(lower(model), 'gemini') THEN 'google' WHEN regexp_matches(lower(model), '^(gpt|o1|o3|o4|codex)') THEN 'openai'
  WHEN starts_with(lower(model), 'groq') THEN 'groq' WHEN starts_with(lower(model), 'grok') THEN 'xai' WHEN regexp_matches(lower(model), '^(local|ollama)') THEN 'local' ELSE 'unknown' END AS provider FROM m""")
def model_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.get(F.array(*[F.lit(m) for m in MODELS]), (F.col("user_id") % 11).cast("int"))
    return _events(spark, sf_dir).select(model.alias("model")).distinct().withColumn("provider", reg.provider(F.col("model")))


@query("SELECT doc_id, contains(lower(text), 'the ') OR contains(lower(text), 'eau') AS anchored FROM documents")
def anchored_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.anchored(_docs(spark, sf_dir), ["The ", "eau", " "]).select("doc_id", "anchored")


@query("""
WITH a AS (SELECT doc_id, source, n_chars, contains(lower(text), 'aumention') OR contains(lower(text), 'thereble') AS anchored FROM documents)
SELECT source, doc_id, anchored FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY anchored DESC, n_chars DESC, doc_id) AS p FROM a) WHERE anchored OR p <= 8""")
def anchored_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = reg.anchored(_docs(spark, sf_dir), ["aumention", "thereble"])
    return reg.anchored_selection(nodes, 8, "source", "n_chars", "doc_id").select("source", "doc_id", "anchored")


@query("SELECT label, count(*) AS nodes, greatest(1, CAST(floor(count(*) * 0.2::DOUBLE) AS BIGINT), count(*) FILTER (vec_id % 100 / 100 >= 0.2::DOUBLE)) AS kept FROM embeddings GROUP BY label")
def budget_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "embeddings").withColumn("ratio", F.col("vec_id") % 100 / 100)
    return reg.budget_floor(nodes, "label", "ratio", 0.2)


@query("""
WITH n AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, CASE WHEN y IS NULL THEN 0.0::DOUBLE ELSE round(greatest(0, least(1, list_cosine_similarity(x::DOUBLE[], y::DOUBLE[]))), 5) END AS fidelity FROM n""")
def fidelity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return vectors.join(following, "vec_id", "left").select("vec_id", F.round(reg.fidelity(F.col("embedding"), F.col("other")), 5).alias("fidelity"))


@query("SELECT kind, count(*) AS nodes, count(label) AS labelled FROM (SELECT 'text' AS kind, NULL AS label FROM documents UNION ALL SELECT 'vector', label FROM embeddings) GROUP BY kind")
def graph_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = reg.union_of_graphs(("text", _docs(spark, sf_dir).select("doc_id")), ("vector", table(spark, sf_dir, "embeddings").select("vec_id", "label")))
    return both.groupBy("kind").agg(F.count("*").alias("nodes"), F.count("label").alias("labelled"))


# -- telemetry and costs


@query("""
WITH e AS (SELECT event_id, user_id, CAST(floor(value * 100) AS BIGINT) * 2 AS o, CAST(floor(value * 100) AS BIGINT) * 2 + 500 - user_id * 20 AS k FROM events),
p AS (SELECT *, user_id % 2 = 0 AS own, CASE WHEN user_id % 2 = 0 THEN 2.5::DOUBLE ELSE 3.0::DOUBLE END AS price, CASE WHEN user_id % 2 = 0 THEN greatest(o - k, 0) ELSE o - k END AS saved FROM e)
SELECT event_id, saved AS saved_tokens, round(CASE WHEN o > 0 THEN (o - k) / o * 100 ELSE 0 END, 1) + 0.0::DOUBLE AS savings_percent, round(o / 1e6::DOUBLE * price, 6) AS original_usd, round(k / 1e6::DOUBLE * price, 6) AS compressed_usd, round(saved / 1e6::DOUBLE * price, 6) AS saved_usd FROM p""")
def cost_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = F.floor(F.col("value") * 100).cast("long") * 2
    rows = _events(spark, sf_dir).withColumns({"original_tokens": original, "compressed_tokens": original + 500 - F.col("user_id") * 20})
    own = F.col("user_id") % 2 == 0
    return reg.cost_telemetry(rows, F.when(own, 2.5).otherwise(3.0), own).select("event_id", "saved_tokens", "savings_percent", "original_usd", "compressed_usd", "saved_usd")


TELEMETRY = "u AS (SELECT *, CAST(floor(value * 100) AS BIGINT) * 100 AS total, CASE WHEN user_id % 3 = 0 THEN 0 ELSE CAST(floor(value * 100) AS BIGINT) * 10 * (user_id % 10) END AS cached FROM events)"


def _telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.floor(F.col("value") * 100).cast("long") * 100
    read = F.when(F.col("user_id") % 3 == 0, F.lit(0)).otherwise(F.floor(F.col("value") * 100) * 10 * (F.col("user_id") % 10)).cast("long")
    return _events(spark, sf_dir).withColumns({"input_tokens": total, "cache_read": read})


@query(f"WITH {TELEMETRY} SELECT event_id, cached > 0 AS cache_hit, round(CASE WHEN total > 0 THEN cached / total ELSE 0 END, 4) AS hit_ratio, round(total / 1e6::DOUBLE * 3, 6) AS input_usd, round(cached / 1e6::DOUBLE * 0.3::DOUBLE, 6) AS read_usd, round(greatest(cached / 1e6::DOUBLE * 3 - cached / 1e6::DOUBLE * 0.3::DOUBLE, 0), 6) AS saved_usd FROM u")
def cache_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.cache_usage(_telemetry(spark, sf_dir)).select("event_id", "cache_hit", "hit_ratio", "input_usd", "read_usd", "saved_usd")


@query(f"WITH {TELEMETRY}, g AS (SELECT event_type, user_id, count(*) AS calls, sum(cached) / sum(total) AS r FROM u GROUP BY event_type, user_id) SELECT event_type, user_id, calls, round(r, 6) AS hit_ratio, r < 0.5 AS degraded FROM g")
def cache_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.cache_health(_telemetry(spark, sf_dir), "event_type", "user_id")


@query("WITH p AS (SELECT conv_id, md5(substr(text, 1, 4)) AS h FROM conversations WHERE turn = 0), s AS (SELECT conv_id, md5(substr(text, 1, 4)) AS h FROM conversations WHERE turn = 1) SELECT p.h AS prefix_hash, count(*) AS prompts, count(*) FILTER (s.h = p.h) AS met FROM p LEFT JOIN s USING (conv_id) GROUP BY p.h")
def prompt_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("prompt_id"), "turn", F.md5(F.substring("text", 1, 4)).alias("prefix_hash"))
    return reg.expectations(turns.filter("turn = 0").drop("turn"), turns.filter("turn = 1").drop("turn"))


@query("SELECT event_id, event_type = 'click' AND CAST(user_id % 3 AS VARCHAR) = '1' AS stale FROM events")
def stale_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", F.col("event_type").alias("version"), (F.col("user_id") % 3).cast("string").alias("label"))
    return reg.invalidated(rows, "click", "1").select("event_id", "stale")


@query("WITH g AS (SELECT conv_id, count(*) AS sections, min(turn) FILTER (role <> 'assistant') AS v, max(turn) FILTER (role = 'assistant') AS s FROM conversations GROUP BY conv_id) SELECT conv_id, sections, v AS first_volatile, coalesce(s > v, false) AS interleaved FROM g")
def section_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.interleaved(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "assistant")


@query("SELECT event_id, props->>'$.k' AS k, props->>'$.missing' AS other, CAST((props->>'$.k') IS NOT NULL AS INT) + CAST((props->>'$.missing') IS NOT NULL AS INT) AS n_fields, try_cast(props->>'$.k' AS DOUBLE) AS number FROM events")
def flat_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reg.flattened(_events(spark, sf_dir), "props", {"k": "$.k", "other": "$.missing"})
    return rows.select("event_id", "k", "other", "n_fields", reg.numeric_field(F.col("props"), ["$.tokens", "$.k"]).alias("number"))


@query(f"SELECT event_id, ts FROM events WHERE event_type = 'click' AND ts >= {T('2024-01-10 00:00:00')} AND ts <= {T(AS_OF)} AND NOT (value > 100)")
def evidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("passed", F.col("value") > 100)
    return reg.evidence(rows, "click", "2024-01-10 00:00:00", AS_OF, True, "event_type").select("event_id", "ts")


@query("SELECT CASE WHEN user_id % 2 = 0 THEN 'semantic' ELSE 'extractive' END AS method, count(*) AS cases, round(avg(value), 6) AS value FROM events GROUP BY 1")
def method_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return reg.method_comparison(("semantic", events.filter("user_id % 2 = 0")), ("extractive", events.filter("user_id % 2 <> 0")), metrics=["value"])


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS calls FROM events GROUP BY user_id, event_type),
g AS (SELECT user_id, sum(calls) AS events, count(*) AS tools, string_agg(event_type || ':' || calls, ', ' ORDER BY event_type) FILTER (p <= 3) AS line FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS p FROM c) GROUP BY user_id)
SELECT user_id, substr('session ' || user_id || ' | ' || CAST(events AS BIGINT) || ' events | ' || line || CASE WHEN tools > 3 THEN ' (+' || (tools - 3) || ' more)' ELSE '' END, 1, 800) AS digest FROM g""")
def session_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.digest(_events(spark, sf_dir), "user_id", "event_type", 3)


@query("SELECT event_id, 'Saved ' || format('{:,}', CAST(floor(value * 100) AS BIGINT)) || ' tokens ($' || printf('%.3f', round(floor(value * 100) * 3 / 1000, 3)) || ')' || CASE WHEN value > 100 THEN ' | Session total: $' || printf('%.2f', round(value, 2)) || ' saved' ELSE '' END AS line FROM events")
def inline_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = F.floor(F.col("value") * 100).cast("long")
    return _events(spark, sf_dir).select("event_id", reg.inline_summary(saved, saved * 3 / 1000, F.when(F.col("value") > 100, F.col("value")).otherwise(0.0)).alias("line"))


# -- facts


FACTS = "f AS (SELECT event_id, user_id, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS valid_to FROM events)"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    return _events(spark, sf_dir).select("event_id", "user_id", F.lead("ts").over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).alias("valid_to"))


@query(f"WITH {FACTS} SELECT event_id, user_id FROM f WHERE valid_to <= {T(AS_OF)}")
def invalid_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.invalid_facts(_facts(spark, sf_dir), AS_OF).select("event_id", "user_id")


@query(f"WITH {FACTS}, r AS (SELECT event_id FROM events UNION ALL SELECT -event_id - 1 FROM events WHERE event_id % 50 = 0) SELECT event_id FROM r WHERE event_id NOT IN (SELECT event_id FROM f WHERE valid_to <= {T(AS_OF)})")
def results_without_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _events(spark, sf_dir).select("event_id")
    unknown = ids.filter("event_id % 50 = 0").select((-F.col("event_id") - 1).alias("event_id"))
    return reg.without_invalid(ids.union(unknown), _facts(spark, sf_dir), AS_OF, "event_id")


# -- rewards and estimates


SCORES = """
s AS (SELECT event_id, user_id % 5 AS phase, ((CASE WHEN user_id % 3 > 0 THEN 1.0::DOUBLE ELSE 0 END) + (CASE WHEN user_id % 4 > 0 THEN 1 ELSE 0 END)) / 2 AS schema,
  (value / 500) * 0.35::DOUBLE + 0.5::DOUBLE * 0.30::DOUBLE + 0.7::DOUBLE * 0.2::DOUBLE + (user_id % 10 / 10) * 0.15::DOUBLE AS semantic,
  (greatest(0, 1 - abs(value / 250 - 0.5::DOUBLE) / 0.5::DOUBLE) + CASE WHEN value < 300 THEN 1 ELSE 0.5::DOUBLE END) / 2 AS fidelity,
  ((CASE WHEN user_id % 7 > 0 THEN 1.0::DOUBLE ELSE 0 END) + 1 + 1 + (CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0.5::DOUBLE END) + greatest(0, 1 - (user_id % 15) * 0.1::DOUBLE)) / 5 AS composition,
  greatest(0, 1 - (user_id % 10 / 10) * 2) * 0.4::DOUBLE + 0.9::DOUBLE * 0.3::DOUBLE + greatest(0, 1 - greatest(0, value / 400 - 0.8::DOUBLE) * 5) * 0.3::DOUBLE AS memory FROM events)"""


def _scores() -> dict[str, F.Column]:
    u, v = F.col("user_id"), F.col("value")
    return {
        "schema": rewards.schema_score(u % 3 > 0, u % 4 > 0),
        "semantic": rewards.semantic_score(v / 500, F.lit(0.5), F.lit(0.7), u % 10 / 10),
        "fidelity": rewards.fidelity_score(v / 250, F.lit(0.5), v < 300),
        "composition": rewards.composition_score(u % 7 > 0, F.lit(True), F.lit(True), u % 2 == 0, u % 15),
        "memory": rewards.memory_score(u % 10 / 10, F.lit(0.9), v, F.lit(400.0)),
    }


@query(f"WITH {SCORES} SELECT event_id, round(schema, 9) AS schema, round(semantic, 9) AS semantic, round(fidelity, 9) AS fidelity, round(composition, 9) AS composition, round(memory, 9) AS memory FROM s")
def reward_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", *[F.round(c, 9).alias(k) for k, c in _scores().items()])


@query(f"""
WITH {SCORES}, w(phase, a, b, c, d, e) AS (VALUES (0, 0.40, 0.20, 0.15, 0.15, 0.10), (1, 0.25, 0.30, 0.20, 0.15, 0.10), (2, 0.15, 0.35, 0.20, 0.15, 0.15), (3, 0.10, 0.30, 0.25, 0.15, 0.20)),
r AS (SELECT s.*, schema * a::DOUBLE + semantic * b::DOUBLE + fidelity * c::DOUBLE + composition * d::DOUBLE + memory * e::DOUBLE AS reward FROM s JOIN w ON w.phase = least(s.phase, 3))
SELECT event_id, round(reward, 10) AS reward, round(reward, 10) >= 0.7 AS passes, CASE least(schema, semantic, fidelity, composition, memory) WHEN schema THEN 'schema' WHEN semantic THEN 'semantic' WHEN fidelity THEN 'fidelity' WHEN composition THEN 'composition' ELSE 'memory' END AS weakest
FROM (SELECT event_id, reward, round(schema, 9) AS schema, round(semantic, 9) AS semantic, round(fidelity, 9) AS fidelity, round(composition, 9) AS composition, round(memory, 9) AS memory FROM r)""")
def shaped_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _events(spark, sf_dir).select("event_id", (F.col("user_id") % 5).alias("phase"), *[c.alias(k) for k, c in _scores().items()])
    names = {c: F.col(c) for c in rewards.COMPONENTS}
    reward = F.round(rewards.phase_reward(names, F.col("phase")), 10)
    return scored.select("event_id", reward.alias("reward"), rewards.passes(reward).alias("passes"), rewards.weakest({c: F.round(v, 9) for c, v in names.items()})["name"].alias("weakest"))


@query("""
WITH d AS (SELECT doc_id, n_chars * (1 + doc_id % 40) AS t, doc_id % 100 / 100 AS r, doc_id % 9 / 10 AS s FROM documents),
b AS (SELECT *, (CASE WHEN t < 200 THEN 1.0::DOUBLE WHEN t < 8000 THEN 1.2::DOUBLE + r * 0.8::DOUBLE WHEN t < 32000 THEN 2.0::DOUBLE + r WHEN t < 100000 THEN 4.0::DOUBLE + r * 2 ELSE 6.0::DOUBLE + r * 4 END) * greatest(1.0::DOUBLE, least(2.0::DOUBLE, 1 + (0.2::DOUBLE - s) * 5)) AS ratio, greatest(30, floor(t * 0.05::DOUBLE)) AS least_left FROM d),
l AS (SELECT *, CAST(greatest(floor(t / ratio), least_left) AS BIGINT) AS kept FROM b)
SELECT doc_id, round(ratio, 6) AS ratio, kept AS "left", round((1 - kept / greatest(t, 1)) * 100, 4) AS saved_percent, CAST(greatest(floor(t / (ratio * 1.3::DOUBLE)), least_left) AS BIGINT) AS best_left, CAST(greatest(floor(t / (ratio * 0.7::DOUBLE)), least_left) AS BIGINT) AS worst_left FROM l""")
def compression_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    found = advice.estimated_compression(F.col("n_chars") * (1 + d % 40), d % 100 / 100, d % 9 / 10)
    return _docs(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in found.items()])


@query("WITH e AS (SELECT event_id, value / 100 AS a, CASE WHEN user_id % 13 = 0 THEN 'nan'::DOUBLE ELSE user_id / 40 END AS x FROM events) SELECT event_id, CASE WHEN isnan(x) OR a <= 0 THEN 'fair' WHEN abs(a - x) / a <= 0.15::DOUBLE + 1e-9::DOUBLE THEN 'excellent' WHEN abs(a - x) / a <= 0.4::DOUBLE + 1e-9::DOUBLE THEN 'good' ELSE 'fair' END AS grade FROM e")
def estimate_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    estimated = F.when(F.col("user_id") % 13 == 0, float("nan")).otherwise(F.col("user_id") / 40)
    return _events(spark, sf_dir).select("event_id", advice.estimate_grade(F.col("value") / 100, estimated).alias("grade"))


@query("SELECT event_id, round(greatest(0.5, least(1.0, 1.0 - CASE WHEN user_id % 3 = 0 THEN 0.2 ELSE 0 END - CASE WHEN value * 4 > 1000 * 0.9 THEN 0.1 ELSE 0 END + CASE WHEN user_id % 5 = 0 THEN 0.1 ELSE 0 END)), 6)::DOUBLE AS confidence FROM events")
def advice_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return _events(spark, sf_dir).select("event_id", advice.advice_confidence(u % 3 == 0, F.col("value") * 4, F.lit(1000), u % 5 == 0).alias("confidence"))


STRUCTURED = "CASE WHEN doc_id % 4 = 0 THEN '## Head' || chr(10) || text WHEN doc_id % 4 = 1 THEN text || chr(10) || chr(10) || ' - item' || chr(10) || chr(10) || 'end' ELSE text END"


@query(f"""
WITH d AS (SELECT doc_id, {STRUCTURED} AS x FROM documents),
p AS (SELECT *, regexp_split_to_array(x, '[.!?]+') AS parts FROM d),
l AS (SELECT *, list_filter(list_transform(parts, lambda s: len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> ''))), lambda n: n > 0) AS lens FROM p)
SELECT doc_id, round(least(1.0::DOUBLE,
  CASE WHEN regexp_matches(x, '(?m)^#{{1,6}}\\s+') OR regexp_matches(x, '(?m)^[A-Z][A-Za-z\\s]+:$') OR regexp_matches(x, '(?m)^\\d+\\.\\s+[A-Z]') THEN 0.3::DOUBLE ELSE 0 END
  + CASE WHEN len(string_split(x, chr(10) || chr(10))) >= 3 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(x, '(?m)^\\s*[-*•]\\s+') THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN len(parts) >= 5 AND len(lens) > 0 AND list_sum(list_transform(lens, lambda n: n * n)) / len(lens) - pow(list_sum(lens) / len(lens), 2) < 100 THEN 0.3::DOUBLE ELSE 0 END), 4) AS structure FROM l""")
def structure_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    shaped = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("## Head\n"), x)).when(F.col("doc_id") % 4 == 1, F.concat(x, F.lit("\n\n - item\n\nend"))).otherwise(x)
    return _docs(spark, sf_dir).select("doc_id", shaped.alias("x")).select("doc_id", advice.structure_score(F.col("x")).alias("structure"))


@query("SELECT doc_id, text FROM documents")
def admonitions_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit('!!! note "Title" '), F.col("text"), F.lit("\n??? tip\n"))
    return _docs(spark, sf_dir).select("doc_id", F.regexp_replace(reg.admonitions_stripped(marked), "\n\n$", "").alias("text"))


# -- searching documentation


DOCS_BM25 = BM25.replace("lower(text)", "lower(source || chr(10) || text)")


@query(f"WITH {DOCS_BM25}, r AS (SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS rank FROM bm) SELECT id, source AS title, r.score, CAST(rank AS INT) AS rank FROM r JOIN documents ON id = doc_id WHERE rank <= 5")
def docs_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.docs_search(_docs(spark, sf_dir), QUESTION, 5, title="source").select("id", F.col("source").alias("title"), "score", "rank")


# -- prompts, headings, times


@query("SELECT event_id, 'm' || user_id % 3 || ':' || event_type || ':' || substr(sha256(props), 1, 16) AS key FROM events")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string"))
    return _events(spark, sf_dir).select("event_id", promptcache.cache_key(model, F.col("event_type"), F.col("props")).alias("key"))


@query("""
SELECT event_id, CASE WHEN value < 50 THEN 'below_minimum' WHEN user_id % 4 <> 0 THEN 'prefix_changed' WHEN user_id > 70 THEN 'expired' ELSE 'unknown' END AS cause FROM events""")
def miss_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    rows = _events(spark, sf_dir).select("event_id", F.lit(0).alias("expected_hash"), (u % 4).alias("seen_hash"), F.col("value").alias("tokens"), F.lit(50.0).alias("minimum"), u.alias("age"), F.lit(70).alias("ttl"))
    return promptcache.diagnosis(rows).select("event_id", "cause")


@query("""
WITH d AS (SELECT doc_id, text AS a, CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN '  ' || replace(text, ' ', chr(10) || ' ') ELSE text || ' more' END AS b FROM documents)
SELECT doc_id, CASE WHEN a = b THEN 'none' WHEN trim(regexp_replace(a, '\\s+', ' ', 'g')) = trim(regexp_replace(b, '\\s+', ' ', 'g')) THEN 'whitespace' ELSE 'semantic' END AS drift FROM d""")
def prefix_drift_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, d = F.col("text"), F.col("doc_id")
    b = F.when(d % 3 == 0, a).when(d % 3 == 1, F.concat(F.lit("  "), F.replace(a, F.lit(" "), F.lit("\n ")))).otherwise(F.concat(a, F.lit(" more")))
    return _docs(spark, sf_dir).select("doc_id", promptcache.drift(a, b).alias("drift"))


@query("""
WITH e AS (SELECT event_id, greatest(0, least(1, (user_id % 10 / 10 + user_id % 7 / 7 + 0.5::DOUBLE) / 3)) * 4 AS x FROM events)
SELECT event_id, list_extract([0.10::DOUBLE, 0.15, 0.20, 0.25, 0.30], CAST(round_even(x, 0) AS INT) + 1) AS rate FROM e""")
def rate_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return _events(spark, sf_dir).select("event_id", numbers.rate_level(u % 10 / 10, u % 7 / 7, F.lit(0.5)).alias("rate"))


@query("""
SELECT event_id, CASE user_id % 3 WHEN 0 THEN epoch(ts)::DOUBLE WHEN 1 THEN user_id + 0.5::DOUBLE ELSE 7.0 END AS seconds,
       CASE user_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(make_timestamp(CAST(CASE user_id % 3 WHEN 1 THEN user_id ELSE 7 END * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') END AS shown FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)""")
def coerced_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    value = F.when(u % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(u % 3 == 1, F.concat(u.cast("string"), F.lit(".5"))).otherwise("no time")
    rows = _events(spark, sf_dir).select("event_id", temporal.coerced_timestamp(value, F.lit(7.0)).alias("seconds"))
    return rows.withColumn("shown", temporal.formatted_timestamp(F.col("seconds")))


@query("""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 2 WHEN doc_id % 4 = 1 THEN 6 ELSE 0 END AS level, CASE WHEN doc_id % 4 = 0 THEN 'Title ' || doc_id WHEN doc_id % 4 = 1 THEN 'Deep' ELSE '' END AS heading, CASE WHEN doc_id % 4 = 2 THEN 'Asked ' || doc_id END AS asked, doc_id % 4 = 3 AS structured FROM documents""")
def heading_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, name = F.col("doc_id"), F.col("doc_id").cast("string")
    text = F.when(d % 4 == 0, F.concat(F.lit("  ## Title "), name, F.lit(" \nbody"))).when(d % 4 == 1, F.lit("###### Deep\n#x")).when(d % 4 == 2, F.concat(F.lit("intro\n# Asked "), name, F.lit("\n"))).otherwise(F.lit("a\n# x\n- i\n## y\n- j\n### z\n1. k\n")).alias("t")
    t = F.col("t")
    rows = _docs(spark, sf_dir).select("doc_id", text)
    first = F.when(d % 4 == 3, F.lit(None)).otherwise(tx.first_heading_query(t))
    return rows.select("doc_id", tx.heading_level(t).alias("level"), tx.heading_text(t).alias("heading"), first.alias("asked"), tx.is_structured_markdown(t).alias("structured"))


@query(f"""
WITH {BM25}, top AS (SELECT id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, id LIMIT 1)
SELECT id, score, score >= 100 OR EXISTS (SELECT 1 FROM f JOIN d USING (term), s WHERE f.id = top.id AND tf > 0 AND ln(1 + (n - df + 0.5) / (df + 0.5)) >= 1.0) AS discriminative FROM top""")
def discriminative_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.discriminative(_docs(spark, sf_dir), QUESTION, 1.0, 100.0)


@query("SELECT source || '-' || lpad(doc_id::VARCHAR, 7, '0') AS name, substr(text, 1, 200) AS description, CAST(contains(lower(source || '-' || lpad(doc_id::VARCHAR, 7, '0') || ' ' || text), 'queque') AS INT) + CAST(contains(lower(source || '-' || lpad(doc_id::VARCHAR, 7, '0') || ' ' || text), 'thanedble') AS INT) AS relevance FROM documents WHERE contains(lower(text), 'queque') OR contains(lower(text), 'thanedble') ORDER BY relevance DESC, name LIMIT 25")
def tool_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = _docs(spark, sf_dir).select(F.concat_ws("-", "source", F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("name"), F.col("text").alias("description"))
    return retrieval.tool_search(tools, "Queque thanedble", 25)


@query("""
WITH g AS (SELECT event_type, count(*) AS operations, sum(value / 1000) AS saved, epoch(max(ts)) - epoch(min(ts)) AS span FROM events GROUP BY event_type)
SELECT event_type, operations, round(saved, 4) AS saved, round(CASE WHEN span > 60 THEN saved / span * 2592000 ELSE saved * 100 END, 2) AS monthly, CASE WHEN saved > 0 THEN CAST(floor(29.0::DOUBLE / (saved / operations)) AS BIGINT) END AS breakeven FROM g""")
def monthly_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return savings.projection(_events(spark, sf_dir).withColumn("dollars", F.col("value") / 1000), "event_type", "dollars")


WISHES = "'I prefer  ' || source || '. Always use ' || lang || chr(10) || 'we DONT  use tabs! She likes ' || source || ' and ' || lang || '.'"


@query(f"""
WITH d AS (SELECT doc_id, {WISHES} AS x FROM documents),
p AS (SELECT doc_id, list_concat(regexp_extract_all(x, '(?i)\\bprefer\\s+([^.!\\n]+)', 1), regexp_extract_all(x, '(?i)\\balways\\s+use\\s+([^.!\\n]+)', 1), regexp_extract_all(x, '(?i)\\bdo\\s+not\\s+use\\s+([^.!\\n]+)', 1), regexp_extract_all(x, '(?i)\\bdon''?t\\s+use\\s+([^.!\\n]+)', 1), regexp_extract_all(x, '(?i)\\blikes?\\s+([^.!\\n]+)', 1)) AS v FROM d)
SELECT doc_id, list_filter(list_transform(v, lambda t: trim(regexp_replace(t, '\\s+', ' ', 'g'))), lambda t: t <> '') AS preferences FROM p""")
def user_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("I prefer  "), "source", F.lit(". Always use "), "lang", F.lit("\nwe DONT  use tabs! She likes "), "source", F.lit(" and "), "lang", F.lit("."))
    return _docs(spark, sf_dir).select("doc_id", tx.preferences(said).alias("preferences"))


@query("""
WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source || '-' || doc_id WHEN 1 THEN '../' || source WHEN 2 THEN '/' || source WHEN 3 THEN 'a b' ELSE source || '/' || doc_id END AS v FROM documents)
SELECT doc_id, doc_id % 5 = 0 AS safe, doc_id % 5 IN (0, 4) AS safe_below FROM d""")
def id_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, name = F.col("doc_id") % 5, F.col("source")
    value = F.when(d == 0, F.concat_ws("-", name, "doc_id")).when(d == 1, F.concat(F.lit("../"), name)).when(d == 2, F.concat(F.lit("/"), name)).when(d == 3, "a b").otherwise(F.concat_ws("/", name, "doc_id"))
    return _docs(spark, sf_dir).select("doc_id", tx.safe_id(value).alias("safe"), tx.safe_id(value, True).alias("safe_below"))


@query(r"""
WITH d AS (SELECT doc_id, regexp_replace(text, '(?m)^[ \t]*#{1,6}[ \t]+', '', 'g') AS x FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '`', ''), '\*\*(.+?)\*\*', '\1', 'g'), '\*(.+?)\*', '\1', 'g'), '(?m)^[ \t]*[!?]{3}\+?[ \t]+[\w-]+(?:[ \t]+"[^"]*")?[ \t]*', '', 'g') AS text FROM documents)),
s AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(x, '([.!?])\s+', '\1' || chr(1), 'g'), '([。！？])', '\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(regexp_replace(x, '([.!?])\s+', '\1' || chr(1), 'g'), '([。！？])', '\1' || chr(1), 'g'), chr(1)), 1) AS i FROM d),
c AS (SELECT doc_id, i, trim(regexp_replace(regexp_replace(regexp_replace(s, '^\s*[-*+]\s+', ''), '^\s*\d+\.\s+', ''), '\s+', ' ', 'g')) AS s FROM s),
t AS (SELECT *, floor(len(list_filter(string_split(s, ' '), lambda w: w <> '')) * 1.3) AS t FROM c WHERE regexp_matches(s, '[\p{L}\p{N}]')),
r AS (SELECT *, sum(t) OVER (PARTITION BY doc_id ORDER BY i) AS used, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM t)
SELECT d.doc_id, coalesce(string_agg(s, ' ' ORDER BY i) FILTER (k = 1 OR used <= 60), '') AS anchor FROM d LEFT JOIN r ON d.doc_id = r.doc_id GROUP BY d.doc_id""")
def extractive_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", skeleton.anchor_text(F.col("text"), 60).alias("anchor"))
