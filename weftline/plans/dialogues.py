"""Queries over conversations. Word lists suit their invented vocabulary; the operators' own lists are tested on English."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from weftline.functions import text as tx
from weftline.operators import dedup, dialogue, memory, promptcache, prompts, skeleton
from weftline.plans.base import query
from weftline.session import table

CRITICAL, RELEVANT = ["thanedble", "queque", "enschach"], ["tion", "ment", "ung"]
SIGNALS = {"decision": "the ", "lesson": " de ", "issue": " und "}
CATEGORIES = {"gotcha": ["the ", " of "], "issue": [" de ", "que"], "decision": [" und ", "der "]}
PAIRS = [(r"\bthe\b", r"\bde\b"), (r"\bund\b", r"\bof\b")]


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def _hit(words: list[str]) -> str:
    return " OR ".join(f"contains(lower(text), '{w}')" for w in words)


LEVEL = f"CASE WHEN {_hit(CRITICAL)} THEN 'CRITICAL' WHEN {_hit(RELEVANT)} THEN 'RELEVANT' WHEN role = 'system' THEN 'RELEVANT' ELSE 'TRIVIAL' END"


@query(f"SELECT conv_id, turn, {LEVEL} AS importance FROM conversations")
def message_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", dialogue.importance(F.col("text"), F.col("role"), CRITICAL, RELEVANT, None).alias("importance"))


@query()
def fuzzy_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With misspellings, which SQL can't compare; the tests compare them one by one."""
    return _turns(spark, sf_dir).select("conv_id", "turn", dialogue.importance(F.col("text"), F.col("role"), CRITICAL, RELEVANT).alias("importance"))


@query(f"WITH c AS (SELECT conv_id, {LEVEL} AS level FROM conversations) SELECT conv_id, count(*) AS turns, count(*) FILTER (level = 'CRITICAL') AS critical, count(*) FILTER (level = 'RELEVANT') AS relevant, count(*) FILTER (level = 'TRIVIAL') AS trivial FROM c GROUP BY conv_id")
def dialogue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.stats(_turns(spark, sf_dir), CRITICAL, RELEVANT, ratio=None)


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role <> 'system') SELECT conv_id, turn, role, text FROM r WHERE k <= 3")
def recent_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.recent_tail(_turns(spark, sf_dir), 3)


@query("WITH m AS (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) SELECT conv_id, turn, round(CASE WHEN last > 0 THEN 1 - (last - turn) / last ELSE 1 END, 6) AS linear, round(pow(0.5, (last - turn) / 3.0), 6) AS half_life FROM m")
def recency_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max("turn").over(W.partitionBy("conv_id"))
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(dialogue.recency(F.col("turn"), last), 6).alias("linear"), F.round(dialogue.half_life_weight(F.col("turn"), last, 3.0), 6).alias("half_life"))


@query()
def relevance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = skeleton.embed(_turns(spark, sf_dir))
    return dialogue.scored(rows, None, CRITICAL, RELEVANT).select("conv_id", "turn", "importance", F.round("relevance", 6).alias("relevance"), "fidelity")


@query()
def afm_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dialogue.scored(skeleton.embed(_turns(spark, sf_dir)), None, CRITICAL, RELEVANT)
    return dialogue.pack(rows, 200)


@query()
def packing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.packing_stats(afm_packing(spark, sf_dir), 200)


@query()
def afm_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.rendered(_turns(spark, sf_dir), afm_packing(spark, sf_dir))


#: The summary of a text to 80 characters, as ``functions.text.summary`` has it.
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '`+', '', 'g'), '\*+|__', '', 'g'), '(?m)^#+\s*', '', 'g'), '(?m)^>\s*', '', 'g')"
_SAID = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(clean, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 20)"


@query(f"""
WITH c AS (SELECT *, {_CLEAN} AS clean, sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
f AS (SELECT *, coalesce({_SAID}[1], trim(clean)) AS first, '[' || role || '] ' || trim(text) AS line FROM c),
s AS (SELECT *, CASE WHEN length(first) > 80 THEN '- ' || substr(first, 1, 80) || '...' ELSE '- ' || first END AS said, trim(text) <> '' AS filled FROM f)
SELECT conv_id, coalesce(string_agg(line, chr(10) ORDER BY turn, line) FILTER (filled AND role = 'system'), '') AS system,
    coalesce(string_agg(said, chr(10) ORDER BY turn, said) FILTER (filled AND role <> 'system' AND back > 2), '') AS older,
    coalesce(string_agg(line, chr(10) ORDER BY turn, line) FILTER (filled AND role <> 'system' AND back <= 2), '') AS tail FROM s GROUP BY conv_id""")
def history_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.compacted(_turns(spark, sf_dir), 2)


@query(r"""
WITH t AS (SELECT conv_id, turn, string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n{2,}', chr(1), 'g'), chr(1)) AS p FROM conversations),
s AS (SELECT conv_id, turn, generate_subscripts(p, 1) AS pos, regexp_replace(trim(unnest(p)), '(?i)^\s*\[?\s*(?:user|assistant|human|ai|system)\s*\]?\s*:?\s*', '') AS whole FROM t),
c AS (SELECT conv_id, turn, pos, substr(whole, 1, 500) AS sentence FROM s WHERE length(whole) >= 20),
g AS (SELECT *, CASE WHEN regexp_matches(sentence, '(?i)the ') THEN 'decision' WHEN regexp_matches(sentence, '(?i) de ') THEN 'lesson' WHEN regexp_matches(sentence, '(?i) und ') THEN 'issue' END AS signal FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(sentence) ORDER BY turn, pos) AS k FROM g WHERE signal IS NOT NULL)
SELECT conv_id, turn AS first_turn, sentence, signal FROM r WHERE k = 1""")
def transcript_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.insights(_turns(spark, sf_dir), SIGNALS)


def _share(patterns: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN 1.0::DOUBLE ELSE 0 END" for p in patterns) + f") / {len(patterns)}"


@query(f"""
WITH s AS (SELECT conv_id, turn, {', '.join(f'{_share(p)} AS {c}' for c, p in CATEGORIES.items())} FROM conversations), b AS (SELECT *, greatest({', '.join(CATEGORIES)}) AS best FROM s)
SELECT conv_id, turn, CASE WHEN best = 0 THEN 'general' {' '.join(f"WHEN {c} = best THEN '{c}'" for c in CATEGORIES)} END AS category, round(CASE WHEN best > 0 THEN least(best * 3, 1) ELSE 0.3 END, 6) AS confidence FROM b""")
def memory_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    category, confidence = memory.classify(F.col("text"), CATEGORIES)
    return _turns(spark, sf_dir).select("conv_id", "turn", category.alias("category"), F.round(confidence, 6).alias("confidence"))


@query("WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]+')) AS topic FROM conversations) SELECT topic, count(*) AS n FROM t WHERE length(topic) >= 4 GROUP BY topic ORDER BY n DESC, topic LIMIT 25")
def topics_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.topics(_turns(spark, sf_dir), 25)


@query(f"""
WITH s AS ({' UNION ALL '.join(f"SELECT role, {k} AS rule, conv_id * 1000 + turn AS id, regexp_matches(text, '(?i){p}') AND NOT regexp_matches(text, '(?i){n}') AS p, regexp_matches(text, '(?i){n}') AND NOT regexp_matches(text, '(?i){p}') AS n FROM conversations" for k, (p, n) in enumerate(PAIRS))})
SELECT role, rule, count(*) FILTER (p) AS n_positive, count(*) FILTER (n) AS n_negative, min(id) FILTER (p) AS first_positive, min(id) FILTER (n) AS first_negative FROM s GROUP BY role, rule HAVING count(*) FILTER (p) > 0 AND count(*) FILTER (n) > 0""")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).withColumn("memory_id", F.col("conv_id") * 1000 + F.col("turn"))
    return memory.contradictions(rows, PAIRS, group="role")


@query("""
WITH o AS (SELECT DISTINCT conv_id, sha256(text) AS h FROM conversations WHERE role = 'user'), n AS (SELECT DISTINCT conv_id, sha256(text) AS h FROM conversations WHERE role = 'assistant'),
b AS (SELECT coalesce(o.conv_id, n.conv_id) AS conv_id, o.h AS oh, n.h AS nh FROM o FULL JOIN n ON o.conv_id = n.conv_id AND o.h = n.h),
c AS (SELECT conv_id, count(*) FILTER (oh IS NOT NULL AND nh IS NOT NULL) AS unchanged, count(*) FILTER (oh IS NULL) AS fresh, count(*) FILTER (nh IS NULL) AS gone FROM b GROUP BY conv_id)
SELECT conv_id, unchanged, least(fresh, gone) AS updated, fresh - least(fresh, gone) AS added, gone - least(fresh, gone) AS removed FROM c""")
def chunk_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    return dedup.chunk_diff(t.filter("role = 'user'"), t.filter("role = 'assistant'"), "conv_id")


@query(r"""
WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn, CASE WHEN before IS NULL THEN NULL WHEN before = text THEN 'none' WHEN trim(regexp_replace(before, '\s+', ' ', 'g')) = trim(regexp_replace(text, '\s+', ' ', 'g')) THEN 'whitespace' ELSE 'semantic' END AS drift FROM p""")
def turn_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    rows = _turns(spark, sf_dir).withColumn("before", before)
    return rows.select("conv_id", "turn", F.when(F.col("before").isNotNull(), promptcache.drift(F.col("before"), F.col("text"))).alias("drift"))


@query(r"""
WITH p AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS x, list_distinct(list_filter(regexp_split_to_array(lower(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)), '\s+'), lambda x: x <> '')) AS y FROM conversations)
SELECT conv_id, turn, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS overlap FROM p WHERE y IS NOT NULL""")
def turn_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).withColumn("before", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).filter("before IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(dedup.word_jaccard("text", "before"), 6).alias("overlap"))


@query("""
WITH m AS (SELECT role AS user_id, conv_id * 1000 + turn AS memory_id, CASE WHEN length(text) < 200 THEN 'short' ELSE 'long' END AS category FROM conversations),
c AS (SELECT user_id, count(*) AS total, count(*) FILTER (category = 'long') AS longs, count(*) FILTER (category = 'short') AS shorts FROM m GROUP BY user_id),
l AS (SELECT user_id, list(memory_id ORDER BY memory_id DESC) AS latest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY memory_id DESC) AS k FROM m) WHERE k <= 5 GROUP BY user_id)
SELECT user_id, total, longs, shorts, latest FROM c JOIN l USING (user_id)""")
def user_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.col("conv_id") * 1000 + F.col("turn")
    rows = _turns(spark, sf_dir).select(F.col("role").alias("user_id"), ids.alias("memory_id"), F.when(F.length("text") < 200, "short").otherwise("long").alias("category"), ids.alias("created_at"))
    found = memory.profile(rows)
    return found.select("user_id", "total", F.coalesce(F.col("by_category")["long"], F.lit(0)).alias("longs"), F.coalesce(F.col("by_category")["short"], F.lit(0)).alias("shorts"), "latest")


@query("SELECT role AS category, count(*) AS n, '# ' || role || chr(10) || chr(10) || string_agg('- ' || text, chr(10) ORDER BY conv_id * 1000 + turn) AS article FROM conversations GROUP BY role")
def knowledge_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("memory_id"), "text", F.col("role").alias("category"))
    return memory.articles(rows)


@query("SELECT conv_id, sum(floor(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) * 1.3))::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def conversation_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).groupBy("conv_id").agg(F.sum(tx.token_count(F.col("text"))).alias("tokens"))


@query("""
WITH v AS (SELECT conv_id AS prompt, turn AS version, role AS system, text AS context FROM conversations),
p AS (SELECT *, lag(version) OVER w AS pv, lag(system) OVER w AS ps, lag(context) OVER w AS pc FROM v WINDOW w AS (PARTITION BY prompt ORDER BY version))
SELECT prompt, version, CASE WHEN pv IS NULL OR ps IS NOT DISTINCT FROM system THEN 0 ELSE 1 END AS stable, CASE WHEN pv IS NULL OR pc IS NOT DISTINCT FROM context THEN 0 ELSE 1 END AS volatile FROM p""")
def prompt_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    versions = _turns(spark, sf_dir).select(F.col("conv_id").alias("prompt"), F.col("turn").alias("version"), F.col("role").alias("system"), none.alias("tools"), none.alias("policies"), F.col("text").alias("context"), none.alias("user"))
    found = prompts.changed_fields(versions)
    return found.select("prompt", "version", F.size("stable_changes").alias("stable"), F.size("volatile_changes").alias("volatile"))
