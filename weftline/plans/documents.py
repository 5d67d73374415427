"""Queries over documents, pages and the benchmark table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions import metatokens, numbers as num, text as tx
from weftline.operators import advice, clifilter, dedup, promptcache, quality as ql, retrieval, savings, scopes, skeleton
from weftline.plans.base import query
from weftline.session import table
from weftline.sources import connectors, sinks

#: Words of the documents' vocabulary, frequent and less frequent.
QUESTION = "the of tion queque thanedble"
WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
SENTENCES = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"""
SELECT doc_id, CAST(len(w) AS INT) AS words, CAST(floor(len(w) * 1.3) AS INT) AS tokens, length(text) // 4 AS chars_4, length(text) // 2 AS json_2,
       CAST(strlen(text) AS BIGINT) AS utf8_bytes,
       CASE WHEN length(text) > 100000 THEN length(text) // 4
            ELSE CAST(floor(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) * 0.25 + (length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))) * 1.3) AS BIGINT) END AS mixed
FROM (SELECT *, {WORDS} AS w FROM documents)""")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", tx.word_count(t).alias("words"), tx.token_count(t).alias("tokens"), *[c.alias(k) for k, c in tx.token_estimates(t).items()])


@query(f"""
SELECT doc_id, tokens, CASE WHEN tokens < 8000 THEN 0.8 WHEN tokens < 32000 THEN 0.5 WHEN tokens < 100000 THEN 0.2 ELSE 0.1 END AS ratio,
       CASE WHEN tokens >= 1500 THEN 'critical' WHEN tokens >= 1200 THEN 'urgent' WHEN tokens >= 800 THEN 'warning' ELSE 'ok' END AS status
FROM (SELECT doc_id, CAST(floor(len({WORDS}) * 1.3) AS INT) AS tokens FROM documents)""")
def adaptive_ratio_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", tx.token_count(F.col("text")).alias("tokens"))
    return rows.select("doc_id", "tokens", num.adaptive_ratio(F.col("tokens")).alias("ratio"), num.budget_status(F.col("tokens"), F.lit(2000)).alias("status"))


BM25 = f"""
t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS toks FROM documents),
s AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t),
q AS (SELECT unnest(string_split('{QUESTION}', ' ')) AS term),
f AS (SELECT id, len(toks) AS dl, term, len(list_filter(toks, lambda x: x = term)) AS tf FROM t, q),
d AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM f GROUP BY term),
bm AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
       FROM f JOIN d USING (term), s WHERE tf > 0 GROUP BY id)"""


@query(f"WITH {BM25}, r AS (SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS rank FROM bm) SELECT id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = retrieval.bm25(_docs(spark, sf_dir), QUESTION).withColumn("score", F.round("score", 6))
    return retrieval.top_k(scored, 20)


@query("""
WITH t AS (SELECT list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS toks FROM documents),
n AS (SELECT count(*) AS n FROM t), d AS (SELECT token, count(*) AS df FROM (SELECT unnest(toks) AS token FROM t) GROUP BY token)
SELECT token, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM d, n WHERE df >= 5""")
def bm25_idf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.idf_terms(_docs(spark, sf_dir), least=5).withColumn("idf", F.round("idf", 6))


@query("SELECT doc_id, regexp_matches(text, '\"[^\"]*\\w[^\"]*\"') OR regexp_matches(text, '[0-9_]') OR regexp_matches(text, '[a-z][A-Z]') AS fuse FROM documents")
def lexical_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.gated(_docs(spark, sf_dir), "text").select("doc_id", "fuse")


@query(rf"""
WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w, regexp_split_to_array(text, '[.!?]+') AS p FROM documents),
g AS (SELECT doc_id, w, p, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END AS grams FROM w),
h AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(array_to_string(p[1:5], ' ')), '\s+'), lambda x: x <> '')) AS a,
             list_distinct(list_filter(regexp_split_to_array(lower(array_to_string(p[greatest(len(p) - 4, 1):], ' ')), '\s+'), lambda x: x <> '')) AS b FROM g),
r AS (SELECT *, 1 - len(list_distinct(grams)) / greatest(len(grams), 1) AS rep FROM h)
SELECT doc_id, round(CASE WHEN len(w) < 10 THEN 0.0 WHEN len(p) < 3 OR len(a) = 0 OR len(b) = 0 THEN rep
       ELSE least(rep * 0.7 + len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) * 0.3, 1.0) END, 6) AS redundancy FROM r""")
def redundancy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.round(tx.redundancy(F.col("text")), 6).alias("redundancy"))


@query(f"SELECT doc_id, round(CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w) ELSE 0 END, 6) AS word_length, CAST(len(s) AS INT) AS sentences FROM (SELECT doc_id, {WORDS} AS w, {SENTENCES} AS s FROM documents)")
def text_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.round(tx.average_word_length(t), 6).alias("word_length"), F.size(tx.sentences(t)).alias("sentences"))


@query(r"""
SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
       coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9._-]+', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'item') AS segment FROM pages""")
def page_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.slugify(F.col("url")).alias("slug"), tx.sanitize_segment(F.col("url")).alias("segment"))


@query()
def key_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", tx.key_entities(t).alias("entities"), tx.summary(t).alias("summary"))


@query()
def token_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    refined = F.array_join(F.transform(tx.sentences(F.col("text")), lambda s: tx.refined(s)), " ")
    return _docs(spark, sf_dir).select("doc_id", refined.alias("refined")).withColumn("tokens", tx.token_count(F.col("refined")))


@query()
def identifier_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.guarded(F.col("text"), tx.summary(F.col("text"))).alias("guarded"))


@query("SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(_docs(spark, sf_dir))


@query(r"""
WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS ngram FROM w WHERE len(w) >= 3)
SELECT id, 3 AS n, ngram, count(*) AS freq, count(*) * 2 - 3 AS savings FROM g GROUP BY id, ngram HAVING count(*) >= 2 AND count(*) * 2 - 3 > 0""")
def repeated_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.repeated_ngrams(_docs(spark, sf_dir), 3, 3)


@query()
def repeated_ngrams_2_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two to twenty words; their SQL takes two minutes on small tables, so the tests count them in plain Python."""
    return dedup.repeated_ngrams(_docs(spark, sf_dir), 2, 20)


LINES = "l AS (SELECT doc_id AS id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)"


@query(f"""
WITH {LINES}, c AS (SELECT *, CASE WHEN lag(line) OVER (PARTITION BY id ORDER BY pos) = line THEN 0 ELSE 1 END AS new FROM l),
r AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY pos) AS run FROM c)
SELECT id, CAST(min(pos) AS INT) AS start, any_value(line) AS line, count(*) AS n FROM r GROUP BY id, run""")
def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clifilter.line_runs(_docs(spark, sf_dir))


@query(f"""
WITH {LINES}, c AS (SELECT *, CASE WHEN lag(line) OVER (PARTITION BY id ORDER BY pos) = line THEN 0 ELSE 1 END AS new FROM l),
r AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY pos) AS run FROM c),
g AS (SELECT id, run, any_value(line) AS line, count(*) AS n FROM r GROUP BY id, run)
SELECT id, string_agg(CASE WHEN n > 1 THEN line || ' (repeated ' || n || ' times)' ELSE line END, chr(10) ORDER BY run) AS text FROM g GROUP BY id""")
def log_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clifilter.collapse_runs(_docs(spark, sf_dir))


@query()
def generic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clifilter.generic(_docs(spark, sf_dir))


@query(f"WITH {LINES} SELECT id, CAST(pos + 1 AS INT) AS line_no, line FROM l WHERE regexp_matches(line, 'licensed? under|[0-9]{{3}}-[0-9]{{4}}')")
def line_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.line_search(_docs(spark, sf_dir), "licensed? under|[0-9]{3}-[0-9]{4}")


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'rights reserved')")
def term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.term_search(_docs(spark, sf_dir), ["License", "rights reserved"]).select("doc_id", "source")


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '^\s*[\[{]') THEN 'json' WHEN regexp_matches(text, '\d{1,3}%') THEN 'progress' ELSE 'generic' END AS kind FROM documents")
def command_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", clifilter.command_kind(F.col("text")).alias("kind"))


@query("""
WITH d AS (SELECT CASE WHEN n_chars < 100 THEN 'skip' WHEN n_chars < 500 THEN 'direct' ELSE 'compress' END AS action, n_chars // 4 AS tokens FROM documents)
SELECT action, count(*) AS files, sum(tokens) AS tokens, sum(CASE WHEN action = 'compress' THEN floor(tokens * 0.8) ELSE 0 END)::BIGINT AS saved FROM d GROUP BY action""")
def discovery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return savings.discovery_report(_docs(spark, sf_dir))


@query("SELECT source, count(*) AS documents, sum(n_chars) AS chars, round(sum(n_chars) * 100 / (SELECT sum(n_chars) FROM documents), 4) AS pct FROM documents GROUP BY source")
def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))
    return savings.share_of_total(sums, "chars")


@query("""
WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, count(*) AS n, list(doc_id ORDER BY doc_id) FILTER (rank <= ceil(n * 0.1)) AS brief, list(doc_id ORDER BY doc_id) FILTER (rank <= ceil(n * 0.3)) AS standard FROM r GROUP BY source""")
def multi_level_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.tiers(_docs(spark, sf_dir), "source", "n_chars", "doc_id")


@query("""
WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id, CASE WHEN rank <= greatest(1, floor(n * 0.15)) THEN 'main' WHEN rank <= greatest(1, floor(n * 0.15)) + floor(n * 0.25) THEN 'auxiliary' ELSE 'rest' END AS band FROM r""")
def three_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.bands(_docs(spark, sf_dir), "source", "n_chars", "doc_id").select("source", "doc_id", "band")


@query("""
WITH l AS (SELECT doc_id AS file_id, string_split(text, chr(10)) AS lines FROM documents), s AS (SELECT file_id, lines, unnest(range(1, len(lines) + 1, 5)) AS a FROM l)
SELECT file_id, CAST((a - 1) // 5 AS INT) AS block, CAST(a AS INT) AS start_line, CAST(least(a + 4, len(lines)) AS INT) AS end_line, array_to_string(lines[a:a + 4], chr(10)) AS code FROM s""")
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.line_chunks(_docs(spark, sf_dir), 5)


@query()
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.chunk_documents(_docs(spark, sf_dir), budget=128)


@query(f"""
WITH d AS (SELECT doc_id, {SENTENCES} AS ss FROM documents), u AS (SELECT doc_id, ss, len(ss) AS n, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS i FROM d WHERE len(ss) > 0),
w AS (SELECT *, len(list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '')) AS words FROM u),
c AS (SELECT doc_id, ss, n, i, CAST(floor(words * 1.3) AS BIGINT) AS t, -(1 - 0.15::DOUBLE * i / n + CASE WHEN words BETWEEN 6 AND 40 THEN 0.2::DOUBLE ELSE 0 END) AS less FROM w),
l AS (SELECT doc_id, ss, n, list({{'t': t, 'i': i::BIGINT, 'used': 0::BIGINT, 'at': []::BIGINT[]}} ORDER BY less, i) AS xs FROM c GROUP BY doc_id, ss, n),
r AS (SELECT doc_id, ss, n, list_reduce(xs, lambda a, x: CASE WHEN a.used + x.t <= 120 THEN {{'t': x.t, 'i': x.i, 'used': a.used + x.t, 'at': list_append(a.at, x.i)}} ELSE a END, {{'t': 0::BIGINT, 'i': 0::BIGINT, 'used': 0::BIGINT, 'at': []::BIGINT[]}}) AS a FROM l)
SELECT d.doc_id AS id, CAST(len(d.ss) AS INT) AS sentences, CAST(coalesce(len(a.at), 0) AS INT) AS kept, CAST(coalesce(a.used, 0) AS INT) AS tokens, coalesce(array_to_string(list_transform(list_sort(a.at), lambda k: r.ss[k + 1]), ' '), '') AS text FROM d LEFT JOIN r USING (doc_id)""")
def extractive_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.extractive(_docs(spark, sf_dir), 120)


@query()
def document_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.flagship(_docs(spark, sf_dir))


@query()
def modulated_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.modulate(_docs(spark, sf_dir), "OUTLINE").select("doc_id", "rendered")


@query("SELECT d.doc_id, b.item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("span"))
    return ql.span_gate(_docs(spark, sf_dir), spans)


@query()
def predicted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _docs(spark, sf_dir).withColumn("kept", ql.simulated(F.col("text"), 0.4))
    return kept.select("doc_id", ql.predicted_quality(F.col("text"), F.col("kept")).alias("score"))


@query(r"""
WITH p AS (SELECT doc_id, regexp_matches(substr(text, 1, 5000), '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}|\b\d{10,13}\b|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|(?i:\b(?:request|session|trace)[_-]?id\b)') AS volatile, sha256(substr(text, 1, 5000)) AS prefix_hash FROM documents)
SELECT doc_id, NOT volatile AS stable, prefix_hash FROM p""")
def prefix_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = promptcache.stability(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", found["stable"].alias("stable"), found["prefix_hash"].alias("prefix_hash"))


@query("SELECT h AS prefix_hash, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT doc_id, sha256(substr(text, 1, 40)) AS h FROM documents) GROUP BY h HAVING count(*) > 1")
def prefix_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.sha2(F.substring("text", 1, 40), 256).alias("prefix_hash"))
    return promptcache.siblings(rows, id_col="doc_id")


@query("SELECT doc_id, CASE WHEN trim(text) = '' THEN 'blank' WHEN length(text) < 20 THEN 'too short' WHEN strlen(text) > 1048576 THEN 'too large' END AS error FROM documents")
def ingest_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connectors.valid(_docs(spark, sf_dir)).select("doc_id", "error")


@query("""
WITH l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls, substr(ltrim(text), 1, 1) AS c FROM documents),
f AS (SELECT *, len(ls) >= 2 AND len(list_filter(ls, lambda x: substr(ltrim(x), 1, 1) IN ('{', '[') AND json_valid(x))) = len(ls) AS jsonl, len(string_split(ls[1], ',')) AS width FROM l)
SELECT doc_id, CASE WHEN jsonl THEN 'jsonl' WHEN c = '[' AND json_valid(text) THEN 'json_array' WHEN c = '{' AND json_valid(text) THEN 'json_object'
       WHEN len(ls) >= 2 AND width >= 2 AND len(list_filter(ls, lambda x: len(string_split(x, ',')) = width)) = len(ls) AND NOT contains(text, '"') THEN 'csv' END AS kind FROM f""")
def structured_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", connectors.structured_kind(F.col("text")).alias("kind"))


@query(r"""
SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS source_id, url,
       trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def page_text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = connectors.page_documents(table(spark, sf_dir, "pages"))
    return found.select("source_id", F.col("metadata")["url"].alias("url"), "text")


@query("SELECT replace(replace(n_name, chr(92), chr(92) || chr(92)), ',', chr(92) || ',') || ',' || n_nationkey || ',' || n_regionkey AS value FROM nation")
def tabular_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.tabular_rows(table(spark, sf_dir, "nation"), ["n_name", "n_nationkey", "n_regionkey"])


@query("SELECT 'documents_total{source=\"' || source || '\",lang=\"' || lang || '\"} ' || count(*) AS value FROM documents GROUP BY source, lang")
def prometheus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _docs(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("n"))
    return sinks.prometheus(counts, "documents_total", ["source", "lang"], "n")


@query("SELECT c_custkey, 'scope__w=' || c_mktsegment || '__u=' || c_nationkey || '__f=' || replace(c_name, '#', '%23') AS scoped, c_name AS file_id FROM customer")
def scope_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    scoped = rows.withColumn("scoped", scopes.composed(F.col("c_name"), {"workspace_id": F.col("c_mktsegment"), "user_id": F.col("c_nationkey").cast("string")}))
    return scoped.select("c_custkey", "scoped", scopes.parsed(F.col("scoped"))["file_id"].alias("file_id"))


@query("""
WITH d AS (SELECT doc_id, (n_chars // 200) AS nodes FROM documents), u AS (SELECT * FROM (VALUES ('quick_summary', 'ABSTRACT', 10), ('question_answering', 'DETAILED', 100), ('exact_quotes', 'RAW', 200)) v(use_case, own, per))
SELECT doc_id, use_case, CASE WHEN nodes * per <= 1000 THEN own WHEN nodes * 100 <= 1000 THEN 'DETAILED' WHEN nodes * 50 <= 1000 THEN 'STRUCTURE' WHEN nodes * 30 <= 1000 THEN 'OUTLINE' WHEN nodes * 10 <= 1000 THEN 'ABSTRACT' ELSE own END AS fidelity FROM d, u""")
def fidelity_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = spark.createDataFrame([("quick_summary",), ("question_answering",), ("exact_quotes",)], "use_case string")
    rows = _docs(spark, sf_dir).select("doc_id", F.floor(F.col("n_chars") / 200).alias("nodes")).crossJoin(F.broadcast(uses))
    return rows.select("doc_id", "use_case", advice.fidelity(F.col("use_case"), F.col("nodes"), F.lit(1000)).alias("fidelity"))


@query("""
SELECT doc_id, round(greatest(0.01, least(0.90, (ln(greatest(n_chars, 1)) * (0.40 / (ln(1000000) - ln(50000))) + 0.10 - 0.40 / (ln(1000000) - ln(50000)) * ln(50000)) * 0.75)), 4) AS ratio FROM documents""")
def window_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", advice.window_ratio(F.col("n_chars"), F.lit(0.6)).alias("ratio"))


@query("""
WITH p AS (SELECT * FROM (VALUES (0, 'minimal', 0.05::DOUBLE), (1, 'summary', 0.15), (2, 'balanced', 0.20), (3, 'detailed', 0.50), (4, 'full', 0.80)) v(place, profile, ratio)),
q AS (SELECT doc_id, place, profile, CASE WHEN n_chars * ratio >= 400 THEN 1.0 ELSE 0.5 END AS quality FROM documents, p)
SELECT doc_id, coalesce(first(profile ORDER BY place) FILTER (quality >= 0.8), first(profile ORDER BY place DESC)) AS profile FROM q GROUP BY doc_id""")
def auto_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "n_chars")
    return advice.auto_profile(advice.all_profiles(docs, lambda r: F.when(F.col("n_chars") * r >= 400, 1.0).otherwise(0.5)), 0.8)


@query(f"""
WITH s AS (SELECT doc_id, text, {WORDS} AS w, {SENTENCES} AS s FROM documents), f AS (SELECT *, list_filter(regexp_split_to_array(s[1], '\\s+'), lambda x: x <> '') AS fw FROM s)
SELECT doc_id, CASE WHEN len(w) <= 40 THEN text WHEN len(fw) <= 40 THEN s[1] ELSE array_to_string(w[1:40], ' ') || '…' END AS short FROM f""")
def manifest_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", advice.shortened(F.col("text")).alias("short"))


@query()
def handoff_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    top = retrieval.bm25(docs, QUESTION).select(F.col("id").alias("file_id"), F.col("id").alias("node"), "score")
    return advice.handoff(docs.select(F.col("doc_id").alias("file_id"), tx.summary(F.col("text")).alias("skeleton_text")), top)


@query()
def response_intercept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clifilter.intercepted(_docs(spark, sf_dir))


@query()
def meta_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = metatokens.compress(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", small.alias("compressed"))
