"""Queries over embeddings. Thresholds suit their vectors, whose cosines stay below .61."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions import numbers as num
from weftline.operators import dedup, graph, retrieval, skeleton
from weftline.plans.base import query
from weftline.plans.documents import BM25, QUESTION
from weftline.session import table

EDGE, DUPLICATE, BLIND = 0.25, 0.35, 0.25
DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
COS = f"{DOT} / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"
#: Cosines of all vectors with the first one.
SELF = f"sims AS (SELECT a.vec_id AS id, a.label, round({COS}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) b)"
EDGES = f"e AS (SELECT a.label, a.vec_id AS src, b.vec_id AS dst, {DOT} AS weight FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {DOT} > {EDGE})"
DEGREE = "d AS (SELECT label, vec_id AS id, (SELECT count(*) FROM e WHERE src = vec_id OR dst = vec_id) AS degree FROM embeddings)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _first(vectors: DataFrame) -> list[float]:
    """The first vector: one row."""
    return list(vectors.orderBy("vec_id").first()["embedding"])


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return retrieval.dense_scores(v, _first(v)).withColumn("score", F.round("score", 6))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.similarity_edges(_vectors(spark, sf_dir), EDGE)


@query(f"WITH {SELF} SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rank FROM sims ORDER BY score DESC, id LIMIT 20")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_k(_scored(spark, sf_dir), 20)


@query(f"""
WITH {BM25}, {SELF}, x AS (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS rank FROM bm), y AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sims),
u AS (SELECT id, rank FROM x WHERE rank <= 50 UNION ALL SELECT id, rank FROM y WHERE rank <= 50)
SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM u GROUP BY id""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical = retrieval.top_k(retrieval.bm25(table(spark, sf_dir, "documents"), QUESTION).withColumn("score", F.round("score", 6)), 50)
    return retrieval.rrf([lexical, retrieval.top_k(_scored(spark, sf_dir), 50)]).withColumn("score", F.round("score", 8))


@query(f"WITH {SELF}, m AS (SELECT max(score) AS best_score FROM sims) SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rank, best_score, best_score >= 0.35 AS sufficient, best_score < 0.35 AS used_expanded_search FROM sims, m ORDER BY score DESC, id LIMIT 10")
def evidence_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.evidence(_scored(spark, sf_dir), 10)


@query(f"WITH {EDGES} SELECT label, src, dst, round(weight, 6) AS weight FROM e")
def similarity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).withColumn("weight", F.round("weight", 6))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({COS}, 4) AS similarity FROM embeddings a JOIN embeddings b ON a.label <> b.label AND a.vec_id < b.vec_id WHERE {COS} >= {DUPLICATE}")
def cross_group_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cross_group_pairs(_vectors(spark, sf_dir), DUPLICATE)


@query(f"""
WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label <> b.label AND a.vec_id < b.vec_id WHERE {COS} >= 0.40),
both_ AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT a AS node, a AS seen FROM both_ UNION SELECT r.node, both_.b FROM r JOIN both_ ON r.seen = both_.a)
SELECT node, min(seen) AS component FROM r GROUP BY node""")
def duplicate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.components(graph.cross_group_pairs(_vectors(spark, sf_dir), 0.40, spanning=True))


@query()
def pagerank_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank_of_groups(_edges(spark, sf_dir)).withColumn("rank", F.round("rank", 8))


@query()
def pagerank_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(_edges(spark, sf_dir)).withColumn("rank", F.round("rank", 8))


@query(f"""
WITH {EDGES}, {DEGREE}, m AS (SELECT *, min(degree) OVER (PARTITION BY label) AS low, max(degree) OVER (PARTITION BY label) AS high FROM d)
SELECT label, id, degree, round(CASE WHEN high > low THEN (degree - low) / (high - low) ELSE 1.0 END, 6) AS importance FROM m""")
def importance_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.degrees(_edges(spark, sf_dir), _vectors(spark, sf_dir))
    return graph.min_max(found, "degree", "label", "importance").withColumn("importance", F.round("importance", 6))


@query(f"""
WITH {EDGES}, {DEGREE}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY degree DESC, id) AS rank, count(*) OVER (PARTITION BY label) AS n FROM d)
SELECT label, id, degree AS importance, CAST(rank AS INT) AS rank, round(1 - (rank - 1) / n, 4) AS percentile, degree AS neighbours, rank <= greatest(1, floor(n * 0.2)) AS kept FROM r""")
def explain_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    ranked = graph.degrees(edges, _vectors(spark, sf_dir)).withColumnRenamed("degree", "importance")
    return graph.explain(ranked, edges, 0.2)


@query(f"WITH {EDGES}, n AS (SELECT label, count(*) AS n_nodes FROM embeddings GROUP BY label), m AS (SELECT label, count(*) AS n_edges FROM e GROUP BY label) SELECT label, n_nodes, coalesce(n_edges, 0) AS n_edges, round(coalesce(n_edges, 0) / (n_nodes * (n_nodes - 1) / 2), 6) AS density FROM n LEFT JOIN m USING (label)")
def graph_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.density(_edges(spark, sf_dir), _vectors(spark, sf_dir), "label").withColumn("density", F.round("density", 6))


@query(f"""
WITH {SELF}, r AS (SELECT label, id, greatest(score, 0) AS rel, sum(greatest(score, 0)) OVER (PARTITION BY label) AS total, count(*) OVER (PARTITION BY label) AS n FROM sims)
SELECT label, id, round(least(greatest(CASE WHEN total > 0 THEN rel / total * 0.3 * n ELSE 0.3 END, 0.05), 1), 5) AS ratio FROM r""")
def section_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    rows = _scored(spark, sf_dir).join(_vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "label"), "id").withColumn("rel", F.greatest("score", F.lit(0.0)))
    w = W.partitionBy("label")
    return rows.select("label", "id", F.round(num.section_ratio(F.col("rel"), F.sum("rel").over(w), F.lit(0.3), F.count("*").over(w)), 5).alias("ratio"))


@query(f"""
WITH {SELF}, got AS (SELECT id FROM sims ORDER BY score DESC, id LIMIT 5)
SELECT id, score, CASE WHEN score * 0.9 >= 0.6 THEN 'critical' WHEN score * 0.9 >= 0.4 THEN 'high' WHEN score * 0.9 >= 0.25 THEN 'medium' ELSE 'low' END AS urgency
FROM sims WHERE score >= {BLIND} AND id NOT IN (SELECT id FROM got)""")
def blind_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    near = scored.filter(F.col("score") >= BLIND).join(retrieval.top_k(scored, 5).select("id"), "id", "left_anti")
    return near.select("id", "score", num.urgency(F.col("score") * 0.9).alias("urgency"))


@query(f"""
WITH {SELF}, r AS (SELECT label, id AS vec_id, greatest(score, 0) AS score, row_number() OVER (PARTITION BY label ORDER BY greatest(score, 0) DESC, id) AS rank, count(*) OVER (PARTITION BY label) AS n FROM sims)
SELECT label, vec_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= greatest(1, ceil(n * 0.1))""")
def relevance_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return retrieval.prune_by_relevance(v, _first(v), 0.1)


@query()
def mmr_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.mmr(_vectors(spark, sf_dir).withColumn("importance", F.lit(1.0)), 10)


@query(f"""
WITH {SELF}, t AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sims ORDER BY score DESC, id LIMIT 20)
SELECT id, score, CAST(rank AS INT) AS rank, CAST(row_number() OVER (ORDER BY CASE WHEN rank <= 10 THEN 0 ELSE 1 END, CASE WHEN rank <= 10 THEN -id ELSE rank END, rank) AS INT) AS new_rank FROM t""")
def rerank_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = retrieval.top_k(_scored(spark, sf_dir), 20)
    external = _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("vec_id").cast("double").alias("score"))
    return retrieval.rerank(ranked, external, 10)


@query("SELECT vec_id, true AS usable, label FROM embeddings")
def vector_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", num.finite_vector(F.col("embedding"), 64).alias("usable"), "label")


@query("SELECT label, CAST(k AS INT) AS k, round(avg(v), 6) AS mean FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS k, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings) GROUP BY label, k")
def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = _vectors(spark, sf_dir).select("label", F.posexplode("embedding").alias("k", "v"))
    return dims.groupBy("label", "k").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@query(f"""
WITH {EDGES}, x AS (SELECT label, 'e|' || src || '|' || dst || '|' || printf('%.4f', weight) AS x FROM e UNION ALL SELECT label, 'n|' || vec_id FROM embeddings),
s AS (SELECT label, CAST(sum(('0x' || substr(sha1(x), 1, 12))::HUGEINT) AS VARCHAR) AS s FROM x GROUP BY label)
SELECT label, substr(sha1(label || ':' || s), 1, 16) AS hash FROM s""")
def graph_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_hash(_edges(spark, sf_dir), _vectors(spark, sf_dir))
