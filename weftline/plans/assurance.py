"""Queries that verify compression and read pages: contracts, composition, bundles, batches, excerpts, hand-overs written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions import text as tx
from weftline.operators import reading, verification as vf
from weftline.plans.base import query
from weftline.plans.documents import WORDS
from weftline.session import table
from weftline.sources import encoded

#: A line's first sentence; lines of fewer words are no nodes.
HEAD, LEAST_WORDS = r"^[^.!?]*[.!?]*", 5
EXCERPT_WORDS = 120


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, document, source, lines): lines with their hash, first sentence and whether they are nodes."""
    line = lambda x: F.struct(F.md5(x).alias("id"), F.regexp_extract(x, HEAD, 0).alias("head"), (tx.word_count(x) >= LEAST_WORDS).alias("node"))
    found = F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != ""), line)
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("document"), "source", found.alias("lines"))


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document compressed to the first sentences of its lines, at the level that its length asks for."""
    nodes = F.filter("lines", lambda x: x["node"])
    rows = _lines(spark, sf_dir).withColumns({
        "node_map": F.map_from_entries(F.array_distinct(F.transform(nodes, lambda x: F.struct(x["id"], x["head"])))),
        "skeleton": F.array_join(F.transform(nodes, lambda x: F.concat(F.lit("["), x["id"], F.lit("] "), x["head"])), "\n"),
        "original_tokens": tx.token_count(F.col("document")),
    })
    level = F.when(F.col("original_tokens") < 50, "RAW").when(F.col("original_tokens") < 200, "DETAILED").when(F.col("original_tokens") < 600, "STRUCTURE").otherwise("OUTLINE")
    return rows.select("doc_id", "document", "lines", F.col("source").alias("path"), level.alias("level"), "skeleton", "node_map", "original_tokens", tx.token_count(F.col("skeleton")).alias("skeleton_tokens"))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes: lines that the skeleton holds. Edges: each line to the next of the document."""
    rows = _lines(spark, sf_dir)
    nodes = rows.select("doc_id", F.explode(F.filter("lines", lambda x: x["node"])).alias("x")).select("doc_id", F.col("x.id").alias("node_id"))
    after = F.slice("lines", F.lit(2), F.size("lines"))
    pairs = F.zip_with(F.slice("lines", F.lit(1), F.size(after)), after, lambda a, b: F.struct(a["id"].alias("src"), b["id"].alias("dst")))
    return nodes, rows.select("doc_id", F.inline(pairs))


LINES = rf"""l AS (SELECT doc_id, text AS document, source AS path, list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> ''),
      lambda x: {{'id': md5(x), 'head': regexp_extract(x, '{HEAD}'), 'node': len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) >= {LEAST_WORDS}}}) AS lines FROM documents)"""
OPERATIONS = rf"""{LINES},
k AS (SELECT *, list_filter(lines, lambda x: x.node) AS nodes FROM l),
s AS (SELECT *, coalesce(array_to_string(list_transform(nodes, lambda x: '[' || x.id || '] ' || x.head), chr(10)), '') AS skeleton FROM k),
t AS (SELECT *, CAST(floor(len({WORDS.replace("text", "coalesce(document, '')", 1)}) * 1.3) AS INT) AS o, CAST(floor(len({WORDS.replace("text", "skeleton", 1)}) * 1.3) AS INT) AS n FROM s),
v AS (SELECT *, CASE WHEN o < 50 THEN 'RAW' WHEN o < 200 THEN 'DETAILED' WHEN o < 600 THEN 'STRUCTURE' ELSE 'OUTLINE' END AS level FROM t),
r AS (SELECT *, level = 'RAW' AS raw, CASE level WHEN 'RAW' THEN 1.0 WHEN 'DETAILED' THEN 2.0 WHEN 'STRUCTURE' THEN 3.0 ELSE 5.0 END::DOUBLE AS target FROM v),
c AS (SELECT *, list_filter([('non_empty_document', coalesce(length(document) > 0, false)), ('document_is_string', document IS NOT NULL), ('valid_utf8', document IS NOT NULL),
      ('document_size_limit', coalesce(strlen(document) <= 104857600, false)), ('valid_fidelity_level', true), ('no_null_bytes', coalesce(NOT contains(document, chr(0)), false)),
      CASE WHEN length(path) > 0 THEN ('safe_file_path', NOT (contains(path, '../') OR contains(path, '..' || chr(92)) OR contains(path, '/etc/') OR contains(path, 'C:' || chr(92) || 'Windows'))) END,
      ('skeleton_non_empty', length(skeleton) > 0), ('skeleton_token_limit', n <= 50000), ('valid_node_map', true), ('node_map_populated', raw OR o <= 50 OR len(nodes) > 0),
      ('compression_achieved', raw OR o::DOUBLE / greatest(n, 1) >= target * 0.5), ('tokens_reduced', raw OR n < o), CASE WHEN len(nodes) > 0 THEN ('valid_node_ids', true) END], lambda x: x IS NOT NULL) AS checks FROM r)"""
COMPOSITION = rf"""
e AS (SELECT doc_id, lines[i].id AS src, lines[i + 1].id AS dst FROM (SELECT doc_id, lines, unnest(range(1, len(lines))) AS i FROM l)),
g AS (SELECT DISTINCT doc_id, x.id AS node FROM (SELECT doc_id, unnest(nodes) AS x FROM k)),
en AS (SELECT DISTINCT doc_id, unnest([src, dst]) AS node FROM e),
mi AS (SELECT doc_id, count(*) AS missing FROM en ANTI JOIN g USING (doc_id, node) GROUP BY doc_id),
du AS (SELECT doc_id, count(*) - count(DISTINCT (src, dst)) AS again FROM e GROUP BY doc_id),
rf AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(skeleton, '\[[^\]]+\]|\(node_[^\)]+\)'), lambda x: CASE WHEN starts_with(x, '[') THEN x[2:-2] ELSE x[7:-2] END), lambda x: x <> '')) AS node FROM s),
re AS (SELECT doc_id, count(*) AS invalid FROM rf ANTI JOIN g USING (doc_id, node) GROUP BY doc_id),
co AS (SELECT doc_id, coalesce(missing, 0)::BIGINT AS missing_nodes, coalesce(again, 0)::BIGINT AS duplicate_edges, coalesce(invalid, 0)::BIGINT AS invalid_references FROM l LEFT JOIN mi USING (doc_id) LEFT JOIN du USING (doc_id) LEFT JOIN re USING (doc_id))"""


@query(f"WITH {OPERATIONS}, {COMPOSITION} SELECT * FROM co")
def composition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return vf.composition(nodes, edges, _operations(spark, sf_dir).select("doc_id", "skeleton"))


@query(f"""
WITH {OPERATIONS}, {COMPOSITION}
SELECT doc_id, level, len(checks)::INT AS checks, len(list_filter(checks, lambda x: NOT x[2])) = 0 AS verified,
       array_to_string(list_concat(list_filter([CASE WHEN missing_nodes > 0 THEN 'edge_endpoints_valid' END, CASE WHEN duplicate_edges > 0 THEN 'no_duplicate_edges' END, CASE WHEN invalid_references > 0 THEN 'skeleton_refs_valid' END], lambda x: x IS NOT NULL),
                                   list_transform(list_filter(checks, lambda x: NOT x[2]), lambda x: x[1])), ',') AS violations FROM c JOIN co USING (doc_id)""")
def operation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    operations = _operations(spark, sf_dir)
    found = vf.verified(operations, vf.composition(nodes, edges, operations.select("doc_id", "skeleton")))
    names = F.array_join(F.transform("violations", lambda v: v["contract"]), ",")
    return found.select("doc_id", "level", F.size("checks").alias("checks"), "verified", names.alias("violations"))


SEALED = """b AS (SELECT doc_id, 'compress' AS operation, sha256(document) AS input_hash, o, sha256(skeleton) AS output_hash, n, level, checks,
      array_to_string(list_transform(checks, lambda x: x[1] || CASE WHEN x[2] THEN '+' ELSE '-' END), ',') AS outcomes FROM c)"""


@query(f"""
WITH {OPERATIONS}, {SEALED}
SELECT doc_id, sha256(array_to_string(list_transform([operation, input_hash, o::VARCHAR, output_hash, n::VARCHAR, level, outcomes, NULL], lambda x: coalesce(length(x) || ':' || x, '-')), '|')) AS bundle_hash,
       len(list_filter(checks, lambda x: NOT x[2])) = 0 AS verified, len(list_filter(checks, lambda x: NOT x[2]))::INT AS violations FROM b""")
def bundle_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vf.verified_bundles(vf.bundles(vf.verified(_operations(spark, sf_dir)), "compress"))
    return found.select("doc_id", "bundle_hash", "verified", F.size("violations").alias("violations"))


@query(f"""
WITH {OPERATIONS}, f AS (SELECT doc_id, list_transform(list_filter(checks, lambda x: NOT x[2]), lambda x: x[1]) AS names FROM c),
x AS (SELECT len(names) AS n, unnest(list_concat(['*'], names)) AS contract FROM f)
SELECT contract, CASE WHEN contract = '*' THEN sum(n) ELSE count(*) END::BIGINT AS violations, count(*) AS operations, count(*) FILTER (n = 0) AS passed, round(count(*) FILTER (n = 0) / count(*)::DOUBLE, 6) AS pass_rate FROM x GROUP BY contract""")
def verification_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vf.batch(vf.verified(_operations(spark, sf_dir)))


def _markdown_sql(html: str) -> str:
    t = f"coalesce({html}, '')"
    for tag in ("script", "style", "head"):
        t = rf"regexp_replace({t}, '(?is)<{tag}\b.*?</{tag}>', ' ', 'g')"
    t = rf"regexp_replace({t}, '\s+', ' ', 'g')"
    for level in range(1, 7):
        t = rf"regexp_replace({t}, '(?i)<h{level}\b[^>]*>', chr(10) || '{'#' * level} ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '{reading.BLOCKS}', chr(10), 'g'), '<[^>]*>', '', 'g')"
    return f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: x <> '')"


def _slug_sql(name: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace(lower({name}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'docs')"


def _words_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda w: w <> '')"


@query(rf"""
WITH p AS (SELECT page_id, {_markdown_sql("html")} AS lines, {_slug_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS anchor FROM pages),
q AS (SELECT *, array_to_string(lines, chr(10)) AS text, regexp_extract_all(replace(anchor, '-', ' '), '[a-z0-9_]+') AS terms FROM p),
m AS (SELECT *, {_words_sql("text")} AS w, list_position(list_transform(lines, lambda x: regexp_matches(x, '^#{{1,6}}[ \t]+') AND {_slug_sql("regexp_replace(x, '^#{1,6}[ \\t]+', '')")} = anchor), true) AS headed,
      list_transform(lines, lambda x: len(list_intersect(terms, regexp_extract_all(lower(x), '[a-z0-9_]+')))) AS shared FROM q),
c AS (SELECT *, coalesce(list_sum(list_transform(lines[:coalesce(nullif(headed, 0), list_position(shared, list_max(shared))) - 1], lambda x: len({_words_sql("x")}))), 0) AS centre FROM m),
b AS (SELECT *, greatest(0, least(len(w), greatest(0, centre - {EXCERPT_WORDS // 2}) + {EXCERPT_WORDS}) - {EXCERPT_WORDS}) AS s FROM c)
SELECT page_id, anchor, CASE WHEN len(w) <= {EXCERPT_WORDS} THEN text ELSE CASE WHEN s > 0 THEN '[...]' || chr(10) ELSE '' END || array_to_string(w[CAST(s + 1 AS BIGINT):CAST(s + {EXCERPT_WORDS} AS BIGINT)], ' ')
       || CASE WHEN s + {EXCERPT_WORDS} < len(w) THEN chr(10) || '[...]' ELSE '' END END AS excerpt FROM b""")
def page_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of 120 words of every page around the line that its title names."""
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    rows = table(spark, sf_dir, "pages").select("page_id", reading.anchor_of(title).alias("anchor"), reading.markdown(F.col("html")).alias("text"))
    return rows.select("page_id", "anchor", reading.excerpt(F.col("text"), F.col("anchor"), EXCERPT_WORDS).alias("excerpt"))


@query(rf"""
WITH {OPERATIONS}
SELECT doc_id, o::BIGINT AS tokens, round(o::DOUBLE / greatest(n, 1), 3) AS ratio, sha256(skeleton) AS skeleton_sha256, sha256(coalesce(document, '')) AS replay_sha256, len(lines)::INT AS results,
       sha256(array_to_string(list_transform(lines, lambda x: x.id || ' ' || x.head), chr(10))) AS results_sha256 FROM c""")
def bundle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's hand-over, with all its text and lines, written as text and read back; the figures are of what was read."""
    rows = _operations(spark, sf_dir)
    ratio = F.col("original_tokens") / F.greatest("skeleton_tokens", F.lit(1))
    results = F.transform("lines", lambda x: F.struct(x["id"].alias("node_id"), F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("double").alias("importance"), x["head"].alias("summary")))
    values = {"bundle_id": F.md5(F.col("doc_id").cast("string")), "doc_id": F.col("doc_id"), "skeleton_text": F.col("skeleton"), "skeleton_tokens": F.col("original_tokens"), "compression_ratio": ratio, "replay_text": F.col("document")}
    read = rows.select("doc_id", encoded.bundle(values, results).alias("text")).select("doc_id", encoded.read_bundle(F.col("text")).alias("b"))
    listed = F.array_join(F.transform("b.search_results", lambda r: F.concat(r["node_id"], F.lit(" "), r["summary"])), "\n")
    return read.select(
        F.col("b.doc_id").cast("long").alias("doc_id"), F.col("b.skeleton_tokens").alias("tokens"), F.col("b.compression_ratio").alias("ratio"), F.sha2("b.skeleton_text", 256).alias("skeleton_sha256"),
        F.sha2("b.replay_text", 256).alias("replay_sha256"), F.size("b.search_results").alias("results"), F.sha2(listed, 256).alias("results_sha256"))
