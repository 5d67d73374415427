"""The queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.session import table

from . import conversations, extract, fingerprint, jaccard, line_dedup, media, minhash, packing, pii, quality, resample, sentencepiece_fst, warc
from .common import staged

#: Sites on which a line must stand to count as boilerplate; ``documents`` has 20 sources.
MIN_SITES = 10

#: The tokenizer file of the packer; ``public_tokenizers`` is where it is installed.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.pieces(docs, tokenizer_path(TOKENIZER)), docs.count())


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "captured_at")


def op9_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars", "path")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.remove_boilerplate(docs, min_sites=MIN_SITES).select("doc_id", "text", "n_lines", "n_removed")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = staged(media.write_shards(docs, media.media_folder(spark)), "media-index")
    found = media.with_features(media.with_header(media.in_shares(index, "shard", "offset", "length")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "width", "height", "bits")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.jaccard_classes(docs, words=3, similarity="0.9").select("doc_id", "n_shingles", "component_id")


#: The model file of the SentencePiece transducer.
PIECES = "piece_bpe_32k.model"


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(PIECES)
    both = sentencepiece_fst.decoded(sentencepiece_fst.encoded(docs, path), path)
    return both.select("doc_id", "n_ids", "ids", F.sha2("text", 256).alias("decoded_sha256"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_neighbour(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: A row is held out of training when crc32 of its doc_id modulo this many folds is ``HELD_OUT``.
FOLDS, HELD_OUT = 4, 2
#: Score from which a document counts as good.
GOOD = 0.7


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    stats = staged(quality.document_statistics(docs), "quality-stats")
    model = quality.QualityModel.fit(quality.labelled_rows(stats, labels.filter(~held_out())))
    scored = quality.scores(stats, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


#: The key of the registered query, fixed so that its rows can be compared; a job that publishes texts passes a secret one.
PII_KEY = "a key for comparable rows"


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY).select("doc_id", "text", "n_pseudonyms")


#: Words of a feature at least and at most, hash buckets, percent to draw, words that a drawn document needs, seed of the noise.
DRAW = {"low": 1, "high": 1, "buckets": 10_000, "share": 10, "least_words": 20, "seed": 2024}


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = resample.importance_resampled(docs, table(spark, sf_dir, "benchmark").select("text"), **DRAW)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, words=5, similarity="0.85").select("doc_id", "n_shingles", "component_id", "kept")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damage_report(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def _jaccard_sql(words: int, percent: int, columns: str) -> str:
    """Components of documents whose sets of runs of ``words`` words are ``percent`` percent alike, by all pairs that share a run."""
    run = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(words))
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: {run})) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * i >= {percent} * (na + nb - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM g UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, {columns} FROM g JOIN c ON doc_id = node
"""


JACCARD_SQL = _jaccard_sql(3, 90, "component_id")
MINHASH_SQL = _jaccard_sql(5, 85, "component_id, doc_id = component_id AS kept")

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS digest FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured_at FROM f
"""

LINE_DEDUP_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS source, text FROM documents),
t AS (SELECT text, min(source) AS home FROM d WHERE text IS NOT NULL GROUP BY text),
need AS (SELECT home, greatest(1, ceil(count(*) * CAST({line_dedup.MIN_SHARE} AS DOUBLE))) AS need FROM t GROUP BY home),
k AS (SELECT DISTINCT text, home, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS key FROM t),
s AS (SELECT key, k.home FROM k JOIN need ON k.home = need.home WHERE key <> '' GROUP BY key, k.home, need HAVING count(*) >= need),
bad AS (SELECT key FROM s GROUP BY key HAVING count(*) >= {MIN_SITES}),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL),
m AS (SELECT l.*, bad.key IS NOT NULL AS cut FROM l LEFT JOIN bad ON trim(l.line, ' ' || chr(9) || chr(13)) = bad.key),
g AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (cut) AS n_cut, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT cut), '') AS kept FROM m GROUP BY rid)
SELECT d.doc_id, CASE WHEN g.n_cut = 0 THEN d.text ELSE g.kept END AS text, CAST(g.n_lines AS INT) AS n_lines, CAST(g.n_cut AS INT) AS n_removed
FROM d LEFT JOIN g ON d.rid = g.rid
"""

#: crc32 of the values ``x`` of a table, in SQL: {name}(x, crc).
CRC_SQL = """
poly AS (SELECT list_transform(range(256), lambda i: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
{name} AS (SELECT x, xor(list_reduce(list_transform(range(strlen(x)), lambda i: ('0x' || substr(hex(x), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS crc FROM ({values}), poly)"""

RESAMPLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{resample.WORD}') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{resample.WORD}') AS w FROM benchmark),
dw AS (SELECT rid, x, count(*) AS n FROM (SELECT rid, unnest(w) AS x FROM d) GROUP BY rid, x),
bw AS (SELECT unnest(w) AS x FROM b),
{CRC_SQL.format(name="k", values="SELECT x FROM dw UNION SELECT x FROM bw")},
s AS (SELECT crc % 10000 AS bucket, sum(n) AS s FROM dw JOIN k USING (x) GROUP BY bucket), t AS (SELECT crc % 10000 AS bucket, count(*) AS t FROM bw JOIN k USING (x) GROUP BY bucket),
tot AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS al, (SELECT coalesce(sum(t), 0) FROM t) AS tl),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (al + 10000)::DOUBLE / ((s + 1)::DOUBLE * (tl + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), tot),
m AS (SELECT rid, sum(n)::BIGINT AS n, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM dw JOIN k USING (x) JOIN g ON crc % 10000 = bucket GROUP BY rid),
h AS (SELECT rid, doc_id, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (rid)),
c AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h),
r AS (SELECT *, CASE WHEN n >= 20 THEN row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place, count(*) FILTER (n >= 20) OVER () AS fit FROM c)
SELECT doc_id, n AS n_features, weight, score, CASE WHEN place <= 10 * fit // 100 THEN place END AS rank, n AS n_words FROM r
"""

#: Least costs to go are lists over the states 1 to 4 (nothing yet, after system, user, assistant); ``b`` is without insertions first.
REPAIR_SQL = rf"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS x FROM conversations),
{CRC_SQL.format(name="k", values="SELECT DISTINCT x FROM o")},
f AS (SELECT o.*, crc % 20 AS kind FROM o JOIN k USING (x) WHERE crc % 20 <> 0),
g AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM g),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, substr(role, 1, 1) AS c FROM p),
r AS (SELECT conv_id, turn, role, text, i, c, body = '' AS blank, body <> '' AND again AS duplicate, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS truncated, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM d),
t AS (SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
             count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY conv_id),
togo AS (SELECT conv_id, n + 1 AS i, [0, 6, 3, 0] AS v, [0, 999, 999, 0] AS b FROM t
  UNION ALL SELECT conv_id, i, [least(b[1], b[3] + 3, b[4] + 6), least(b[2], b[3] + 3, b[4] + 6), least(b[3], b[4] + 3), least(b[4], b[3] + 3)] AS v, b FROM (
    SELECT r.conv_id, r.i, CASE WHEN blank OR duplicate THEN list_transform(v, lambda x: x + 4) ELSE
      [least(v[1] + 4, v[3] + 3 + e, CASE c WHEN 's' THEN v[2] + e WHEN 'u' THEN v[3] + e ELSE 999 END), least(v[2] + 4, v[3] + 3 + e, CASE c WHEN 'u' THEN v[3] + e ELSE 999 END),
       least(v[3] + 4, v[4] + 3 + e, CASE c WHEN 'a' THEN v[4] + e ELSE 999 END), least(v[4] + 4, v[3] + 3 + e, CASE c WHEN 'u' THEN v[3] + e ELSE 999 END)] END AS b
    FROM togo JOIN (SELECT *, CASE WHEN truncated THEN 3 ELSE 0 END AS e FROM r) r ON togo.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = togo.i - 1)),
walk AS (SELECT conv_id, 1::BIGINT AS i, 1 AS q, '' AS audit, []::VARCHAR[] AS lines, false AS done FROM t
  UNION ALL SELECT conv_id, CASE WHEN edit IN ('D', 'K', 'R') THEN i + 1 ELSE i END, CASE edit WHEN 'D' THEN q WHEN 'I' THEN nq WHEN 'R' THEN nq WHEN 'K' THEN CASE c WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END ELSE q END, audit || edit,
    CASE edit WHEN 'I' THEN list_append(lines, new || ':') WHEN 'K' THEN list_append(lines, role || ':' || text) WHEN 'R' THEN list_append(lines, new || ':' || text) ELSE lines END, edit = ''
  FROM (SELECT *, CASE WHEN role IS NOT NULL AND v[q] = later[q] + 4 THEN 'D' WHEN v[q] = v[nq] + 3 THEN 'I' WHEN role IS NULL THEN '' WHEN NOT gone AND (c = 's' AND q = 1 AND v[q] = later[2] + e OR c = 'u' AND q <> 3 AND v[q] = later[3] + e OR c = 'a' AND q = 3 AND v[q] = later[4] + e) THEN 'K' ELSE 'R' END AS edit
    FROM (SELECT w.*, togo.v, nx.v AS later, r.role, r.text, r.c, r.blank OR r.duplicate AS gone, CASE WHEN r.truncated THEN 3 ELSE 0 END AS e, CASE q WHEN 3 THEN 4 ELSE 3 END AS nq, CASE q WHEN 3 THEN 'assistant' ELSE 'user' END AS new
      FROM walk w JOIN togo ON togo.conv_id IS NOT DISTINCT FROM w.conv_id AND togo.i = w.i LEFT JOIN togo nx ON nx.conv_id IS NOT DISTINCT FROM w.conv_id AND nx.i = w.i + 1
      LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i WHERE NOT w.done))),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT every.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(togo.v[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM every LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM every.conv_id LEFT JOIN togo ON togo.conv_id IS NOT DISTINCT FROM every.conv_id AND togo.i = 1 LEFT JOIN walk ON walk.conv_id IS NOT DISTINCT FROM every.conv_id AND walk.done
"""
