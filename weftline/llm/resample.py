"""Importance resampling of documents towards a target text collection, over hashed n-gram features.

1. In each task DuckDB cuts the texts into words by SQL ``unnest`` and forms n-grams by a window
   over the words of a text; a registered zlib function gives each distinct n-gram's bucket.
2. The counts of each document's buckets are spilled to Parquet in the shared folder: texts are read once.
3. Spark merges the counts of all documents and of the target, turns them into gains of log likelihood,
   and weighs each document by the floored mean of its features' gains.
4. A document's score is its weight plus Gumbel noise that hashes its id, so that the highest scores are a
   draw without replacement; ranks come from a range-partitioned sort and the sizes of its partitions.

Defined results: a null or empty text, or one without words, has no features, weight 0 and a score of
noise alone; texts of any length are whole (long ones go to DuckDB in pieces that are cut between words, and a
window spans the pieces); repeated rows count each and score alike, ties go to the smaller doc_id; a null doc_id
hashes as an empty id and comes last among ties; extra columns are ignored, whatever their names; empty tables give
no rows, and an empty target still gives gains, since every bucket has one more than its count.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftline.session import reachable

from .common import dropped, staged, task_started

#: What separates words, once A-Z are lower case: ASCII but digits and letters.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters that go to DuckDB at once, and of a piece of a text, at about.
BATCH, PIECE = 8_000_000, 1_000_000
MEMORY = "1GB"

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"""
CREATE OR REPLACE TEMP TABLE words AS SELECT row, piece{{place}}, unnest(words) AS w
FROM (SELECT row, piece, regexp_extract_all({LOWER}, '{WORD}') AS words FROM pieces)"""
COUNTS = """
WITH g AS MATERIALIZED ({grams}),
v AS MATERIALIZED (SELECT feature, crc32(feature) % {buckets} AS bucket FROM (SELECT DISTINCT feature FROM g))
SELECT row, bucket::INTEGER AS bucket, count(*) AS n FROM g JOIN v USING (feature) GROUP BY row, v.bucket ORDER BY row"""


def _grams(n: int) -> str:
    """SQL for the n-grams of each text: a window over its words, in all its pieces."""
    if n == 1:
        return "SELECT row, w AS feature FROM words"
    later = ", ".join(f"lead(w, {k}) OVER o" for k in range(1, n))
    return f"SELECT row, feature FROM (SELECT row, array_to_string([w, {later}], ' ') AS feature, lead(w, {n - 1}) OVER o AS last FROM words WINDOW o AS (PARTITION BY row ORDER BY piece, place)) WHERE last IS NOT NULL"


def _pieces(text: str, between: re.Pattern) -> Iterator[str]:
    """``text`` in pieces of about ``PIECE`` characters that end between words."""
    at = 0
    while len(text) - at > PIECE and (cut := between.search(text, at + PIECE)):
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def _connection():
    """DuckDB for one task: one thread, bounded memory, no files."""
    import duckdb

    def crc32(words):
        return pa.chunked_array([pa.array([zlib.crc32(w.encode()) for w in part.to_pylist()], pa.int64()) for part in words.chunks])

    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
    con.create_function("crc32", crc32, ["VARCHAR"], "BIGINT", type="arrow")
    return con


def bucket_counts(docs: DataFrame, low: int, high: int, buckets: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, buckets, counts) of every row: how many of its n-grams of ``low`` to ``high`` words fall in each bucket."""
    if not 1 <= low <= high or buckets < 1:
        raise ValueError("n-grams take 1 word or more, and buckets are 1 or more")
    words = WORDS.format(place=", generate_subscripts(words, 1) AS place" if high > 1 else "")
    counts = COUNTS.format(grams=" UNION ALL ".join(_grams(n) for n in range(low, high + 1)), buckets=buckets)
    kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_started()
        con, between = _connection(), re.compile(SEPARATOR)
        ids, rows, parts, texts, held = [], [], [], [], 0

        def counted() -> pa.RecordBatch:
            con.register("pieces", pa.table({"row": pa.array(rows, pa.int64()), "piece": pa.array(parts, pa.int64()), "text": pa.array(texts, pa.string())}))
            con.execute(words)
            con.unregister("pieces")
            n_words = dict(con.execute("SELECT row, count(*) FROM words GROUP BY row").fetchall())
            got = con.sql(counts).to_arrow_table()
            heads = pa.array(np.searchsorted(got["row"].to_numpy(), np.arange(len(ids) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(heads, got[c].combine_chunks().cast(kind)) for c, kind in (("bucket", pa.int32()), ("n", pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([n_words.get(k, 0) for k in range(len(ids))], pa.int64()), *lists], schema=kinds)

        for batch in found:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for key, body in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for k, piece in enumerate(_pieces(body or "", between)):
                        rows.append(len(ids))
                        parts.append(k)
                        texts.append(piece)
                    ids.append(key)
                    held += len(body or "")
                    if held > BATCH or len(ids) >= 20_000:
                        yield counted()
                        ids, rows, parts, texts, held = [], [], [], [], 0
        if ids:
            yield counted()
        con.close()

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(read, "doc_id long, n_words long, buckets array<int>, counts array<long>")


def merged(counted: DataFrame, name: str) -> DataFrame:
    """(bucket, name): the counts of all rows in each bucket that has any."""
    pairs = counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("e")).select(F.col("e.buckets").alias("bucket"), F.col("e.counts").alias("n"))
    return pairs.groupBy("bucket").agg(F.sum("n").alias(name))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """One row with ``gains``: for each bucket floor(1000 * log of its smoothed share in ``target`` over that in ``raw``); ``buckets`` numbers."""
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(merged(raw, "s"), "bucket", "left").join(merged(target, "t"), "bucket", "left").na.fill(0, ["s", "t"])
    totals = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    double = lambda c, plus: (F.col(c) + plus).cast("double")
    gain = F.floor(1000 * F.log(double("t", 1) * double("all_s", buckets) / (double("s", 1) * double("all_t", buckets))))
    rows = both.crossJoin(F.broadcast(totals)).select("bucket", gain.alias("gain"))
    ordered = F.array_sort(F.collect_list(F.struct("bucket", "gain")))
    return rows.agg(F.transform(ordered, lambda e: e["gain"]).alias("gains"))


def noise(doc_id: str, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 8 digits of sha256(seed:doc_id)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, share: int, least_words: int) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3... for floor(share * N / 100) of the N rows of ``least_words`` words, highest scores first.

    A sort over ranges of (score, doc_id) orders the rows; each counts the rows of its partition before it, and those
    of the partitions before come from their sizes, a number a partition.
    """
    fit = scored.filter(F.col("n_words") >= least_words)
    spark, least = scored.sparkSession, F.lit((1 << 33) - 1)
    # equal ids and scores are told apart by a row number, so that no value of the key fills a task
    numbered = fit.withColumn("_tie", F.monotonically_increasing_id()).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "_tie").drop("_tie")
    ordered = staged(numbered.withColumn("_at", F.monotonically_increasing_id()), "resample-order")
    parts = ordered.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row a partition
    before, total, starts = [], 0, {}
    for p in parts:
        starts[p.part] = total
        total += p.n
    before = spark.createDataFrame(list(starts.items()), "part long, before long")
    placed = ordered.join(F.broadcast(before), F.shiftright("_at", 33) == F.col("part"))
    rank = F.col("before") + F.col("_at").bitwiseAND(least) + 1
    drawn = share * total // 100
    done = placed.withColumn("rank", F.when(rank <= drawn, rank)).select(*scored.columns, "rank")
    rest = scored.filter(~F.coalesce(F.col("n_words") >= least_words, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return done.unionByName(rest)


def importance_resampled(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 2, buckets: int = 10_000, share: int = 10, least_words: int = 20, seed: int = 2024, text: str = "text", doc_id: str = "doc_id", target_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``; ``rank`` is null where it isn't drawn."""
    reachable(docs.sparkSession)
    raw = staged(bucket_counts(docs, low, high, buckets, text, doc_id), "resample-counts")
    wanted = staged(bucket_counts(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_text).alias("text")), low, high, buckets), "resample-target")
    table = staged(gains(raw, wanted, buckets), "resample-gains")
    gained = F.aggregate(F.zip_with("buckets", "counts", lambda b, n: F.get("gains", b) * n), F.lit(0).cast("long"), lambda a, x: a + x)
    sums = raw.crossJoin(F.broadcast(table)).select("doc_id", "n_words", F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n).alias("n_features"), gained.alias("_sum"))
    weight = F.when(F.col("n_features") > 0, F.expr("(_sum - pmod(_sum, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    scored = staged(sums.withColumn("weight", weight).drop("_sum").withColumn("score", F.col("weight") + noise("doc_id", seed)), "resample-scores")
    dropped(raw, wanted, table)
    return ranked(scored, share, least_words)


def drawn(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns; of rows with one doc_id, each drawn id keeps one."""
    ids = importance_resampled(docs, target, **parameters).filter("rank is not null AND doc_id is not null").select("doc_id").distinct()
    key = parameters.get("doc_id", "doc_id")
    chosen = ids.withColumnRenamed("doc_id", "_drawn")
    return docs.join(chosen, docs[key] == chosen["_drawn"], "left_semi").dropDuplicates([key])
