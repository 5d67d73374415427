"""New versions of chunked documents that reuse what did not change.

A store is a folder with a folder ``version=N`` for each version, with one row a chunk: its document, position, text, hash and
embedding. A version is written as a whole in place of what a failed or repeated run left, so that replaying it changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import IntegerType, LongType

from weftline.functions import text as tx
from weftline.staging import staged

from .skeleton import embed

COLUMNS = ["file_id", "position", "text", "hash", "embedding"]
#: Documents of a new version whose ids may be broadcast to the old one (16 bytes each); of more, the old version is exchanged to find theirs.
SMALL_FILES = 5_000_000


def matched(old: DataFrame, new: DataFrame) -> DataFrame:
    """New chunks and old ones that are gone, with ``status``: kept (same place), moved, new or gone, and the old ``embedding``, null for new ones.

    Chunks are equal if their hash is; the nth of equal ones of a document meets the nth of the old ones. Both versions are dealt by
    document together, once: a join by (document, hash, nth) would exchange each of them again.
    """
    rest = [c for c in new.columns if c not in ("file_id", "hash")]
    now = new.select("file_id", "hash", F.lit(False).alias("old"), F.col("position").alias("place"), F.struct(*rest).alias("n"))
    before = old.select("file_id", "hash", F.lit(True).alias("old"), F.col("position").alias("place"), "embedding")
    rows = now.unionByName(before, allowMissingColumns=True).repartition("file_id")
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("file_id", "hash", "old").orderBy("place")))
    # nulls equal nothing
    alone = F.when(F.col("file_id").isNull() | F.col("hash").isNull(), F.col("old")).alias("alone")
    held = rows.groupBy("file_id", "hash", "nth", alone).agg(F.first("n", True).alias("n"), F.max(F.when(F.col("old"), F.col("place"))).alias("old_position"), F.first("embedding", True).alias("embedding"))
    both = held.select("file_id", "hash", *[F.col(f"n.{c}").alias(c) for c in rest], "old_position", "embedding")
    status = F.when(F.col("position").isNull(), "gone").when(F.col("old_position").isNull(), "new").when(F.col("position") == F.col("old_position"), "kept").otherwise("moved")
    return both.withColumn("status", status)


def chunked(docs: DataFrame, parts: Column, id_col: str = "doc_id") -> DataFrame:
    """(file_id, position, text, hash) of the array ``parts`` of each row."""
    rows = docs.select(F.col(id_col).alias("file_id"), F.posexplode(parts).alias("position", "text"))
    return rows.withColumn("hash", tx.sha_key(F.col("text"), 32))


def _path(store: str, version: int) -> str:
    return f"{store}/version={version}"


def read_version(spark: SparkSession, store: str, version: int) -> DataFrame:
    return spark.read.parquet(_path(store, version))


def ingest(chunks: DataFrame, store: str, version: int = 0, embedded: Callable[[DataFrame], DataFrame] = embed) -> None:
    """The first version: every chunk is embedded."""
    embedded(chunks).select(*COLUMNS).write.mode("overwrite").parquet(_path(store, version))


def reingest(chunks: DataFrame, store: str, version: int, embedded: Callable[[DataFrame], DataFrame] = embed) -> DataFrame:
    """Writes ``version`` from the one before and ``chunks``, the documents as they are now; only new chunks are embedded.

    Documents that ``chunks`` doesn't hold stay as they were. Returns (file_id, kept, moved, new, gone) of the documents that it holds.
    """
    spark = chunks.sparkSession
    old = read_version(spark, store, version - 1)
    chunks = staged(chunks, "reingest-chunks")
    files = chunks.select("file_id").distinct()
    files = F.broadcast(files) if isinstance(files.schema["file_id"].dataType, (IntegerType, LongType)) and files.count() <= SMALL_FILES else files
    found = staged(matched(old.join(files, "file_id", "left_semi"), chunks), "reingest-matched")
    fresh = embedded(found.filter("status = 'new'").drop("embedding"))
    rest = old.join(files, "file_id", "left_anti")
    now = found.filter("status IN ('kept', 'moved')").select(*COLUMNS).unionByName(fresh.select(*COLUMNS)).unionByName(rest.select(*COLUMNS))
    now.write.mode("overwrite").parquet(_path(store, version))
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return found.groupBy("file_id").agg(*[count(s) for s in ("kept", "moved", "new", "gone")])


def stream_into(store: str, parts: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: batch k makes version k + 1 of the store, of the chunks that ``parts`` gives; a replayed batch writes the same version again."""

    def put(batch: DataFrame, batch_id: int) -> None:
        reingest(parts(batch), store, batch_id + 1)

    return put
