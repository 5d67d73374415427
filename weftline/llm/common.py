"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.staging import dropped, scratch, shared_dir, staged  # noqa: F401  the operators take them from here

_STAGE = [-1]
#: Functions that empty what a Python worker keeps between tasks of a stage.
CACHES: list = []


def task_started() -> None:
    """To be called in a worker when it begins a partition: caches live no longer than a stage, and freed memory goes back."""
    from pyspark import TaskContext

    task = TaskContext.get()
    if task is None or task.stageId() == _STAGE[0]:
        return
    _STAGE[0] = task.stageId()
    for empty in CACHES:
        empty()
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    known = {c.lower() for c in columns}
    while name.lower() in known:
        name = "_" + name
    return name


#: Rows of a looked-up table that may be broadcast, at most about 100 bytes each.
LOOKUP_ROWS = 200_000
#: A key is hot if it has more than this share of the rows; there can be no more hot keys than its inverse.
HOT_SHARE = 1 / 1000


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], copies: str, bound: int | None = None) -> DataFrame:
    """``rows`` left-joined with ``table`` (staged, a row for each key) on the columns ``on``.

    ``copies`` counts the rows that have a key and is dropped. Up to ``bound`` keys (``LOOKUP_ROWS``) are broadcast.
    Beyond that, the at most ``1 / HOT_SHARE`` keys that hold more than ``HOT_SHARE`` of the rows
    are, and the others joined by an exchange in which hot rows are dealt by their number: no key fills a
    task, however many rows have it.
    """
    n, total = table.agg(F.count("*"), F.sum(copies)).first()
    if n <= (LOOKUP_ROWS if bound is None else bound):
        return rows.join(F.broadcast(table.drop(copies)), on, "left")
    values = [c for c in table.columns if c not in {*on, copies}]
    hit, salt = unused([*rows.columns, *values], "_hit"), unused([*rows.columns, *values], "_salt")
    hot = table.filter(F.col(copies) > F.lit((total or 0) * HOT_SHARE))
    first = F.broadcast(hot.select(*on, F.struct(*values).alias(hit)))
    marked = rows.join(first, on, "left")
    marked = marked.withColumn(salt, F.when(F.col(hit).isNull(), F.lit(0)).otherwise(F.xxhash64(F.monotonically_increasing_id())))
    second = unused([*rows.columns, *values, hit, salt], "_second")
    cold = table.select(*on, F.lit(0).cast("long").alias(salt), F.struct(*values).alias(second))
    out = marked.join(cold, [*on, salt], "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(hit)[v], F.col(second)[v]).alias(v) for v in values])


def spread(spark: SparkSession) -> int:
    """Shuffle partitions that a keyed exchange should use."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def null_as_empty(column: str):
    return F.coalesce(F.col(column), F.lit(""))
