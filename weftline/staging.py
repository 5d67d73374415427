"""Tables and folders in the storage that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Only on a single machine (a local master, as in tests) may the session leave that setting
    unset: a temporary folder is then made and set as the checkpoint folder. A cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(_ROOTS[app])
    return _ROOTS[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder."""
    return f"{shared_dir(spark)}/weftline-{name}-{uuid.uuid4().hex}"


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def staged(df: DataFrame, name: str, arrow_rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage: later jobs reread the table, whatever executors are lost, and never
    run the work above it again. ``arrow_rows`` bounds the rows that go to Python at once while
    it is written, for rows of many kilobytes.
    """
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(ARROW_ROWS)
    if arrow_rows:
        spark.conf.set(ARROW_ROWS, arrow_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.weftline_path = path
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None) -> DataFrame:
    """``df`` staged in ``buckets`` buckets of a key (as many as the session's shuffle partitions, if not given), so that joins and groups by it don't exchange this table again."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, title = scratch(spark, name), f"weftline_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(title)
    out = spark.table(title)
    out.weftline_path, out.weftline_table = path, title
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove staged tables that no later job reads: what was made of them is itself staged or done."""
    for df in tables:
        path, title = getattr(df, "weftline_path", None), getattr(df, "weftline_table", None)
        if title:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {title}")
        if path:
            where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
