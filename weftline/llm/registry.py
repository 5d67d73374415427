"""Names of the training-data queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import queries as q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in vars(q).items() if name.startswith("op") and name[2:].split("_")[0].isdigit()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {"op3_jaccard": q.JACCARD_SQL, "op8_warc": q.WARC_SQL, "op10_line_dedup": q.LINE_DEDUP_SQL, "op11_resample": q.RESAMPLE_SQL, "op12_minhash": q.MINHASH_SQL, "op13_repair": q.REPAIR_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
