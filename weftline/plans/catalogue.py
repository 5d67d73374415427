"""All queries of the engine, by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.operators import skeleton
from weftline.plans import analytics, assurance, corpus, dialogues, documents, services, vectors  # noqa: F401  they register queries
from weftline.plans.base import QUERIES, SQL, Query
from weftline.session import table


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skeletons of all documents."""
    return skeleton.flagship(table(spark, sf_dir, "documents"))
