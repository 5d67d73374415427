"""Sinks and text forms of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions import text as tx
from weftline.sources import encoded


def _cell(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType.simpleString()
    v = F.format_string("%.3f", F.col(c).cast("double")) if kind in ("double", "float") or kind.startswith("decimal") else tx.escape_cell(F.col(c).cast("string"))
    return F.coalesce(F.when(F.col(c).isNotNull(), v), F.lit(""))


def tabular_rows(df: DataFrame, fields: list[str]) -> DataFrame:
    """One line a row: escaped cells, floats to 3 places, nothing for null."""
    return df.select(F.array_join(F.array(*[_cell(df, c) for c in fields]), ",").alias("value"))


def tabular(df: DataFrame, fields: list[str], name: str = "results", order: list[str] | None = None) -> DataFrame:
    """(pos, value): a header name[n]{fields}: and the rows in order, for results of a page's length."""
    rows = df.select(*(order or fields), *[f for f in fields if f not in (order or fields)]).withColumn("_line", F.array_join(F.array(*[_cell(df, c) for c in fields]), ","))
    body = rows.agg(F.array_sort(F.collect_list(F.struct(*(order or fields), "_line"))).alias("x"), F.count("*").alias("n"))
    head = F.format_string(f"{name}[%d]{{{','.join(fields)}}}:", F.col("n"))
    return body.select(F.posexplode(F.concat(F.array(head), F.transform("x", lambda s: F.concat(F.lit("  "), s["_line"])))).alias("pos", "value"))


def parsed_tabular(lines: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of ``tabular_rows`` read back as strings, whatever marks their cells hold."""
    return lines.select(encoded.cells(F.col("value")).alias("_c")).select(*[F.get("_c", F.lit(k)).alias(f) for k, f in enumerate(fields)])


def prometheus(df: DataFrame, metric: str, labels: list[str], value: str) -> DataFrame:
    """Lines metric{label="value",...} value."""
    parts = F.array_join(F.array(*[F.format_string(f'{c}="%s"', F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in labels]), ",")
    return df.select(F.concat(F.lit(metric + "{"), parts, F.lit("} "), F.col(value).cast("string")).alias("value"))


def write_reports(df: DataFrame, path: str) -> None:
    """The same rows as CSV with a header and as JSON."""
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    df.write.mode("overwrite").json(f"{path}/json")


def write_articles(articles: DataFrame, path: str) -> None:
    """One folder a category."""
    articles.select("category", F.col("article").alias("value")).write.mode("overwrite").partitionBy("category").text(path)


def kept_originals(rows: DataFrame, threshold: float = 0.3, original: str = "text", kept: str = "compressed") -> DataFrame:
    """(key, text) of originals whose compression saved at least ``threshold``, once each."""
    saved = 1 - F.length(kept) / F.greatest(F.length(original), F.lit(1))
    return rows.filter(saved >= threshold).select(F.sha2(original, 256).alias("key"), F.col(original).alias("text")).dropDuplicates(["key"])


def redacted(rows: DataFrame, fields: str = "context", names: str = "(?i)password|secret|token|api_?key|authorization|cookie") -> DataFrame:
    """A map column with the values of sensitive keys hidden."""
    return rows.withColumn(fields, F.transform_values(fields, lambda k, v: F.when(k.rlike(names), "[REDACTED]").otherwise(v)))
