"""Records of structured texts: JSON arrays, JSON lines, CSV."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from weftline.functions import text as tx
from weftline.sources.connectors import structured_kind


def _json_parts(text: str) -> list[str]:
    """The top-level elements of a JSON array as they stand in the source."""
    from json import JSONDecodeError, JSONDecoder

    decoder, out = JSONDecoder(), []
    at = text.index("[") + 1
    while True:
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        if at >= len(text) or text[at] == "]":
            return out
        try:
            _, end = decoder.raw_decode(text, at)
        except JSONDecodeError:
            return []
        out.append(text[at:end])
        at = end


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_array_records(texts: pd.Series) -> pd.Series:
    return pd.Series([_json_parts(t) if t and "[" in t else [] for t in texts])


def line_records(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")


def csv_records(text: Column) -> Column:
    """Each row with the header before it; none where a quote runs over lines."""
    rows = line_records(text)
    head = F.get(rows, F.lit(0))
    odd = F.exists(rows, lambda r: F.length(F.regexp_replace(r, '[^"]', "")) % 2 == 1)
    return F.when(odd, F.array().cast("array<string>")).otherwise(F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.concat(head, F.lit("\n"), r)))


def records(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, kind, position, record) of structured documents; a JSON object is one record."""
    t = F.col(text)
    kinds = docs.select(F.col(id_col).alias("id"), t.alias("text"), structured_kind(t).alias("kind")).filter("kind IS NOT NULL")
    parts = F.when(F.col("kind") == "json_array", json_array_records(F.col("text"))).when(F.col("kind") == "jsonl", line_records(F.col("text"))).when(F.col("kind") == "csv", csv_records(F.col("text"))).otherwise(F.array("text"))
    return kinds.select("id", "kind", F.posexplode(parts).alias("position", "record"))


def packed(found: DataFrame, budget: int = 512) -> DataFrame:
    """(id, chunk, records, text): records packed in order to at most ``budget`` tokens a chunk, never cut; the separator counts one."""
    from weftline.operators.skeleton import packed_parts

    rows = found.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "record"))), lambda x: x["record"]).alias("r"))
    return rows.select("id", F.posexplode(packed_parts(F.col("r"), budget, "\n", 1)).alias("chunk", "text")).withColumn("tokens", tx.token_count(F.col("text")))
