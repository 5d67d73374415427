"""Tenancy: ids that carry a scope, and filters by scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FIELDS = {"w": "workspace_id", "u": "user_id", "a": "agent_id", "s": "session_id"}


def _coded(value: Column) -> Column:
    return F.replace(F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")), F.lit("_"), F.lit("%5F"))


def composed(file_id: Column, scope: dict[str, Column]) -> Column:
    """scope__w=..__u=..__f=.. with only the fields that aren't null; the plain id without any."""
    parts = [F.when(scope[c].isNotNull(), F.concat(F.lit(f"{k}="), _coded(scope[c]))) for k, c in FIELDS.items() if c in scope]
    joined = F.concat_ws("__", *parts)
    return F.when(joined == "", file_id).otherwise(F.concat(F.lit("scope__"), joined, F.lit("__f="), _coded(file_id)))


def parsed(scoped: Column) -> dict[str, Column]:
    """The file id and the scope fields of a composed id."""
    inside = scoped.startswith("scope__")
    out = {"file_id": F.when(inside, F.url_decode(F.regexp_extract(scoped, "__f=(.*)$", 1))).otherwise(scoped)}
    for k, c in FIELDS.items():
        found = F.regexp_extract(scoped, f"__{k}=([^_]*)", 1)
        out[c] = F.when(inside & (found != ""), F.url_decode(found))
    return out


def in_scope(rows: DataFrame, scope: dict[str, str | None]) -> DataFrame:
    """Rows whose scope columns equal what is asked; nothing asked means rows without any scope."""
    asked = {k: v for k, v in scope.items() if v is not None}
    keep = F.lit(True)
    for c in FIELDS.values():
        if asked and c in asked:
            keep = keep & F.col(c).eqNullSafe(F.lit(asked[c]))
        elif not asked:
            keep = keep & F.col(c).isNull()
    return rows.filter(keep)


def pairs_in_scope(pairs: DataFrame, rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Pairs (a, b) both ends of which are among ``rows``."""
    ids = rows.select(F.col(id_col).alias("_id")).distinct()
    return pairs.join(ids, pairs["a"] == ids["_id"], "left_semi").join(ids, F.col("b") == F.col("_id"), "left_semi")
