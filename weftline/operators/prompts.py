"""Prompt versions, labels and deployments as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STABLE = ("system", "tools", "policies")
VOLATILE_FIELDS = ("context", "user")


def prefix_hash(fields: tuple[str, ...] = STABLE) -> Column:
    return F.sha2(F.concat_ws("\n", *[F.coalesce(F.col(f), F.lit("")) for f in fields]), 256)


def resolved(requests: DataFrame, versions: DataFrame, labels: DataFrame) -> DataFrame:
    """(request_id, prompt, version): the version asked for, else the label's, else the latest."""
    latest = versions.groupBy("prompt").agg(F.max("version").alias("_latest"))
    rows = requests.join(labels.select("prompt", "label", F.col("version").alias("_labelled")), ["prompt", "label"], "left").join(latest, "prompt", "left")
    return rows.select("request_id", "prompt", F.coalesce("version", "_labelled", "_latest").alias("version"))


def changed_fields(versions: DataFrame, fields: tuple[str, ...] = STABLE + VOLATILE_FIELDS) -> DataFrame:
    """Each version with the names of stable and volatile fields that differ from the version before."""
    from pyspark.sql import Window as W

    w = W.partitionBy("prompt").orderBy("version")
    first = F.lag("version").over(w).isNull()

    def names(group: tuple[str, ...]) -> Column:
        marks = [F.when(~F.col(f).eqNullSafe(F.lag(f).over(w)), f) for f in group if f in fields]
        return F.when(first, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*marks)))

    return versions.select("prompt", "version", names(STABLE).alias("stable_changes"), names(VOLATILE_FIELDS).alias("volatile_changes"))


def deployed(labels: DataFrame, wanted: DataFrame, versions: DataFrame, allow: bool = False) -> DataFrame:
    """(prompt, label, version, refused): a label moves to the wanted version unless that changes the stable prefix."""
    hashed = versions.select("prompt", "version", prefix_hash().alias("h"))
    now = labels.join(hashed, ["prompt", "version"]).select("prompt", "label", F.col("version").alias("old"), F.col("h").alias("old_h"))
    rows = wanted.join(hashed, ["prompt", "version"]).join(now, ["prompt", "label"], "left")
    refused = F.lit(not allow) & F.col("old_h").isNotNull() & (F.col("old_h") != F.col("h"))
    return rows.select("prompt", "label", F.when(refused, F.col("old")).otherwise(F.col("version")).alias("version"), refused.alias("refused"))


def rendered(versions: DataFrame, sections: tuple[str, ...] = STABLE + VOLATILE_FIELDS) -> DataFrame:
    """Prompts as text, sections in stable-first order, empty ones left out."""
    parts = [F.when(F.coalesce(F.col(s), F.lit("")) != "", F.concat(F.lit(f"## {s}\n"), F.col(s))) for s in sections]
    return versions.select("prompt", "version", F.concat_ws("\n\n", *parts).alias("text"))
