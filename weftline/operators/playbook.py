"""Playbooks: bullets with confidence, their selection, merging and curation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from weftline.functions import numbers as num

from .grouped import by_group


def best_bullets(bullets: DataFrame, query: list[float], k: int, least: float = 0.0, group: str = "context_id") -> DataFrame:
    """The k bullets of each context most like the query, weighed by .5 + .5 confidence."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = bullets.filter(F.col("confidence") >= least).withColumn("score", num.cosine(F.col("embedding"), q) * (0.5 + 0.5 * F.col("confidence")))
    w = W.partitionBy(group).orderBy(F.desc("score"), "bullet_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def trajectory(best: DataFrame, steps: int = 5, group: str = "context_id") -> DataFrame:
    """(context, step, confidence): each step has the same bullets and their mean confidence."""
    mean = best.groupBy(group).agg(F.avg("confidence").alias("confidence"))
    return mean.select(group, F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"), "confidence")


def reflection(found: DataFrame, success: bool, group: str = "context_id") -> DataFrame:
    """(context, steps): how many steps speak for success (above .7) or failure (below .4)."""
    hit = F.col("confidence") > 0.7 if success else F.col("confidence") < 0.4
    return found.groupBy(group).agg(F.count(F.when(hit, 1)).alias("steps"))


def deduplicated(bullets: DataFrame, threshold: float = 0.85, group: str = "context_id") -> DataFrame:
    """(context, bullet_id) kept: of two bullets more alike than ``threshold`` the less confident goes, of equals the later."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values(["confidence", "bullet_id"], ascending=[False, True])
        v = np.array(pdf.embedding.tolist(), dtype=float).reshape(len(pdf), -1)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        kept: list[int] = []
        for k in range(len(v)):
            if not kept or (v[kept] @ v[k]).max() <= threshold:
                kept.append(k)
        return pdf.iloc[kept][["grp", "bullet_id"]]

    kind = bullets.schema[group].dataType.simpleString()
    rows = bullets.select(F.col(group).alias("grp"), "bullet_id", "confidence", "embedding")
    return by_group(rows, ["grp"], keep, f"grp {kind}, bullet_id long").withColumnRenamed("grp", group)


def curated(bullets: DataFrame, most: int, group: str = "context_id") -> DataFrame:
    """Bullets without near copies, the ``most`` most confident of each context."""
    kept = bullets.join(deduplicated(bullets, group=group), [group, "bullet_id"], "left_semi")
    w = W.partitionBy(group).orderBy(F.desc("confidence"), "bullet_id")
    return kept.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def integrated(bullets: DataFrame, insights: DataFrame, threshold: float = 0.85, group: str = "context_id") -> DataFrame:
    """(context, insight_id, bullet_id): the nearest bullet that an insight replaces, or null where it is new.

    ``insights`` of one cycle are few; each context's meet only its own bullets.
    """
    near = insights.select(group, "insight_id", F.col("embedding").alias("_e")).join(bullets.select(group, "bullet_id", "embedding"), group)
    near = near.withColumn("like", num.cosine(F.col("_e"), F.col("embedding"))).groupBy(group, "insight_id").agg(F.max(F.struct("like", "bullet_id")).alias("m"))
    rows = insights.select(group, "insight_id").join(near, [group, "insight_id"], "left")
    return rows.select(group, "insight_id", F.when(F.col("m.like") > threshold, F.col("m.bullet_id")).alias("bullet_id"))


def stats(bullets: DataFrame, group: str = "context_id") -> DataFrame:
    used = F.col("success_count") + F.col("failure_count")
    return bullets.groupBy(group).agg(F.count("*").alias("bullets"), F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.round(F.sum("success_count") / F.greatest(F.sum(used), F.lit(1)), 4).alias("success_rate"), F.sum(used).alias("uses"))
