"""Advice on compression: profiles, fidelity, ratios for context windows, estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.functions import text as tx

#: Named bundles of parameters (ratio, fidelity, chunk size).
PROFILES = {"minimal": (0.05, "ABSTRACT", 256), "summary": (0.15, "OUTLINE", 512), "balanced": (0.20, "STRUCTURE", 512), "detailed": (0.50, "DETAILED", 1024), "full": (0.80, "RAW", 2048)}
#: Tokens a node takes at each fidelity, and the fidelity of each use.
NODE_TOKENS = {"ABSTRACT": 10, "OUTLINE": 30, "STRUCTURE": 50, "DETAILED": 100, "RAW": 200}
USES = {
    "quick_summary": "ABSTRACT", "topic_overview": "OUTLINE", "entity_extraction": "STRUCTURE", "question_answering": "DETAILED",
    "detailed_analysis": "DETAILED", "exact_quotes": "RAW", "code_review": "RAW", "fact_verification": "RAW",
}


def _of(key: Column, values: dict, default: object) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(default))


def profiles(spark: SparkSession) -> DataFrame:
    """The profiles as a dimension, from least to most kept."""
    return spark.createDataFrame([(k, n, *v) for k, (n, v) in enumerate(PROFILES.items())], "place int, profile string, ratio double, fidelity string, chunk_size int")


def window_ratio(window: Column, trigger: Column) -> Column:
    """Keep ratio for a context window: log-linear through 0.10 at 50 000 and 0.50 at 1 000 000 tokens, less for early triggers."""
    import math

    slope = 0.40 / (math.log(1_000_000) - math.log(50_000))
    raw = F.log(F.greatest(window, F.lit(1)).cast("double")) * slope + (0.10 - slope * math.log(50_000))
    raw = F.when(trigger < 0.80, raw * (trigger / 0.80)).otherwise(raw)
    return F.round(F.greatest(F.lit(0.01), F.least(F.lit(0.90), raw)), 4)


def fidelity(use: Column, nodes: Column, budget: Column) -> Column:
    """A use's fidelity, or the highest below RAW that the budget holds; the use's own where none fits or there is no budget."""
    own = _of(use, USES, "STRUCTURE")
    out = own
    for level in ("ABSTRACT", "OUTLINE", "STRUCTURE", "DETAILED"):
        out = F.when(nodes * NODE_TOKENS[level] <= budget, level).otherwise(out)
    fits = budget.isNull() | (budget == 0) | (_of(own, NODE_TOKENS, 50) * nodes <= budget)
    return F.when(fits, own).otherwise(out)


def auto_profile(scored: DataFrame, least: float, id_col: str = "doc_id") -> DataFrame:
    """(id, profile) from rows (id, place, profile, quality): the first profile of enough quality, else the last."""
    good = F.col("quality") >= least
    return scored.groupBy(id_col).agg(F.coalesce(F.min_by("profile", F.when(good, F.col("place"))), F.max_by("profile", "place")).alias("profile"))


def all_profiles(docs: DataFrame, quality, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with each of the five profiles and ``quality(ratio)`` of it."""
    return docs.crossJoin(F.broadcast(profiles(docs.sparkSession))).withColumn("quality", quality(F.col("ratio"))).select(id_col, "place", "profile", "quality")


def should_compress(name: Column, size: Column, small: int = 500, large: int = 1 << 20) -> Column:
    """SKIP for binaries, DIRECT_READ for small texts, CONVERT for documents to convert, else COMPRESS."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("png", "jpg", "gif", "zip", "gz", "exe", "so", "bin"), "SKIP").when(ext.isin("pdf", "docx", "pptx", "xlsx"), "CONVERT").when(size < small, "DIRECT_READ").otherwise("COMPRESS")


def shortened(description: Column, most: int = 40) -> Column:
    """A description of over ``most`` words as its first sentence, if that is short enough, else cut."""
    first = F.get(tx.sentences(description), F.lit(0))
    cut = F.concat(F.array_join(F.slice(tx.words(description), F.lit(1), F.lit(most)), " "), F.lit("…"))
    return F.when(tx.word_count(description) <= most, description).when(tx.word_count(first) <= most, first).otherwise(cut)


def handoff(skeletons: DataFrame, top: DataFrame, id_col: str = "file_id") -> DataFrame:
    """Bundles: a document's skeleton, its best nodes (id, node, score) in order, and a hash over both."""
    nodes = top.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "node"))), lambda x: x["node"].cast("string")).alias("nodes"))
    rows = skeletons.join(nodes, id_col, "left")
    return rows.withColumn("bundle_hash", F.sha2(F.concat_ws("|", F.col(id_col).cast("string"), "skeleton_text", F.array_join(F.coalesce("nodes", F.array().cast("array<string>")), ",")), 256))


def context_block(facts: DataFrame, accesses: DataFrame, ratios: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a document: active facts, accesses, last ratio."""
    f = facts.groupBy(key).agg(F.count("*").alias("active_facts"))
    a = accesses.select(key, "access_count", "last_accessed")
    r = ratios.groupBy(key).agg(F.max_by("ratio", "ts").alias("last_ratio"))
    return a.join(f, key, "left").join(r, key, "left").withColumn("active_facts", F.coalesce("active_facts", F.lit(0)))


def estimated_compression(tokens: Column, redundancy: Column, skeleton_ratio: Column) -> dict[str, Column]:
    """The ratio that a text may reach, by its size, and the tokens left and saved at it; at least 30 tokens or a twentieth stay."""
    base = F.when(tokens < 200, 1.0).when(tokens < 8_000, 1.2 + redundancy * 0.8).when(tokens < 32_000, 2.0 + redundancy).when(tokens < 100_000, 4.0 + redundancy * 2).otherwise(6.0 + redundancy * 4)
    ratio = base * F.greatest(F.lit(1.0), F.least(F.lit(2.0), 1 + (0.2 - skeleton_ratio) * 5))
    least = F.greatest(F.lit(30), F.floor(tokens * 0.05))

    def left(r: Column) -> Column:
        return F.greatest(F.floor(tokens / r), least).cast("long")

    return {
        "ratio": F.round(ratio, 6), "left": left(ratio), "saved_percent": F.round((1 - left(ratio) / F.greatest(tokens, F.lit(1))) * 100, 4),
        "best_left": left(ratio * 1.3), "worst_left": left(ratio * 0.7),
    }


def estimate_grade(actual: Column, estimated: Column) -> Column:
    """Excellent within 15 %, good within 40 % of the actual value, else fair; so are values that are no positive numbers."""
    error = F.abs(actual - estimated) / actual
    odd = actual.isNull() | estimated.isNull() | F.isnan(actual) | F.isnan(estimated) | (F.abs(actual) == float("inf")) | (F.abs(estimated) == float("inf")) | (actual <= 0)
    return F.when(odd, "fair").when(error <= 0.15 + 1e-9, "excellent").when(error <= 0.40 + 1e-9, "good").otherwise("fair")


def advice_confidence(changed: Column, needed_tokens: Column, budget: Column, clear: Column) -> Column:
    """Less for a level that isn't the usual one and for a tight budget, more for clear uses; between a half and 1."""
    value = F.lit(1.0) - F.when(changed, 0.2).otherwise(0.0) - F.when(F.coalesce((budget > 0) & (needed_tokens > budget * 0.9), F.lit(False)), 0.1).otherwise(0.0) + F.when(clear, 0.1).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.5), F.least(F.lit(1.0), value)), 6)


def structure_score(text: Column) -> Column:
    """Headings count 0.3, three paragraphs 0.2, lists 0.2, five sentences of even length 0.3; at most 1."""
    heads = text.rlike(r"(?m)^#{1,6}\s+") | text.rlike(r"(?m)^[A-Z][A-Za-z\s]+:$") | text.rlike(r"(?m)^\d+\.\s+[A-Z]")
    lists = text.rlike(r"(?m)^\s*[-*•]\s+")
    parts = F.split(text, r"[.!?]+")
    lengths = F.filter(F.transform(parts, lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))), lambda n: n > 0)
    total = F.aggregate(lengths, F.lit(0.0), lambda s, n: s + n)
    squares = F.aggregate(lengths, F.lit(0.0), lambda s, n: s + n * n)
    n = F.size(lengths)
    even = (F.size(parts) >= 5) & (n > 0) & (squares / n - (total / n) * (total / n) < 100)
    score = F.when(heads, 0.3).otherwise(0.0) + F.when(F.size(F.split(text, "\n\n")) >= 3, 0.2).otherwise(0.0) + F.when(lists, 0.2).otherwise(0.0) + F.when(even, 0.3).otherwise(0.0)
    return F.round(F.least(score, F.lit(1.0)), 4)
