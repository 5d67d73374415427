"""Explicit memories: extraction, classification, profiles, compilation and checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weftline.functions import text as tx

#: Phrases that signal an insight worth keeping.
SIGNALS = {
    "decision": r"\b(?:decid(?:e|ed)|chose|choice|went\s+with|opt(?:ed)?\s+for)\b",
    "lesson": r"\b(?:lesson|learned|takeaway|insight|realize[ds]?|turns?\s+out)\b",
    "pattern": r"\b(?:always|never|convention|best\s+practice|pattern|recurring)\b",
    "gotcha": r"\b(?:gotcha|caveat|pitfall|watch\s+out|careful|beware|avoid)\b",
    "issue": r"\b(?:bug|error|fail(?:ed|ure)?|broken|regression|crash)\b",
    "preference": r"\b(?:prefer|like\s+to|rather|instead\s+of|don'?t\s+like)\b",
    "action": r"\b(?:going\s+forward|from\s+now\s+on|next\s+time|we\s+should|must|need\s+to)\b",
}
#: What speaks for each category of memory; of equal shares the first category counts.
CATEGORIES = {
    "gotcha": [r"\bwatch\s*out\b", r"\bgotcha\b", r"\bcaveat\b", r"\bpitfall\b", r"\btrap\b", r"\bcareful\b", r"\bsilently\b", r"\bnever\b.*\buse\b", r"\bwarning\b", r"\bbeware\b", r"\bgotchas?\b", r"\bavoid\b", r"\bdon'?t\b.*\bforget\b", r"\bsubtl[ey]\b"],
    "issue": [r"\bbug\b", r"\berror\b", r"\bfail(?:s|ed|ure|ing)?\b", r"\bcrash\b", r"\bbroken\b", r"\bregression\b", r"\btimeout\b", r"\bnull\s*pointer\b", r"\bexception\b", r"\bflaw\b", r"\bdefect\b"],
    "decision": [r"\bdecid(?:e|ed)\b", r"\bchose\b", r"\bchoice\b", r"\binstead\s*of\b", r"\bopt(?:ed)?\s*for\b", r"\bwe\s*went\s*with\b", r"\breason(?:ing)?\s*(?:for|behind)\b", r"\btrade-?off\b", r"\bselect(?:ed|ion)\b"],
    "pattern": [r"\bpattern\b", r"\bconsistently\b", r"\balways\b.*\buse\b", r"\bconvention\b", r"\bbest\s*practice\b", r"\bidiom\b", r"\brecurring\b", r"\bstandard\b.*\bapproach\b"],
}
#: Fixed value: what names a speaker before a sentence.
ROLE = r"(?i)^\s*\[?\s*(?:user|assistant|human|ai|system)\s*\]?\s*:?\s*"
CONTRADICTIONS = [(r"\balways\b", r"\bnever\b"), (r"\buse\b", r"\bavoid\b"), (r"\benable\b", r"\bdisable\b"), (r"\bshould\b", r"\bshould not\b")]


def insights(turns: DataFrame, signals: dict[str, str] = SIGNALS, group: str = "conv_id", order: str = "turn", text: str = "text", low: int = 20, high: int = 500) -> DataFrame:
    """(group, first_turn, sentence, signal): sentences of ``low`` characters or more with a signal, the first ``high`` of them, each once a group whatever the case."""
    parts = turns.select(group, order, F.posexplode(F.split(F.col(text), r"(?<=[.!?])\s+|\n{2,}")).alias("pos", "sentence"))
    parts = parts.withColumn("sentence", F.regexp_replace(F.trim("sentence"), ROLE, "")).filter(F.length("sentence") >= low).withColumn("sentence", F.substring("sentence", 1, high))
    signal = F.lit(None).cast("string")
    for name, pattern in reversed(signals.items()):
        signal = F.when(F.col("sentence").rlike("(?i)" + pattern), name).otherwise(signal)
    hit = parts.withColumn("signal", signal).filter("signal IS NOT NULL")
    first = F.min(F.struct(order, "pos", "sentence", "signal")).alias("f")
    return hit.groupBy(group, F.lower("sentence").alias("_key")).agg(first).select(group, F.col(f"f.{order}").alias("first_turn"), "f.sentence", "f.signal")


def classify(text: Column, categories: dict[str, list[str]] = CATEGORIES) -> tuple[Column, Column]:
    """(category, confidence): three times the share of a category's patterns that hit, at most 1; none gives general at 0.3."""
    shares = {c: sum((F.when(text.rlike("(?i)" + p), 1.0).otherwise(0.0) for p in ps), F.lit(0.0)) / len(ps) for c, ps in categories.items()}
    best = F.greatest(*shares.values())
    name = F.lit("general")
    for c, v in reversed(shares.items()):
        name = F.when(v == best, c).otherwise(name)
    return F.when(best > 0, name).otherwise("general"), F.when(best > 0, F.round(F.least(best * 3, F.lit(1.0)), 2)).otherwise(0.3)


def topics(rows: DataFrame, k: int, group: str | None = None, text: str = "text", stop: tuple[str, ...] = (), order: str = "turn") -> DataFrame:
    """The k most frequent lower-case words of 4 letters or more; of equal ones, the first by name."""
    keys = [group] if group else []
    ws = rows.select(*keys, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9_-]+"), F.lit(0))).alias("topic")).filter((F.length("topic") >= 4) & (~F.col("topic").isin(*stop) if stop else F.lit(True)))
    counts = ws.groupBy(*keys, "topic").agg(F.count("*").alias("n"))
    if not group:
        return counts.orderBy(F.desc("n"), "topic").limit(k)
    w = W.partitionBy(group).orderBy(F.desc("n"), "topic")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def profile(memories: DataFrame, user: str = "user_id", newest: int = 5) -> DataFrame:
    """(user, total, by_category, latest) of memories (user_id, memory_id, text, category, created_at)."""
    counts = memories.groupBy(user, "category").agg(F.count("*").alias("n")).groupBy(user).agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("by_category"))
    w = W.partitionBy(user).orderBy(F.desc("created_at"), F.desc("memory_id"))
    last = memories.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= newest).groupBy(user).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "memory_id"))), lambda s: s["memory_id"]).alias("latest"))
    return counts.join(last, user)


def contradictions(memories: DataFrame, pairs: list[tuple[str, str]] = CONTRADICTIONS, group: str = "category", id_col: str = "memory_id", text: str = "text") -> DataFrame:
    """(group, rule, n_positive, n_negative, first_positive, first_negative): rules that a group's memories state both ways.

    Sides are aggregated, so that a large group never becomes pairs.
    """
    sides = []
    for k, (yes, no) in enumerate(pairs):
        p, n = (F.col(text).rlike("(?i)" + tx.ascii_bounds(x)) for x in (yes, no))
        sides.append(memories.select(group, F.lit(k).alias("rule"), F.col(id_col).alias("id"), (p & ~n).alias("p"), (n & ~p).alias("n")).filter("p OR n"))
    rows = sides[0]
    for s in sides[1:]:
        rows = rows.unionByName(s)
    both = rows.groupBy(group, "rule").agg(F.count(F.when(F.col("p"), 1)).alias("n_positive"), F.count(F.when(F.col("n"), 1)).alias("n_negative"), F.min(F.when(F.col("p"), F.col("id"))).alias("first_positive"), F.min(F.when(F.col("n"), F.col("id"))).alias("first_negative"))
    return both.filter("n_positive > 0 AND n_negative > 0")


def stale(memories: DataFrame, now: Column, days: int = 30, created: str = "created_at") -> DataFrame:
    age = F.floor((now.cast("double") - F.col(created).cast("timestamp").cast("double")) / 86400)
    return memories.withColumn("age_days", age).filter(F.col("age_days") > days)


def orphans(memories: DataFrame, articles: DataFrame) -> DataFrame:
    """Categories of memories without an article."""
    return memories.select("category").distinct().join(articles.select("category").distinct(), "category", "left_anti")


def weak_bullets(bullets: DataFrame, uses: int = 5, least: float = 0.3) -> DataFrame:
    """Bullets used often that rarely helped."""
    used = F.col("success_count") + F.col("failure_count")
    return bullets.filter((used >= uses) & (F.col("success_count") / used < least))


def similar_pairs(memories: DataFrame, threshold: float = 0.75, group: str = "category", id_col: str = "memory_id", text: str = "text") -> DataFrame:
    """(group, a, b, ratio): texts of a group as like as ``threshold``; pairs are met in the task, and only likely ones are compared in full."""

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        from difflib import SequenceMatcher

        rows, out = sorted(zip(pdf.id, pdf.text.str.lower(), strict=True)), []
        for j, (b, tb) in enumerate(rows):
            m = SequenceMatcher(None, "", tb)
            for a, ta in rows[:j]:
                m.set_seq1(ta)
                if m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and (r := m.ratio()) >= threshold:
                    out.append((pdf.grp.iloc[0], a, b, round(r, 4)))
        return pd.DataFrame(out, columns=["grp", "a", "b", "ratio"])

    g, i = (memories.schema[c].dataType.simpleString() for c in (group, id_col))
    return memories.select(F.col(group).alias("grp"), F.col(id_col).alias("id"), F.col(text).alias("text")).groupBy("grp").applyInPandas(pairs, f"grp {g}, a {i}, b {i}, ratio double").withColumnRenamed("grp", group)


def articles(memories: DataFrame, id_col: str = "memory_id", text: str = "text") -> DataFrame:
    """(category, n, article): a markdown article a category, memories in order of id."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("i"), F.col(text).alias("t")))), lambda s: F.concat(F.lit("- "), s["t"])), "\n")
    return memories.groupBy("category").agg(F.count("*").alias("n"), body.alias("body")).select("category", "n", F.concat(F.lit("# "), F.col("category"), F.lit("\n\n"), F.col("body")).alias("article"))


def cross_links(found: DataFrame, least: float = 0.1) -> DataFrame:
    """(a, b, overlap) of articles whose words overlap more than ``least``; one article a category, so few."""
    ws = found.select("category", F.array_distinct(tx.bm25_tokens(F.col("article"))).alias("w"))
    a, b = ws.select(F.col("category").alias("a"), F.col("w").alias("wa")), ws.select(F.col("category").alias("b"), F.col("w").alias("wb"))
    overlap = F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.round(overlap, 4).alias("overlap")).filter(F.col("overlap") > least)


def latest_state(deltas: DataFrame, key: str = "bullet_id", order: str = "version") -> DataFrame:
    """A playbook's bullets as its log of deltas leaves them; a removed bullet is gone."""
    last = deltas.groupBy(key).agg(F.max_by(F.struct(*[c for c in deltas.columns if c != key]), order).alias("s")).select(key, "s.*")
    return last.filter("op <> 'remove'")


def bullet_scores(bullets: DataFrame, similarity: str = "similarity") -> DataFrame:
    return bullets.withColumn("score", F.col(similarity) * (0.5 + 0.5 * F.col("confidence")))


def feedback(bullets: DataFrame, events: DataFrame, up: float = 0.1, down: float = 0.05) -> DataFrame:
    """``bullets`` with counts and confidence after feedback events (bullet_id, success)."""
    sums = events.groupBy("bullet_id").agg(F.count(F.when(F.col("success"), 1)).alias("s"), F.count(F.when(~F.col("success"), 1)).alias("f"))
    rows = bullets.join(sums, "bullet_id", "left").na.fill(0, ["s", "f"])
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence") + F.col("s") * up - F.col("f") * down))
    return rows.withColumns({"success_count": F.col("success_count") + F.col("s"), "failure_count": F.col("failure_count") + F.col("f"), "confidence": conf}).drop("s", "f")
