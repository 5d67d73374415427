"""Dialogue memory: importance, relevance, budget packing, compaction."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weftline.functions import numbers as num, text as tx

#: Words that make a turn critical or relevant.
CRITICAL = [
    "allergy", "allergic", "severe", "life-threatening", "critical", "emergency", "danger", "fatal", "deadly", "poisonous", "toxic",
    "medical condition", "cannot eat", "cannot have", "avoid", "never", "must not", "forbidden",
]
RELEVANT = ["important", "prefer", "like", "dislike", "want", "need", "requirement", "constraint", "limitation", "restriction"]


def importance(text: Column, role: Column, critical: list[str] = CRITICAL, relevant: list[str] = RELEVANT, ratio: float | None = 0.8) -> Column:
    """CRITICAL, RELEVANT or TRIVIAL by substrings; system turns are at least relevant.

    Words as like a critical one as ``ratio`` count as misspellings of it; without ``ratio`` only substrings count.
    """
    low = F.lower(text)
    hit = lambda ws: F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: low.contains(w))
    severe = hit(critical) if ratio is None else hit(critical) | misspelt(critical, ratio)(low)
    return F.when(severe, "CRITICAL").when(hit(relevant), "RELEVANT").when(role == "system", "RELEVANT").otherwise("TRIVIAL")


def misspelt(keywords: list[str], ratio: float = 0.8) -> Callable[[Column], Column]:
    """Whether a text holds a word of 4 letters or more as like a keyword as ``ratio``, by matching blocks.

    Keywords with a space are left to substrings; of hyphenated ones, parts of 4 letters or more are compared.
    Arrow-batched: no built-in function compares by matching blocks. A word is compared once a task.
    """
    parts = [p for k in keywords if " " not in k for p in ([k] if "-" not in k else k.split("-")) if "-" not in k or len(p) >= 4]

    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher
        from functools import lru_cache

        @lru_cache(maxsize=100_000)
        def like(word: str) -> bool:
            for p in parts:
                m = SequenceMatcher(None, word, p)
                if m.real_quick_ratio() >= ratio and m.quick_ratio() >= ratio and m.ratio() >= ratio:
                    return True
            return False

        return texts.map(lambda t: any(like(w) for w in (t or "").split() if len(w) >= 4)).astype(bool)

    return found


def recency(turn: Column, last: Column) -> Column:
    """1 for the last turn, falling in a straight line to 0."""
    return F.when(last > 0, 1 - (last - turn) / last).otherwise(1.0)


def half_life_weight(turn: Column, last: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), (last - turn) / half_life)


def scored(turns: DataFrame, query: list[float] | None = None, critical: list[str] = CRITICAL, relevant: list[str] = RELEVANT, conv: str = "conv_id", ratio: float | None = 0.8) -> DataFrame:
    """``turns`` (conv_id, turn, role, text, embedding) with importance, relevance and fidelity.

    Relevance of other than critical turns: .4 of the distance from the conversation's mean
    vector, .3 of the likeness to the query, .3 of recency.
    """
    w = W.partitionBy(conv)
    dims = turns.select(conv, F.posexplode("embedding").alias("k", "v")).groupBy(conv, "k").agg(F.avg("v").alias("m"))
    centre = dims.groupBy(conv).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("centre"))
    rows = turns.join(centre, conv, "left").withColumn("importance", importance(F.col("text"), F.col("role"), critical, relevant, ratio))
    away = 1 - num.relevance(F.col("embedding"), F.col("centre"))
    to_query = num.relevance(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])) if query else F.lit(0.0)
    mixed = num.clamp(0.4 * F.coalesce(away, F.lit(0.0)) + 0.3 * to_query + 0.3 * recency(F.col("turn"), F.max("turn").over(w)))
    rows = rows.withColumn("relevance", F.when(F.col("importance") == "CRITICAL", 1.0).otherwise(mixed))
    return rows.withColumn("fidelity", fidelity(F.col("relevance"))).drop("centre")


def fidelity(relevance: Column) -> Column:
    return F.when(relevance >= 0.45, "FULL").when(relevance >= 0.25, "COMPRESSED").otherwise("PLACEHOLDER")


#: Words that raise a sentence of a summary.
WEIGHTY = ["critical", "important", "allergy", "severe", "warning", "must", "never"]


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _cut(text: Column, length: Column) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, F.lit(1), length), F.lit("..."))).otherwise(text)


def placeholder(role: Column, turn: Column, text: Column, most: int = 12) -> Column:
    """A stub of about ``most`` tokens: role, turn and, where there is room, how the text begins."""
    stub = F.concat(F.lit("["), role, F.lit(" turn "), turn.cast("string"), F.lit("]"))
    left = F.lit(most) - tx.token_count(stub)
    return F.when(left > 3, F.concat(stub, F.lit(" "), _cut(text, left * 4))).otherwise(stub)


def summarised(text: Column, target: Column) -> Column:
    """Sentences of most weight up to ``target`` tokens, in the order of the text; a null text is null.

    Sentences of about 15 tokens, early ones and those with ``WEIGHTY`` words go first, of equals the earlier; choosing ends at nine tenths
    of the target. If none fits, the first is cut at four characters a token, and so are choices that are over the target together.
    """
    parts = F.filter(F.transform(F.split(text, r"\. "), _stripped), lambda s: s != "")
    whole = F.transform(parts, lambda s: F.when(s.endswith("."), s).otherwise(F.concat(s, F.lit("."))))

    def chosen(v: Column) -> Column:
        ss, aim = v["ss"], v["aim"]

        def weight(s: Column, i: Column) -> Column:
            n, low = tx.token_count(s), F.lower(s)
            heavy = F.lit(False)
            for w in WEIGHTY:
                heavy = heavy | F.contains(low, F.lit(w))
            score = F.greatest(F.lit(0.1), 1.0 - F.abs(n - 15) / 30.0) * (1.0 - i / F.size(ss) * 0.3) * F.when(heavy, 1.2).otherwise(1.0)
            return F.struct((-score).alias("less"), i.alias("i"), n.alias("n"))

        start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.array().cast("array<int>").alias("at"))

        def step(a: Column, x: Column) -> Column:
            fits = ~a["full"] & (a["used"] + x["n"] <= aim)
            used = a["used"] + F.when(fits, x["n"]).otherwise(0)
            return F.struct(used.alias("used"), (a["full"] | (used >= aim * 0.9)).alias("full"), F.when(fits, F.array_append(a["at"], x["i"])).otherwise(a["at"]).alias("at"))

        kept = F.aggregate(F.array_sort(F.transform(ss, weight)), start, step, lambda a: F.array_sort(a["at"]))
        joined = tx.let(kept, lambda at: F.when(F.size(at) > 0, F.array_join(F.transform(at, lambda i: F.get(ss, i)), " ")))
        over = tx.let(joined, lambda t: F.when(tx.token_count(t) > aim, F.concat(F.substring(t, F.lit(1), aim * 4), F.lit("..."))).otherwise(t))
        return F.coalesce(over, _cut(F.get(ss, F.lit(0)), aim * 4))

    said = tx.let(F.struct(whole.alias("ss"), target.alias("aim")), chosen)
    return F.when(F.size(parts) == 0, F.substring(text, F.lit(1), target * 4)).otherwise(said)


def compressed(role: Column, text: Column, ratio: float = 0.33) -> Column:
    """A turn's summary of ``ratio`` of its tokens, ten at least, after its role."""
    target = F.greatest(F.lit(10), F.floor(tx.token_count(text) * F.lit(ratio)).cast("int"))
    return F.concat(F.lit("["), role, F.lit(" summarized]: "), summarised(text, target))


def rendered(turns: DataFrame, packed: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv_id, turn, used_fidelity, shown): what each turn that ``pack`` kept looks like in the context; a turn's number is unique in its conversation."""
    rows = turns.select(conv, "turn", "role", "text").join(packed.filter("used_fidelity <> 'DROPPED'").select(conv, "turn", "used_fidelity"), [conv, "turn"])
    shown = F.when(F.col("used_fidelity") == "FULL", F.col("text")).when(F.col("used_fidelity") == "COMPRESSED", compressed(F.col("role"), F.col("text"))).otherwise(placeholder(F.col("role"), F.col("turn"), F.col("text")))
    return rows.select(conv, "turn", "used_fidelity", shown.alias("shown"))


def pack(turns: DataFrame, budget: int, conv: str = "conv_id") -> DataFrame:
    """(conv_id, turn, used_fidelity, tokens): in order, each turn at its fidelity or the next lower one that fits, else left out.

    A fold over each conversation's turns in order; ``turns`` has role, text and fidelity.
    """
    body = F.col("text")
    sizes = F.struct(tx.token_count(body).alias("full"), tx.token_count(compressed(F.col("role"), body)).alias("mid"), tx.token_count(placeholder(F.col("role"), F.col("turn"), body)).alias("low"))
    rows = turns.select(conv, "turn", "fidelity", sizes.alias("t"))
    grouped = rows.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct("turn", "fidelity", "t"))).alias("turns"))
    kind = "array<struct<turn:bigint,used_fidelity:string,tokens:int>>"
    start = F.struct(F.lit(0).alias("used"), F.array().cast(kind).alias("out"))

    def step(s: Column, x: Column) -> Column:
        left = budget - s["used"]
        full, mid, low = (x["t"][k] for k in ("full", "mid", "low"))
        chosen = (
            F.when((x["fidelity"] == "FULL") & (full <= left), F.struct(x["turn"].cast("bigint").alias("turn"), F.lit("FULL").alias("used_fidelity"), full.alias("tokens")))
            .when((x["fidelity"] != "PLACEHOLDER") & (mid <= left), F.struct(x["turn"].cast("bigint").alias("turn"), F.lit("COMPRESSED").alias("used_fidelity"), mid.alias("tokens")))
            .when(low <= left, F.struct(x["turn"].cast("bigint").alias("turn"), F.lit("PLACEHOLDER").alias("used_fidelity"), low.alias("tokens")))
            .otherwise(F.struct(x["turn"].cast("bigint").alias("turn"), F.lit("DROPPED").alias("used_fidelity"), F.lit(0).alias("tokens")))
        )
        return F.struct((s["used"] + chosen["tokens"]).alias("used"), F.array_append(s["out"], chosen).alias("out"))

    done = grouped.select(conv, F.explode(F.aggregate("turns", start, step, lambda s: s["out"])).alias("o"))
    return done.select(conv, "o.turn", "o.used_fidelity", "o.tokens")


def packing_stats(packed: DataFrame, budget: int, conv: str = "conv_id") -> DataFrame:
    kinds = ("FULL", "COMPRESSED", "PLACEHOLDER", "DROPPED")
    return packed.groupBy(conv).agg(*[F.count(F.when(F.col("used_fidelity") == k, 1)).alias(k.lower()) for k in kinds], F.sum("tokens").alias("tokens"), F.lit(budget).alias("budget"))


def recent_tail(turns: DataFrame, k: int, conv: str = "conv_id") -> DataFrame:
    """The last k turns of each conversation that aren't system turns."""
    w = W.partitionBy(conv).orderBy(F.desc("turn"))
    return turns.filter(F.col("role") != "system").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def compacted(turns: DataFrame, k: int, conv: str = "conv_id") -> DataFrame:
    """(conv_id, system, older, tail): system turns, a summary of older turns, the last k turns in full."""
    w = W.partitionBy(conv).orderBy(F.desc("turn"))
    other = F.col("role") != "system"
    rows = turns.withColumn("_back", F.sum(other.cast("int")).over(w))
    line = F.concat(F.lit("["), F.col("role"), F.lit("] "), F.trim("text"))
    join = lambda when, shown: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when & (F.trim("text") != ""), F.struct("turn", shown.alias("x"))))), lambda s: s["x"]), "\n")
    return rows.groupBy(conv).agg(join(~other, line).alias("system"), join(other & (F.col("_back") > k), F.concat(F.lit("- "), tx.summary(F.col("text"), 80))).alias("older"), join(other & (F.col("_back") <= k), line).alias("tail"))


def stats(turns: DataFrame, critical: list[str] = CRITICAL, relevant: list[str] = RELEVANT, conv: str = "conv_id", ratio: float | None = 0.8) -> DataFrame:
    level = importance(F.col("text"), F.col("role"), critical, relevant, ratio)
    return turns.groupBy(conv).agg(F.count("*").alias("turns"), *[F.count(F.when(level == k, 1)).alias(k.lower()) for k in ("CRITICAL", "RELEVANT", "TRIVIAL")])
