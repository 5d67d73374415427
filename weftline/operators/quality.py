"""Quality gates, rewards, benchmark guards and audit chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weftline.functions import numbers as num, text as tx


def answerable(text: Column, spans: Column) -> Column:
    """Share of answer spans that stand in the text; 1 without spans."""
    return F.when(F.size(spans) > 0, F.size(F.filter(spans, lambda s: F.contains(text, s))) / F.size(spans)).otherwise(1.0)


def in_order(text: Column, markers: Column) -> Column:
    """Whether all markers stand in the text, first places never falling."""
    at = F.transform(markers, lambda m: F.instr(text, m))
    return F.forall(at, lambda p: p > 0) & (F.array_sort(at) == at)


def span_gate(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text: str = "text", key: str = "item_id", span: str = "span", few: int = 1_000, heads_at_once: int = 500_000) -> DataFrame:
    """(id, item) pairs where a document contains a span.

    A document that contains a span holds the span's second to fourth words in a row: these meet
    by hash, and only then is the whole span looked for, so that documents and spans are never
    crossed. Up to ``heads_at_once`` spans, their hashes are broadcast and the documents' runs aren't exchanged. Spans of fewer than five words have no such run: they are looked for in blocks of about ``few``.
    """
    ws = lambda c: F.transform(tx.words(F.col(c)), lambda w: F.xxhash64(w))
    sized = spans.select(F.col(key), F.col(span), ws(span).alias("w")).filter(F.col(span).isNotNull() & (F.col(span) != ""))
    heads = sized.filter(F.size("w") >= 5).select(key, span, F.xxhash64(F.get("w", F.lit(1)), F.get("w", F.lit(2)), F.get("w", F.lit(3))).alias("h"))
    hashed = docs.select(F.col(id_col), F.col(text), ws(text).alias("w"))
    n = F.greatest(F.size("w") - 2, F.lit(0))
    runs = hashed.select(id_col, F.explode(F.array_distinct(F.filter(F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i < n, F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))), lambda h: h.isNotNull()))).alias("h"))
    ids = heads.select("h", key)  # a hash and an item a span
    hits = runs.join(F.broadcast(ids) if ids.count() <= heads_at_once else ids, "h").select(id_col, key).distinct()
    whole = hits.join(spans.select(key, span), key)
    found = whole.join(docs.select(id_col, text), id_col).filter(F.contains(F.col(text), F.col(span))).select(id_col, key)
    short = sized.filter(F.size("w") < 5).select(key, span)
    blocks = -(-short.count() // few)
    for k in range(blocks):
        block = short.filter(F.pmod(F.xxhash64(key, span), F.lit(blocks)) == k)
        found = found.unionByName(docs.select(id_col, text).join(F.broadcast(block), F.contains(F.col(text), F.col(span))).select(id_col, key))
    return found.distinct()


def evaluated(fixtures: DataFrame, compressed: str = "compressed", spans: str = "answer_spans", tokens: str = "load_bearing_tokens", markers: str = "order_markers") -> DataFrame:
    """Per fixture: answerability, byte identity, order, and whether all pass."""
    a, b = answerable(F.col(compressed), F.col(spans)), answerable(F.col(compressed), F.col(tokens))
    o = in_order(F.col(compressed), F.col(markers))
    return fixtures.withColumns({"answerability": a, "byte_identity": b, "ordered": o}).withColumn("passed", (F.col("answerability") == 1) & (F.col("byte_identity") == 1) & F.col("ordered"))


def first_paragraph(text: Column) -> Column:
    return F.get(F.split(F.trim(text), r"\n\s*\n"), F.lit(0))


def entity_retention(original: Column, kept: Column) -> Column:

    def share(e: Column) -> Column:
        return F.when(F.size(e["n"]) > 0, F.size(F.filter(e["n"], lambda n: F.contains(e["k"], n))) / F.size(e["n"])).otherwise(1.0)

    return tx.let(F.struct(tx.key_entities(original, 50).alias("n"), kept.alias("k")), share)


def coverage(original: Column, kept: Column) -> Column:
    """Share of sentences with a word of three letters or more that the kept text holds."""

    def share(e: Column) -> Column:
        hit = F.filter(e["s"], lambda s: F.exists(F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9_]{3,}"), F.lit(0)), lambda w: F.contains(e["low"], w)))
        return F.when(F.size(e["s"]) > 0, F.size(hit) / F.size(e["s"])).otherwise(1.0)

    return tx.let(F.struct(tx.sentences(original).alias("s"), F.lower(kept).alias("low")), share)


def predicted_quality(original: Column, kept: Column, relevance: Column | None = None) -> Column:
    """.4 entity retention, .3 coverage, .3 relevance."""
    return F.round(0.4 * entity_retention(original, kept) + 0.3 * coverage(original, kept) + 0.3 * (relevance if relevance is not None else F.lit(1.0)), 4)


def simulated(text: Column, ratio: float) -> Column:
    """round(n * ratio) sentences of most length and entity density, in order; halves round to even."""

    def chosen(ss: Column) -> Column:
        k = F.greatest(F.lit(1), F.bround(F.size(ss) * F.lit(ratio), 0).cast("int"))
        weighed = F.transform(ss, lambda s, i: F.struct((-(tx.word_count(s) + 2 * F.size(F.regexp_extract_all(s, F.lit(r"\b\p{Lu}"), F.lit(0))))).alias("less"), i.alias("i")))
        top = F.array_sort(F.transform(F.slice(F.array_sort(weighed), F.lit(1), k), lambda x: x["i"]))
        return F.when(F.size(ss) > 0, F.array_join(F.transform(top, lambda i: F.get(ss, i)), " ")).otherwise("")

    return tx.let(tx.sentences(text), chosen)


#: Target ratios of each fidelity for contracts and for rewards, and weights of a reward's components.
CONTRACT_RATIOS = {"ABSTRACT": 10.0, "OUTLINE": 5.0, "STRUCTURE": 3.0, "DETAILED": 2.0, "BALANCED": 3.0, "RAW": 1.0}
REWARD_RATIOS = {"ABSTRACT": 20.0, "OUTLINE": 10.0, "STRUCTURE": 5.0, "DETAILED": 2.5, "RAW": 1.0}
REWARD_WEIGHTS = {"ratio": 0.15, "fidelity": 0.35, "speed": 0.20, "memory": 0.15, "coherence": 0.15}


def lookup(key: Column, values: dict[str, float], default: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.upper(key)), F.lit(default))


def reward(rows: DataFrame, weights: dict[str, float] = REWARD_WEIGHTS, least: float = 0.7) -> DataFrame:
    """``rows`` with a column for each component (0 to 1): total, weakest component, and whether the total passes."""
    total = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    weakest = F.array_min(F.array(*[F.struct(F.col(c).alias("v"), F.lit(k).alias("k"), F.lit(c).alias("c")) for k, c in enumerate(weights)]))
    return rows.withColumns({"total": F.round(total, 9), "weakest": weakest["c"], "passes": total >= least})


def ratio_score(original: Column, kept: Column, level: Column) -> Column:
    target = lookup(level, REWARD_RATIOS, 5.0)
    return num.clamp(F.when(kept > 0, original / kept / target).otherwise(0.0))


def contracts(rows: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Named checks of an operation (original_tokens, kept_tokens, level, text, skeleton) and whether all hold."""
    ratio = F.col("original_tokens") / F.greatest(F.col("kept_tokens"), F.lit(1))
    checks = {
        "input_not_blank": F.trim("text") != "",
        "output_not_blank": F.trim("skeleton") != "",
        "tokens_positive": F.col("original_tokens") > 0,
        "not_longer": F.col("kept_tokens") <= F.col("original_tokens"),
        "ratio_met": (F.upper("level") == "RAW") | (ratio >= lookup(F.col("level"), CONTRACT_RATIOS, 3.0) * tolerance),
    }
    return rows.withColumns(checks).withColumn("passed", F.forall(F.array(*[F.col(c) for c in checks]), lambda c: c))


def chained(events: DataFrame, group: str, order: str, body: Column) -> DataFrame:
    """Audit rows linked to the row before: content hash, previous content hash, link hash. Windows a group."""
    w = W.partitionBy(group).orderBy(order)
    rows = events.withColumn("content_hash", F.sha2(body, 256))
    rows = rows.withColumn("previous_hash", F.coalesce(F.lag("content_hash").over(w), F.lit("")))
    return rows.withColumn("link_hash", F.sha2(F.concat("previous_hash", "content_hash"), 256))


def verified(chain: DataFrame, group: str, order: str, body: Column) -> DataFrame:
    """(group, rows, broken): rows whose link no longer fits content or predecessor."""
    again = chained(chain.drop("content_hash", "previous_hash", "link_hash"), group, order, body).select(group, order, F.col("link_hash").alias("_again"))
    both = chain.join(again, [group, order])
    return both.groupBy(group).agg(F.count("*").alias("rows"), F.count(F.when(F.col("link_hash") != F.col("_again"), 1)).alias("broken"))


def guard(report: DataFrame, floors: DataFrame) -> DataFrame:
    """Floors (mode, case_id, metric, floor) that a report (mode, case_id, metric, value) misses or lacks."""
    both = floors.join(report, ["mode", "case_id", "metric"], "left")
    return both.filter(F.col("value").isNull() | (F.col("value") < F.col("floor"))).select("mode", "case_id", "metric", "floor", "value")


def summary(results: DataFrame, mode: str = "mode") -> DataFrame:
    return results.groupBy(mode).agg(F.count("*").alias("cases"), F.count(F.when(F.col("passed"), 1)).alias("passed"), *[F.round(F.avg(c), 4).alias(f"avg_{c}") for c in ("compression_ratio", "token_savings_pct")])


def compared(a: DataFrame, b: DataFrame, key: str, *values: str) -> DataFrame:
    """Differences b - a of two runs, to 4 places."""
    y = b.select(key, *[F.col(v).alias(f"_{v}") for v in values])
    return a.join(y, key).select(key, *[F.round(F.col(f"_{v}") - F.col(v), 4).alias(f"delta_{v}") for v in values])


def evidence_stats(bundles: DataFrame) -> DataFrame:
    return bundles.groupBy("operation").agg(F.count("*").alias("n"), F.round(F.avg("ratio"), 4).alias("avg_ratio"), F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def estimate_grade(estimated: Column, actual: Column) -> Column:
    error = F.abs(estimated - actual) / F.when(actual > 0, actual)
    return F.when(error <= 0.1, "excellent").when(error <= 0.25, "good").otherwise("fair")
