"""State tables of a service: memories, caches, evidence, prompts, batches, storage, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Extensions of the kinds of media.
IMAGES = [".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp"]
AUDIO = [".mp3", ".wav", ".m4a", ".flac", ".ogg"]
DOCUMENTS = [".pdf", ".md", ".txt", ".html", ".docx"]
# Beginnings of model names and who provides them, in order of the test.
PROVIDERS = [
    ("claude", "anthropic"), ("haiku", "anthropic"), ("gemini", "google"), ("gpt", "openai"), ("o1", "openai"), ("o3", "openai"),
    ("o4", "openai"), ("codex", "openai"), ("groq", "groq"), ("grok", "xai"), ("local", "local"), ("ollama", "local"),
]


def newest(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in an order: each task keeps its own first, so that no task sorts all."""
    return rows.orderBy(*order).limit(n)


def memory_list(memories: DataFrame, n: int, created: str = "created_at", id_col: str = "memory_id") -> DataFrame:
    return newest(memories, [F.desc(created), F.desc(id_col)], n)


def memory_hits(scored: DataFrame, n: int, score: str = "score", created: str = "created_at", id_col: str = "memory_id") -> DataFrame:
    return newest(scored, [F.desc(score), F.desc(created), F.desc(id_col)], n)


def top_per_group(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark filters ranks before the exchange too."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("place") <= n)


def pruned(bullets: DataFrame, target: int, group: str, confidence: str = "confidence", id_col: str = "id") -> DataFrame:
    """``bullets`` without the least confident ones beyond ``target`` a group."""
    return top_per_group(bullets, group, [F.desc(confidence), F.col(id_col)], target).drop("place")


def filtered_bullets(bullets: DataFrame, least: float, kind: str | None = None, confidence: str = "confidence", kind_col: str = "kind") -> DataFrame:
    found = bullets.filter(F.col(confidence) >= least)
    return found if kind is None else found.filter(F.col(kind_col) == kind)


def capped(keys: DataFrame, key: str, cap: int, group: str | None = None, used: str = "ts") -> DataFrame:
    """(group, key, used) that a registry of bounded size holds: the ``cap`` keys used last."""
    last = keys.groupBy(*([group] if group else []), key).agg(F.max(used).alias(used))
    order = [F.desc(used), F.col(key)]
    return top_per_group(last, group, order, cap).drop("place") if group else newest(last, order, cap)


def cache_lookup(entries: DataFrame, now: str, ttl_seconds: int, written: str = "ts") -> DataFrame:
    """``entries`` with ``age`` in seconds and ``hit``: an entry older than its time to live is a miss."""
    age = F.lit(now).cast("timestamp").cast("double") - F.col(written).cast("timestamp").cast("double")
    return entries.withColumns({"age": age, "hit": age <= ttl_seconds})


def batch_progress(items: DataFrame, batch: str, done: Column, failed: Column) -> DataFrame:
    """(batch, total, done, failed, percent, success_rate)."""
    g = items.groupBy(batch).agg(F.count("*").alias("total"), F.count_if(done).alias("done"), F.count_if(failed).alias("failed"))
    rate = F.when(F.col("done") > 0, (F.col("done") - F.col("failed")) / F.col("done") * 100).otherwise(F.lit(0.0))
    return g.withColumns({"percent": F.round(F.col("done") / F.col("total") * 100, 4), "success_rate": F.round(rate, 4)})


def storage_summary(documents: DataFrame, session: str = "source", text: str = "text", limit_mb: float | None = None) -> DataFrame:
    """One row: documents, sessions, bytes, megabytes, and the share of a limit."""
    out = documents.agg(F.count("*").alias("documents"), F.count_distinct(session).alias("sessions"), F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("bytes"))
    out = out.withColumn("megabytes", F.round(F.col("bytes") / 1048576, 4))
    return out.withColumn("percent_used", F.round(F.col("bytes") / 1048576 / limit_mb * 100, 4)) if limit_mb else out


def global_stats(nodes: DataFrame, file_id: str = "file_id", tokens: str = "tokens") -> DataFrame:
    """One row: files, nodes and tokens; of a scope if ``nodes`` was filtered to it."""
    return nodes.agg(F.count_distinct(file_id).alias("files"), F.count("*").alias("nodes"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"))


def media_kind(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))
    return F.when(suffix.isin(*IMAGES), "image").when(suffix.isin(*AUDIO), "audio").when(suffix.isin(*DOCUMENTS), "document").otherwise("unknown")


def provider(model: Column) -> Column:
    found = None
    for start, name in PROVIDERS:
        hit = F.lower(model).startswith(start)
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found.otherwise("unknown")


def numeric_field(body: Column, paths: list[str]) -> Column:
    """The first of ``paths`` of a JSON text that holds a number."""
    return F.coalesce(*[F.get_json_object(body, p).try_cast("double") for p in paths])


def cost_telemetry(rows: DataFrame, price: Column, priced: Column, original: str = "original_tokens", kept: str = "compressed_tokens") -> DataFrame:
    """Saved tokens and dollars: signed at the default price, never negative for a model with its own."""
    saved = F.col(original) - F.col(kept)
    shown = F.when(priced, F.greatest(saved, F.lit(0))).otherwise(saved)
    percent = F.when(F.col(original) > 0, saved / F.col(original) * 100).otherwise(F.lit(0.0))
    costs = {"original_usd": F.col(original), "compressed_usd": F.col(kept), "saved_usd": shown}
    return rows.withColumns({"saved_tokens": shown, "savings_percent": F.round(percent, 1), **{k: F.round(v / 1e6 * price, 6) for k, v in costs.items()}})


def cache_usage(rows: DataFrame, total: str = "input_tokens", read: str = "cache_read", price: float = 3.0, cached_price: float = 0.3) -> DataFrame:
    """Hit ratio and costs of a provider's prompt cache, with a warning where a hit was expected in vain."""
    ratio = F.when(F.col(total) > 0, F.col(read) / F.col(total)).otherwise(F.lit(0.0))
    saved = F.greatest(F.col(read) / 1e6 * price - F.col(read) / 1e6 * cached_price, F.lit(0.0))
    return rows.withColumns({"cache_hit": F.col(read) > 0, "hit_ratio": F.round(ratio, 4), "input_usd": F.round(F.col(total) / 1e6 * price, 6), "read_usd": F.round(F.col(read) / 1e6 * cached_price, 6), "saved_usd": F.round(saved, 6)})


def cache_health(telemetry: DataFrame, *keys: str, least: float = 0.5, read: str = "cache_read", total: str = "input_tokens") -> DataFrame:
    """(keys, calls, hit_ratio, degraded): templates whose share of tokens read from the cache is below ``least``."""
    g = telemetry.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum(read).alias("_read"), F.sum(total).alias("_total"))
    ratio = F.when(F.col("_total") > 0, F.col("_read") / F.col("_total")).otherwise(F.lit(0.0))
    return g.select(*keys, "calls", F.round(ratio, 6).alias("hit_ratio"), (ratio < least).alias("degraded"))


def expectations(expected: DataFrame, observed: DataFrame, id_col: str = "prompt_id", hashed: str = "prefix_hash") -> DataFrame:
    """(prefix_hash, prompts, met): how many prompts expect a prefix and were seen with it."""
    seen = observed.select(id_col, F.col(hashed).alias("_seen"))
    met = expected.join(seen, id_col, "left")
    return met.groupBy(hashed).agg(F.count("*").alias("prompts"), F.count_if(F.col("_seen") == F.col(hashed)).alias("met"))


def invalidated(expected: DataFrame, version: str, label: str, version_col: str = "version", label_col: str = "label") -> DataFrame:
    """``expected`` with ``stale``: of the replaced version under the label."""
    return expected.withColumn("stale", (F.col(version_col) == version) & (F.col(label_col) == label))


def interleaved(sections: DataFrame, group: str, position: str, stable: Column) -> DataFrame:
    """(group, sections, first_volatile, interleaved): whether a stable section follows a volatile one, which breaks the prefix."""
    g = sections.groupBy(group).agg(F.count("*").alias("sections"), F.min(F.when(~stable, F.col(position))).alias("first_volatile"), F.max(F.when(stable, F.col(position))).alias("_last_stable"))
    return g.select(group, "sections", "first_volatile", F.coalesce(F.col("_last_stable") > F.col("first_volatile"), F.lit(False)).alias("interleaved"))


def evidence(rows: DataFrame, operation: str | None = None, since: str | None = None, until: str | None = None, failed: bool | None = None, op_col: str = "operation", at: str = "ts", ok: str = "passed") -> DataFrame:
    """Evidence entries of an operation, of a time range (both ends in it), and failed ones or passed ones."""
    if operation is not None:
        rows = rows.filter(F.col(op_col) == operation)
    if since is not None:
        rows = rows.filter(F.col(at) >= F.lit(since).cast("timestamp"))
    if until is not None:
        rows = rows.filter(F.col(at) <= F.lit(until).cast("timestamp"))
    return rows if failed is None else rows.filter(~F.col(ok) if failed else F.col(ok))


def method_comparison(*runs: tuple[str, DataFrame], metrics: list[str]) -> DataFrame:
    """(method, cases, mean of each metric) over the runs of several methods."""
    every = [df.select(F.lit(name).alias("method"), *metrics) for name, df in runs]
    rows = every[0]
    for other in every[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("method").agg(F.count("*").alias("cases"), *[F.round(F.avg(m), 6).alias(m) for m in metrics])


def union_of_graphs(*graphs: tuple[str, DataFrame]) -> DataFrame:
    """The nodes of several graphs, each with its ``kind``; columns that one lacks are null there."""
    out = None
    for kind, df in graphs:
        df = df.withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def anchored(nodes: DataFrame, keywords: list[str], text: str = "text") -> DataFrame:
    """``nodes`` with ``anchored``: whether a keyword stands in the text, in any case."""
    hit = F.lit(False)
    for k in keywords:
        if k.strip():
            hit = hit | F.contains(F.lower(F.col(text)), F.lit(k.lower()))
    return nodes.withColumn("anchored", F.coalesce(hit, F.lit(False)))


def anchored_selection(nodes: DataFrame, budget: int, group: str, score: str, id_col: str, anchor: str = "anchored") -> DataFrame:
    """All anchors of a group, and its best other nodes as far as the budget goes."""
    w = W.partitionBy(group).orderBy(F.desc(anchor), F.desc(score), F.col(id_col))
    return nodes.withColumn("place", F.row_number().over(w)).filter(F.col(anchor) | (F.col("place") <= budget))


def budget_floor(nodes: DataFrame, group: str, ratio: str, base: float) -> DataFrame:
    """(group, nodes, kept): as many as reach the base ratio, but never fewer than that share of all nor than one."""
    g = nodes.groupBy(group).agg(F.count("*").alias("nodes"), F.count_if(F.col(ratio) >= base).alias("_over"))
    return g.select(group, "nodes", F.greatest(F.lit(1), F.floor(F.col("nodes") * F.lit(base)).cast("long"), F.col("_over")).alias("kept"))


def invalid_facts(facts: DataFrame, as_of: str, valid_to: str = "valid_to") -> DataFrame:
    return facts.filter(F.col(valid_to) <= F.lit(as_of).cast("timestamp"))


def without_invalid(results: DataFrame, facts: DataFrame, as_of: str, on: str) -> DataFrame:
    """``results`` whose fact is valid as of a time; facts that nobody knows count as valid."""
    return results.join(invalid_facts(facts, as_of).select(on).distinct(), on, "left_anti")


def digest(sessions: DataFrame, session: str, tool: str, shown: int = 5) -> DataFrame:
    """(session, digest): a line of at most 800 characters with the first tools by name and their counts."""
    calls = sessions.groupBy(session, tool).agg(F.count("*").alias("calls"))
    w = W.partitionBy(session).orderBy(tool)
    few = calls.withColumns({"place": F.row_number().over(w), "tools": F.count("*").over(W.partitionBy(session)), "events": F.sum("calls").over(W.partitionBy(session))}).filter(F.col("place") <= shown)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat(F.substring(tool, 1, 32), F.lit(":"), F.col("calls").cast("string")).alias("t")))), lambda x: x["t"]), ", ")
    more = F.when(F.max("tools") > shown, F.concat(F.lit(" (+"), (F.max("tools") - shown).cast("string"), F.lit(" more)"))).otherwise("")
    return few.groupBy(session).agg(F.substring(F.concat(F.lit("session "), F.first(F.col(session).cast("string")), F.lit(" | "), F.max("events").cast("string"), F.lit(" events | "), line, more), 1, 800).alias("digest"))


def inline_summary(saved: Column, dollars: Column, total: Column) -> Column:
    """One line on what an operation saved and what the session did."""
    last = F.concat(F.lit("Saved "), F.format_number(saved, 0), F.lit(" tokens ($"), F.format_string("%.3f", F.round(dollars, 3)), F.lit(")"))
    return F.concat(last, F.when(total > 0, F.concat(F.lit(" | Session total: $"), F.format_string("%.2f", F.round(total, 2)), F.lit(" saved"))).otherwise(""))


def flattened(rows: DataFrame, nested: str, fields: dict[str, str]) -> DataFrame:
    """``rows`` with fields of a JSON text as columns, by path, and ``n_fields``: how many of them it has."""
    found = {name: F.get_json_object(F.col(nested), path) for name, path in fields.items()}
    return rows.withColumns(found).withColumn("n_fields", sum((F.col(n).isNotNull().cast("int") for n in list(fields)[1:]), F.col(next(iter(fields))).isNotNull().cast("int")))


def fidelity(a: Column, b: Column) -> Column:
    """Cosine of two vectors, clamped to 0 to 1; 0 where one has no length. Both are null: 1, one of them: 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = [F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) for v in (a, b)]
    cosine = F.when((norm[0] == 0) | (norm[1] == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / (norm[0] * norm[1]))))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(cosine)


def admonitions_stripped(text: Column) -> Column:
    return F.regexp_replace(text, r'(?m)^[ \t]*[!?]{3}\+?[ \t]+[\w-]+(?:[ \t]+"[^"]*")?[ \t]*', "")
