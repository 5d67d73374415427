"""Verification of compression: contracts before and after it, composition of its graph, evidence bundles, batches.

Checks are columns of one projection; only ``composition`` and ``batch`` exchange rows, and both combine them in the tasks first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftline.operators.quality import CONTRACT_RATIOS, lookup

#: Limits of an operation, share of a level's ratio that must be reached, and what no path may hold.
MOST_MIB, MOST_SKELETON_TOKENS, TRIVIAL_TOKENS, TOLERANCE = 100, 50_000, 50, 0.5
UNSAFE = ["../", "..\\", "/etc/", "C:\\Windows"]
#: What a skeleton's text refers to: ``[id]`` or ``(node_id)``.
REFERENCE = r"\[([^\]]+)\]|\(node_([^\)]+)\)"
#: Columns that a bundle's hash covers, in order.
SEALED = ["operation", "input_hash", "input_tokens", "output_hash", "output_tokens", "level", "outcomes", "previous_hash"]


def _check(contract: str, kind: str, held: Column, expected: str) -> Column:
    """A check that holds where ``held`` is true; null is a failure."""
    return F.struct(F.lit(contract).alias("contract"), F.lit(kind).alias("kind"), F.coalesce(held, F.lit(False)).alias("held"), F.lit(expected).alias("expected"))


def _present(checks: list[Column]) -> Column:
    return F.filter(F.array(*checks), lambda c: c.isNotNull())


def preconditions(document: Column, level: Column, path: Column) -> Column:
    """Checks of what goes in. A null document fails all that look into it; a null or empty path isn't checked."""
    safe = F.forall(F.array(*[F.lit(u) for u in UNSAFE]), lambda u: ~F.contains(path, u))
    return _present([
        _check("non_empty_document", "precondition", F.length(document) > 0, "text"),
        _check("document_is_string", "precondition", document.isNotNull(), "a string"),
        _check("valid_utf8", "precondition", F.is_valid_utf8(document), "UTF-8"),
        _check("document_size_limit", "precondition", F.octet_length(document) <= MOST_MIB << 20, f"at most {MOST_MIB} MiB"),
        _check("valid_fidelity_level", "precondition", F.upper(level).isin(*CONTRACT_RATIOS), "a level"),
        _check("no_null_bytes", "precondition", ~F.contains(document, F.lit("\0")), "no null characters"),
        F.when(F.length(path) > 0, _check("safe_file_path", "precondition", safe, "a path inside its folder")),
    ])


def postconditions(skeleton: Column, node_map: Column, original: Column, kept: Column, level: Column) -> Column:
    """Checks of what comes out. At level RAW nothing need shrink; small documents need no nodes; without nodes their ids aren't checked."""
    raw = F.coalesce(F.upper(level) == "RAW", F.lit(False))
    ids = F.forall(F.map_entries(node_map), lambda e: (F.length(e["key"]) > 0) & e["value"].isNotNull())
    reached = original / F.greatest(kept, F.lit(1)) >= lookup(level, CONTRACT_RATIOS, 3.0) * TOLERANCE
    return _present([
        _check("skeleton_non_empty", "postcondition", F.length(skeleton) > 0, "text"),
        _check("skeleton_token_limit", "postcondition", kept <= MOST_SKELETON_TOKENS, f"at most {MOST_SKELETON_TOKENS} tokens"),
        _check("valid_node_map", "postcondition", node_map.isNotNull(), "a map"),
        _check("node_map_populated", "postcondition", raw | (original <= TRIVIAL_TOKENS) | (F.size(node_map) > 0), "nodes"),
        _check("compression_achieved", "postcondition", raw | reached, "half the level's ratio"),
        _check("tokens_reduced", "postcondition", raw | (kept < original), "fewer tokens"),
        F.when(F.size(node_map) > 0, _check("valid_node_ids", "postcondition", ids, "ids and texts")),
    ])


def references(text: Column) -> Column:
    """Ids that a skeleton's text refers to, repeats included."""
    inner = [F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(k)) for k in (1, 2)]
    return F.filter(F.zip_with(*inner, lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)), lambda r: r != "")


def composition(nodes: DataFrame, edges: DataFrame, skeletons: DataFrame, key: str = "doc_id", text: str = "skeleton") -> DataFrame:
    """(key, missing_nodes, duplicate_edges, invalid_references): what breaks each key's graph, a row for every key of ``skeletons``.

    ``nodes`` (key, node_id) may repeat; null ids are no nodes. ``edges`` (key, src, dst); an end without a node is missing and counts once,
    a null end too. References count as often as they occur. Rows meet by key and node, so that a key with most rows is spread.
    """
    links = edges.groupBy(key, "src", "dst").agg((F.count("*") - 1).alias("again"))
    flags = ["is_node", "is_end", "refs", "again"]

    def flagged(rows: DataFrame, node: Column, **found: Column) -> DataFrame:
        return rows.select(F.col(key), node.cast("string").alias("node"), *[found.get(f, F.lit(0)).cast("long").alias(f) for f in flags])

    one = F.lit(1)
    ends = links.withColumn("_first", F.explode(F.array(F.lit(True), F.lit(False))))
    refs = skeletons.select(key, F.explode(references(F.col(text))).alias("_ref"))
    rows = flagged(nodes.filter(F.col("node_id").isNotNull()), F.col("node_id"), is_node=one)
    rows = rows.unionByName(flagged(ends, F.when(F.col("_first"), F.col("src")).otherwise(F.col("dst")), is_end=one, again=F.when(F.col("_first"), F.col("again")).otherwise(0)))
    rows = rows.unionByName(flagged(refs, F.col("_ref"), refs=one)).unionByName(flagged(skeletons, F.lit(None)))
    met = rows.groupBy(key, "node").agg(F.max("is_node").alias("is_node"), F.max("is_end").alias("is_end"), F.sum("refs").alias("refs"), F.sum("again").alias("again"))
    lost = F.col("is_node") == 0
    return met.groupBy(key).agg(
        F.count(F.when(lost & (F.col("is_end") == 1), 1)).alias("missing_nodes"),
        F.sum("again").alias("duplicate_edges"),
        F.coalesce(F.sum(F.when(lost, F.col("refs"))), F.lit(0)).alias("invalid_references"),
    )


def _violations(checks: Column) -> Column:
    return F.transform(F.filter(checks, lambda c: ~c["held"]), lambda c: F.struct(c["contract"].alias("contract"), c["kind"].alias("kind"), F.lit("error").alias("severity"), c["expected"].alias("expected")))


def invariants(missing: Column, duplicates: Column, invalid: Column) -> Column:
    """Warnings of a composition's counts; null counts warn of nothing."""
    found = [("edge_endpoints_valid", missing, "ends among the nodes"), ("no_duplicate_edges", duplicates, "each edge once"), ("skeleton_refs_valid", invalid, "references to nodes")]
    kept = [F.when(n > 0, F.struct(F.lit(c).alias("contract"), F.lit("invariant").alias("kind"), F.lit("warning").alias("severity"), F.lit(e).alias("expected"))) for c, n, e in found]
    return F.filter(F.array(*kept), lambda v: v.isNotNull())


def verified(operations: DataFrame, composed: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """``operations`` (key, document, path, level, skeleton, node_map, original_tokens, skeleton_tokens) with ``checks``, ``violations`` and
    ``verified``. Invariants of ``composed`` only warn: contracts before and after decide."""
    c = F.col
    before = preconditions(c("document"), c("level"), c("path"))
    after = postconditions(c("skeleton"), c("node_map"), c("original_tokens"), c("skeleton_tokens"), c("level"))
    rows = operations.withColumn("checks", F.concat(before, after))
    broken = _violations(c("checks"))
    if composed is not None:
        rows = rows.join(composed, key, "left")
        broken = F.concat(invariants(c("missing_nodes"), c("duplicate_edges"), c("invalid_references")), broken)
    return rows.withColumns({"violations": broken, "verified": F.forall("checks", lambda x: x["held"])})


def seal() -> Column:
    """The hash of a bundle's sealed columns; null and empty differ."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.length(F.col(n).cast("string")).cast("string"), F.lit(":"), F.col(n).cast("string")), F.lit("-")) for n in SEALED]), 256)


def bundles(results: DataFrame, operation: str, previous: Column | None = None, key: str = "doc_id") -> DataFrame:
    """Evidence of ``verified`` operations: hashes and counts of input and output, outcomes of the checks, and the hash that seals them.
    Texts are not kept. ``previous`` is the hash of the bundle before, if there is one."""
    outcomes = F.array_join(F.transform("checks", lambda c: F.concat(c["contract"], F.when(c["held"], "+").otherwise("-"))), ",")
    rows = results.select(
        key, F.lit(operation).alias("operation"), F.sha2("document", 256).alias("input_hash"), F.col("original_tokens").alias("input_tokens"),
        F.sha2("skeleton", 256).alias("output_hash"), F.col("skeleton_tokens").alias("output_tokens"), "level", outcomes.alias("outcomes"),
        (F.lit(None).cast("string") if previous is None else previous).alias("previous_hash"))
    return rows.withColumn("bundle_hash", seal())


def verified_bundles(sealed: DataFrame) -> DataFrame:
    """``sealed`` with ``violations`` and ``verified``: a hash that doesn't fit is the only violation of its bundle, as nothing in it can be
    trusted; else the checks that failed are."""
    intact = F.coalesce(F.col("bundle_hash") == seal(), F.lit(False))
    failed = F.filter(F.split("outcomes", ","), lambda o: F.endswith(o, F.lit("-")))

    def violation(contract: Column, kind: Column, expected: str) -> Column:
        return F.struct(contract.alias("contract"), kind.alias("kind"), F.lit("error").alias("severity"), F.lit(expected).alias("expected"))

    tampered = F.array(violation(F.lit("bundle_integrity"), F.lit("invariant"), "a hash that fits"))
    stored = F.transform(F.coalesce(failed, F.array().cast("array<string>")), lambda o: violation(F.regexp_replace(o, "-$", ""), F.lit("contract"), "check passes"))
    return sealed.withColumn("violations", F.when(intact, stored).otherwise(tampered)).withColumn("verified", F.size("violations") == 0)


def batch(results: DataFrame) -> DataFrame:
    """(contract, violations, operations, passed, pass_rate): a row for each contract that was broken and one, ``*``, for all results.
    A contract's row counts the operations that broke it. No results give no rows."""
    names = F.concat(F.array(F.lit("*")), F.transform("violations", lambda v: v["contract"]))
    rows = results.select("verified", F.size("violations").alias("n"), F.explode(names).alias("contract"))
    found = rows.groupBy("contract").agg(F.count("*").alias("operations"), F.count(F.when(F.col("verified"), 1)).alias("passed"), F.sum("n").alias("n"))
    violations = F.when(F.col("contract") == "*", F.col("n")).otherwise(F.col("operations")).cast("long")
    return found.select("contract", violations.alias("violations"), "operations", "passed", F.round(F.col("passed") / F.col("operations"), 6).alias("pass_rate"))
