"""Set operations and duplicates."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from weftline.functions import text as tx
from weftline.staging import dropped, staged

if TYPE_CHECKING:
    import pyarrow as pa


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(first_id, copies) of texts that stand more than once, by hash."""
    keyed = docs.select(F.col(id_col).alias("id"), F.sha2(F.col(text), 256).alias("h")).filter("h IS NOT NULL")
    return keyed.groupBy("h").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1").select("first_id", "copies")


def chunk_diff(old: DataFrame, new: DataFrame, group: str, text: str = "text") -> DataFrame:
    """(group, unchanged, updated, added, removed) of two versions' chunk sets; equal texts count once."""
    one = old.select(F.col(group), F.sha2(F.col(text), 256).alias("h")).distinct().withColumn("was", F.lit(1))
    two = new.select(F.col(group), F.sha2(F.col(text), 256).alias("h")).distinct().withColumn("now", F.lit(1))
    both = one.join(two, [group, "h"], "full_outer")
    counts = both.groupBy(group).agg(
        F.count(F.when(F.col("was").isNotNull() & F.col("now").isNotNull(), 1)).alias("unchanged"),
        F.count(F.when(F.col("was").isNull(), 1)).alias("fresh"),
        F.count(F.when(F.col("now").isNull(), 1)).alias("gone"),
    )
    updated = F.least("fresh", "gone")
    return counts.select(group, "unchanged", updated.alias("updated"), (F.col("fresh") - updated).alias("added"), (F.col("gone") - updated).alias("removed"))


def preserved(old: DataFrame, new: DataFrame, group: str, text: str = "text", value: str = "embedding") -> DataFrame:
    """``new`` with the value that an unchanged text of the same group had."""
    known = old.select(F.col(group), F.sha2(F.col(text), 256).alias("_h"), F.col(value)).dropDuplicates([group, "_h"])
    return new.drop(value).withColumn("_h", F.sha2(F.col(text), 256)).join(known, [group, "_h"], "left").drop("_h")


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) of pairs (a, b): least node reachable, by alternately linking to least neighbours until nothing changes."""
    edges = staged(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).dropna().filter("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        last, edges = edges, staged(linked.filter("u <> v").distinct(), "links")
        dropped(last)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def collapsed(nodes: DataFrame, pairs: DataFrame, id_col: str = "id") -> DataFrame:
    """One row of ``nodes`` a component, that of the least id, with its number of members and their ids."""
    of = components(pairs)
    rows = nodes.join(of.withColumnRenamed("node", id_col), id_col, "left").withColumn("component", F.coalesce("component", F.col(id_col)))
    members = rows.groupBy("component").agg(F.count("*").alias("occurrence_count"), F.array_sort(F.collect_list(F.when(F.col(id_col) != F.col("component"), F.col(id_col)))).alias("collapsed_from"))
    return nodes.join(members.withColumnRenamed("component", id_col), id_col)


def greedy_distinct(rows: DataFrame, threshold: float, group: str, id_col: str, text: str = "text") -> DataFrame:
    """Rows kept in order of id unless their text is as like a kept one of the group as ``threshold`` (Ratcliff-Obershelp)."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        from difflib import SequenceMatcher

        kept: list[str] = []
        marks = []
        for t in pdf.sort_values("id").itertuples():
            low = (t.text or "").lower()
            new = all(SequenceMatcher(None, low, k).ratio() < threshold for k in kept)
            if new:
                kept.append(low)
                marks.append(t.id)
        return pd.DataFrame({"grp": pdf.grp.iloc[0], "id": marks}) if marks else pd.DataFrame({"grp": [], "id": []})

    g, i = (rows.schema[c].dataType.simpleString() for c in (group, id_col))
    ids = rows.select(F.col(group).alias("grp"), F.col(id_col).alias("id"), F.col(text).alias("text")).groupBy("grp").applyInPandas(keep, f"grp {g}, id {i}")
    return ids.withColumnsRenamed({"grp": group, "id": id_col})


def word_jaccard(a: str, b: str):
    """Jaccard similarity of the words of two columns."""
    x, y = F.array_distinct(tx.words(F.lower(F.col(a)))), F.array_distinct(tx.words(F.lower(F.col(b))))
    all_ = F.size(F.array_union(x, y))
    return F.when(all_ > 0, F.size(F.array_intersect(x, y)) / all_).otherwise(0.0)


def overlap_quality(selected: DataFrame, wanted: DataFrame, group: str, id_col: str) -> DataFrame:
    """(group, precision, recall, f1) of selected ids against wanted ones."""
    s, w = selected.select(group, id_col).distinct().withColumn("s", F.lit(1)), wanted.select(group, id_col).distinct().withColumn("w", F.lit(1))
    c = s.join(w, [group, id_col], "full_outer").groupBy(group).agg(F.count("s").alias("ns"), F.count("w").alias("nw"), F.count(F.col("s") + F.col("w")).alias("both"))
    p, r = F.when(F.col("ns") > 0, F.col("both") / F.col("ns")).otherwise(0.0), F.when(F.col("nw") > 0, F.col("both") / F.col("nw")).otherwise(0.0)
    return c.select(group, p.alias("precision"), r.alias("recall")).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def latest(rows: DataFrame, n: int, group: str, *order: str) -> DataFrame:
    """The newest ``n`` rows of each group."""
    w = W.partitionBy(group).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def _repeated(texts: list[list[str]], n_from: int, n_to: int, least: int) -> Iterator[tuple[int, str, int]]:
    """(n, ngram, freq) of word runs that stand ``least`` times or more in the texts of one id.

    A run repeats only where the run of one word less does: each round looks at the places that are left.
    """
    import numpy as np

    flat = [w for t in texts for w in t]
    names: dict[str, int] = {}
    codes = np.fromiter((names.setdefault(w, len(names)) for w in flat), dtype=np.int64, count=len(flat))
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    last = np.repeat(np.cumsum(sizes), sizes)
    most = np.repeat(np.minimum(n_to, np.maximum(sizes // 2 + 1, n_from)), sizes)
    at, run = np.arange(len(flat)), codes
    for n in range(1, n_to + 1):
        if n > 1:
            fit = (at + n <= last[at]) & (n <= most[at])
            at, run = at[fit], run[fit] * len(names) + codes[at[fit] + n - 1]
        _, first, run, counts = np.unique(run, return_index=True, return_inverse=True, return_counts=True)
        again = np.flatnonzero(counts >= least)
        if n >= n_from:
            for place, freq in zip(at[first[again]].tolist(), counts[again].tolist(), strict=True):
                yield n, " ".join(flat[place : place + n]), freq
        kept = counts[run] >= least
        at, run = at[kept], run[kept]
        if not len(at):
            return


def repeated_ngrams(docs: DataFrame, n_from: int = 2, n_to: int = 4, least: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ngram, n, freq, savings) of word runs that repeat in a text and save f * (n - 1) - n tokens or more than none.

    Rows of one id count together: texts are dealt by id, once, and the runs are counted where a text lies; runs that don't repeat
    are never rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        schema = pa.schema([pa.field("id", pa.null()), ("n", pa.int32()), ("ngram", pa.string()), ("freq", pa.int64()), ("savings", pa.int64())])
        out, now, held = [], None, []

        def solve(now, held: list[list[str]]) -> None:
            for n, gram, freq in _repeated(held, n_from, n_to, least):
                if (saved := freq * (n - 1) - n) > 0:
                    out.append((now, n, gram, freq, saved))

        def packed() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for b in batches:
            schema = schema.set(0, pa.field("id", b.schema.field("id").type))
            for key, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if held and key != now:
                    solve(now, held)
                    held = []
                    if len(out) >= 20_000:
                        yield packed()
                        out.clear()
                now = key
                held.append(tx.python_words(t))
        solve(now, held)
        if out:
            yield packed()

    return rows.repartition("id").sortWithinPartitions("id").mapInArrow(count, f"id {kind}, n int, ngram string, freq long, savings long")
