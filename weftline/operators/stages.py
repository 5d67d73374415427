"""Skeletons in up to three stages: by importance, then for a query, then anchored by the query's evidence.

Each document goes as far as its mode says (baseline, query_guided, evidence_aware) and every stage that it went through
leaves a row of its trace. The stages of a document are numbers of one group: they are picked in a task, where the document's row lies or by exchange of its
vectors; texts are not exchanged for it.
"""

from __future__ import annotations

from typing import TYPE_CHECKING, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions import text as tx

from .grouped import by_group_arrays
from .skeleton import MOST_CHUNKS, embed, finished, large_documents, mmr_order, node_line, rendered, scored_chunks, scored_documents, vectors

if TYPE_CHECKING:
    import numpy as np

STAGES = ("baseline", "query_guided", "evidence_aware")
#: What a query's picks lose by likeness to each other.
REDUNDANCY = 0.5


def resolved(text: Column, query: Column) -> tuple[Column, Column]:
    """(mode, query) of the automatic mode: evidence for structured reports, asked by their first heading if there is no query; others follow the query, if there is one."""
    asked = F.coalesce(F.trim(query), F.lit("")) != ""
    mode = F.when(tx.wants_evidence(text), STAGES[2]).when(asked, STAGES[1]).otherwise(STAGES[0])
    heading = F.coalesce(tx.first_heading_query(text), F.lit("key findings and verdict"))
    return mode, F.when(asked, query).when(tx.wants_evidence(text), heading)


class Stage(NamedTuple):
    """A document's chunks in one stage, by their places: all that it chose from, those of them that always stay, and those kept."""

    name: str
    nodes: np.ndarray
    anchors: np.ndarray
    kept: np.ndarray


def _total(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, one number after the other as Spark adds them."""
    import numpy as np

    return np.cumsum(x, axis=-1)[..., -1]


def _cosines(v: np.ndarray, q: np.ndarray | None) -> np.ndarray:
    """The cosine of each row of ``v`` with ``q`` as ``num.cosine`` sums it; 0 without a query."""
    import numpy as np

    if q is None:
        return np.zeros(len(v))
    length = np.sqrt(_total(v * v)) * np.sqrt(_total(q * q))
    return np.where(length > 0, _total(v * q) / np.where(length > 0, length, 1), 0.0)


def _stages(importance: np.ndarray, v: np.ndarray | None, q: np.ndarray | None, mode: str | None, ratio: float, top_k: int) -> tuple[float, list[Stage]]:
    """(best score, stages) of a document whose chunks come in the order of their ids; ``v`` is not read in the baseline mode."""
    import numpy as np

    n = len(importance)
    least, every = max(1, int(np.floor(n * ratio))), np.arange(n)
    out = [Stage(STAGES[0], every, every[:0], np.sort(np.argsort(-importance, kind="stable")[:least]))]
    if mode not in STAGES[1:]:
        return 0.0, out
    rel = _cosines(v, q)
    by_rel = np.argsort(-rel, kind="stable")
    for name, anchors in zip(STAGES[1 : STAGES.index(mode) + 1], (every[:0], np.sort(by_rel[:top_k])), strict=False):
        nodes = every if n <= 3 else np.union1d(by_rel[: max(2, n // 2)], anchors)  # the better half and the anchors
        some, clear = rel[nodes], np.maximum(rel[nodes], 0.0)
        total = _total(clear)
        share = np.clip(clear / total * ratio * len(nodes) if total > 0 else np.full(len(nodes), ratio), 0.05, 1.0)
        budget = max(least, int((share >= ratio).sum()))
        kept = anchors
        if len(anchors) < budget:
            kept = np.union1d(anchors, nodes[mmr_order(v[nodes], importance[nodes], some, share, budget, REDUNDANCY)])
        out.append(Stage(name, nodes, anchors, kept))
    return max(float(rel.max()), 0.0), out


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column as rows of doubles."""
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _traced(done: DataFrame, least: float) -> DataFrame:
    """The rows of a trace from ``finished`` ones with file_id, stage, mode, n_anchors and best."""
    evidence, enough = F.col("stage") == STAGES[2], F.col("best") >= least
    status = F.concat(F.lit("=== EVIDENCE STATUS: "), F.when(enough, "SUFFICIENT").otherwise("INSUFFICIENT"), F.format_string(f" === best_score=%.3f threshold={least:.3f}\n", F.col("best")))
    return done.select(
        "file_id", "stage", (F.col("stage") == F.col("mode")).alias("final"), "total_nodes", "anchor_nodes", "n_anchors", evidence.alias("evidence_used"),
        F.when(evidence, F.round("best", 3)).alias("best_score"), F.when(evidence, enough).alias("sufficient"), "skeleton_tokens", "compression_ratio",
        F.when(evidence, F.concat(status, "skeleton_text")).otherwise(F.col("skeleton_text")).alias("skeleton_text"),
    )


def trace(chunks: DataFrame, requests: DataFrame, ratio: float = 0.2, top_k: int = 5, least: float = 0.35) -> DataFrame:
    """A row for each stage of each document: (file_id, stage, final, total_nodes, anchor_nodes, n_anchors, evidence_used, best_score, sufficient, skeleton_tokens, compression_ratio, skeleton_text).

    ``chunks`` have file_id, id, position, text, tokens, importance and embedding; ``requests`` have file_id, mode and
    query_embedding, one row a document, whose vector may be null in the baseline mode. Documents without a request have no rows.

    Baseline keeps max(1, int(n * ratio)) chunks by importance. A query first drops the half of the chunks that is least like it; its budget is the same number,
    or that of the chunks whose share of the relevance earns ``ratio``, if more; that share is a chunk's priority in the picks. Evidence makes the ``top_k`` chunks most
    like the query anchors, which always stay, and tells whether the best reaches ``least``.
    """

    def picked(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        import numpy as np

        ids, mode = part.column("id").to_numpy(), part.column("mode")[0].as_py()
        order = np.argsort(ids, kind="stable")
        ids, importance = ids[order], part.column("importance").to_numpy(zero_copy_only=False)[order]
        asked = mode in STAGES[1:]
        q = part.column("q").slice(0, 1) if asked else None
        best, found = _stages(importance, _matrix(part.column("v"))[order] if asked else None, _matrix(q)[0] if asked and q[0].is_valid else None, mode, ratio, top_k)
        nodes = [s.nodes for s in found]
        return (
            ids[np.concatenate(nodes)], np.repeat([s.name for s in found], [len(x) for x in nodes]), np.concatenate([np.isin(s.nodes, s.anchors) for s in found]),
            np.concatenate([np.isin(s.nodes, s.kept) for s in found]), np.full(sum(map(len, nodes)), best),
            np.full(sum(map(len, nodes)), mode, dtype=object),
        )

    # a number for each stage that a chunk is in; its text is met by those only
    asked = chunks.select("file_id", "id", F.col("importance").cast("double").alias("importance"), F.col("embedding").alias("v"))
    asked = asked.join(requests.select("file_id", "mode", F.col("query_embedding").alias("q")), "file_id")
    kind = chunks.schema["file_id"].dataType.simpleString()
    found = by_group_arrays(asked, ["file_id"], picked, f"file_id {kind}, id long, stage string, anchor boolean, kept boolean, best double, mode string")
    met = found.join(chunks.select("file_id", "id", "position", "text", "tokens"), ["file_id", "id"]).withColumn("doc", F.struct("file_id", "stage"))
    done = rendered(met, group="doc", more=(F.sum(F.col("anchor").cast("int")).alias("n_anchors"), F.first("best").alias("best"), F.first("mode").alias("mode")))
    return _traced(done.select("doc.*", *[c for c in done.columns if c != "doc"]), least)


def staged_skeletons(chunks: DataFrame, requests: DataFrame, ratio: float = 0.2, top_k: int = 5, least: float = 0.35) -> DataFrame:
    """The last stage of each document: one row each."""
    return trace(chunks, requests, ratio, top_k, least).filter("final").drop("final")


def document_trace(docs: DataFrame, mode: Column, query: Column, ratio: float = 0.2, top_k: int = 5, least: float = 0.35, last: bool = False, most: int = MOST_CHUNKS) -> DataFrame:
    """``trace`` of documents (doc_id, text), each for its own mode and query; only the ``last`` stage of each, if asked for.

    Documents of at most ``most`` chunks stay in their rows from text to skeleton, without an exchange; the others are chunked into rows.
    """

    @F.arrow_udf("array<struct<stage:string,nodes:array<int>,n_anchors:bigint,best:double,kept:array<int>>>")
    def stages(importance: pa.Array, found: pa.Array, modes: pa.Array, queries: pa.Array) -> pa.Array:
        import numpy as np

        asked = queries.dictionary_encode()
        known = vectors(asked.dictionary.to_pylist()).astype(np.float64) if len(asked.dictionary) else None
        out = []
        for x, raw, m, k in zip(importance, found, modes.to_pylist(), asked.indices.to_pylist(), strict=True):
            x = x.values.to_numpy(zero_copy_only=False)
            v = np.frombuffer(raw.as_py(), dtype=np.float32).reshape(len(x), -1).astype(np.float64) if m in STAGES[1:] else None
            best, done = _stages(x, v, None if k is None else known[k], m, ratio, top_k)
            out.append([{"stage": s.name, "nodes": s.nodes, "n_anchors": len(s.anchors), "best": best, "kept": s.kept} for s in done if not last or s.name == m])
        kind = pa.struct([("stage", pa.string()), ("nodes", pa.list_(pa.int32())), ("n_anchors", pa.int64()), ("best", pa.float64()), ("kept", pa.list_(pa.int32()))])
        return pa.array(out, pa.list_(kind))

    asked = docs.select("doc_id", "text", mode.alias("mode"), query.alias("query"))
    rows = scored_documents(asked, most=most, keep=("mode", "query"), with_vectors=True)
    rows = rows.withColumn("stages", stages("scored.importance", "scored.vectors", "mode", "query"))
    shown = F.array_distinct(F.flatten(F.transform("stages", lambda s: s["kept"])))  # a line is made once for all stages
    lines = tx.let(shown, lambda ids: F.transform("parts", lambda p, i: F.when(F.array_contains(ids, i), node_line(i, p))))
    rows = rows.withColumn("every", lines).select("file_id", "mode", "tokens", "every", F.explode_outer("stages").alias("s")).filter("s is not null")  # outer: Spark then asks for no sizes of the stages first, which would make them twice
    done = rows.select(
        "file_id", "mode", "s.stage", F.size("s.nodes").cast("long").alias("total_nodes"), F.size("s.kept").cast("long").alias("anchor_nodes"), "s.n_anchors", "s.best",
        F.aggregate("s.nodes", F.lit(0).cast("long"), lambda a, i: a + F.get("tokens", i)).alias("total_tokens"), F.transform("s.kept", lambda i: F.get("every", i)).alias("lines"),
    )
    done, large = _traced(finished(done), least), large_documents(asked, most)
    if large is not None:
        requests = embed(large.select(F.col("doc_id").alias("file_id"), "mode", "query"), text="query")
        requests = requests.select("file_id", "mode", F.when(F.col("query").isNotNull(), F.col("embedding")).alias("query_embedding"))
        done = done.unionByName(trace(scored_chunks(large), requests, ratio, top_k, least))
    return done.filter("final") if last else done


def document_skeletons(docs: DataFrame, mode: Column, query: Column, ratio: float = 0.2, top_k: int = 5, least: float = 0.35, most: int = MOST_CHUNKS) -> DataFrame:
    """``staged_skeletons`` of documents, as ``document_trace`` has them."""
    return document_trace(docs, mode, query, ratio, top_k, least, True, most).drop("final")
