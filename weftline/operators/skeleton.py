"""Chunking, selection and rendering of documents."""

from __future__ import annotations

from typing import TYPE_CHECKING

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weftline.functions import numbers as num, text as tx
from weftline.staging import staged

from .registry import admonitions_stripped

if TYPE_CHECKING:
    import numpy as np

#: Chunks of a document whose vectors a task compares where they lie; documents of more go by rows, their vectors by blocks and their edges by joins.
MOST_CHUNKS = 2048


def packed_parts(parts: Column, budget: int, joiner: str = " ", extra: int = 0) -> Column:
    """Consecutive parts joined into chunks of at most ``budget`` tokens; a larger part is a chunk of its own."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("size"))

    def add(s: Column, x: Column) -> Column:
        p, n = x["p"], x["n"]
        fits = (s["now"] != "") & (s["size"] + n + extra <= budget)
        return F.when(fits, F.struct(s["done"].alias("done"), F.concat(s["now"], F.lit(joiner), p).alias("now"), (s["size"] + n + extra).alias("size"))).otherwise(
            F.struct(F.when(s["now"] == "", s["done"]).otherwise(F.array_append(s["done"], s["now"])).alias("done"), p.alias("now"), n.alias("size"))
        )

    sized = F.transform(parts, lambda p: F.struct(p.alias("p"), tx.token_count(p).alias("n")))
    return F.aggregate(sized, empty, add, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.array_append(s["done"], s["now"])))


def paragraph_chunks(text: Column, budget: int = 512) -> Column:
    """Paragraphs packed greedily; a paragraph over the budget is packed by sentences."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    units = F.flatten(F.transform(paragraphs, lambda p: F.when(tx.token_count(p) > budget, packed_parts(tx.sentences(p), budget)).otherwise(F.array(p))))
    return packed_parts(units, budget, "\n\n")


def heading_chunks(text: Column, budget: int = 512) -> Column:
    """Sections before H2 and H3 headings; one over 1.5 budgets is packed under its heading again."""
    sections = F.filter(F.transform(F.split(text, r"(?m)(?=^#{2,3} )"), lambda s: F.trim(s)), lambda s: s != "")

    def cut(section: Column) -> Column:
        head = F.regexp_extract(section, r"^(#{1,6} [^\n]*)", 1)
        body = F.trim(F.substring(section, F.length(head) + 1, F.length(section)))
        parts = F.transform(paragraph_chunks(body, budget), lambda p: F.when(head == "", p).otherwise(F.concat(head, F.lit("\n\n"), p)))
        return F.when(tx.token_count(section) > int(1.5 * budget), parts).otherwise(F.array(section))

    return F.flatten(F.transform(sections, cut))


def uses_headings(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(r"(?m)^#{2,3} ")) >= 2) | (F.regexp_count(text, F.lit(r"(?m)^#{1,3} ")) >= 3)


def chunk_parts(text: Column, budget: int = 512) -> Column:
    """The chunks of a text, by headings where it has them, else by paragraphs and sentences."""
    return F.when(uses_headings(text), heading_chunks(text, budget)).otherwise(paragraph_chunks(text, budget))


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", budget: int = 512) -> DataFrame:
    """(file_id, position, text, tokens, heading_level, heading_text) by headings where a text has them, else by paragraphs and sentences."""
    rows = docs.select(F.col(id_col).alias("file_id"), F.posexplode(chunk_parts(F.col(text), budget)).alias("position", "text"))
    return rows.select("file_id", "position", "text", tx.token_count(F.col("text")).alias("tokens"), tx.heading_level(F.col("text")).alias("heading_level"), tx.heading_text(F.col("text")).alias("heading_text"))


def line_chunks(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(file_id, block, start_line, end_line, code): blocks of ``size`` lines."""
    lines = F.split(F.col(text), "\n")
    starts = F.sequence(F.lit(1), F.size(lines), F.lit(size))
    blocks = docs.select(F.col(id_col).alias("file_id"), lines.alias("lines"), F.posexplode(starts).alias("block", "start_line"))
    end = F.least(F.col("start_line") + size - 1, F.size("lines"))
    return blocks.select("file_id", "block", "start_line", end.alias("end_line"), F.array_join(F.slice("lines", F.col("start_line"), F.lit(size)), "\n").alias("code"))


def hash_embedding(text: Column, size: int = 64) -> Column:
    """Words counted into hash buckets, scaled to length 1: the same in every process."""
    counts = F.aggregate(
        F.transform(tx.words(F.lower(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int")),
        F.array_repeat(F.lit(0.0), size),
        lambda a, b: F.transform(a, lambda v, i: F.when(i == b, v + 1.0).otherwise(v)),
    )
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, v: a + v * v))
    return F.transform(counts, lambda v: F.when(length > 0, v / length).otherwise(v))


def vectors(texts: list[str | None], size: int = 64) -> np.ndarray:
    """The texts' words counted into hash buckets, a row a text, scaled to length 1."""
    import zlib

    import numpy as np

    at: dict[str, int] = {}  # a word's place is found once
    places, counts = [], []
    for t in texts:
        words = (t or "").lower().split()
        for w in set(words).difference(at):
            at[w] = zlib.crc32(w.encode()) % size
        places.extend([at[w] for w in words])
        counts.append(len(words))
    row = np.repeat(np.arange(len(texts)), counts)
    v = np.bincount(row * size + np.array(places, dtype=np.int64), minlength=len(texts) * size).reshape(-1, size).astype(np.float32)
    length = np.array([np.linalg.norm(x) for x in v], dtype=np.float32).reshape(-1, 1)
    return v / np.where(length > 0, length, np.float32(1))


def embed(chunks: DataFrame, size: int = 64, text: str = "text") -> DataFrame:
    """``chunks`` with an ``embedding`` of hashed words; Arrow-batched, since it is a loop over words."""

    @F.pandas_udf("array<float>")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series(list(vectors(list(texts), size)))

    return chunks.withColumn("embedding", vector(F.col(text)))


def select_top(chunks: DataFrame, ratio: float, group: str = "file_id", importance: str = "importance", order: str = "position") -> DataFrame:
    """``chunks`` with ``rank`` and ``kept``: the first max(1, int(n * ratio)) by importance, ties by position."""
    w = W.partitionBy(group)
    rows = chunks.withColumns({"rank": F.row_number().over(w.orderBy(F.desc(importance), order)), "n": F.count("*").over(w)})
    return rows.withColumn("kept", F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(ratio)))).drop("n")


def tiers(chunks: DataFrame, group: str = "file_id", importance: str = "importance", order: str = "position") -> DataFrame:
    """(group, n, n_brief, n_standard): how many nodes the 10 %, 30 % and full tiers hold, with their ids in order."""
    w = W.partitionBy(group)
    rows = chunks.withColumns({"rank": F.row_number().over(w.orderBy(F.desc(importance), order)), "n": F.count("*").over(w)})
    picked = lambda share: F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= F.ceil(F.col("n") * F.lit(share)), F.struct(order)))), lambda s: s[order])
    return rows.groupBy(group).agg(F.count("*").alias("n"), picked(0.1).alias("brief"), picked(0.3).alias("standard"))


def bands(chunks: DataFrame, group: str = "file_id", importance: str = "importance", order: str = "position") -> DataFrame:
    """Each chunk's band: int(15 %) main, the next int(25 %) auxiliary, the rest."""
    w = W.partitionBy(group)
    rows = chunks.withColumns({"rank": F.row_number().over(w.orderBy(F.desc(importance), order)), "n": F.count("*").over(w)})
    main, aux = F.greatest(F.lit(1), F.floor(F.col("n") * 0.15)), F.floor(F.col("n") * 0.25)
    return rows.withColumn("band", F.when(F.col("rank") <= main, "main").when(F.col("rank") <= main + aux, "auxiliary").otherwise("rest")).drop("n")


def mmr_order(v: np.ndarray, imp: np.ndarray, rel: np.ndarray, prio: np.ndarray, k: int, penalty: float) -> list[int]:
    """Rows of ``v`` in the order of picking, ``k`` at most: greedy by hybrid score less the likeness to what is picked."""
    import numpy as np

    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)

    def scaled(x: np.ndarray) -> np.ndarray:
        return (x - x.min()) / (x.max() - x.min()) if x.max() > x.min() else np.ones(len(x))

    base = 0.25 * scaled(imp) + 0.55 * scaled(rel) + 0.20 * scaled(prio)
    most, free, order = None, np.ones(len(v), bool), []
    for _ in range(min(k, len(v))):
        at = int(np.argmax(np.where(free, base if most is None else base - penalty * most, -np.inf)))
        order.append(at)
        free[at] = False
        most = v @ v[at] if most is None else np.maximum(most, v @ v[at])  # below 0, likeness speaks for a node
    return order


def mmr(nodes: DataFrame, k: int, group: str = "label", id_col: str = "vec_id", embedding: str = "embedding", importance: str = "importance", relevance: str | None = None, priority: str | None = None, penalty: float = 0.5) -> DataFrame:
    """(group, id, pick): greedy picks of .25 importance + .55 relevance + .20 priority, each stretched to 0..1, less the likeness to what is picked."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("id").reset_index(drop=True)
        order = mmr_order(np.array(pdf.v.tolist(), dtype=float), *(pdf[c].to_numpy(float) for c in ("imp", "rel", "prio")), k, penalty)
        return pd.DataFrame({"grp": pdf.grp.iloc[0], "id": pdf.id.to_numpy()[order], "pick": range(1, len(order) + 1)})

    kind = nodes.schema[group].dataType.simpleString()
    rows = nodes.select(F.col(group).alias("grp"), F.col(id_col).alias("id"), F.col(embedding).alias("v"), F.col(importance).cast("double").alias("imp"), (F.col(relevance) if relevance else F.lit(0.0)).cast("double").alias("rel"), (F.col(priority) if priority else F.lit(0.0)).cast("double").alias("prio"))
    return rows.groupBy("grp").applyInPandas(pick, f"grp {kind}, id long, pick int").withColumnRenamed("grp", group)


def modulate(chunks: DataFrame, level: str, text: str = "text") -> DataFrame:
    """Chunks rendered at one of five fidelities."""
    body, names = F.col(text), F.array_join(tx.key_entities(F.col(text)), ", ")
    forms = {
        "ABSTRACT": tx.summary(body, 60),
        "OUTLINE": F.concat(tx.summary(body, 100), F.when(names != "", F.concat(F.lit(" ["), names, F.lit("]"))).otherwise("")),
        "STRUCTURE": F.concat(F.lit("- "), tx.summary(body, 160), F.when(names != "", F.concat(F.lit(" | "), names)).otherwise("")),
        "DETAILED": F.array_join(F.slice(tx.sentences(body), F.lit(1), F.lit(5)), " "),
        "RAW": body,
    }
    return chunks.withColumn("rendered", forms[level.upper()])


def node_line(position: Column, text: Column) -> Column:
    """A chunk's line of a skeleton."""
    return F.concat(F.lit("["), position.cast("string"), F.lit("] "), tx.summary(text))


def finished(done: DataFrame) -> DataFrame:
    """Rows with total_nodes, anchor_nodes, total_tokens and ``lines`` with the skeleton's text, tokens and ratio in place of the lines."""
    hidden = F.col("total_nodes") - F.col("anchor_nodes")
    full = F.concat(F.array_join("lines", "\n"), F.when(hidden > 0, F.format_string("\n(%d hidden)", hidden)).otherwise(""))
    out = done.withColumn("skeleton_text", full).drop("lines").withColumn("skeleton_tokens", tx.token_count(F.col("skeleton_text")))
    return out.withColumn("compression_ratio", F.round(F.col("total_tokens") / F.greatest(F.col("skeleton_tokens"), F.lit(1)), 4))


def rendered(selected: DataFrame, group: str = "file_id", order: str = "position", text: str = "text", tokens: str = "tokens", more: tuple[Column, ...] = ()) -> DataFrame:
    """One row a document from chunks with ``kept``: counts, ``more`` aggregates, ratio and the skeleton text in document order."""
    done = selected.groupBy(group).agg(
        F.count("*").alias("total_nodes"),
        F.sum(F.col("kept").cast("int")).alias("anchor_nodes"),
        F.sum(tokens).alias("total_tokens"),
        *more,
        F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct(F.col(order).alias("o"), node_line(F.col(order), F.col(text)).alias("line"))))).alias("lines"),
    )
    return finished(done.withColumn("lines", F.transform("lines", lambda x: x["line"])))


def adjacent_drops(rows: DataFrame, threshold: float = 0.92, group: str = "file_id", order: str = "position", text: str = "text", embedding: str = "embedding") -> DataFrame:
    """``rows`` without near copies of a neighbour: the shorter of two goes, of equal ones the first; groups of up to 3 stay."""
    w = W.partitionBy(group).orderBy(order)
    likeness = F.coalesce(num.cosine(F.col(embedding), F.lag(embedding).over(w)), F.lit(0.0))
    marked = rows.withColumns({"_like": likeness, "_len": F.length(text), "_n": F.count("*").over(W.partitionBy(group))}).withColumns({"_next": F.lead("_like").over(w), "_before": F.lag("_len").over(w), "_after": F.lead("_len").over(w)})
    as_second = (F.col("_like") > threshold) & (F.col("_len") < F.col("_before"))
    as_first = (F.coalesce("_next", F.lit(0.0)) > threshold) & (F.col("_len") <= F.col("_after"))
    return marked.filter((F.col("_n") < 4) | ~(as_second | as_first)).drop("_like", "_len", "_n", "_next", "_before", "_after")


def boundaries(rows: DataFrame, threshold: float = 0.5, group: str = "file_id", order: str = "position", embedding: str = "embedding") -> DataFrame:
    """``rows`` with ``segment``: a new one begins where a row is less like the one before than ``threshold``."""
    w = W.partitionBy(group).orderBy(order)
    like = F.coalesce(num.cosine(F.col(embedding), F.lag(embedding).over(w)), F.lit(1.0))
    return rows.withColumn("_cut", (like < threshold).cast("int")).withColumn("segment", F.sum("_cut").over(w)).drop("_cut")


def extractive(docs: DataFrame, budget: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, kept, tokens): sentences by score 1 - .15 i / n (+ .2 at 6 to 40 tokens), taken while they fit, in order."""
    rows = docs.select(F.col(id_col).alias("id"), tx.sentences(F.col(text)).alias("s")).withColumn("n", F.size("s"))
    scored = F.transform("s", lambda s, i: F.struct((-(1 - 0.15 * i / F.col("n") + F.when(tx.word_count(s).between(6, 40), 0.2).otherwise(0.0))).alias("less"), i.alias("i"), tx.token_count(s).alias("t"), s.alias("s")))

    def take(a: Column, x: Column) -> Column:
        return F.when(a["used"] + x["t"] <= budget, F.struct((a["used"] + x["t"]).alias("used"), F.array_append(a["at"], x["i"]).alias("at"))).otherwise(a)

    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("at"))
    done = rows.withColumn("fold", F.aggregate(F.array_sort(scored), start, take))
    kept = F.transform(F.array_sort(F.col("fold.at")), lambda i: F.get(F.col("s"), i))
    return done.select("id", F.col("n").alias("sentences"), F.size("fold.at").alias("kept"), F.col("fold.used").alias("tokens"), F.array_join(kept, " ").alias("text"))


def anchor_text(text: Column, budget: int) -> Column:
    """Leading sentences without markup up to ``budget`` tokens, at least one; those without a letter or digit are left out."""
    plain = F.replace(F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1"), F.lit("`"), F.lit(""))
    plain = admonitions_stripped(F.regexp_replace(F.regexp_replace(plain, r"\*\*(.+?)\*\*", "$1"), r"\*(.+?)\*", "$1"))
    plain = F.regexp_replace(plain, r"(?m)^[ \t]*#{1,6}[ \t]+", "")
    lead = lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^\s*[-*+]\s+", ""), r"^\s*\d+\.\s+", ""), r"\s+", " "))
    found = F.filter(F.transform(F.split(plain, r"(?<=[.!?])\s+|(?<=[。！？])"), lead), lambda s: s.rlike(r"[\p{L}\p{N}]"))
    sized = F.transform(found, lambda s: F.struct(s.alias("s"), tx.token_count(s).alias("t")))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("over"))

    def take(a: Column, x: Column) -> Column:
        fits = ~a["over"] & ((F.size(a["kept"]) == 0) | (a["used"] + x["t"] <= budget))
        used = a["used"] + F.when(fits, x["t"]).otherwise(0)
        return F.struct(F.when(fits, F.array_append(a["kept"], x["s"])).otherwise(a["kept"]).alias("kept"), used.alias("used"), (~fits | (used >= budget)).alias("over"))

    return F.aggregate(sized, start, take, lambda a: F.array_join(a["kept"], " "))


def flagship(docs: DataFrame, ratio: float = 0.2, threshold: float = 0.25, most: int = MOST_CHUNKS) -> DataFrame:
    """Skeletons: sentence-packed chunks, hashed embeddings, similarity graph, PageRank, boosts, top chunks, one row a document.

    Documents of at most ``most`` chunks stay in their rows from text to skeleton; the others are chunked into rows.
    """
    rows = scored_documents(docs, threshold, most)
    order = F.array_sort(F.transform("scored.importance", lambda x, i: F.struct((-x).alias("less"), i.alias("i"))))
    best = F.transform(F.slice(order, F.lit(1), F.greatest(F.lit(1), F.floor(F.size("parts") * F.lit(ratio)).cast("int"))), lambda x: x["i"])
    rows = rows.withColumn("kept", F.array_sort(best))
    done = rows.select(
        "file_id", F.size("parts").cast("long").alias("total_nodes"), F.size("kept").cast("long").alias("anchor_nodes"),
        F.aggregate("tokens", F.lit(0).cast("long"), lambda a, t: a + t).alias("total_tokens"), F.transform("kept", lambda i: node_line(i, F.get("parts", i))).alias("lines"),
    )
    done, large = finished(done), large_documents(docs, most)
    return done if large is None else done.unionByName(rendered(select_top(scored_chunks(large, threshold), ratio)))


def scored_chunks(docs: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Staged sentence-packed chunks of documents with hashed vectors and their boosted PageRank as importance: for documents of any size."""
    from weftline.operators import graph as g

    chunks = staged(embed(chunk_documents(docs, budget=64)).withColumn("id", F.col("position").cast("long")), "chunks")
    edges = g.similarity_edges(chunks, threshold, group="file_id", id_col="id")
    ranks = g.pagerank_of_groups(edges, "file_id").select("file_id", F.col("node").alias("id"), "rank")
    scored = chunks.join(ranks, ["file_id", "id"], "left").withColumn("importance", F.coalesce("rank", F.lit(0.0)))
    return g.boosted(scored)


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` dealt anew if they lie in fewer partitions than tasks run at once: only where there are few bytes."""
    n = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(4 * n) if docs.rdd.getNumPartitions() < n else docs


def scored_documents(docs: DataFrame, threshold: float = 0.25, most: int = MOST_CHUNKS, keep: tuple[str, ...] = (), with_vectors: bool = False) -> DataFrame:
    """``scored_chunks`` as a row a document, without an exchange: (file_id, keep, parts, tokens, scored), for documents of 1 to ``most`` chunks.

    ``scored`` holds the chunks' importance and, if asked for, their vectors as the bytes of floats, one after the other.
    """
    from weftline.operators import graph as g

    @F.arrow_udf("importance array<double>, vectors binary")
    def scored(parts: pa.Array, boosts: pa.Array) -> pa.Array:
        import numpy as np

        ends = np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))])
        v, up = vectors(parts.flatten().to_pylist()), boosts.flatten().to_numpy(zero_copy_only=False)
        found = [(a, b, v[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        importance = [g.raised(g.vector_ranks(x, threshold), up[a:b]) for a, b, x in found]
        offsets = pa.array(ends, pa.int32())
        values = pa.array(np.concatenate(importance) if importance else np.zeros(0), pa.float64())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, values), pa.array([x.tobytes() if with_vectors else None for *_, x in found], pa.binary())], ["importance", "vectors"])

    rows = spread(docs.select("doc_id", "text", *keep))
    made = F.explode(F.array(chunk_parts(F.col("text"), 64)))  # made once, however many columns are made of it
    rows = rows.select(F.col("doc_id").alias("file_id"), *keep, made.alias("parts")).filter(F.size("parts").between(1, most))
    rows = rows.withColumns({"tokens": F.transform("parts", tx.token_count), "boosts": F.transform("parts", g.boost)})
    return rows.withColumn("scored", scored("parts", "boosts")).drop("boosts")


def large_documents(docs: DataFrame, most: int = MOST_CHUNKS) -> DataFrame | None:
    """The documents of more than ``most`` chunks, None if there are none.

    Two chunks in a row hold over 64 tokens, so at least 50 words, but for those that a heading parts; where sentences end without a space, one word is
    several. Only texts that may be cut into so many by their words and headings are chunked to be counted.
    """
    body = F.col("text")
    words = tx.word_count(body) + F.regexp_count(body, F.lit("[。！？]"))
    may = (F.length(body) > 3 * most) & (words / 25 + F.regexp_count(body, F.lit(r"(?m)^#{2,3} ")) + 1 > most)
    large = docs.filter(may).filter(F.size(chunk_parts(body, 64)) > most)
    return None if large.isEmpty() else large
