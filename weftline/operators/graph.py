"""Similarity graphs over vectors, their ranking and importance."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weftline.functions import numbers as num
from weftline.staging import dropped, staged

from .grouped import by_group_arrays

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa


#: Blocks of a group: few enough that its rows' copies grow with its rows, of at most ``LARGEST`` rows each.
MOST_BLOCKS, LARGEST, STRIP = 32, 16_384, 1024


def _blocks(n: Column, block: int) -> Column:
    """How many blocks ``n`` rows are cut into: of about ``block`` rows, but no more than ``MOST_BLOCKS`` while these hold ``LARGEST`` rows each."""
    return F.greatest(F.lit(1), F.ceil(n / LARGEST), F.least(F.lit(MOST_BLOCKS), F.ceil(n / block))).cast("int")


def _products(a: np.ndarray, b: np.ndarray, near: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, product) where ``near`` holds, a strip of rows at a time."""
    import numpy as np

    found = []
    for k in range(0, len(a), STRIP):
        x, y = np.nonzero(near(w := a[k : k + STRIP] @ b.T))
        found.append((x + k, y, w[x, y]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _forest(a: list[int], b: list[int]) -> list[int]:
    """The places of pairs that link what no pair before them linked, by union-find."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if (x := top(x)) != (y := top(y)):
            root[x] = y
            kept.append(k)
    return kept


def similarity_edges(nodes: DataFrame, threshold: float, group: str = "label", id_col: str = "vec_id", embedding: str = "embedding", block: int = 256, unit: bool = True) -> DataFrame:
    """(group, src, dst, weight) with src < dst and cosine above ``threshold`` within a group.

    A group's vectors are cut into blocks of about ``block``, or into ``MOST_BLOCKS`` larger ones; tasks take pairs of blocks and
    multiply them, so that a large group is spread over many tasks and no pair below the
    threshold is ever a row.
    """
    sized = nodes.select(F.col(group).alias("grp"), F.col(id_col).alias("id"), F.col(embedding).alias("v")).filter(num.finite_vector(F.col("v")))
    totals = sized.groupBy("grp").agg(_blocks(F.count("*"), block).alias("blocks"))
    placed = sized.join(totals, "grp").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def multiply(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        import numpy as np

        i, j, own, ids = part.column("i")[0].as_py(), part.column("j")[0].as_py(), part.column("own").to_numpy(), part.column("id").to_numpy()
        left, right = own == i, own == j
        if not left.any() or not right.any():
            return ids[:0], ids[:0], np.zeros(0)
        v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.float64)
        a, b = v[left], v[right]
        if not unit:
            a, b = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (a, b))
        x, y, w = _products(a, b, lambda p: p > threshold)
        one, two = ids[left][x], ids[right][y]
        keep = one < two if i == j else one != two
        return np.minimum(one, two)[keep], np.maximum(one, two)[keep], w[keep]

    kind = placed.schema["grp"].dataType.simpleString()
    out = by_group_arrays(placed.select("grp", "i", "j", "own", "id", "v"), ["grp", "i", "j"], multiply, f"grp {kind}, i int, j int, src long, dst long, weight double")
    return out.select(F.col("grp").alias(group), "src", "dst", "weight")


def cross_group_pairs(nodes: DataFrame, threshold: float, group: str = "label", id_col: str = "vec_id", embedding: str = "embedding", block: int = 512, spanning: bool = False) -> DataFrame:
    """(a, b, similarity) of vectors of different groups with cosine of at least ``threshold``, to 4 places.

    Every vector meets every other through pairs of blocks; only pairs that reach the threshold
    become rows. With ``spanning``, of each two blocks' pairs only so many as link the same vectors: for components.
    """
    blocks = nodes.agg(_blocks(F.count("*"), block)).first()[0]
    placed = nodes.select(F.col(group).alias("grp"), F.col(id_col).alias("id"), F.col(embedding).alias("v")).filter(num.finite_vector(F.col("v")) & (num.norm(F.col("v")) > 0))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    placed = placed.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        left, right = pdf[pdf.own == pdf.i.iloc[0]], pdf[pdf.own == pdf.j.iloc[0]]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        a, b = (np.array(x.v.tolist(), dtype=np.float64).reshape(len(x), -1) for x in (left, right))
        a, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (a, b))
        x, y, w = _products(a, b, lambda p: p >= threshold)
        one, two = left.id.to_numpy()[x], right.id.to_numpy()[y]
        keep = (one < two if pdf.i.iloc[0] == pdf.j.iloc[0] else one != two) & (left.grp.to_numpy()[x] != right.grp.to_numpy()[y])
        one, two, w = np.minimum(one, two)[keep], np.maximum(one, two)[keep], w[keep]
        if spanning:
            forest = _forest(one.tolist(), two.tolist())
            one, two, w = one[forest], two[forest], w[forest]
        return pd.DataFrame({"a": one, "b": two, "similarity": w})

    return placed.groupBy("i", "j").applyInPandas(multiply, "a long, b long, similarity double").withColumn("similarity", F.round("similarity", 4))


def _rank(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, alpha: float, rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    import numpy as np

    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    n, one, two, other = len(ids), at[: len(src)], at[len(src) :], src != dst
    rows, cols = np.concatenate([one, two[other]]), np.concatenate([two, one[other]])
    weight = np.concatenate([weight, weight[other]])
    out = np.bincount(rows, weight, n)
    share = weight / np.where(out[rows] > 0, out[rows], 1)
    rank = np.full(n, 1 / n)
    for _ in range(rounds):
        new = alpha * (np.bincount(cols, rank[rows] * share, n) + rank[out <= 0].sum() / n) + (1 - alpha) / n
        change = np.abs(new - rank).sum()
        rank = new
        if change < n * tolerance:
            break
    return ids, rank


def vector_ranks(v: np.ndarray, threshold: float, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> np.ndarray:
    """The rank of each of a group's vectors of length 1 in the graph of ``similarity_edges``, 0 for those without an edge."""
    import numpy as np

    v, out = v.astype(np.float64), np.zeros(len(v))
    if len(v) < 2:
        return out
    x, y, w = _products(v, v, lambda p: p > threshold)
    once = x < y
    if once.any():
        ids, rank = _rank(x[once], y[once], w[once], alpha, rounds, tolerance)
        out[ids] = rank
    return out


def pagerank_by_group(edges: DataFrame, group: str = "label", alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(group, node, rank) of undirected weighted graphs, one a group, each small enough for a task."""

    def solve(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        return _rank(*(part.column(c).to_numpy(zero_copy_only=False) for c in ("src", "dst", "weight")), alpha, rounds, tolerance)

    kind = edges.schema[group].dataType.simpleString()
    return by_group_arrays(edges.select(F.col(group).alias("grp"), "src", "dst", "weight"), ["grp"], solve, f"grp {kind}, node long, rank double").withColumnRenamed("grp", group)


#: Nodes whose ranks are sent to every task, so that a round exchanges sums by node and no edges.
MOST_SENT = 1_000_000


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 120, tolerance: float = 1e-6, every: int = 10, in_task: int = 1_000_000) -> DataFrame:
    """(node, rank) of one undirected weighted graph of any size.

    A graph of at most ``in_task`` edges is ranked in a task, a larger one by joins and sums to the same rule, with the ranks staged
    every few rounds, or each round where they are few enough to be sent to every task. Weights are not negative; nodes whose edges all weigh 0 spread their rank over all nodes. It stops when ranks change by less than ``tolerance`` a node, in the joins since they were
    last staged; a round shrinks the change by ``alpha``, so that at the default values it always gets there.
    """
    edges = staged(edges.select("src", "dst", "weight"), "rank-edges")
    if edges.count() <= in_task:
        return pagerank_by_group(edges.withColumn("grp", F.lit(0)), "grp", alpha, rounds, tolerance).select("node", "rank")
    both = edges.union(edges.filter("src <> dst").select("dst", "src", "weight"))
    nodes = staged(both.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("total")), "rank-nodes")
    out = nodes.filter("total > 0").withColumnRenamed("node", "src")
    share = staged(both.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "rank-shares")
    n, n_loose = nodes.agg(F.count("*"), F.count(F.when(F.col("total") <= 0, 1))).first()
    if not n:
        return nodes.select("node", F.col("total").cast("double").alias("rank"))
    loose, rank = 1.0 / n, staged(nodes.select("node", F.lit(1.0 / n).alias("rank")), "ranks")
    before, few = rank, n <= MOST_SENT
    for k in range(1, rounds + 1):
        moved = share.join(F.broadcast(rank) if few else rank, share["src"] == rank["node"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("sum"))
        # nodes without weight have all the same rank: a number that needs no job
        spare = n_loose * loose / n
        loose = alpha * spare + (1 - alpha) / n
        got = F.coalesce("sum", F.lit(0.0)) + spare
        joined = nodes.join(moved, nodes["node"] == moved["dst"], "left")
        last, rank = rank, joined.select("node", (alpha * got + (1 - alpha) / n).alias("rank"))
        checked = k % every == 0 or k == rounds
        if few or checked:
            rank = staged(rank, "ranks")
        if few and last is not before:
            dropped(last)
        if not checked:
            continue
        change = rank.join(before.select("node", F.col("rank").alias("old")), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        dropped(before)
        before = rank
        if change < n * tolerance:
            break
    return rank


def pagerank_of_groups(edges: DataFrame, group: str = "label", alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, in_task: int = 250_000) -> DataFrame:
    """(group, node, rank) as ``pagerank_by_group`` has it, for groups of any size.

    Groups of at most ``in_task`` edges are ranked in a task each, larger ones together by joins and sums: every group by its own number of nodes and until
    its own change is below the tolerance. Ranks are staged each round and sent to the edges where they are few, so that a round exchanges sums by node.
    """
    kind = edges.schema[group].dataType.simpleString()
    edges = staged(edges.select(F.col(group).alias("grp"), "src", "dst", "weight"), "rank-edges")
    large = edges.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") > in_task).select("grp")
    large = staged(large, "rank-groups")  # each of over in_task edges: few
    small = edges.join(F.broadcast(large), edges["grp"].eqNullSafe(large["grp"]), "left_anti") if (many := large.count()) else edges
    done = pagerank_by_group(small, "grp", alpha, rounds, tolerance)
    if not many:
        return done.withColumnRenamed("grp", group)
    names = staged(large.withColumn("g", F.monotonically_increasing_id()), "rank-groups")
    kept = edges.join(F.broadcast(names), edges["grp"].eqNullSafe(names["grp"])).select("g", "src", "dst", "weight")
    turned = lambda a, b: F.when((F.col("src") != F.col("dst")) | F.lit(a == "src"), F.struct(F.col(a).alias("node"), F.col(b).alias("other")))
    ends = kept.select("g", F.explode(F.array(turned("src", "dst"), turned("dst", "src"))).alias("e"), "weight").filter("e is not null")
    nodes = ends.groupBy("g", "e.node").agg(F.sum("weight").alias("total"))
    counts = nodes.groupBy("g").agg(F.count("*").alias("n"))
    state = staged(nodes.join(F.broadcast(counts), "g").select("g", "node", "total", "n", (1 / F.col("n")).alias("rank"), F.lit(0.0).alias("moved"), F.lit(True).alias("open")), "ranks")
    few = state.count() <= MOST_SENT
    held = F.broadcast if few else lambda df: df
    for _ in range(rounds):
        sent = state.filter("open").select("g", "node", F.when(F.col("total") > 0, F.col("rank") / F.col("total")).otherwise(0.0).alias("q"))
        one, two = sent.select("g", F.col("node").alias("src"), F.col("q").alias("p")), sent.select("g", F.col("node").alias("dst"), "q")
        met = kept.join(held(one), ["g", "src"]).join(held(two), ["g", "dst"])
        both = F.array(F.struct(F.col("dst").alias("node"), (F.col("p") * F.col("weight")).alias("x")), F.when(F.col("src") != F.col("dst"), F.struct(F.col("src").alias("node"), (F.col("q") * F.col("weight")).alias("x"))))
        got = met.select("g", F.explode(both).alias("e")).filter("e is not null").groupBy("g", "e.node").agg(F.sum("e.x").alias("x"))
        spare = state.groupBy("g").agg(F.sum(F.when(F.col("total") <= 0, F.col("rank")).otherwise(0.0)).alias("spare"))
        new = alpha * (F.coalesce("x", F.lit(0.0)) + F.col("spare") / F.col("n")) + (1 - alpha) / F.col("n")
        rank = F.when(F.col("open"), new).otherwise(F.col("rank"))
        after = state.join(got, ["g", "node"], "left").join(F.broadcast(spare), "g").select("g", "node", "total", "n", rank.alias("rank"), F.when(F.col("open"), F.abs(new - F.col("rank"))).otherwise(0.0).alias("moved"), "open")
        after = staged(after, "ranks")
        change = after.groupBy("g").agg((F.sum("moved") >= F.first("n") * tolerance).alias("still"))
        last, state = state, staged(after.join(F.broadcast(change), "g").withColumn("open", F.col("open") & F.col("still")).drop("still"), "ranks")
        dropped(last, after)
        if not state.filter("open").limit(1).count():
            break
    ranked = state.join(F.broadcast(names), "g").select(F.col("grp").cast(kind).alias("grp"), "node", "rank")
    return done.unionByName(ranked).withColumnRenamed("grp", group)


def cells(nodes: DataFrame, threshold: float, id_col: str = "vec_id", embedding: str = "embedding", recall: float = 0.95, size: int = 200, most_tables: int = 64, seed: int = 7) -> DataFrame:
    """(cell, id, v): each vector in one cell of each table of random hyperplanes, so that a pair at ``threshold`` shares a cell with a chance of ``recall`` at least.

    A table's hyperplanes are as many as make cells of about ``size`` vectors, but not so many that ``most_tables`` tables couldn't reach the recall.
    Vectors without a direction have no cell.
    """
    import math

    import numpy as np

    rows = nodes.select(F.col(id_col).alias("id"), F.col(embedding).alias("v")).filter(num.finite_vector(F.col("v")) & (num.norm(F.col("v")) > 0))
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    same_side = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    bits = max(1, min(30, math.ceil(math.log2(max(2, n / size)))))
    tables = lambda b: 1 if same_side >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - same_side**b))
    while bits > 1 and tables(bits) > most_tables:
        bits -= 1
    n_tables, width = tables(bits), width or 1
    planes = np.random.default_rng(seed).normal(size=(width, n_tables * bits)).astype(np.float32)
    powers = (1 << np.arange(bits)).astype(np.int64)

    @F.pandas_udf("array<long>")
    def codes(vectors: pd.Series) -> pd.Series:
        sides = (np.array(vectors.tolist(), dtype=np.float32).reshape(len(vectors), -1) @ planes > 0).reshape(len(vectors), n_tables, bits)
        return pd.Series(list(sides @ powers + (np.arange(n_tables, dtype=np.int64) << 32)))

    return rows.withColumn("cell", F.explode(codes("v"))).select("cell", "id", "v")


def near_pairs(nodes: DataFrame, threshold: float, id_col: str = "vec_id", embedding: str = "embedding", recall: float = 0.95, block: int = 256) -> DataFrame:
    """(a, b, similarity) of vectors with cosine above ``threshold``, by ``cells``; exact within them, to 4 places.

    Equal vectors are one: only the least id of each enters the cells and pairs, and its copies are its pairs with similarity 1.
    A pair at the threshold is found with a chance of ``recall``, a nearer one with a higher; ``cross_group_pairs`` finds all, by looking at all.
    """
    key = F.sha2(F.to_json(F.struct(embedding)), 256)
    named = nodes.select(F.col(id_col).alias("id"), F.col(embedding).alias("v"), key.alias("key")).filter(num.finite_vector(F.col("v")) & (num.norm(F.col("v")) > 0))
    firsts = staged(named.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("v").alias("v")), "vector-classes")
    found = similarity_edges(cells(firsts, threshold, "first", "v", recall), threshold, group="cell", id_col="id", embedding="v", block=block, unit=False)
    pairs = found.groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.round(F.max("weight"), 4).alias("similarity"))
    repeated = firsts.filter("copies > 1").select("key", "first")
    copies = named.join(repeated, "key").filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return pairs.unionByName(copies)


#: Rows of a block whose vectors are only counted against another's, a tile at a time: a block may be large, and its copies few.
COUNTED, TILE = 65_536, 256


def near_links(nodes: DataFrame, threshold: float, id_col: str = "vec_id", embedding: str = "embedding", block: int = 1024) -> DataFrame:
    """(id, class_id, copies, links) of every row: the least id of its class, the rows of that class, and the other classes with cosine above ``threshold``.

    Equal vectors are one class; rows whose vectors are not finite or have no direction are classes of their own, without links. Every class meets every
    other through pairs of blocks, and a task returns counts by class: no pair is ever a row, so that what is exchanged grows with the rows and not with the
    links. Products are made in single precision and those near the threshold again in double. Ids are long, vectors of one length.
    """
    key = F.sha2(F.to_json(F.struct(F.col("v"))), 256)
    rows = nodes.select(F.col(id_col).alias("id"), F.col(embedding).alias("v"))
    usable = F.coalesce(num.finite_vector(F.col("v")) & (num.norm(F.col("v")) > 0), F.lit(False))
    named = staged(rows.withColumn("key", F.when(usable, key)), "vectors")
    classes = staged(named.filter("key is not null").groupBy("key").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"), F.first("v").alias("v")), "vector-classes")
    n = classes.count()
    blocks = max(1, -(-n // COUNTED), min(12, -(-n // block)))
    placed = classes.select(F.col("class_id").alias("id"), "v", F.pmod(F.xxhash64("class_id"), F.lit(blocks)).cast("int").alias("own"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def count(table: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow as pa

        ids, own, v = table["id"].to_numpy(), table["own"].to_numpy(), table["v"].combine_chunks()
        v = v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        low, high = own == table["i"][0].as_py(), own == table["j"][0].as_py()
        same = table["i"][0].as_py() == table["j"][0].as_py()

        def unit(m: np.ndarray) -> np.ndarray:
            m = m.astype(np.float64)
            return m / np.linalg.norm(m, axis=1, keepdims=True)

        def gathered(x: np.ndarray) -> np.ndarray:
            """An order in which like vectors lie together, so that most tiles hold no link and are only looked at for their largest product."""
            return np.argsort((x @ x[:: max(1, len(x) // 64)].T).argmax(axis=1), kind="stable")

        def links(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            left, right, p, q = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), gathered(x), gathered(y)
            x, y = x[p], y[q]
            single, to = x.astype(np.float32), y.astype(np.float32)
            for i, j in itertools.product(range(0, len(x), TILE), range(0, len(y), TILE)):
                part = single[i : i + TILE] @ to[j : j + TILE].T
                if part.max() <= threshold - 1e-5:
                    continue
                near = part > threshold + 1e-5
                c, d = np.nonzero((part > threshold - 1e-5) ^ near)
                near[c, d] = np.einsum("ij,ij->i", x[i + c], y[j + d]) > threshold
                left[p[i : i + TILE]] += near.sum(axis=1)
                right[q[j : j + TILE]] += near.sum(axis=0)
            return left, right

        a, b = unit(v[low]), unit(v[high])
        left, right = links(a, b)
        if same:  # each met itself
            found, counts = ids[low], left - (np.einsum("ij,ij->i", a, a) > threshold)
        else:
            found, counts = np.concatenate([ids[low], ids[high]]), np.concatenate([left, right])
        some = counts > 0
        return pa.table({"id": found[some], "links": counts[some]}, schema=pa.schema([("id", pa.int64()), ("links", pa.int64())]))

    met = placed.groupBy("i", "j").applyInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.drop("v").join(met.withColumnRenamed("id", "class_id"), "class_id", "left")
    out = named.select("id", "key").join(known, "key", "left")
    return out.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))


def min_max(rows: DataFrame, value: str, group: str, to: str = "normalised") -> DataFrame:
    """Values of a group stretched to 0..1; equal values give 1."""
    w = W.partitionBy(group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return rows.withColumn(to, F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(1.0))


#: What raises a chunk's importance, and by how much.
BOOSTS = {
    r"(?m)^# ": 0.5,
    r"(?m)^## ": 0.3,
    r"(?i)\b(CRITICAL|HIGH|P0|BLOCKER)\b": 0.4,
    r"(?i)\b(verdict|conclusion|summary|finding|result|status)s?\b": 0.3,
    r"(?m)^\d+\.": 0.2,
}


def boost(text: Column) -> Column:
    total: Column = F.lit(0.0)
    for pattern, by in BOOSTS.items():
        total = total + F.when(text.rlike(pattern), by).otherwise(0.0)
    return total


def boosted(chunks: DataFrame, group: str = "file_id", text: str = "text", importance: str = "importance") -> DataFrame:
    """Importance raised by ``BOOSTS`` and stretched to 0..1 in groups where anything was raised."""
    rows = chunks.withColumn("_raised", F.col(importance) + boost(F.col(text))).withColumn("_any", F.max(boost(F.col(text)) > 0).over(W.partitionBy(group)))
    rows = min_max(rows, "_raised", group, "_scaled")
    return rows.withColumn(importance, F.when(F.col("_any"), F.col("_scaled")).otherwise(F.col(importance))).drop("_raised", "_any", "_scaled")


def raised(importance: np.ndarray, boosts: np.ndarray) -> np.ndarray:
    """``boosted`` for the nodes of one group."""
    import numpy as np

    if not (boosts > 0).any():
        return importance
    x = importance + boosts
    return (x - x.min()) / (x.max() - x.min()) if x.max() > x.min() else np.ones(len(x))


def density(edges: DataFrame, nodes: DataFrame, group: str) -> DataFrame:
    """(group, n_nodes, n_edges, density): share of possible edges, at most 1."""
    n = nodes.groupBy(group).agg(F.count("*").alias("n_nodes"))
    m = edges.groupBy(group).agg(F.count("*").alias("n_edges"))
    possible = F.col("n_nodes") * (F.col("n_nodes") - 1) / 2
    both = n.join(m, group, "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    return both.withColumn("density", F.when(possible > 0, F.least(F.col("n_edges") / possible, F.lit(1.0))).otherwise(0.0))


def graph_hash(edges: DataFrame, nodes: DataFrame, group: str = "label", id_col: str = "vec_id", places: int = 4) -> DataFrame:
    """(group, hash): 16 digits that change with a group's nodes, edges or weights (to ``places`` places), whatever their order.

    Rows are hashed on their own and summed, so that no group is gathered or sorted.
    """
    e = edges.select(F.col(group), F.concat_ws("|", F.lit("e"), F.col("src").cast("string"), F.col("dst").cast("string"), F.format_string(f"%.{places}f", F.col("weight"))).alias("x"))
    n = nodes.select(F.col(group), F.concat_ws("|", F.lit("n"), F.col(id_col).cast("string")).alias("x"))
    part = F.conv(F.substring(F.sha1("x"), 1, 12), 16, 10).cast("decimal(38,0)")
    rows = e.unionByName(n).groupBy(group).agg(F.sum(part).cast("string").alias("s"))
    return rows.select(group, F.substring(F.sha1(F.concat_ws(":", F.col(group).cast("string"), "s")), 1, 16).alias("hash"))


def degrees(edges: DataFrame, nodes: DataFrame, group: str = "label", id_col: str = "vec_id") -> DataFrame:
    """(group, id, degree) for every node."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select(group, F.col(id_col).alias("id")).join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def explain(ranked: DataFrame, edges: DataFrame, ratio: float, group: str = "label", id_col: str = "id", importance: str = "importance") -> DataFrame:
    """For each node its rank, percentile, number of neighbours and whether selection keeps it."""
    w = W.partitionBy(group)
    rows = ranked.withColumns({"rank": F.row_number().over(w.orderBy(F.desc(importance), id_col)), "n": F.count("*").over(w)})
    near = edges.select(F.explode(F.array("src", "dst")).alias(id_col)).groupBy(id_col).agg(F.count("*").alias("neighbours"))
    kept = F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") * ratio))
    return rows.join(near, id_col, "left").select(group, id_col, importance, "rank", F.round(1 - (F.col("rank") - 1) / F.col("n"), 4).alias("percentile"), F.coalesce("neighbours", F.lit(0)).alias("neighbours"), kept.alias("kept"))


def export(nodes: DataFrame, edges: DataFrame, least: float, most: int, id_col: str = "id", importance: str = "importance") -> tuple[DataFrame, DataFrame]:
    """Nodes of at least ``least``, the ``most`` most important, and the edges between them."""
    kept = nodes.filter(F.col(importance) >= least).orderBy(F.desc(importance), id_col).limit(most)
    ids = kept.select(F.col(id_col).alias("_id"))
    inside = edges.join(ids, edges["src"] == ids["_id"], "left_semi").join(ids, F.col("dst") == F.col("_id"), "left_semi")
    return kept, inside


def graphml(nodes: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """Lines of a GraphML file in order (part, key, value)."""
    head = nodes.sparkSession.createDataFrame([(0, 0, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="undirected">'), (3, 0, "</graph></graphml>")], "part int, key long, value string")
    n = nodes.select(F.lit(1).alias("part"), F.col(id_col).cast("long").alias("key"), F.format_string('<node id="%s"/>', F.col(id_col).cast("string")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.col("src").cast("long").alias("key"), F.format_string('<edge source="%s" target="%s"/>', F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))
    return head.unionByName(n).unionByName(e)
