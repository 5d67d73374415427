"""Near duplicates by SuperMinHash signatures, banding, verification and union-find.

1. Equal shingle sets are one node, named by a hash of the set and its size. Each node's signature has
   ``SLOTS`` places. An element draws a random permutation of the places, one place at a level; at level j it offers its
   j plus a random fraction there, and each place keeps its least offer. Places compete by ranks of one
   permutation an element, so that a signature varies less than independent minima do; once every
   place holds an offer of the levels so far, no later one can win, and the set stops early. Sets of a batch
   go level by level together.
2. Bands of ``ROWS`` places are hashed; nodes that share a band meet at the band's least node. Bands with many nodes
   are looked up by broadcast, the others by an exchange; nodes meet at each leader once, whatever they share.
3. Gatherings are cut into blocks, and tasks take pairs of blocks. Signatures go first: a node without a
   partner whose signature is like enough stays out. The full sets of the others follow, and links are confirmed on them exactly.
4. Links that span the groups of a gathering (union-find in the task) join into components in Spark.

At a similarity of exactly 0.85 a pair shares no band with a probability of 6e-9, and fails the look at its signatures with one
below ``MISS``; pairs that are more alike are missed less. Confirmed links are exact, so that nothing is linked wrongly.

Defined results: a null text, an empty one and one without words have an empty set and are linked with nothing; fewer words
than a shingle has are one shingle; texts of any length are whole; copies and repeated rows are one node, however many there are;
rows that share a doc_id are one document; rows without one belong to their text's component and are kept only if it has no
document of that text or like it; extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftline.session import reachable

from .common import dropped, looked_up, staged
from .components import connected_components
from .jaccard import KEYS, _bitmap, _covered, _dealt, _groups, _links, _name, _same_id, _sets, _texts
from .shingles import mixed, shingle_set

#: Places of a signature (under 256), and of a band.
SLOTS, ROWS = 240, 6
#: Elements of a batch of sets; each takes ``SLOTS`` bytes while its set needs a second level.
BATCH = 50_000
#: Sets of a block of a gathering; a task holds two.
BLOCK = 2_000
#: The chance that the signatures of a pair at the threshold are taken for too different.
MISS = 1e-9

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_LEVEL, _NONE = np.uint64(56), np.uint64(2**64 - 1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``SLOTS`` numbers for each non-empty set of 64-bit hashes."""
    best = np.full((len(sets), SLOTS), _NONE, dtype=np.uint64)
    element = mixed(np.concatenate(sets) if sets else np.empty(0, np.uint64))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = None  # what is left of each element's permutation, from the second level on
    for level in range(SLOTS):
        if not len(element):
            break
        drawn = mixed(element + np.uint64(int(_A) * (2 * level + 1) & 2**64 - 1))
        at = level + (mixed(drawn ^ _B) % np.uint64(SLOTS - level)).astype(np.int64)
        offer = (np.uint64(level) << _LEVEL) | (drawn >> np.uint64(8))
        if order is None:
            place = at
        else:
            rows = np.arange(len(element))
            place = order[rows, at].astype(np.int64)
            order[rows, at] = order[rows, level]
        np.minimum.at(best.reshape(-1), owner * SLOTS + place, offer)
        open_sets = best.max(axis=1) >= (np.uint64(level + 1) << _LEVEL)  # later offers are this high at least
        stay = open_sets[owner]
        if order is None:
            element, owner, at = element[stay], owner[stay], at[stay]
            order = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(element), 1))
            order[np.arange(len(element)), at] = 0
        elif stay.sum() < 0.8 * len(stay):
            element, owner, order = element[stay], owner[stay], order[stay]
    return ((best ^ (best >> np.uint64(32))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def band_keys(found: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band of each signature."""
    parts = found.reshape(len(found), SLOTS // ROWS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(SLOTS // ROWS, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        keys = mixed((keys ^ parts[:, :, k]) * _A + np.uint64(k))
    return keys


def least_equal(similarity: float) -> int:
    """Equal places below which two signatures are too different: the most for which a pair at ``similarity`` has fewer with a chance of ``MISS`` at most."""

    def tail(c: int) -> float:  # Chernoff's bound on fewer than c of SLOTS
        x = c / SLOTS
        gain = (x * math.log(x / similarity) if x else 0.0) + ((1 - x) * math.log((1 - x) / (1 - similarity)) if x < 1 else 0.0)
        return math.exp(-SLOTS * gain)

    if similarity >= 1:
        return SLOTS
    return max((c for c in range(int(SLOTS * similarity)) if tail(c) <= MISS), default=0)


def alike(found: np.ndarray, firsts: np.ndarray | None, least: int) -> np.ndarray:
    """Which signatures have ``least`` places in common with another (if told, one of the other kind)."""
    near = np.zeros(len(found), dtype=bool)
    for i in range(len(found) - 1):
        rest = slice(i + 1, len(found))
        open_ = ~near[rest] if near[i] else np.ones(len(found) - i - 1, dtype=bool)  # two known ones need no look
        if firsts is not None:
            open_ &= firsts[rest] != firsts[i]
        at = np.flatnonzero(open_) + i + 1
        if len(at):
            hit = at[(found[at] == found[i]).sum(axis=1) >= least]
            near[hit] = True
            near[i] |= len(hit) > 0
    return near


def _survey(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, node, n, signature) of every row; the signature comes once a task and node."""
    kinds = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("signature", pa.binary())])

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows, sets, held = set(), [], [], 0

        def out() -> pa.RecordBatch:
            made = signatures([s for _, s in sets])
            columns = [list(c) for c in zip(*rows, strict=True)]
            texts: list[bytes | None] = [None] * len(rows)
            for (at, _), signature in zip(sets, made, strict=True):
                texts[at] = signature.astype("<u4").tobytes()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*columns, texts], kinds.types, strict=True)], schema=kinds)

        for doc_id, text in _texts(found):
            members = shingle_set(text, words)
            node = _name(members)
            if len(members) and (node, len(members)) not in known:
                known.add((node, len(members)))
                sets.append((len(rows), members))
                held += len(members)
            rows.append((doc_id, node, len(members)))
            if held > BATCH or len(rows) >= 10_000:
                yield out()
                rows, sets, held = [], [], 0
        if rows:
            yield out()

    return docs.mapInArrow(read, "doc_id long, node long, n long, signature binary")


def _bands(signed: DataFrame) -> DataFrame:
    """(token, node, n) for each band of each node."""

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for at in range(0, batch.num_rows, 2000):
                node, n, raw = batch.slice(at, 2000).columns
                keys = band_keys(np.frombuffer(b"".join(raw.to_pylist()), dtype="<u4").reshape(len(node), SLOTS))
                each = [np.repeat(c.to_numpy(), keys.shape[1]) for c in (node, n)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), *map(pa.array, each)], ["token", "node", "n"])

    return signed.select("node", "n", "signature").mapInArrow(read, "token long, node long, n long")


def _gatherings(entries: DataFrame) -> DataFrame:
    """(leader, node, n): nodes that share a band meet at its least node, once a leader."""
    lists = entries.groupBy("token").agg(F.min("node").alias("leader"), F.max("node").alias("last"), F.count("*").alias("size"))
    lists = staged(lists.filter("leader <> last").select("token", "leader", "size"), "minhash-bands")
    met = looked_up(entries, lists, ["token"], "size").filter("leader is not null")
    out = staged(met.groupBy("leader", "node", "n").agg(F.lit(1).alias("_")).drop("_"), "minhash-gatherings")
    dropped(lists)
    return out


def _alike(gathered: DataFrame, signed: DataFrame, least: int) -> DataFrame:
    """The rows of ``gathered`` whose signature is like another's there."""

    def solve(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch_of(out: list) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["leader", "node", "n"])

        for (leader, i, j), rows in _groups(found):
            made = np.frombuffer(b"".join(r[3] for r in rows), dtype="<u4").reshape(len(rows), SLOTS)
            near = alike(made, np.array([r[0] for r in rows]) if i != j else None, least)
            out += [(leader, rows[k][1], rows[k][2]) for k in np.flatnonzero(near)]
            if len(out) > 50_000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    sizes = gathered.groupBy("leader").agg(F.count("*").alias("sets"))
    sizes = staged(sizes.withColumn("blocks", F.ceil(F.col("sets") / BLOCK).cast("int")), "minhash-sizes")
    work = looked_up(gathered, sizes, ["leader"], "sets").filter("blocks is not null")
    work = work.withColumn("own", F.pmod(F.xxhash64("node", "n", F.lit(7)), F.col("blocks")).cast("int"))
    work = work.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = work.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).withColumn("first", F.col("own") == F.col("i"))
    work = work.select(*KEYS, "first", "node", "n").join(signed, ["node", "n"])
    out = staged(_dealt(work, "signature").mapInArrow(solve, "leader long, node long, n long").distinct(), "minhash-alike", arrow_rows=2000)
    dropped(sizes)
    return out


def near_duplicates(docs: DataFrame, words: int = 5, similarity: Fraction | str = "0.8", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, node, component_id, kept) for every row of ``docs``.

    Two documents link when their sets' Jaccard similarity is at least ``similarity`` (compared in whole numbers);
    ``component_id`` is the least doc_id that links reach, the document's own included. ``node`` names its class of equal sets.
    """
    spark, share = docs.sparkSession, Fraction(similarity)
    reachable(spark)
    num, den = share.numerator, share.denominator
    if not 0.5 <= share <= 1:
        raise ValueError("bands are made for a similarity of 0.5 to 1")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = staged(_survey(docs, words), "minhash-survey")
    signed = rows.filter("signature is not null").select("node", "n", "signature")
    met = _gatherings(_bands(signed))
    near = _alike(met, signed.dropDuplicates(["node", "n"]), least_equal(float(share)))
    gathered = staged(_covered(near), "minhash-covered")
    bitmap = spark.sparkContext.broadcast(_bitmap(gathered.select("node")))
    links = staged(_links(gathered, _sets(docs, words, bitmap), num, den), "minhash-links", arrow_rows=200)
    dropped(met, near, gathered)
    return _named(rows.select("doc_id", "node", "n"), links)


def _named(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Each row's component: nodes that links or a common doc_id join, named by their least document."""
    full = rows.filter("n > 0")
    nodes = staged(full.groupBy("node", "n").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")), "minhash-nodes")
    edges = links.select(F.xxhash64("a", "a_n").alias("a"), F.xxhash64("b", "b_n").alias("b"))
    components = connected_components(edges.union(_same_id(rows).select(F.xxhash64("a", "a_n"), F.xxhash64("b", "b_n"))))
    joined = nodes.withColumn("id", F.xxhash64("node", "n")).join(components.withColumnRenamed("node", "id"), "id", "left")
    joined = staged(joined.withColumn("component", F.coalesce("component", "id")), "minhash-components")
    # a component may hold many nodes: its least document is looked up, not joined by its name alone
    least = staged(joined.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("nodes")), "minhash-least")
    named = staged(looked_up(joined.select("node", "n", "copies", "component"), least, ["component"], "nodes").drop("component"), "minhash-named")
    dropped(nodes, joined, least)
    found = looked_up(full, named, ["node", "n"], "copies").unionByName(rows.filter("n = 0").withColumn("component_id", F.col("doc_id")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "node", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def without_near_duplicates(docs: DataFrame, words: int = 5, similarity: Fraction | str = "0.8") -> DataFrame:
    """``docs`` with one row of each component, that of the least doc_id; rows without a doc_id all stay."""
    stay = near_duplicates(docs, words, similarity).filter("kept AND doc_id is not null").select(F.col("doc_id").alias("_stay")).distinct()
    named = docs.join(stay, docs["doc_id"] == stay["_stay"], "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.filter("doc_id is null"))
