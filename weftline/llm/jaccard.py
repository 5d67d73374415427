"""Exact Jaccard joins of shingle sets, reduced to links between classes of equal sets.

The join follows set-relation skipping:

1. Equal sets are one node, named by a hash of the set and its size. Work from here on is on
   nodes, so that a text copied a million times is joined once.
2. Shingles get a global order: those of many sets last, and of the others those of rare words
   first, which are hardly shared by chance. Two tables, sized by the number of documents within
   bounds, count shingles and words over all sets (one slot per hash bucket, summed over tasks). The order only steers the work;
   any order gives the same links.
3. Two sets of the wanted similarity share a shingle among the first few of each (its prefix).
   Prefix entries form the index lists; the least entry of a list (nodes are
   named by a hash) is its leader, and
   each entry's set goes to the leaders of its lists, once each. Two entries of one list meet at
   that list's leader, so that no pair is missed, and no pair is ever a row.
4. First only parity bitmaps go to the leaders, a bit or two for each shingle: two bitmaps differ in
   no more bits than the sets differ in members, so that a set without a partner close enough
   stays at home. The sets of the others follow, but not to leaders all of whose sets meet
   elsewhere too.
5. A leader's gathering is cut into blocks of bounded size, and tasks take pairs of blocks. Within
   one, the index lists are kept by size and then by position, in runs of ``RUN`` entries with their least
   position: sizes out of range are skipped by bisection, and of the rest each run that lies too late
   to leave enough shingles, at once. The overlaps of a set with all others are derived from those of
   the most similar of the last ``ANSWERED`` answered sets: only lists of shingles in which the two
   differ are read. A task returns links that span its groups, not all links.

Sets are recomputed from the texts where needed, and only for nodes that have a partner, told by a
bitmap of fixed size.

Defined results: null texts, empty texts and texts without words have the empty set, which links
with nothing; texts of any length are read whole; a similarity of just the threshold links; repeated rows are
members of one class; rows that share a doc_id share a component; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from weftline.session import reachable

from .common import dropped, looked_up, spread, staged, task_started
from .components import connected_components
from .shingles import runs_of, shingle_set, word_hashes

#: Slots of each table of counts, 4 bytes each: a power of two near an eighth of the number of documents, within these bounds.
#: The second table, for words, follows the first.
LEAST_BUCKETS, MOST_BUCKETS = 1 << 20, 1 << 23
PARTS = 16
#: A list is long if its slot counts more sets than this; no other list is longer.
LONG = 2_000
#: Entries of an index list that are skipped together, and answered sets to derive answers from.
RUN, ANSWERED = 64, 3
#: Shingles that a row counts for at least where memory is bounded by shingles.
ROW = 64
#: Shingles in a block of a leader's gathering when sets, or only their bitmaps, are compared; a task holds two blocks.
BLOCK, BITMAP_BLOCK = 500_000, 16_000_000
#: Bits of the bitmap of nodes with a partner.
BITS = 1 << 24


def needed(n: int | np.ndarray, m: int | np.ndarray, num: int, den: int):
    """The least overlap with which sets of n and m members reach the similarity num / den."""
    return -((-num * (n + m)) // (num + den))


def prefix_length(n: int, num: int, den: int) -> int:
    """Members of which at least one must be shared, whatever the size of the other set."""
    return n - -(-num * n // den) + 1


def parity_bits(n: int) -> int:
    """Bits of the bitmap of a set of n members: the power of two from n up, 64 at least."""
    return max(64, 1 << max(0, n - 1).bit_length())


def parity(members: np.ndarray) -> bytes:
    """For each bit, whether an odd number of members falls on it."""
    bits = parity_bits(len(members))
    odd = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _name(members: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(members.tobytes()))))


def _buckets(n_documents: int) -> int:
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (n_documents // 8).bit_length()))


def _bucket(members: np.ndarray, buckets: int) -> np.ndarray:
    return (members & np.uint64(buckets - 1)).astype(np.int64)


def _texts(found: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    task_started()
    for batch in found:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def _survey(docs: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """The node of each document, and how many sets (copies in one task counted once) fall in each bucket."""
    size = _buckets(docs.count())

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known, rows, held, n_held = np.zeros(2 * size, dtype=np.int64), set(), [], [], 0
        kinds = {"doc_id": pa.int64(), "node": pa.int64(), "n": pa.int64(), "bitmap": pa.binary(), "part": pa.int32(), "counts": pa.binary()}

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

        for doc_id, text in _texts(found):
            hashes = word_hashes(text)
            members = np.unique(runs_of(hashes, words))
            node = _name(members)
            fresh = node not in known and len(members) > 0
            rows.append((doc_id, node, len(members), parity(members) if fresh else None, None, None))
            if fresh:
                known.add(node)
                held += [_bucket(members, size), _bucket(hashes, size) + size]
                n_held += len(members)
            if n_held > size // 4:
                counts += np.bincount(np.concatenate(held), minlength=2 * size)
                held, n_held = [], 0
            if len(rows) >= 10_000:
                yield out(rows)
                rows = []
        if held:
            counts += np.bincount(np.concatenate(held), minlength=2 * size)
        if known:
            rows += [(None, None, None, None, k, x.astype("<i4").tobytes()) for k, x in enumerate(np.split(counts, PARTS))]
        if rows:
            yield out(rows)

    both = staged(docs.mapInArrow(read, "doc_id long, node long, n long, bitmap binary, part int, counts binary"), "jaccard-survey")

    def total(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in found:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, dtype="<i4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(x, 2**31 - 1).astype("<i4").tobytes() for x in sums.values()], pa.binary())], ["part", "counts"])

    tables = both.filter("part is not null").select("part", "counts").repartition(PARTS, "part").mapInArrow(total, "part int, counts binary")
    counts = np.zeros((PARTS, 2 * size // PARTS), dtype=np.int32)
    for row in tables.collect():  # PARTS rows
        counts[row.part] = np.frombuffer(row.counts, dtype="<i4")
    return both.filter("part is null").select("doc_id", "node", "n", "bitmap"), counts.reshape(-1)


def _prefix(hashes: np.ndarray, words: int, counts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(all members, the first of them in the global order): by the power of two of the slot's count, by the words' frequency, by hash."""
    members, first = np.unique(runs_of(hashes, words), return_index=True)
    if not len(members):
        return members, members
    size = len(counts) // 2
    commonness = np.log2(1.0 + counts[_bucket(hashes, size) + size])
    n = min(words, len(hashes))
    common = sum(commonness[k : len(hashes) - n + 1 + k] for k in range(n))[first]
    level = np.frexp(counts[_bucket(members, size)].astype(np.float64))[1]
    return members, members[np.lexsort((members, np.round(4 * common), level))][: prefix_length(len(members), num, den)]


def _entries(docs: DataFrame, words: int, num: int, den: int, counts) -> DataFrame:
    """(token, node, n, long) of every prefix entry of every node; ``long`` where the token's list may be long."""

    limit = LONG

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, n_held = set(), [], 0

        def out(held: list) -> pa.RecordBatch:
            sizes = [len(p) for _, _, p in held]
            tokens = np.concatenate([p for _, _, p in held]).view(np.int64)
            node = np.repeat(np.array([x for x, _, _ in held], dtype=np.int64), sizes)
            n = np.repeat(np.array([x for _, x, _ in held], dtype=np.int64), sizes)
            long = counts.value[_bucket(tokens.view(np.uint64), len(counts.value) // 2)] > limit
            return pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(node), pa.array(n), pa.array(long)], ["token", "node", "n", "long"])

        for (text,) in _texts(found):
            members, prefix = _prefix(word_hashes(text), words, counts.value, num, den)
            node = _name(members)
            if not len(members) or node in known:
                continue
            known.add(node)
            held.append((node, len(members), prefix))
            n_held += len(prefix)
            if n_held > 50_000:
                yield out(held)
                held, n_held = [], 0
        if held:
            yield out(held)

    return docs.select("text").mapInArrow(read, "token long, node long, n long, long boolean")


def _gatherings(entries: DataFrame, num: int, den: int) -> DataFrame:
    """(leader, node, n): which leaders each node's set goes to; a leader goes to itself."""
    facts = {"leader": F.min("node"), "last": F.max("node"), "size": F.count("*"), "least": F.min("n"), "most": F.max("n")}
    # a list whose two sets differ too much in size links nothing
    useful = (F.col("leader") != F.col("last")) & ((F.col("size") > 2) | (F.col("most") * num <= F.col("least") * den))
    # short lists: one exchange, facts by window; long ones: facts by partial aggregation, and a join that can be split
    short = entries.filter("NOT long").select("token", "node", "n").withColumns({k: v.over(W.partitionBy("token")) for k, v in facts.items()}).filter(useful)
    rest = entries.filter("long").select("token", "node", "n")
    lists = rest.groupBy("token").agg(*[v.alias(k) for k, v in facts.items()]).filter(useful).select("token", "leader")
    both = short.select("leader", "node", "n").unionByName(rest.join(lists, "token").select("leader", "node", "n"))
    return both.groupBy("leader", "node", "n").agg(F.lit(1).alias("_")).drop("_")


def _covered(gathered: DataFrame) -> DataFrame:
    """``gathered`` without the leaders all of whose sets meet at one other leader too."""
    sizes = gathered.groupBy("leader").agg(F.count("*").alias("sets"))
    sized = gathered.join(sizes, "leader")
    main = sized.groupBy("node", "n").agg(F.max(F.struct("sets", "leader")).alias("main")).select("node", "n", F.col("main.leader").alias("main"))
    ends = gathered.join(main, ["node", "n"]).groupBy("leader").agg(F.min("main").alias("a"), F.max("main").alias("b"))
    return gathered.join(ends.filter("a = b AND a <> leader").select("leader"), "leader", "left_anti")


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """One bit for each value of node modulo ``BITS``; at most BITS / 64 rows come to the driver."""
    words = nodes.selectExpr(f"pmod(node, {BITS}) AS bit").selectExpr("shiftright(bit, 6) AS w", "shiftleft(1L, cast(bit % 64 AS int)) AS b")
    out = np.zeros(BITS // 64, dtype=np.uint64)
    for row in words.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        out[row.w] = np.uint64(row.b & (2**64 - 1))
    return out


def _sets(docs: DataFrame, words: int, bitmap) -> DataFrame:
    """(node, n, members) of nodes in the bitmap, once per task."""

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows, held = set(), [], 0

        def out(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["node", "n", "members"])

        for (text,) in _texts(found):
            members = shingle_set(text, words)
            node = _name(members)
            at = node % BITS
            if len(members) and node not in known and (int(bitmap.value[at >> 6]) >> (at & 63)) & 1:
                known.add(node)
                rows.append((node, len(members), members.tobytes()))
                held += members.nbytes
                if held > 4_000_000:
                    yield out(rows)
                    rows, held = [], 0
        if rows:
            yield out(rows)

    # a set that several tasks hold comes once
    return docs.select("text").mapInArrow(read, "node long, n long, members binary").dropDuplicates(["node", "n"])


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def linked_within(sets: list[np.ndarray], num: int, den: int, split: int | None = None) -> list[tuple[int, int]]:
    """Links that span the groups of similar sets; with ``split``, only between sets before and after it.

    The overlaps of a set are those of the most similar set answered before, changed by the lists of
    the members in which they differ, or counted anew where that is less.
    """
    n_sets = len(sets)
    if n_sets < 2:
        return []
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if n_sets == 2 and split in (None, 1):
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True)) if min(sizes) * den >= max(sizes) * num else 0
        return [(0, 1)] if shared and shared >= needed(sizes[0], sizes[1], num, den) else []
    vocabulary, local = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n_sets), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    held_by = np.bincount(local, minlength=len(vocabulary))
    # the order of the index: rare members first, so that lists of the prefix are short
    rank = np.empty(len(vocabulary), dtype=np.int64)
    rank[np.argsort(held_by, kind="stable")] = np.arange(len(vocabulary))
    local = rank[local]
    lists = np.argsort(local, kind="stable")
    posted, heads = owner[lists], np.concatenate([[0], np.cumsum(np.bincount(local, minlength=len(vocabulary)))])
    mine = [np.sort(local[starts[i] : starts[i + 1]]) for i in range(n_sets)]
    # the index: prefix members only, each list by size and position, in runs with their least position
    front = [m[: prefix_length(len(m), num, den)] for m in mine]
    lengths = np.array([len(f) for f in front])
    token, place, holder = np.concatenate(front), np.concatenate([np.arange(k) for k in lengths]), np.repeat(np.arange(n_sets), lengths)
    listed = np.lexsort((place, sizes[holder], token))
    entry, entry_place, entry_size = holder[listed], place[listed], sizes[holder[listed]]
    entry_heads = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(vocabulary)))])
    least_place = np.minimum.reduceat(entry_place, np.arange(0, len(entry_place), RUN))

    def reachable_entries(a: int, b: int, low: int, high: int, latest: int) -> np.ndarray:
        """Sets listed from ``a`` to ``b`` within the sizes and up to the position."""
        a, b = a + np.searchsorted(entry_size[a:b], low, side="left"), a + np.searchsorted(entry_size[a:b], high, side="right")
        if b - a <= 2 * RUN:
            return entry[a:b][entry_place[a:b] <= latest]
        runs = np.flatnonzero(least_place[a // RUN : (b - 1) // RUN + 1] <= latest) + a // RUN
        spots = (runs[:, None] * RUN + np.arange(RUN)).ravel()
        spots = spots[(spots >= a) & (spots < b)]
        return entry[spots[entry_place[spots] <= latest]]

    forest, links = _Forest(n_sets), []
    order = np.lexsort((np.arange(n_sets), [int(m[-1]) for m in mine], [int(m[0]) for m in mine], sizes))
    answered: list[tuple[int, np.ndarray]] = []  # the last sets with their overlaps
    for i in order.tolist():
        tokens, n = mine[i], int(sizes[i])
        low, high = -(-num * n // den), den * n // num
        latest = int((np.arange(low, high + 1) - needed(n, np.arange(low, high + 1), num, den)).max())  # place from which too few shingles follow
        near = []
        for at, t in enumerate(front[i].tolist()):
            a, b = entry_heads[t], entry_heads[t + 1]
            if b - a > 1 and n - at >= needed(n, low, num, den):
                near.append(reachable_entries(a, b, low, high, latest))
        candidates = np.unique(np.concatenate(near)) if near else np.empty(0, dtype=np.int64)
        candidates = candidates[candidates != i]
        if split is not None:
            candidates = candidates[(candidates < split) != (i < split)]
        if not len(candidates):
            continue
        plus, minus, overlap = tokens, tokens[:0], None
        for k, known in answered:
            more, less = np.setdiff1d(tokens, mine[k], assume_unique=True), np.setdiff1d(mine[k], tokens, assume_unique=True)
            if len(more) + len(less) < len(plus) + len(minus):
                plus, minus, overlap = more, less, known
        overlap = np.zeros(n_sets, dtype=np.int64) if overlap is None else overlap.copy()
        for part, sign in ((plus, 1), (minus, -1)):
            if len(part):
                overlap += sign * np.bincount(np.concatenate([posted[heads[t] : heads[t + 1]] for t in part.tolist()]), minlength=n_sets)
        answered = [*answered[-ANSWERED + 1 :], (i, overlap)]
        for j in candidates[overlap[candidates] >= needed(n, sizes[candidates], num, den)].tolist():
            if forest.join(i, j):
                links.append((i, j))
    return links


def near_in_bitmaps(sizes: list[int], bitmaps: list[bytes], firsts: list[bool] | None, num: int, den: int) -> set[int]:
    """Which sets may have a partner among the others (if told, among those of the other kind), by their parity bitmaps."""
    order = sorted(range(len(sizes)), key=lambda k: sizes[k])
    n = np.array([sizes[k] for k in order], dtype=np.int64)
    kind = np.array([firsts[k] for k in order]) if firsts else None
    low = np.searchsorted(n, -(-num * n // den), side="left")
    found = np.zeros(len(order), dtype=bool)
    maps: dict[int, tuple[int, np.ndarray]] = {}  # for each number of bits: where its sets begin, their bitmaps
    for bits in {parity_bits(int(x)) for x in n}:
        at = [k for k in range(len(order)) if parity_bits(int(n[k])) == bits]
        maps[bits] = at[0], np.frombuffer(b"".join(bitmaps[order[k]] for k in at), dtype="<u8").reshape(len(at), bits // 64)
    for i in np.flatnonzero(low < np.arange(len(order))).tolist():
        bits = parity_bits(int(n[i]))
        start, own = maps[bits]
        mine, end = own[i - start], i
        while end > low[i]:
            a = max(int(low[i]), start)
            if a < end:
                differ = np.bitwise_count(own[a - start : end - start] ^ mine).sum(axis=1)
                near = differ <= n[i] + n[a:end] - 2 * needed(int(n[i]), n[a:end], num, den)
                if kind is not None:
                    near &= kind[a:end] != kind[i]
                if near.any():
                    found[a:end] |= near
                    found[i] = True
            end = min(end, start)
            while end > low[i]:  # sets with a smaller bitmap: halves of the larger one, one upon the other
                bits //= 2
                mine = mine[: len(mine) // 2] ^ mine[len(mine) // 2 :]
                if bits in maps:
                    start, own = maps[bits]
                    break
    return {order[k] for k in np.flatnonzero(found).tolist()}


KEYS = ["leader", "i", "j"]


def _in_blocks(gathered: DataFrame, capacity: int) -> DataFrame:
    """Each member of a gathering in all its pairs of blocks (i, j); ``first`` marks members of block i."""
    total = gathered.groupBy("leader").agg(F.sum(F.greatest("n", F.lit(ROW))).alias("total"))
    work = gathered.join(total, "leader").withColumn("blocks", F.ceil(F.col("total") / capacity).cast("int"))
    work = work.withColumn("own", F.pmod(F.xxhash64("node", "n", F.lit(7)), F.col("blocks")).cast("int"))
    work = work.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = work.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    return work.select(*KEYS, (F.col("own") == F.col("i")).alias("first"), "node", "n")


def _groups(found: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows (first, node, n, data) of each pair of blocks, from rows sorted by ``KEYS``."""
    key, rows = None, []
    for batch in found:
        for at in range(0, batch.num_rows, 1000):
            for *now, first, node, n, data in zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns), strict=True):
                if now != key:
                    if len(rows) > 1:
                        yield key, rows
                    key, rows = now, []
                rows.append((first, node, n, data))
    if len(rows) > 1:
        yield key, rows


def _dealt(work: DataFrame, data: str) -> DataFrame:
    return work.select(*KEYS, "first", "node", "n", data).repartition(spread(work.sparkSession), *KEYS).sortWithinPartitions(*KEYS)


def _near(gathered: DataFrame, bitmaps: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of ``gathered`` that may have a partner there."""

    def solve(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch_of(out: list) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["leader", "node", "n"])

        for (leader, i, j), rows in _groups(found):
            near = near_in_bitmaps([r[2] for r in rows], [r[3] for r in rows], [r[0] for r in rows] if i != j else None, num, den)
            out += [(leader, rows[k][1], rows[k][2]) for k in near]
            if len(out) > 50_000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    work = _in_blocks(gathered, BITMAP_BLOCK).join(bitmaps, ["node", "n"])
    return _dealt(work, "bitmap").mapInArrow(solve, "leader long, node long, n long").distinct()


def _links(gathered: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, a_n, b, b_n): links that span each gathering."""

    def solve(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch_of(out: list) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "a_n", "b", "b_n"])

        for (_, i, j), rows in _groups(found):
            rows.sort(key=lambda r: (not r[0], r[1], r[2]))
            split = sum(r[0] for r in rows) if i != j else None
            for a, b in linked_within([np.frombuffer(r[3], dtype=np.uint64) for r in rows], num, den, split):
                out.append((rows[a][1], rows[a][2], rows[b][1], rows[b][2]))
            if len(out) > 50_000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    work = _in_blocks(gathered, BLOCK).join(sets, ["node", "n"])
    return _dealt(work, "members").mapInArrow(solve, "a long, a_n long, b long, b_n long")


def jaccard_classes(docs: DataFrame, words: int = 5, similarity: Fraction | str = "0.8", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, node, component_id) for every row of ``docs``.

    Two documents link when their sets' Jaccard similarity is at least ``similarity`` (compared in
    whole numbers); ``component_id`` is the least doc_id that links reach, the document's own
    included. ``node`` names its class of equal sets.
    """
    spark = docs.sparkSession
    reachable(spark)
    share = Fraction(similarity)
    num, den = share.numerator, share.denominator
    if not 0 < share <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows, counts = _survey(docs, words)
    shared = spark.sparkContext.broadcast(counts)
    entries = staged(_entries(docs, words, num, den, shared), "jaccard-entries")
    every = staged(_gatherings(entries, num, den), "jaccard-gatherings")
    dropped(entries)
    bitmaps = rows.filter("bitmap is not null").select("node", "n", "bitmap").dropDuplicates(["node", "n"])
    near = staged(_near(every, bitmaps, num, den), "jaccard-near", arrow_rows=2000)
    gathered = staged(_covered(near), "jaccard-covered")
    dropped(every, near)
    bitmap = spark.sparkContext.broadcast(_bitmap(gathered.select("node")))
    sets = _sets(docs, words, bitmap)
    links = staged(_links(gathered, sets, num, den), "jaccard-links", arrow_rows=200)
    dropped(gathered)
    # components of nodes, each named by one number, and their least documents
    lowest = staged(rows.filter("n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")), "jaccard-lowest")
    edges = links.select(F.xxhash64("a", "a_n").alias("a"), F.xxhash64("b", "b_n").alias("b"))
    edges = edges.union(_same_id(rows).select(F.xxhash64("a", "a_n"), F.xxhash64("b", "b_n")))
    components = connected_components(edges)
    named = lowest.withColumn("id", F.xxhash64("node", "n"))
    linked = staged(named.join(components.withColumnRenamed("node", "id"), "id"), "jaccard-linked")
    least = staged(linked.groupBy("component").agg(F.min("low").alias("least"), F.count("*").alias("nodes")), "jaccard-least")
    linked = looked_up(linked, least, ["component"], "nodes").select("node", "n", F.col("least").alias("component_id"), "copies")
    alone = lowest.filter("copies > 1").join(linked.select("node", "n"), ["node", "n"], "left_anti").select("node", "n", F.col("low").alias("component_id"), "copies")
    # a text that stands once and links with nothing is its own component
    reps = staged(linked.unionByName(alone), "jaccard-classes")
    dropped(links, linked, least)
    out = looked_up(rows.select("doc_id", "node", "n"), reps, ["node", "n"], "copies")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "node", F.coalesce("component_id", "doc_id").alias("component_id"))


def _same_id(rows: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): the nodes of rows that share a doc_id, each with the least one."""
    ids = rows.filter("n > 0 AND doc_id IS NOT NULL")
    node = F.struct("node", "n")
    several = ids.groupBy("doc_id").agg(F.min(node).alias("a"), F.max(node).alias("z")).filter("a <> z").select("doc_id", "a")
    found = ids.join(several, "doc_id").filter(node != F.col("a"))
    return found.select(F.col("a.node").alias("a"), F.col("a.n").alias("a_n"), F.col("node").alias("b"), F.col("n").alias("b_n")).distinct()


def keep_one(docs: DataFrame, words: int = 5, similarity: Fraction | str = "0.8") -> DataFrame:
    """``docs`` with one row of each component, that of the least doc_id; rows without a doc_id all stay."""
    classes = jaccard_classes(docs, words, similarity)
    stay = classes.filter("doc_id = component_id").select(F.col("doc_id").alias("_stay")).distinct()
    named = docs.join(stay, docs["doc_id"] == stay["_stay"], "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.filter("doc_id is null"))
