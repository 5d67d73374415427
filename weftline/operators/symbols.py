"""The graph of code symbols: who calls whom and who is like whom, ranked by a walk with personal restarts, and searched.

A symbol calls every other symbol that bears one of the names in its ``calls``. A name that many define and many call would make
callers times definers edges; here both are linked to the name alone, and the walk passes through it: what callers send to a name
is summed once and every definer gets the sum, less its own share, and the other way round. Ranks are those of the whole graph,
and the work is linear in the calls.

A link is a whole number, its code: twice the number of its name, and one more for a caller. The two ends of a name differ in the last bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from weftline.functions import numbers as num
from weftline.staging import bucketed, dropped, staged

from .skeleton import embed

#: Names whose sums may be broadcast to the links in a round (about 100 bytes each); of more, links are exchanged by name.
SMALL_NAMES = 500_000
#: Times as many names whose sums go to the tasks as arrays (32 bytes a name, and the names themselves once).
DENSE = 4
#: Calls that a task numbers at once, and sums that it hands on at once.
AT_ONCE = 1_000_000


def symbols(chunks: DataFrame, path: str = "path") -> DataFrame:
    """(id, path, name, short, calls, text) of the definitions of ``code.code_chunks``; ``short`` is the last part of a name.

    Chunks of imports are none. Equal names of a file are told apart by their first line; a null list of calls is an empty one, a
    null signature or docstring an empty text.
    """
    short = F.substring_index("name", ".", -1)
    text = F.concat_ws(" ", "name", "signature", "docstring")
    rows = chunks.filter("kind <> 'imports'")
    return rows.select(F.concat_ws("::", F.col(path).cast("string"), "name", F.col("start_line").cast("string")).alias("id"), F.col(path).alias("path"), "name", short.alias("short"), F.coalesce("calls", F.array().cast("array<string>")).alias("calls"), text.alias("text"))


def _column(codes: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """A binary column of ``n`` rows that holds the codes, which are in the order of their rows."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(codes.astype(np.int32))])


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The codes of such a column and the row of each."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 4
    codes = np.frombuffer(column.buffers()[2], np.int32)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.int32)
    return codes.astype(np.intp), np.repeat(np.arange(len(column)), np.diff(ends))


def _batch(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    """``n`` rows of a schema, null in the columns that are not given."""
    made = {c: x.cast(schema.field(c).type) if isinstance(x, pa.Array) else pa.array(x, schema.field(c).type) for c, x in columns.items()}
    return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.nulls(n, f.type) for f in schema], schema=schema)


def _handed_on(schema: pa.Schema, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The task's sums that are not 0, as rows (code, x)."""
    found = np.flatnonzero(sums)
    for k in range(0, len(found), AT_ONCE):
        part = found[k : k + AT_ONCE]
        yield _batch(schema, len(part), code=part.astype(np.int32), x=sums[part])


def _numbered(names: Broadcast, schema: pa.Schema) -> Callable:
    """For ``mapInArrow`` over (id, short, calls, ...): (..., own, at) with the codes of a symbol's links, and rows (code, x) with the callers of a name."""

    def numbered(table: pa.Table) -> tuple[pa.RecordBatch, np.ndarray]:
        n, columns = table.num_rows, {c: table.column(c).combine_chunks() for c in table.column_names}
        number = lambda words: pc.index_in(words.cast(pa.string()), value_set=names.value).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.intp)
        short, calls = number(columns.pop("short")), columns.pop("calls")
        rows = np.repeat(np.arange(n), pc.list_value_length(calls).fill_null(0).to_numpy(zero_copy_only=False))
        called = number(calls.flatten())
        rows, called = rows[called >= 0], called[called >= 0]
        defining = np.flatnonzero(short >= 0)
        ends = np.concatenate([defining, rows])
        order = np.argsort(ends, kind="stable")
        codes = np.concatenate([2 * short[defining], 2 * called + 1])[order]
        own = np.zeros(n, bool)
        own[rows[called == short[rows]]] = True
        return _batch(schema, n, own=own, at=_column(codes, ends[order], n), **columns), called

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        callers = np.zeros(len(names.value))
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("calls").flatten()) + batch.num_rows
            if size >= AT_ONCE:
                out, called = numbered(pa.Table.from_batches(held))
                np.add.at(callers, called, 1.0)
                yield out
                held, size = [], 0
        if held:
            out, called = numbered(pa.Table.from_batches(held))
            np.add.at(callers, called, 1.0)
            yield out
        yield from _handed_on(schema, callers)

    return run


def _totals(sizes: Broadcast, schema: pa.Schema) -> Callable:
    """For ``mapInArrow`` over (own, at, ...): with ``total``, the weight of all links of a symbol but those to itself; ``sizes`` are what a link weighs, by code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, rows = _codes(batch.column("at"))
            # a symbol that calls its own name counted itself twice, as a caller and as a definer
            total = np.bincount(rows, sizes.value[codes], batch.num_rows) - 2.0 * batch.column("own").to_numpy(zero_copy_only=False)
            yield _batch(schema, batch.num_rows, total=total, **{c: batch.column(c) for c in batch.schema.names})

    return run


def _walked(n_codes: int, alpha: float, was: tuple[Broadcast, float] | None, now: tuple[Broadcast, float] | None, last: bool, schema: pa.Schema) -> Callable:
    """For ``mapInArrow`` over (id, own, total, p, rank, at): a round ``now`` after the round ``was``, each given by what a link brings, by code, and the chance to restart.

    The given ranks are those after ``was`` for symbols that call themselves and the first ones for others, whose rank depends on the last round alone.
    Rows are the new ranks of the former, of all if it is the ``last`` step, and else (code, x) with what a task's symbols then send by each link.
    A code beyond those of links stands for the change of the ranks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_codes + 1)
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            own, total, p, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("own", "total", "p", "rank"))
            codes, rows = _codes(batch.column("at"))
            linked = total > 0
            each = np.where(linked, total, 1.0)
            reached = lambda got, back: np.where(linked, alpha * np.bincount(rows, got.value[codes], n), 0.0) + back * p  # noqa: B023, E731
            if was is not None:
                rank = np.where(own, rank, reached(*was))
            if now is not None:
                new = reached(*now) - np.where(own & linked, 2 * alpha * rank / each, 0.0)
                sums[n_codes] += np.abs(new - rank).sum()
                rank = new
            if last:
                yield _batch(schema, n, id=batch.column("id"), rank=rank)
                continue
            if now is not None and own.any():
                kept = batch.filter(pa.array(own))
                yield _batch(schema, kept.num_rows, rank=rank[own], **{c: kept.column(c) for c in ("id", "own", "total", "p", "at")})
            np.add.at(sums, codes, np.where(linked, rank / each, 0.0)[rows])
        if not last:
            yield from _handed_on(schema, sums)

    return run


def _summed(rows: DataFrame, n: int) -> np.ndarray:
    """Sums of all tasks by code, of at most ``n`` codes."""
    found = rows.filter("code is not null").groupBy("code").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(n)
    out[found.column("code").to_numpy()] = found.column("x").to_numpy()
    return out


@dataclass
class SymbolGraph:
    """Staged tables of a graph: ``nodes`` (id, total, own, at), ``links`` (id, short, calls) and ``likeness`` (src, dst, weight), both ways.

    Without likeness, and with at most ``DENSE * SMALL_NAMES`` names, the codes of a symbol's links lie in its row (``at``) and there is no table of links:
    a round reads the rows where they lie and exchanges only sums of names. Else links lie in buckets of their symbols, and a round exchanges
    ranks and the sums of names, not the links, unless the ``names`` are too many.
    ``total`` is the weight of a symbol's edges: one a call in either direction, and its likeness to others; ``own`` tells that it
    calls its own name, which is no edge.
    """

    nodes: DataFrame
    links: DataFrame | None
    likeness: DataFrame | None
    names: int

    @classmethod
    def build(cls, rows: DataFrame, likeness: DataFrame | None = None, keep: tuple[str, ...] = ()) -> SymbolGraph:
        """The graph of ``symbols``, ids taken to be unique, with edges of ``likeness`` (src, dst, weight), each pair once, if given.

        Columns of ``keep``, named otherwise than those of ``nodes``, stay with the symbols, so that ``rank`` may restart by one of them.
        """
        rows = rows.select("id", "short", F.array_distinct("calls").alias("calls"), *keep)
        if likeness is None:
            made = staged(rows.filter("short is not null").groupBy("short").agg(F.count("*").alias("definers")), "symbol-names")
            if made.count() <= DENSE * SMALL_NAMES:
                return cls._dense(rows, made, keep)
            dropped(made)
        rows = staged(rows, "symbols")
        own = F.coalesce(F.array_contains("calls", F.col("short")), F.lit(False))
        made = rows.select("id", "short", F.lit(False).alias("calls")).filter("short is not null")
        used = rows.select("id", F.explode("calls").alias("short"), F.lit(True).alias("calls")).filter("short is not null")
        ends = made.unionByName(used)
        names = ends.groupBy("short").agg(F.count(F.when(~F.col("calls"), 1)).alias("definers"), F.count(F.when(F.col("calls"), 1)).alias("callers")).filter("definers > 0 and callers > 0")
        names = staged(names, "symbol-names")
        n_names = names.count()
        sized = ends.join(F.broadcast(names) if n_names <= SMALL_NAMES else names, "short").select("id", "short", "calls", F.when(F.col("calls"), F.col("definers")).otherwise(F.col("callers")).cast("double").alias("n"))
        links = bucketed(sized, "symbol-links", "id")
        weights = links.select("id", F.col("n").alias("w"))
        both = None
        if likeness is not None:
            pairs = likeness.select("src", "dst", F.col("weight").cast("double").alias("weight")).filter("src <> dst and weight > 0")
            both = staged(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")), "symbol-likeness")
            weights = weights.unionByName(both.select(F.col("src").alias("id"), F.col("weight").alias("w")))
        totals = weights.groupBy("id").agg(F.sum("w").alias("_w"))
        # a symbol that calls its own name counted itself twice, as a caller and as a definer
        total = F.coalesce("_w", F.lit(0.0)) - F.when(F.col("own"), 2.0).otherwise(0.0)
        nodes = rows.select("id", own.alias("own"), *keep).join(totals, "id", "left").select("id", "own", total.alias("total"), *keep)
        nodes = staged(nodes, "symbol-nodes")
        dropped(rows, names)
        return cls(nodes, links, both, n_names)

    @classmethod
    def _dense(cls, rows: DataFrame, made: DataFrame, keep: tuple[str, ...]) -> SymbolGraph:
        """The graph of symbols, read once more, and the names that they define, whose number is bounded. A name that nobody calls has links of no weight."""
        context, kind = rows.sparkSession.sparkContext, rows.schema
        names = made.toArrow()
        words = context.broadcast(names.column("short").combine_chunks().cast(pa.string()))
        columns = ", ".join(f"`{c}` {kind[c].dataType.simpleString()}" for c in ("id", *keep)) + ", own boolean, at binary"
        schema = f"{columns}, code int, x double"
        numbered = staged(rows.mapInArrow(_numbered(words, to_arrow_schema(_parse_datatype_string(schema))), schema), "symbol-codes")
        dropped(made)
        sizes = np.empty(2 * len(names))
        sizes[::2], sizes[1::2] = _summed(numbered, len(names)), names.column("definers").to_numpy()
        schema = f"{columns}, total double"
        nodes = numbered.filter("code is null").select("id", *keep, "own", "at").mapInArrow(_totals(context.broadcast(sizes), to_arrow_schema(_parse_datatype_string(schema))), schema)
        nodes = staged(nodes, "symbol-nodes")
        dropped(numbered)
        return cls(nodes, None, None, len(names))

    def close(self) -> None:
        """Remove the graph's tables; ranks that were taken stay."""
        dropped(self.nodes, *[t for t in (self.links, self.likeness) if t is not None])

    def rank(self, restart: DataFrame | str | None = None, alpha: float = 0.85, rounds: int = 120, tolerance: float = 1e-6) -> DataFrame:
        """(id, rank): the walk follows an edge by its weight with chance ``alpha`` and restarts otherwise; ranks add up to 1.

        It restarts at the symbols of ``restart`` (id, weight) by their weights, summed where ids repeat, or by the weights in a column
        that was kept, or anywhere where none is given or none weighs anything; a symbol without edges always restarts. It stops when
        the ranks of ``n`` symbols change by less than ``n * tolerance`` together, by the same rule at every size; the ranks of each
        round are staged.
        """
        places = self.nodes
        if isinstance(restart, str):
            places = places.withColumn("p", F.when(F.col(restart) > 0, F.col(restart).cast("double")).otherwise(0.0))
        elif restart is not None:
            wanted = restart.filter("weight > 0").groupBy("id").agg(F.sum("weight").cast("double").alias("p"))
            places = places.join(wanted, "id", "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
        else:
            places = places.withColumn("p", F.lit(1.0))
        # rows that hold their links are only written again where their weights came by a join
        if self.links is not None or isinstance(restart, DataFrame):
            places = staged(places, "symbol-restarts")
        kept = places
        n, mass, stuck = places.agg(F.count("*"), F.sum("p"), F.sum(F.when(F.col("total") <= 0, F.col("p")))).first()
        if not n:
            return staged(places.select("id", F.col("p").alias("rank")), "symbol-ranks")
        if not mass:
            places, mass = places.withColumn("p", F.lit(1.0)), float(n)
            stuck = places.filter("total <= 0").count()
        share, stuck = F.col("p") / mass, (stuck or 0.0) / mass
        if self.links is None:
            ranks = self._walk(places.select("id", "own", "total", share.alias("p"), share.alias("rank"), "at"), n, stuck, alpha, rounds, tolerance)
            dropped(kept)
            return ranks
        state = staged(places.select("id", "own", "total", share.alias("p"), share.alias("rank"), F.lit(0.0).alias("change")), "symbol-ranks")
        loose = stuck  # symbols without edges only ever get restarts: what they hold needs no job
        for _ in range(rounds):
            sent = state.filter("total > 0").select("id", (F.col("rank") / F.col("total")).alias("q"))
            through = self.links.join(sent, "id").groupBy("short").agg(F.sum(F.when(F.col("calls"), F.col("q"))).alias("called"), F.sum(F.when(~F.col("calls"), F.col("q"))).alias("defined"))
            through = F.broadcast(through) if self.names <= SMALL_NAMES else through
            got = self.links.join(through, "short").select("id", F.when(F.col("calls"), F.col("defined")).otherwise(F.col("called")).alias("x"))
            if self.likeness is not None:
                alike = self.likeness.join(sent.withColumnRenamed("id", "src"), "src")
                got = got.unionByName(alike.select(F.col("dst").alias("id"), (F.col("q") * F.col("weight")).alias("x")))
            got = got.groupBy("id").agg(F.sum("x").alias("x"))
            mine = F.when(F.col("own") & (F.col("total") > 0), 2 * F.col("rank") / F.col("total")).otherwise(0.0)
            moved = F.when(F.col("total") > 0, F.coalesce("x", F.lit(0.0)) - mine).otherwise(0.0)
            new = alpha * moved + (alpha * loose + 1 - alpha) * F.col("p")
            loose = (alpha * loose + 1 - alpha) * stuck
            after = staged(state.join(got, "id", "left").select("id", "own", "total", "p", new.alias("rank"), F.abs(new - F.col("rank")).alias("change")), "symbol-ranks")
            dropped(state)
            state = after
            if state.agg(F.sum("change")).first()[0] < n * tolerance:
                break
        dropped(kept)
        return state.select("id", "rank")

    def _walk(self, state: DataFrame, n: int, stuck: float, alpha: float, rounds: int, tolerance: float) -> DataFrame:
        """The ranks after at most ``rounds`` rounds from (id, own, total, p, rank, at); each reads the symbols as they lie and exchanges sums of names.

        Only symbols that call themselves are written again each round.
        """
        context, n_codes, loose = state.sparkSession.sparkContext, 2 * self.names, stuck
        schema = f"id {state.schema['id'].dataType.simpleString()}, own boolean, total double, p double, rank double, at binary, code int, x double"
        arrow = to_arrow_schema(_parse_datatype_string(schema))
        step = lambda rows, *how: rows.mapInArrow(_walked(n_codes, alpha, *how, arrow), schema)
        others, rows, was, written = state.filter("not own"), state, None, []
        sent = _summed(step(rows, None, None, False), n_codes + 1)
        for k in range(rounds):
            # what definers send to a name its callers get, and the other way round
            now = context.broadcast(sent[:n_codes].reshape(-1, 2)[:, ::-1].ravel()), alpha * loose + 1 - alpha
            loose = (alpha * loose + 1 - alpha) * stuck
            if k == rounds - 1:
                break
            written.append(staged(step(rows, was, now, False), "symbol-ranks"))
            sent = _summed(written[-1], n_codes + 1)
            if was is not None:
                was[0].unpersist()
            rows, was, now = others.unionByName(written[-1].filter("code is null").drop("code", "x")), now, None
            dropped(*written[:-1])
            written = written[-1:]
            if sent[n_codes] < n * tolerance:
                break
        else:
            now = None
        ranks = staged(step(rows, was, now, True).select("id", "rank"), "symbol-ranks")
        dropped(*written)
        return ranks


def search(rows: DataFrame, question: str, k: int = 5, path: str | None = None) -> DataFrame:
    """(id, score): the ``k`` symbols most like a question or piece of code by the cosine of their texts' vectors, ties by id.

    With ``path`` only the symbols of that file; a symbol without words scores 0.
    """
    inside = rows if path is None else rows.filter(F.col("path") == path)
    asked = embed(rows.sparkSession.createDataFrame([(question,)], "text string")).select(F.col("embedding").alias("_asked"))
    scored = embed(inside.select("id", "text")).crossJoin(F.broadcast(asked))
    return scored.select("id", F.round(num.cosine(F.col("embedding"), F.col("_asked")), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def related(rows: DataFrame, graph: SymbolGraph, question: str, k: int = 20, seeds: int = 5, alpha: float = 0.5, rounds: int = 120) -> DataFrame:
    """(id, rank): the ``k`` symbols that a walk from the ``seeds`` best matches of a question reaches most, ties by id."""
    start = search(rows, question, seeds).filter("score > 0").select("id", F.col("score").alias("weight"))
    return graph.rank(staged(start, "symbol-seeds"), alpha, rounds).orderBy(F.desc(F.round("rank", 12)), "id").limit(k)
