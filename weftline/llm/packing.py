"""Vector best-fit packing of documents into token sequences.

``pieces`` tokenises documents (with a memo of word ids in each Python worker), ends each with a
separator id and cuts only those longer than a sequence. ``pack`` puts the pieces into sequences:

* pieces are dealt in turn to shards of about ``SHARD`` documents, so that shards are equal and
  all see the same mix of lengths, and sorted there by falling length (an external sort);
* a shard streams through vector best-fit. Each open sequence has three residual capacities:
  tokens, documents and attention cost (the sum of squared piece lengths). Among the sequences
  that satisfy every constraint, ``rule="norm"`` takes the one whose weighted residual after
  placement has the smallest norm, ``rule="dot"`` the one whose residual has the largest weighted
  dot product with the demand. Where none fits, a sequence is opened.

With no limits but the length of a sequence, as in ``op1``, the other two capacities can't bind: a
sequence holds no more documents than tokens and costs no more than its length squared. They then
only weigh in the choice of a sequence.

A shard leaves less than one sequence in a thousand partly filled; memory is three numbers for
each of its open sequences. Piece ids never leave the tokenising task: the packer moves lengths.

Defined results: a null text is an empty document (the separator alone); a text of any length is cut
into as many pieces as it needs; repeated rows, and rows of a null doc_id, are pieces of their own; of
equally good sequences the one opened or moved to first is taken, of equal lengths the piece of the least
doc_id goes first; extra columns are ignored by ``pieces`` and pass through ``pack``, but
``sequence_id`` and ``offset`` are replaced; empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from weftline.session import reachable

from .tokens import word_memo

SEQUENCE_TOKENS = 4096
SEPARATOR_ID = 1
#: Documents in a shard; about a third as many sequences are open at once.
SHARD = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", size: int = SEQUENCE_TOKENS, separator: int = SEPARATOR_ID, with_ids: bool = False) -> DataFrame:
    """A row per piece of at most ``size`` tokens; ``with_ids`` adds the ids themselves (binary, little-endian 32-bit)."""
    end = np.array([separator], dtype="<u4").tobytes()
    reachable(docs.sparkSession)

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo(tokenizer_path)
        for batch in found:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for key, ids in zip(part.column(0).to_pylist(), memo.ids([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    for k, start in enumerate(range(0, len(ids), 4 * size)):
                        block = ids[start : start + 4 * size]
                        rows.append((key, k, start // 4, len(block) // 4, zlib.crc32(block), block))
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                arrays = [pa.array(c, k) for c, k in list(zip(columns, kinds, strict=True))[: 6 if with_ids else 5]]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


class BestFit:
    """Open sequences of one shard and their residual capacities."""

    def __init__(self, capacities: tuple[float, float, float], weights: tuple[float, float, float], rule: str):
        self.capacities = np.array(capacities, dtype=float)
        self.scale = np.array(weights, dtype=float) / self.capacities
        self.rule = rule
        self.left = np.empty((3, 1024))
        self.name = np.empty(1024, dtype=np.int64)
        self.open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece."""
        need = np.array([length, 1.0, float(length) * length])
        tokens, documents, cost = self.left[:, : self.open]
        fits = np.flatnonzero((tokens >= need[0]) & (documents >= need[1]) & (cost >= need[2])) if self.open else ()
        if len(fits):
            left = self.left[:, fits]
            if self.rule == "norm":
                rest = (left - need[:, None]) * self.scale[:, None]
                at = int(fits[int(np.argmin((rest * rest).sum(axis=0)))])
            else:
                at = int(fits[int(np.argmax((self.scale * self.scale * need) @ left))])
        else:
            if self.open == self.left.shape[1]:
                self.left = np.concatenate([self.left, np.empty_like(self.left)], axis=1)
                self.name = np.concatenate([self.name, np.empty_like(self.name)])
            at, self.left[:, self.open], self.name[self.open] = self.open, self.capacities, self.made
            self.open += 1
            self.made += 1
        sequence, offset = int(self.name[at]), int(self.capacities[0] - self.left[0, at])
        self.left[:, at] -= need
        if (self.left[:2, at] < 1).any():
            self.open -= 1
            self.left[:, at], self.name[at] = self.left[:, self.open], self.name[self.open]
        return sequence, offset


def pack(
    found: DataFrame,
    n_documents: int,
    size: int = SEQUENCE_TOKENS,
    max_documents: int | None = None,
    max_cost: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
    rule: str = "norm",
    shard: int = SHARD,
) -> DataFrame:
    """``found`` (doc_id, piece, length and others) with ``sequence_id`` and ``offset``.

    A sequence holds at most ``size`` tokens, ``max_documents`` pieces (no limit: one per token)
    and ``max_cost`` of squared lengths (no limit: the square of ``size``). A piece whose cost
    alone is more than ``max_cost`` can't be placed and raises. ``n_documents`` only sets the
    number of shards.
    """
    reachable(found.sparkSession)
    limits = (float(size), float(max_documents or size), float(max_cost or size * size))
    found = found.drop("sequence_id", "offset")
    fields = found.schema.fields
    schema = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, fit = TaskContext.get().partitionId() << 40, BestFit(limits, weights, rule)
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index("length")).to_pylist()
            if lengths and max(lengths) * max(lengths) > limits[2]:
                raise ValueError("a piece costs more than a sequence may")
            placed = [fit.place(n) for n in lengths]
            more = [pa.array([base + s for s, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "sequence_id", "offset"])

    shards = max(1, -(-n_documents // shard))
    dealt = found.repartition(shards)
    return dealt.sortWithinPartitions(F.desc("length"), "doc_id", "piece").mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from ``pack`` over ``pieces(with_ids=True)``: at most ``size`` ids a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    done = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return done.select("sequence_id", F.aggregate("parts.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
