"""Chunks of consecutive sentences that belong together, within a budget."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weftline.functions import text as tx
from weftline.session import reachable


def likeness(a: Counter, b: Counter) -> float:
    """Cosine of two bags of words, 0 where one is empty."""
    norms = sum(v * v for v in a.values()) * sum(v * v for v in b.values())
    return sum(v * b[w] for w, v in a.items()) / math.sqrt(norms) if norms else 0.0


def semantic_chunks(docs: DataFrame, threshold: float = 0.5, budget: int = 512, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, position, units, tokens, text) of each chunk of each row.

    A chunk ends where a sentence is less like the one before than ``threshold``, or where the next one would take it over
    ``budget`` words; a sentence over the budget is a chunk of its own. Sentences pass through in order, and only the chunk
    at hand and the bag of the last sentence are held: no document is gathered or exchanged. A text without sentences has no chunks.
    """
    reachable(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(tx.sentences(F.coalesce(F.col(text), F.lit("")))).alias("pos", "s"))
    kind = rows.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("position", pa.int32()), ("units", pa.int32()), ("tokens", pa.int64()), ("text", pa.string())])

    def fold(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size = [], 0
        chunk: list[str] = []
        key, position, used, last = None, 0, 0, Counter()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)

        def close() -> None:
            nonlocal chunk, position, used, size
            if chunk:
                done.append((key, position, len(chunk), used, " ".join(chunk)))
                size += len(done[-1][-1])
                chunk, position, used = [], position + 1, 0

        for part in found:
            for i, pos, sentence in zip(*(c.to_pylist() for c in part.columns), strict=True):
                words = sentence.lower().split()
                bag = Counter(words)
                if pos == 0:  # a row begins
                    close()
                    key, position = i, 0
                elif likeness(last, bag) < threshold or used + len(words) > budget:
                    close()
                chunk.append(sentence)
                used, last = used + len(words), bag
                if size > 4_000_000 or len(done) >= 10_000:
                    yield batch()
                    done, size = [], 0
        close()
        if done:
            yield batch()

    return rows.mapInArrow(fold, f"id {kind.simpleString()}, position int, units int, tokens long, text string")
