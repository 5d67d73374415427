"""Sparse TF-IDF vectors: a vocabulary fitted on the corpus, and texts as weights of its terms.

Terms are runs of 1 to 2 words without stop words, case and accents. The vocabulary is chosen by aggregation and
a top-k over partitions; only its rows, at most ``max_features``, are ever broadcast.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import zip_longest
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weftline.staging import staged

if TYPE_CHECKING:
    import pyarrow as pa

#: Words without content in English text; a parameter for other languages.
STOP_WORDS = tuple(
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does "
    "down during each few for from further had has have he her here his how if in into is it its just more most no nor not now of off on once "
    "only or other our out over own same she should so some such than that the their them then there these they this those through to too "
    "under until up very was we were what when where which while who whom why will with would you your".split()
)
WORD = r"[\p{L}\p{N}_]{2,}"


def _accents() -> tuple[str, str]:
    """Letters that lose an accent, with what is left, by Unicode decomposition; combining marks last, which go."""
    pairs, marks = {}, []
    for code in range(0xC0, 0x2000):
        c = chr(code)
        bare = "".join(d for d in unicodedata.normalize("NFKD", c) if not unicodedata.combining(d))
        if not bare:
            marks.append(c)
        elif len(bare) == 1 and bare != c:
            pairs[c] = bare
    return "".join(pairs) + "".join(marks), "".join(pairs.values())


_BARE = {ord(c): bare or None for c, bare in zip_longest(*_accents())}
_WORD = re.compile(r"\w{2,}")  # Python's letters and digits are those of WORD


def _lower(text: str) -> Column:
    return F.lower(F.coalesce(F.col(text), F.lit("")))


def terms(lower: str, high: int, stop_words: frozenset[str]) -> list[str]:
    """All runs of 1 to ``high`` words of a text in lower case without stop words and accents, in order of length and place, repeats included."""
    out = ws = [w for w in _WORD.findall(lower if lower.isascii() else lower.translate(_BARE)) if w not in stop_words]
    for n in range(2, high + 1):
        out = out + [" ".join(run) for run in zip(*(ws[k:] for k in range(n)))]
    return out


#: Terms that a task counts before it hands them on.
AT_ONCE = 500_000


def _longs(values: list[int]) -> pa.Array:
    import pyarrow as pa

    return pa.array(values, pa.int64())


def _batch(**columns: list) -> pa.RecordBatch:
    """Columns as they are, texts as strings, whole numbers as longs."""
    import pyarrow as pa

    made = [c if isinstance(c, pa.Array) else pa.array(c, pa.string()) if k == "term" else _longs(c) for k, c in columns.items()]
    return pa.RecordBatch.from_arrays(made, names=list(columns))


@dataclass
class Vocabulary:
    """(term, index, df, idf) of the chosen terms, at most ``max_features`` rows, staged; indices follow the terms' order."""

    table: DataFrame
    high: int
    stop_words: tuple[str, ...]

    @classmethod
    def fit(cls, docs: DataFrame, text: str = "text", max_features: int = 5000, high: int = 2, min_df: int = 1, max_df: float = 0.95, stop_words: tuple[str, ...] = STOP_WORDS) -> Vocabulary:
        """The ``max_features`` most frequent terms (ties by term) that at least ``min_df`` documents and at most a share ``max_df`` of them hold."""

        stop = frozenset(stop_words)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tf, df = Counter(), Counter()
            for b in batches:
                for lower in b.column("text").to_pylist():
                    tf.update(ts := terms(lower, high, stop))
                    df.update(set(ts))
                    if len(tf) >= AT_ONCE:
                        yield _batch(term=list(tf), tf=list(tf.values()), df=[df[t] for t in tf])
                        tf, df = Counter(), Counter()
            yield _batch(term=list(tf), tf=list(tf.values()), df=[df[t] for t in tf])

        n = docs.count()
        rows = docs.select(_lower(text).alias("text")).mapInArrow(counted, "term string, tf long, df long")
        sums = rows.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
        best = sums.orderBy(F.desc("tf"), "term").limit(max_features)
        index = F.row_number().over(W.orderBy("term")) - 1  # at most max_features rows
        idf = F.log((1.0 + n) / (1.0 + F.col("df"))) + 1
        return cls(staged(best.select("term", index.alias("index"), "df", idf.alias("idf")), "vocabulary"), high, stop_words)

    def weights(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """(id, index, term, weight): tf * idf of each term of each row, scaled to length 1 a row; rows without terms have none."""
        index = {r["term"]: r["index"] for r in self.table.select("term", "index").collect()}  # at most max_features rows
        high, stop = self.high, frozenset(self.stop_words)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, places, tf = [], [], []
                for k, lower in enumerate(b.column("text").to_pylist()):
                    found = Counter([index[t] for t in terms(lower, high, stop) if t in index])
                    at += [k] * len(found)
                    places += found.keys()
                    tf += found.values()
                yield _batch(id=b.column("id").take(_longs(at)), index=places, tf=tf)

        rows = docs.select(F.col(id_col).alias("id"), _lower(text).alias("text"))
        counts = rows.mapInArrow(counted, f"id {rows.schema['id'].dataType.simpleString()}, index long, tf long")
        counts = counts.repartition("id").groupBy("id", "index").agg(F.sum("tf").alias("tf")).join(F.broadcast(self.table.select("term", "index", "idf")), "index")
        counts = counts.withColumn("index", F.col("index").cast(self.table.schema["index"].dataType))
        value = F.col("tf") * F.col("idf")
        return counts.withColumn("weight", value / F.sqrt(F.sum(value * value).over(W.partitionBy("id")))).select("id", "index", "term", "weight")

    def vectors(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """(id, indices, values): sparse vectors, empty where a row has no term of the vocabulary; ids are taken to be unique."""
        pairs = self.weights(docs, id_col, text).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("index", "weight"))).alias("p"))
        every = docs.select(F.col(id_col).alias("id")).join(pairs, "id", "left")
        empty = F.array().cast("array<struct<index:int,weight:double>>")
        return every.withColumn("p", F.coalesce("p", empty)).select("id", F.col("p.index").alias("indices"), F.col("p.weight").alias("values"))

    def search(self, docs: DataFrame, query: str, k: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """(id, score, rank) of the ``k`` rows whose vectors are nearest to the query's, ties by id; only rows that share a term have a score."""
        asked = docs.sparkSession.createDataFrame([(0, query)], "doc_id int, text string")
        wanted = self.weights(asked).select("index", F.col("weight").alias("wanted"))  # a row a term of the query
        found = self.weights(docs, id_col, text).join(F.broadcast(wanted), "index")
        scored = found.groupBy("id").agg(F.round(F.sum(F.col("weight") * F.col("wanted")), 6).alias("score"))
        best = scored.orderBy(F.desc("score"), "id").limit(k)
        return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))
