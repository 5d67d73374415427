"""A quality classifier over document statistics.

``document_statistics`` turns whole texts into ``STATISTICS``: shares of character and word
classes, repetition and line shape. ``QualityModel.fit`` standardises them, maps them through
random Fourier features (cosines of random projections, whose inner products approximate a
Gaussian kernel), sums the normal equations over partitions, solves them for ridge scores and
calibrates these by isotonic regression. ``score`` applies the model to statistics,
``keep_good`` to texts.

The fit reads at most ``MAX_LABELLED`` labelled rows in expectation: beyond that number, rows are
taken by a hash of their doc_id. Everything else covers all rows.

Labels, language, source and doc_id are no inputs of a score.

Defined results: a null text counts as an empty one and gets the score of empty texts; repeated
rows are scored each; rows without a label or with a null one don't train; repeated labels of a
document train once each; without labelled rows of both kinds all scores are the share of label 1
(0.5 without any); extra columns pass through ``keep_good``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import staged, task_started

#: Labelled rows that a fit reads at most, in expectation.
MAX_LABELLED = 500_000
STATISTICS = [
    "log_chars", "upper", "digits", "symbols", "exclamations", "bars", "stops", "non_ascii", "spaces",
    "word_chars", "short_words", "long_words", "symbol_words", "upper_words", "distinct_words",
    "top_word", "same_as_before", "same_as_two_before", "log_line_chars", "same_lines", "stopped_lines",
]
SYMBOLS = b"#$%&*@^~=+<>{}[]\\/_`"


def statistics_of(text: str | None) -> list[float]:
    """The values of ``STATISTICS`` for one text; all zero for a text without words."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n, n_words = len(raw), len(words)
    letters = max(1, int(count[65:91].sum() + count[97:123].sum()))
    lengths = np.fromiter(map(len, words), np.int64, n_words)
    kinds = Counter(words)
    lines = raw.split(b"\n")
    same = sum(map(bytes.__eq__, words, words[1:]))
    same_two = sum(map(bytes.__eq__, words, words[2:]))
    symbol_words = sum(1 for w in words if w[-1] in SYMBOLS or w[-1] == 33)
    upper_words = sum(map(bytes.isupper, words))
    return [
        np.log1p(n),
        count[65:91].sum() / letters,
        count[48:58].sum() / n,
        sum(int(count[c]) for c in SYMBOLS) / n_words,
        count[33] / n_words,
        count[124] / n_words,
        (count[46] + count[44]) / n_words,
        count[128:].sum() / n,
        (count[32] + count[10] + count[9]) / n,
        lengths.mean(),
        (lengths <= 3).mean(),
        (lengths >= 14).mean(),
        symbol_words / n_words,
        upper_words / n_words,
        np.log1p(len(kinds)) / np.log1p(n_words),
        kinds.most_common(1)[0][1] / n_words,
        same / n_words,
        same_two / n_words,
        np.log1p(n / len(lines)),
        1 - len(set(lines)) / len(lines),
        sum(1 for x in lines if x[-1:] in (b".", b"!", b"?")) / len(lines),
    ]


def document_statistics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, stats) for every row."""

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_started()
        for batch in found:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                stats = [statistics_of(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "stats"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string")).mapInArrow(read, f"doc_id {kind}, stats array<double>")


def pooled(values: np.ndarray, targets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: (value, level) knots."""
    blocks: list[list[float]] = []  # level, weight, first value, last value
    for v, y, w in zip(values, targets, weights, strict=True):
        blocks.append([y, w, v, v])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            y2, w2, _, last = blocks.pop()
            y1, w1, first, _ = blocks.pop()
            blocks.append([(y1 * w1 + y2 * w2) / (w1 + w2), w1 + w2, first, last])
    knots = [(x, b[0]) for b in blocks for x in dict.fromkeys((b[2], b[3]))]
    return np.array([k for k, _ in knots]), np.array([k for _, k in knots])


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def _features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        f = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.projection + self.phase)
        return np.concatenate([np.ones((len(f), 1)), z, f], axis=1)

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self._features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated chance of label 1 for each row of statistics."""
        if not len(self.weights):
            return np.full(len(stats), self.levels[0])
        return np.clip(np.interp(self.ridge(stats), self.knots, self.levels), 0.0, 1.0)

    @staticmethod
    def constant(level: float) -> QualityModel:
        e = np.empty(0)
        return QualityModel(e, e, e, e, e, e, np.array([level]))

    @staticmethod
    def fit(labelled: DataFrame, n_features: int = 192, gamma: float = 0.05, ridge: float = 1e-3, bins: int = 2000, seed: int = 20) -> QualityModel:
        """A model from rows (doc_id, stats, label); label is 0 or 1."""
        n = labelled.count()
        if n > MAX_LABELLED:
            labelled = labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(1e6 * MAX_LABELLED / n))
        labelled = staged(labelled.select("stats", F.col("label").cast("double").alias("label")), "quality-labelled")
        d = len(STATISTICS)
        sums = labelled.select(F.count("*"), F.sum("label"), *[F.sum(F.get("stats", F.lit(k))) for k in range(d)], *[F.sum(F.get("stats", F.lit(k)) ** 2) for k in range(d)]).first()
        n, ones = sums[0], sums[1]
        if not n or ones in (0, n):
            return QualityModel.constant(ones / n if n else 0.5)
        mean = np.array(sums[2 : 2 + d]) / n
        scale = np.sqrt(np.maximum(np.array(sums[2 + d :]) / n - mean**2, 1e-12))
        scale[scale < 1e-5] = 1.0
        rng = np.random.default_rng(seed)
        model = QualityModel(mean, scale, rng.normal(0, np.sqrt(2 * gamma), (d, n_features)), rng.uniform(0, 2 * np.pi, n_features), np.empty(0), np.empty(0), np.empty(0))
        width = 1 + d + n_features

        def equations(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width, width + 1))
            for batch in found:
                x = model._features(np.array(batch.column(0).to_pylist()).reshape(-1, d))
                y = np.array(batch.column(1).to_pylist(), dtype=float)
                total += x.T @ np.concatenate([x, y[:, None]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["row", "sums"])

        def summed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: dict[int, np.ndarray] = {}
            for batch in found:
                for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    rows[k] = rows.get(k, 0.0) + np.frombuffer(raw)
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array([r.tobytes() for r in rows.values()], pa.binary())], ["row", "sums"])

        parts = labelled.mapInArrow(equations, "row int, sums binary").repartition(16, "row").mapInArrow(summed, "row int, sums binary")
        system = np.zeros((width, width + 1))
        for r in parts.collect():  # one row per feature
            system[r.row] = np.frombuffer(r.sums)
        penalty = ridge * n * np.eye(width)
        penalty[0, 0] = 0
        model.weights = np.linalg.solve(system[:, :width] + penalty, system[:, width])

        def raw(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in found:
                s = model.ridge(np.array(batch.column(0).to_pylist()).reshape(-1, d))
                yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.floor((s + 0.5) / 2 * bins), 0, bins - 1).astype(np.int64)), batch.column(1)], ["bin", "label"])

        found = labelled.mapInArrow(raw, "bin long, label double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("label").alias("y")).orderBy("bin").collect()  # at most ``bins`` rows
        values = np.array([(r.bin + 0.5) / bins * 2 - 0.5 for r in found])
        model.knots, model.levels = pooled(values, np.array([r.y for r in found]), np.array([r.n for r in found], dtype=float))
        return model


def scores(stats: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) for every row of (doc_id, stats)."""

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            s = model.score(np.array(batch.column(1).to_pylist()).reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(read, T.StructType([stats.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def labelled_rows(stats: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, stats, label) of the documents with a label."""
    return stats.join(labels.select("doc_id", F.col(label).alias("label")).filter(F.col("label").isin(0, 1)), "doc_id")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``."""

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_started()
        for batch in found:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                stats = np.array([statistics_of(t) for t in part.column(part.schema.get_field_index(text)).to_pylist()]).reshape(-1, len(STATISTICS))
                yield part.filter(pa.array(model.score(stats) >= threshold))

    return docs.mapInArrow(read, docs.schema)
