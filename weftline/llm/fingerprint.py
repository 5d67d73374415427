"""Order MinHash fingerprints of texts.

A text's k-mers (runs of ``K`` code points) are numbered by occurrence, so that repeated ones
differ. Each numbered k-mer is hashed; the upper bits of the hash deal it to one of ``SLOTS``
slots, and in each slot the ``TUPLE`` k-mers of least hash are selected, put back into text order
and hashed together to the slot's signature of 16 bits. Slots see disjoint samples (one hash serves
all, instead of one for each slot), and the order within a tuple makes moved passages count as
edits, as sets of k-mers wouldn't.

A fingerprint is written as 4 hexadecimal digits a slot; a slot without k-mers is ``----``. The
likeness of two fingerprints is the share of equal signatures among slots filled in either; two
empty fingerprints have 1.

``with_neighbour`` streams documents by falling doc_id, each with the next one. Documents are cut
into ranges of ids of about equal numbers; the first row of each range is also sent to the range
before, so that no row waits for another task and texts are exchanged once.

Defined results: a null text is an empty one; a text shorter than ``K`` is one k-mer; repeated
doc_ids are ordered by text, null ones come last; a single document is its own neighbour; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shingles import mixed

K, SLOTS, TUPLE = 6, 64, 2
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Documents in a range of ids, as long as there are at most ``RANGES`` of them; tasks stream, so ranges may be larger.
RANGE, RANGES = 4_000, 20_000


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def signature(text: str | None) -> np.ndarray:
    """One number a slot: the 16-bit signature, or -1 for a slot without k-mers."""
    points = _points(text or "")
    out = np.full(SLOTS, -1, dtype=np.int64)
    if not len(points):
        return out
    k = min(K, len(points))
    n = len(points) - k + 1
    code = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        code = code * np.uint64(0x100000001B3) + points[i : i + n]
    code = mixed(code)
    # occurrence numbers: equal k-mers in text order
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if not new.all():
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        again = np.arange(n) - first
        hashed = np.empty(n, dtype=np.uint64)
        hashed[order] = mixed(ranked + again.astype(np.uint64) * _STEP)
    else:
        hashed = mixed(code)
    # least of each slot: slots are the upper bits, so that sorted hashes are slot by slot
    few = np.flatnonzero(hashed & np.uint64((1 << 58) - 1) < np.uint64(min((1 << 58) - 1, (1 << 58) * 24 * SLOTS // n))) if n > 48 * SLOTS else np.arange(n)
    few = few[np.argsort(hashed[few], kind="stable")]
    slot = (hashed[few] >> np.uint64(58)).astype(np.int64)
    heads = np.searchsorted(slot, np.arange(SLOTS + 1))
    sizes = np.diff(heads)
    if n > 48 * SLOTS and (sizes < TUPLE).any():  # a slot with too few below the cut: look at all
        few = np.argsort(hashed, kind="stable")
        slot = (hashed[few] >> np.uint64(58)).astype(np.int64)
        heads = np.searchsorted(slot, np.arange(SLOTS + 1))
        sizes = np.diff(heads)
    chosen = np.minimum(heads[:-1, None] + np.arange(TUPLE), len(few) - 1)
    places = few[chosen]
    places[np.arange(TUPLE) >= sizes[:, None]] = n  # missing: last, with no code
    places.sort(axis=1)
    codes = np.concatenate([code, [np.uint64(0)]])
    total = np.zeros(SLOTS, dtype=np.uint64)
    for i in range(TUPLE):
        total = mixed(total * _STEP + codes[places[:, i]] + np.uint64(1))
    filled = sizes > 0
    out[filled] = (total[filled] >> np.uint64(48)).astype(np.int64)
    return out


def written(found: np.ndarray) -> str:
    return "".join("----" if x < 0 else f"{x:04x}" for x in found.tolist())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    either = (a >= 0) | (b >= 0)
    n = int(either.sum())
    return 1.0 if not n else float((either & (a == b)).sum() / n)


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many characters from the start of ``following``, or all there are."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row."""

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([written(signature(t)) for t in texts])], ["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(read, "doc_id long, n_chars long, fingerprint string")


def _ranges(docs: DataFrame) -> list[int]:
    """Bounds, falling, of ranges of doc_id."""
    n = docs.count()
    pieces = min(max(1, -(-n // RANGE)), RANGES)
    cuts = docs.select(F.percentile_approx("doc_id", [k / pieces for k in range(1, pieces)], 10_000)).first()[0] if pieces > 1 and n else []
    return sorted(set(cuts or []), reverse=True)


def with_neighbour(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of texts and of their edited forms, next to the likeness to both the edited text and the next document's."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    cuts = _ranges(rows)
    bound = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    # range 0 holds the largest ids, the last one null ids

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        after = F.col("doc_id") < F.get(bound, middle)
        return F.when(s["lo"] >= s["hi"], s).when(after, F.struct((middle + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle.alias("hi")))

    found = F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), halve, lambda s: s["lo"])
    place = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(found)
    ranged = rows.withColumn("range", place.cast("int"))
    tops = ranged.groupBy("range").agg(F.max(F.coalesce("doc_id", F.lit(0))).alias("top")).orderBy("range").collect()  # a row for each range
    if not tops:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    before = {r.range: tops[k - 1].range for k, r in enumerate(tops)}  # the first range follows the last
    starts = F.map_from_arrays(F.array(*[F.lit(r.range) for r in tops]), F.array(*[F.lit(r.top).cast("long") for r in tops]))
    sends = F.map_from_arrays(F.array(*[F.lit(k) for k in before]), F.array(*[F.lit(v) for v in before.values()]))
    lead = F.coalesce("doc_id", F.lit(0)) == starts[F.col("range")]
    copies = F.when(lead, F.array(F.struct(F.col("range"), F.lit(False).alias("ahead")), F.struct(sends[F.col("range")].alias("range"), F.lit(True).alias("ahead")))).otherwise(F.array(F.struct(F.col("range"), F.lit(False).alias("ahead"))))
    dealt = ranged.withColumn("to", F.explode(copies)).select(F.col("to.range").alias("range"), F.col("to.ahead").alias("ahead"), "doc_id", "text")

    def solve(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = None  # (doc_id, text, signature) that waits for its next
        now, over = None, False

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in found:
            for at in range(0, batch.num_rows, 200):
                for rng, ahead, key, value in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns), strict=True):
                    if rng != now:
                        now, held, over = rng, None, False
                    if over:  # only the first row of the next range is looked at
                        continue
                    own = signature(value)
                    if held:
                        last_key, last, sig = held
                        changed = edited(last, value)
                        new = sig if changed == last else signature(changed)
                        out.append((last_key, len(last), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), written(sig), written(new), likeness(sig, new), likeness(sig, own)))
                    held, over = (key, value, own), ahead
                if len(out) > 500:
                    yield batch_of(out)
                    out = []
        yield batch_of(out)

    dealt = dealt.repartitionById(len(cuts) + 2, F.col("range")).sortWithinPartitions("range", "ahead", F.desc_nulls_last("doc_id"), "text")
    return dealt.mapInArrow(solve, SCHEMA)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
