"""Removal of boilerplate lines that many sites share.

A line is boilerplate when different texts hold it on at least ``min_sites`` distinct sites, on each of
them at least ``min_share`` of the site's texts (one at least): short sentences that meet on many
sites by chance stay, however large the corpus is. Equal whole texts count as one, at home on the least of
their sites, so that a copied document's lines are no boilerplate for being copied. Boilerplate lines
go from every document, whatever is left of it. Steps:

1. Texts that stand on several sites are found by hash, with their home.
2. Documents are counted per line hash (partial aggregation before the exchange). A line that
   fewer than ``min_sites`` of them hold can't be on ``min_sites`` sites, so only the others go on.
3. Texts are counted per surviving line hash and home site; sites below the share drop out.
4. A HyperLogLog sketch of the sites left is built per line hash; sketches merge by aggregation,
   so a line that half of the corpus carries costs one small sketch per task.
5. Lines whose estimate lies within a factor of two of the threshold are counted exactly.

Hashes of lines (trimmed) and texts are two chained 64-bit hashes.

Defined results: a null text stays null, an empty one empty; blank lines are never boilerplate; repeated
rows are each cut but count as one text; a null site counts as one site of its own; of equal counts none
is preferred: every line at or over the threshold goes; texts of any length are read whole; an empty
table gives an empty table; extra columns pass through, but ``n_lines`` and ``n_removed`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

from weftline.session import reachable

from .common import dropped, looked_up, null_as_empty, staged, task_started

#: Boilerplate hashes that may be broadcast: about 150 bytes each in Python, so 60 MB a worker at most.
BROADCAST_LINES = 400_000
#: Share of a site's texts that must hold a line for the site to count.
MIN_SHARE = 0.005
BLANK = " \t\r"
MASK = (1 << 64) - 1


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(BLANK))


def _homes(docs: DataFrame, text: str, site: str) -> tuple[DataFrame, DataFrame]:
    """((t1, t2, home, copies) of the texts that stand on several sites, (site, need) of sites that need more than one text)."""
    texts = docs.filter(F.col(text).isNotNull()).select(F.xxhash64(text).alias("t1"), F.xxhash64(text, text).alias("t2"), null_as_empty(site).alias("site"))
    least = texts.groupBy("t1", "t2").agg(F.min("site").alias("home"), F.max("site").alias("last"), F.count("*").alias("copies"))
    least = staged(least.select("t1", "t2", "home", "last", "copies"), "texts")
    return least.filter("home <> last").drop("last"), least.groupBy(F.col("home").alias("site")).agg(F.count("*").alias("texts"))


def _lines(docs: DataFrame, text: str, site: str) -> DataFrame:
    """(h1, h2, t1, t2, site) of every line that isn't blank, once a document."""
    lines = F.array_distinct(F.transform(F.split(F.col(text), "\n"), _trimmed))
    line = docs.select(null_as_empty(site).alias("site"), F.xxhash64(text).alias("t1"), F.xxhash64(text, text).alias("t2"), F.explode(lines).alias("line"))
    return line.filter(F.col("line") != "").select(F.xxhash64("line").alias("h1"), F.xxhash64("line", "line").alias("h2"), "t1", "t2", "site")


def boilerplate_lines(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = 10, lg_k: int = 10, min_share: float = MIN_SHARE, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """(h1, h2, sites, exact): hashes of the lines on at least ``min_sites`` sites, each in ``min_share`` of its texts."""
    lines = _lines(docs, text, site)
    often = staged(lines.groupBy("h1", "h2").agg(F.count("*").alias("held")).filter(F.col("held") >= min_sites), "lines-often")
    homes, sites = _homes(docs, text, site)
    homes = staged(homes, "homes")
    candidates = looked_up(lines, often.select("h1", "h2", F.lit(True).alias("often"), "held"), ["h1", "h2"], "held", broadcast_lines).filter("often").drop("often")
    candidates = looked_up(candidates, homes, ["t1", "t2"], "copies", broadcast_lines)
    # a line that half of the corpus holds has a row for each text, but no task has all of them
    texts = candidates.groupBy("h1", "h2", F.coalesce("home", "site").alias("site"), "t1", "t2").agg(F.lit(1).alias("_"))
    at_site = staged(texts.groupBy("h1", "h2", "site").count(), "lines-at-site")
    need = staged(sites.select("site", F.ceil(F.col("texts") * F.lit(min_share)).alias("need"), F.lit(1).alias("one")).filter("need > 1"), "sites-need")
    seen = staged(looked_up(at_site, need, ["site"], "one", broadcast_lines).filter(F.col("count") >= F.coalesce("need", F.lit(1))).select("h1", "h2", "site"), "lines-seen")
    dropped(often, homes, at_site)
    estimate = seen.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"))
    estimate = staged(estimate.filter(F.col("sites") * 2 >= min_sites), "lines-estimate")
    near = estimate.filter(F.col("sites") < 2 * min_sites).select("h1", "h2")
    exact = seen.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count("*").alias("sites"))
    sure = estimate.filter(F.col("sites") >= 2 * min_sites).select("h1", "h2", F.col("sites").cast("long").alias("sites"), F.lit(False).alias("exact"))
    out = staged(sure.unionByName(exact.filter(F.col("sites") >= min_sites).select("h1", "h2", "sites", F.lit(True).alias("exact"))), "boilerplate")
    dropped(seen, estimate, need)
    return out


def _with_set(docs: DataFrame, text: str, shared: Broadcast) -> DataFrame:
    """Lines removed against a broadcast set of hashes."""
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.IntegerType()), T.StructField("n_removed", T.IntegerType())])

    def clean(value: str | None, found: frozenset) -> tuple[str | None, int | None, int | None]:
        if value is None:
            return None, None, None
        lines, keep = value.split("\n"), []
        for line in lines:
            key = line.strip(BLANK).encode()
            h1 = xxhash.xxh64_intdigest(key, 42)
            if not key or (h1, xxhash.xxh64_intdigest(key, h1)) not in found:
                keep.append(line)
        removed = len(lines) - len(keep)
        return ("\n".join(keep) if removed else value), len(lines), removed

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_started()
        for batch in (whole.slice(k, 500) for whole in found for k in range(0, whole.num_rows, 500)):
            at = batch.schema.get_field_index(text)
            out = [clean(x, shared.value) for x in batch.column(at).to_pylist()]
            columns = batch.columns
            columns[at] = pa.array([x[0] for x in out], pa.string())
            columns += [pa.array([x[k] for x in out], pa.int32()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "n_lines", "n_removed"])

    return docs.mapInArrow(batches, schema)


def _with_join(docs: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """Lines removed by a join on the hash, for more boilerplate than may be broadcast."""
    rows = staged(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("id")), "line-rows")
    lines = rows.select("id", F.posexplode(F.split(F.col("row")[text], "\n")).alias("pos", "line"))
    lines = lines.withColumns({"key": _trimmed(F.col("line"))}).withColumns({"h1": F.xxhash64("key"), "h2": F.xxhash64("key", "key")})
    # the sites of a line stand for its rows: the lines of most sites are the hot ones
    marked = looked_up(lines, known.select("h1", "h2", F.lit(True).alias("bad"), "sites"), ["h1", "h2"], "sites", 0)
    bad = F.col("bad").isNotNull() & (F.col("key") != "")
    kept = marked.groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(~bad, F.struct("pos", "line")))).alias("kept"),
        F.count("*").cast("int").alias("n_lines"),
        F.sum(F.when(bad, 1).otherwise(0)).cast("int").alias("n_removed"),
    )
    out = rows.join(kept, "id", "left")
    cleaned = F.when(F.coalesce(F.col("n_removed") == 0, F.lit(True)), F.col("row")[text]).otherwise(F.array_join(F.col("kept.line"), "\n"))
    return out.select(*[(cleaned if c == text else F.col("row")[c]).alias(c) for c in docs.columns], "n_lines", "n_removed")


def remove_boilerplate(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = 10, lg_k: int = 10, broadcast_lines: int = BROADCAST_LINES, min_share: float = MIN_SHARE) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``, plus ``n_lines`` and ``n_removed``.

    Hashes of boilerplate lines go to the executors as a set only if there are at most
    ``broadcast_lines``; beyond it, they are joined.
    """
    docs = docs.drop("n_lines", "n_removed")
    reachable(docs.sparkSession)
    known = boilerplate_lines(docs, text, site, min_sites, lg_k, min_share, broadcast_lines)
    if known.count() > broadcast_lines:
        return _with_join(docs, text, known)
    rows = known.select("h1", "h2").toLocalIterator()
    return _with_set(docs, text, docs.sparkSession.sparkContext.broadcast(frozenset((r.h1 & MASK, r.h2 & MASK) for r in rows)))
