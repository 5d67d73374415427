"""The pipeline's stages against brute force on a small table, and the registry."""

from __future__ import annotations

import corpus_pipeline as cp
from tests.llm.test_operators import brute_classes, brute_lines
from fractions import Fraction


def test_stages_one_by_one(spark, sf_dir):
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality", "line_dedup", "near_duplicates", "pii", "pack"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    good = cp.staged(cp.quality_stage(spark, docs, sf_dir), "t1")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.select("doc_id").collect()}
    marked = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in marked) >= 0.95 * len(marked)
    lines = cp.staged(cp.line_stage(spark, good, sf_dir), "t2")
    assert sorted([(r.doc_id, r.text) for r in lines.collect()], key=str) == brute_lines([(r.doc_id, r.text, r.source) for r in good.collect()], cp.MIN_SITES)
    one = cp.staged(cp.near_duplicate_stage(spark, lines, sf_dir), "t3")
    classes = brute_classes([(r.doc_id, r.text) for r in lines.select("doc_id", "text").collect()], 5, Fraction("0.8"))
    assert {r.doc_id for r in one.collect()} == {c for _, _, c in classes}
    private = cp.staged(cp.pii_stage(spark, one, sf_dir), "t4")
    assert private.columns == one.columns == lines.columns == good.columns == columns
    assert private.count() == one.count()
    packed = cp.pack_stage(spark, private, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in private.select("doc_id").collect()}
    assert private.filter("n_chars <> length(text)").count() == 0


def test_registry_names():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
