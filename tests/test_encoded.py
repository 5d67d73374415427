"""Text forms of nested results: exact round trips and written lines."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftline.sources import encoded, sinks

ODD = ["", "a", ",", "\\", "\n", "\\,", "\\n", "\\\\", "a,b\\", "\\\\,\n0", "\n1\n2", "tail\\\n", " lead, and trail ", "é—漢", "x: y", " search_results:", "results[0]{}", "\r\n", "handoff_bundle:\n query: z"]


def odd(rng):
    return "".join(rng.choice(["\\", ",", "\n", "n", "0", "1", "2", "a", " ", ":"]) for _ in range(rng.randint(0, 12)))


def test_cells_come_back(spark):
    rng = random.Random(3)
    rows = [(rng.choice(ODD), odd(rng), odd(rng)) for _ in range(800)] + [(x, x, x) for x in ODD]
    frame = spark.createDataFrame(rows, "a string, b string, c string")
    written = frame.select(F.array_join(F.array(*[encoded.cell(F.col(c)) for c in "abc"]), ",").alias("value"))
    lines = [r.value for r in written.collect()]
    assert not any("\n" in x for x in lines)
    assert [tuple(r) for r in sinks.parsed_tabular(spark.createDataFrame([(x,) for x in lines], "value string"), ["a", "b", "c"]).collect()] == rows


RESULTS = "array<struct<node_id:string,similarity:double,importance:double,summary:string>>"


def test_bundles_come_back(spark):
    rng = random.Random(5)
    keys = [k for k in encoded.BUNDLE_KEYS if k not in encoded.NUMBERS | encoded.WHOLE]
    rows = []
    for k in range(200):
        results = [(rng.choice(ODD), rng.randint(0, 1000) / 1000, None, odd(rng)) for _ in range(rng.choice([0, 1, 4]))]
        rows.append((k, [rng.choice(ODD + [odd(rng)]) for _ in keys], rng.randint(0, 9999), rng.randint(0, 9999) / 1000, results))
    frame = spark.createDataFrame(rows, f"k int, texts array<string>, n long, ratio double, results {RESULTS}")
    values = {k: F.get("texts", F.lit(i)) for i, k in enumerate(keys)} | {"skeleton_total_nodes": F.col("n"), "compression_ratio": F.col("ratio")}
    got = {r.k: r.b for r in frame.select("k", encoded.read_bundle(encoded.bundle(values, F.col("results"))).alias("b")).collect()}
    for k, texts, n, ratio, results in rows:
        b = got[k]
        assert [b[x] for x in keys] == texts and (b.skeleton_total_nodes, b.skeleton_tokens, b.compression_ratio) == (n, 0, ratio)
        assert [tuple(r) for r in b.search_results] == results


def test_no_bundle(spark):
    frame = spark.createDataFrame([("handoff:\n",), ("",), (None,), ("handoff_bundle:\n doc_id: 4",)], "t string")
    found = [r.b for r in frame.select(encoded.read_bundle(F.col("t")).alias("b")).collect()]
    assert found[:3] == [None] * 3 and found[3].doc_id == "4" and found[3].query is None and found[3].search_results == []


def test_null_results_are_none(spark):
    frame = spark.createDataFrame([(None,), ([],)], f"r {RESULTS}")
    assert {r[0] for r in frame.select(encoded.rows_of("results", F.col("r"), encoded.RESULT_FIELDS)).collect()} == {"results[0]{}"}


def test_long_cells(spark):
    long = "a,\\\n" * 300_000
    row = spark.createDataFrame([(long,)], "t string").select(encoded.cells(F.concat(encoded.cell(F.col("t")), F.lit(",z"))).alias("c")).first()
    assert row.c == [long, "z"]


def test_written_lines(spark):
    nodes = "array<struct<node_id:string,importance:double,type:string,summary:string>>"
    frame = spark.createDataFrame([("d1", 2, 2.549, [("n0", 0.87, "text", "Waves, and more"), ("n5", None, None, "two\nlines")]), (None, None, None, [])], f"f string, n int, ratio double, nodes {nodes}")
    found = [r[0] for r in frame.select(encoded.skeleton(F.col("f"), F.col("n"), F.col("ratio"), F.col("nodes"))).collect()]
    assert found[0] == "skeleton:\n file_id: d1\n total_nodes: 2\n compression_ratio: 2.5\n\n results[2]{node_id,importance,type,summary}:\n  n0,0.870,text,Waves\\, and more\n  n5,,,two\\nlines"
    assert found[1] == "skeleton:\n file_id: unknown\n total_nodes: 0\n compression_ratio: 1.0\n\n results[0]{}"


@pytest.mark.parametrize("most,content", [(None, "one two"), (3, "one...")])
def test_dialogue_lines(spark, most, content):
    frame = spark.createDataFrame([({"kept": 2, "cut": None}, [("user", "one two"), (None, None)])], "s map<string,int>, m array<struct<role:string,content:string>>")
    found = frame.select(encoded.dialogue(F.col("s"), F.col("m"), most)).first()[0]
    assert found == f"afm_context:\n stats:\n  cut: \n  kept: 2\n\n results[2]{{role,content}}:\n  user,{content}\n  ,"
