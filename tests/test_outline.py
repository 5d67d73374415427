"""Outlines of code files: nesting, strings, comments, signatures; staged skeletons against brute force."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest

from weftline.operators import outline, stages

PYTHON = '''
import os, sys
from a.b import (c,
   d as e)
LIMIT = 3
x = 1
@dec(a=1,
     b="}")
class A(Base):
    """doc: with def f(): inside"""
    n: int = 5
    names: dict[str, int]
    class Inner:
        async def run(self, a: int = {"x": 1}, *args, **kw) -> "list[int]":
            def hidden(): pass
            return 1
    @property
    def p(self): return "class X:"
def top(a,
        b=(1, 2),  # comment (
        c: str = 'x'):
    class Local: pass
if True:
    def guarded(): ...
s = """
def no(): pass
"""
'''

SCRIPT = """
import x from "y";
// class No {
export class A extends B {
  constructor(a = "}") { if (a) { foo(); } }
  async m(x) { return `}${x}`; }
}
function top(a, b) { function inner() {} }
const f = async (x) => { return {a: 1}; };
const o = { k: 1 };
"""

RUST = """
use std::io;
pub struct P<'a> { x: &'a str, c: char }
impl<'a> P<'a> {
    pub fn new(x: &'a str) -> Self { let c = '{'; P { x, c } }
}
pub fn main() -> i32 { 0 }
"""

C = """#include <stdio.h>
static int add(int a, int b) { return a + b; }
namespace n { class K : public B { int get() const { return 1; } virtual void h(int x); }; }
"""

GO = 'package main\nimport "fmt"\ntype T struct { a int }\nfunc (t *T) Name(x int) string { return "{" }\nfunc main() { for { } }\n'


def kinds(lang, code):
    return [(depth, kind, name) for _, depth, kind, name, _ in outline.symbols_of(lang, code)]


def test_python_outline():
    found = list(outline.symbols_of("python", PYTHON))
    assert [(line, depth, kind, name) for line, depth, kind, name, _ in found] == [
        (2, 0, "import", ""), (3, 0, "import", ""), (5, 0, "constant", "LIMIT"), (9, 0, "class", "A"), (11, 1, "field", "A.n"), (12, 1, "field", "A.names"), (13, 1, "class", "A.Inner"),
        (14, 2, "method", "A.Inner.run"), (18, 1, "method", "A.p"), (19, 0, "function", "top"), (24, 0, "function", "guarded"),
    ]
    by_name = {name: s for *_, name, s in found}
    assert by_name["A.Inner.run"] == 'async def run(self, a: int = ..., *args, **kw) -> "list[int]"'
    assert by_name["A"] == '@dec(a=1, b="}")\nclass A(Base)' and by_name["A.p"] == "@property\ndef p(self)"
    assert by_name["top"] == "def top(a, b = ..., c: str = ...)" and by_name["A.n"] == "n: int = ..." and by_name["A.names"] == "names: dict[str, int]"


def test_brace_outlines():
    assert kinds("javascript", SCRIPT) == [(0, "import", ""), (0, "class", "A"), (1, "method", "A.constructor"), (1, "method", "A.m"), (0, "function", "top"), (0, "function", "f")]
    assert kinds("rust", RUST) == [(0, "import", ""), (0, "class", "P"), (0, "class", "P"), (1, "method", "P.new"), (0, "function", "main")]
    assert kinds("cpp", C) == [(0, "import", ""), (0, "function", "add"), (0, "class", "n"), (1, "class", "n.K"), (2, "method", "n.K.get"), (2, "method", "n.K.h")]
    assert kinds("go", GO) == [(0, "import", ""), (0, "import", ""), (0, "class", "T"), (0, "function", "Name"), (0, "function", "main")]
    assert kinds("css", "p{margin:0} /* q{ */ .a .b{content:'}'}") == [(0, "rule", "p"), (0, "rule", ".a .b")]


@pytest.mark.parametrize("lang", ["python", "javascript", "rust"])
@pytest.mark.parametrize("text", ["", "{" * 50_000, '"' * 100_001, "/*" * 50_000, "'''" * 30_001, "(" * 100_000, "def f(" * 20_000, "class A {" * 20_000, "\\" * 100_000, "`" * 100_001, "x = (\n" * 30_000])
def test_any_text_takes_linear_time(lang, text):
    began = time.perf_counter()
    list(outline.symbols_of(lang, text))
    assert time.perf_counter() - began < 10


def test_outline_rows(spark):
    files = spark.createDataFrame([("a/m.py", PYTHON), ("b.js", SCRIPT), ("none.go", None), ("c.css", "p{a:b}"), ("odd.txt", "just words"), ("empty.py", "")], "path string, code string")
    rows = {r.path: r for r in outline.outlines(files).collect()}
    assert len(rows) == 6 and rows["a/m.py"].symbol_count == 6 and rows["b.js"].language == "javascript"
    text = rows["a/m.py"].summary_text.split("\n")
    assert text[0] == "# m.py (27 lines)" and "        async def run(self, a: int = ..., *args, **kw) -> \"list[int]\": ..." in text and "    @property" in text
    assert rows["a/m.py"].summary_tokens == len(rows["a/m.py"].summary_text) // 4 and rows["a/m.py"].original_tokens == len(PYTHON) // 4
    assert rows["none.go"].summary_text == "# none.go (0 lines)" and rows["odd.txt"].symbol_count == 0


# -- staged skeletons


def brute_stage(nodes, query, mode, ratio, top_k):
    """Kept positions and total of each stage; ``nodes`` are (id, importance, vector)."""
    n = len(nodes)
    cos = lambda v: float(v @ query / (np.linalg.norm(v) * np.linalg.norm(query))) if np.linalg.norm(v) and np.linalg.norm(query) else 0.0
    rel = {i: cos(v) for i, _, v in nodes}
    budget = max(1, int(n * ratio))
    out = {"baseline": ({i for i, _, _ in sorted(nodes, key=lambda x: (-x[1], x[0]))[:budget]}, n)}
    if mode == "baseline":
        return out
    order = sorted(rel, key=lambda i: (-rel[i], i))
    for stage, anchors in (("query_guided", set()), ("evidence_aware", set(order[:top_k]))):
        kept = set(order) if n <= 3 else set(order[: max(2, n // 2)]) | anchors
        some = [x for x in nodes if x[0] in kept]
        total = sum(max(rel[i], 0) for i, *_ in some)
        share = {i: min(1.0, max(0.05, max(rel[i], 0) / total * ratio * len(some) if total > 0 else ratio)) for i, *_ in some}
        want = max(budget, sum(s >= ratio for s in share.values()))
        picked = set(anchors)
        if len(anchors) < want:
            def scaled(f):
                xs = [f(x) for x in some]
                return [(x - min(xs)) / (max(xs) - min(xs)) if max(xs) > min(xs) else 1.0 for x in xs]

            base = dict(zip([x[0] for x in some], (0.25 * a + 0.55 * b + 0.2 * c for a, b, c in zip(scaled(lambda x: x[1]), scaled(lambda x: rel[x[0]]), scaled(lambda x: share[x[0]]), strict=True)), strict=True))
            unit, done = {x[0]: x[2] / np.linalg.norm(x[2]) for x in some}, []
            while len(done) < min(want, len(some)):
                now = {i: base[i] - (0.5 * max(float(unit[i] @ unit[j]) for j in done) if done else 0.0) for i in sorted(base) if i not in done}
                done.append(max(now, key=lambda i: (now[i], -i)))
            picked |= set(done)
        out[stage] = (picked, len(some))
        if stage == mode:
            break
    return out


def test_trace_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    chunks, requests, want = [], [], {}
    for f in range(24):
        n, mode = int(rng.integers(1, 20)), stages.STAGES[f % 3]
        query = rng.normal(size=6)
        nodes = [(k, float(rng.random()), rng.normal(size=6)) for k in range(n)]
        chunks += [(f, k, k, f"Sentence number {k} of the file is here.", 10, imp, v.tolist()) for k, imp, v in nodes]
        requests.append((f, mode, None if mode == "baseline" else query.tolist()))
        want[f] = brute_stage(nodes, query, mode, 0.3, 3)
    table = spark.createDataFrame(chunks, "file_id int, id long, position int, text string, tokens int, importance double, embedding array<double>")
    asked = spark.createDataFrame(requests, "file_id int, mode string, query_embedding array<double>")
    rows = stages.trace(table, asked, ratio=0.3, top_k=3).collect()
    assert len(rows) == sum(len(w) for w in want.values())
    for r in rows:
        kept, total = want[r.file_id][r.stage]
        assert {int(x) for x in re.findall(r"(?m)^\[(\d+)\]", r.skeleton_text)} == kept and (r.total_nodes, r.anchor_nodes) == (total, len(kept))
        assert r.final == (r.stage == stages.STAGES[r.file_id % 3]) and r.evidence_used == (r.stage == "evidence_aware") == r.skeleton_text.startswith("=== EVIDENCE STATUS")
    assert stages.staged_skeletons(table, asked).count() == 24


def test_automatic_mode(spark):
    from pyspark.sql import functions as F

    report = "# Audit of x\n" + "".join(f"## Part {k}\n{k}. Finding\n" for k in range(3)) + "Verdict: good"
    rows = spark.createDataFrame([(report, None), ("prose", "why?"), ("prose", " "), (report, "own?"), (None, None)], "t string, q string")
    mode, query = stages.resolved(F.col("t"), F.col("q"))
    assert [tuple(r) for r in rows.select(F.coalesce(mode, F.lit("baseline")), query).collect()] == [("evidence_aware", "Audit of x"), ("query_guided", "why?"), ("baseline", None), ("evidence_aware", "own?"), ("baseline", None)]


def test_random_python_is_no_error():
    rng = random.Random(3)
    words = ["def", "class", "f", "(", ")", ":", "\n", "    ", '"', "'''", "#", "@", "=", "import", ",", "{", "}", "->", "async", "\\\n"]
    for _ in range(300):
        text = "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(40))
        for lang in ("python", "java", "rust"):
            list(outline.symbols_of(lang, text))


# -- documents in their rows


def _files(spark):
    """Documents (doc_id, lang, text) of several kinds: empty, one chunk, copied paragraphs, headings, many chunks."""
    rng, words = random.Random(5), "alpha beta gamma delta verdict result critical river mountain seven eleven plan".split()
    said = lambda n: " ".join(" ".join(rng.choices(words, k=rng.randint(6, 14))).capitalize() + "." for _ in range(n))
    texts = [None, "", "  \n \n", "One line only.", "\n\n".join([said(6)] * 5)]
    texts += ["\n\n".join(said(rng.randint(1, 9)) for _ in range(rng.randint(2, 12))) for _ in range(12)]
    texts += ["".join(f"## Part {k}\n{k}. Finding\n{said(rng.randint(1, 20))}\n" for k in range(6)) for _ in range(4)]
    texts.append("\n\n".join(said(7) for _ in range(90)))
    return spark.createDataFrame([(k, ("en", "de")[k % 2], t) for k, t in enumerate(texts)], "doc_id long, lang string, text string")


def _asked(docs):
    from pyspark.sql import functions as F

    mode = F.when(F.col("doc_id") % 5 == 4, stages.STAGES[0]).when(F.col("lang") == "en", stages.STAGES[2]).otherwise(stages.STAGES[1])
    return mode, F.when(F.col("doc_id") % 7 != 6, F.lit("verdict of the river plan"))


def _same(left, right):
    assert left.columns == right.columns
    left, right = (sorted((tuple(r) for r in x.collect()), key=repr) for x in (left, right))
    assert left == right and left


def test_documents_in_their_rows_are_as_by_rows(spark):
    from pyspark.sql import functions as F

    from weftline.operators import skeleton

    docs = _files(spark)
    mode, query = _asked(docs)
    asked = docs.select(F.col("doc_id").alias("file_id"), mode.alias("mode"), query.alias("q"))
    requests = skeleton.embed(asked, text="q").withColumn("query_embedding", F.when(F.col("q").isNotNull(), F.col("embedding")))
    chunks = skeleton.scored_chunks(docs)
    assert docs.count() - 3 == chunks.select("file_id").distinct().count()
    in_rows = stages.document_trace(docs, mode, query)
    _same(in_rows, stages.trace(chunks, requests))
    _same(in_rows, stages.document_trace(docs, mode, query, most=10))  # larger documents by rows
    _same(stages.document_skeletons(docs, mode, query), in_rows.filter("final").drop("final"))
    by_rows = skeleton.rendered(skeleton.select_top(chunks, 0.2))
    _same(skeleton.flagship(docs), by_rows)
    _same(skeleton.flagship(docs, most=10), by_rows)
    assert skeleton.large_documents(docs, 10).count() == chunks.groupBy("file_id").count().filter("count > 10").count() > 0
    assert skeleton.large_documents(docs) is None


@pytest.mark.parametrize("name", ["staged_skeletons", "skeleton_trace", "document_skeletons"])
def test_skeletons_exchange_and_stage_nothing(spark, tmp_path, monkeypatch, name):
    """Documents in as many partitions as tasks run at once stay in them, and are chunked and scored once."""
    import __spark_entry__ as entry

    from weftline import staging

    _files(spark).repartition(2 * spark.sparkContext.defaultParallelism).write.parquet(str(tmp_path / "documents.parquet"))
    made = []
    monkeypatch.setattr(staging, "scratch", lambda spark, name: made.append(name) or str(tmp_path / f"{name}-{len(made)}"))
    sizes = {"spark.sql.files.openCostInBytes": "1048576", "spark.sql.files.maxPartitionBytes": "1048576"}
    before = {k: spark.conf.get(k) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        rows = entry.queries()[name](spark, str(tmp_path))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("ArrowEvalPython [scored") == plan.count("Generate explode(array(") == 1
        assert rows.count() and not made
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
