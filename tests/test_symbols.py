"""Graphs of code symbols against dense matrices."""

import random

import numpy as np
import pytest
from pyspark.sql import DataFrame

from weftline.operators import code, graph, symbols
from weftline.operators.skeleton import embed

SYMBOL = "id string, short string, calls array<string>"


def brute(rows, likeness=(), restart=None, alpha=0.85, rounds=120, tolerance=1e-6):
    """Ranks by the dense matrix of all pairs."""
    ids = [r[0] for r in rows]
    at = {x: k for k, x in enumerate(ids)}
    w = np.zeros((len(ids), len(ids)))
    for a, _, calls in rows:
        for b, short, _ in rows:
            if a != b and short is not None and short in set(calls or ()):
                w[at[a], at[b]] += 1
                w[at[b], at[a]] += 1
    for a, b, x in likeness:
        w[at[a], at[b]] += x
        w[at[b], at[a]] += x
    p = np.ones(len(ids))
    if restart and sum(x for _, x in restart):
        p = np.zeros(len(ids))
        for i, x in restart:
            p[at[i]] += x
    p /= p.sum()
    total, rank = w.sum(axis=1), p.copy()
    for _ in range(rounds):
        q = np.where(total > 0, rank / np.where(total > 0, total, 1), 0)
        new = alpha * (q @ w + rank[total <= 0].sum() * p) + (1 - alpha) * p
        change, rank = np.abs(new - rank).sum(), new
        if change < len(ids) * tolerance:
            break
    return dict(zip(ids, rank.tolist(), strict=True))


def drawn(seed, n=60):
    """Symbols of which a third bear one name, and a third call it; some call themselves, nobody or what nobody defines."""
    rng = random.Random(seed)
    names = ["main", *[f"f{k}" for k in range(15)]]
    short = lambda: "main" if rng.random() < 0.33 else rng.choice([*names, None])
    calls = lambda: None if rng.random() < 0.1 else [rng.choice([*names, "gone", "main"]) for _ in range(rng.randrange(5))]
    return [(f"a.py::{k}", short(), calls()) for k in range(n)]


@pytest.mark.parametrize(("seed", "how"), [(1, {"alpha": 0.5, "tolerance": 1e-4}), (2, {"rounds": 4})])
def test_ranks_equal_dense(spark, seed, how):
    rows = drawn(seed)
    alike = [(rows[k][0], rows[k + 7][0], 0.7 + k / 100) for k in range(0, 40, 9)]
    restart = [(rows[k][0], 1.0 + k) for k in (3, 8, 21)]
    built = symbols.SymbolGraph.build(spark.createDataFrame(rows, SYMBOL), spark.createDataFrame(alike, "src string, dst string, weight double"))
    found = {r.id: r["rank"] for r in built.rank(spark.createDataFrame(restart, "id string, weight double"), **how).collect()}
    assert found == pytest.approx(brute(rows, alike, restart, **how), abs=1e-12)
    assert sum(found.values()) == pytest.approx(1)


def test_no_weights_no_edges_and_empty(spark, monkeypatch):
    monkeypatch.setattr(symbols, "SMALL_NAMES", 0)  # names by exchange
    rows = drawn(3, 20)
    built = symbols.SymbolGraph.build(spark.createDataFrame(rows, SYMBOL))
    nothing = spark.createDataFrame([(rows[0][0], 0.0)], "id string, weight double")
    found = {r.id: r["rank"] for r in built.rank(nothing, rounds=3, tolerance=0.0).collect()}
    assert found == pytest.approx(brute(rows, rounds=3, tolerance=0.0), abs=1e-12)
    alone = symbols.SymbolGraph.build(spark.createDataFrame([("x", "f", ["f"]), ("y", "g", [])], SYMBOL))
    assert {r.id: r["rank"] for r in alone.rank(rounds=3).collect()} == pytest.approx({"x": 0.5, "y": 0.5})
    empty = symbols.SymbolGraph.build(spark.createDataFrame([], SYMBOL))
    assert empty.rank().collect() == []


@pytest.mark.parametrize(("seed", "rounds"), [(4, 5), (5, 1), (6, 0)])
def test_links_lie_with_their_symbols(spark, monkeypatch, seed, rounds):
    """Without likeness nothing is joined: neither the build nor a round exchanges links or ranks."""
    monkeypatch.setattr(symbols, "AT_ONCE", 7)  # several pieces a task
    monkeypatch.setattr(DataFrame, "join", None)
    weights = {3: 1.0, 8: 2.0, 21: -1.0}
    rows = [(*r, weights.get(k)) for k, r in enumerate(drawn(seed))]
    made = spark.createDataFrame(rows, SYMBOL + ", weight double").repartition(3)
    built = symbols.SymbolGraph.build(made, keep=("weight",))
    ranks = built.rank("weight", 0.5, rounds, 0.0)
    everywhere = built.rank(rounds=rounds, tolerance=1e-3)
    built.close()
    plain = [r[:3] for r in rows]
    want = brute(plain, restart=[(rows[k][0], x) for k, x in weights.items() if x > 0], alpha=0.5, rounds=rounds, tolerance=0.0)
    assert {r.id: r["rank"] for r in ranks.collect()} == pytest.approx(want, abs=1e-12)
    assert {r.id: r["rank"] for r in everywhere.collect()} == pytest.approx(brute(plain, rounds=rounds, tolerance=1e-3), abs=1e-12)


def test_dense_edge_cases_and_restarts_by_a_table(spark, monkeypatch):
    rows = drawn(7, 30)
    built = symbols.SymbolGraph.build(spark.createDataFrame(rows, SYMBOL))
    restart = [(rows[k][0], 1.0 + k) for k in (3, 8, 8, 21)]
    found = {r.id: r["rank"] for r in built.rank(spark.createDataFrame(restart, "id string, weight double"), rounds=4, tolerance=0.0).collect()}
    assert found == pytest.approx(brute(rows, restart=restart, rounds=4, tolerance=0.0), abs=1e-12)
    nothing = built.rank(spark.createDataFrame([(rows[0][0], 0.0)], "id string, weight double"), rounds=3, tolerance=0.0)
    assert {r.id: r["rank"] for r in nothing.collect()} == pytest.approx(brute(rows, rounds=3, tolerance=0.0), abs=1e-12)
    numbered = spark.createDataFrame([(2, "f", ["f", None, "f"], 0), (5, "g", [], 0), (7, None, None, 0)], "id long, short string, calls array<string>, w int")
    assert {r.id: r["rank"] for r in symbols.SymbolGraph.build(numbered, keep=("w",)).rank("w", rounds=3).collect()} == pytest.approx({2: 1 / 3, 5: 1 / 3, 7: 1 / 3})
    empty = symbols.SymbolGraph.build(spark.createDataFrame([], SYMBOL))
    assert empty.rank().collect() == []
    monkeypatch.setattr(symbols, "SMALL_NAMES", 0)  # kept columns where names are exchanged
    kept = symbols.SymbolGraph.build(spark.createDataFrame([(*r, 1 + k) for k, r in enumerate(rows)], SYMBOL + ", w int"), keep=("w",))
    want = brute(rows, restart=[(r[0], 1 + k) for k, r in enumerate(rows)], rounds=2, tolerance=0.0)
    assert {r.id: r["rank"] for r in kept.rank("w", rounds=2, tolerance=0.0).collect()} == pytest.approx(want, abs=1e-12)


FILES = [
    ("store.py", "import json\n\nclass Store:\n    def load(self, path):\n        return parse(open(path).read())\n\n    def save(self, path):\n        check(path)\n\ndef check(path):\n    '''Whether a path may be written.'''\n    return bool(path)\n"),
    ("parse.py", "def parse(text):\n    '''Reads a document into tokens.'''\n    return split(text)\n\ndef split(text):\n    return text.split()\n"),
    ("web.js", "function handler(req) {\n  return parse(req.body);\n}\n"),
]


def test_files_to_ranks_and_search(spark):
    rows = symbols.symbols(code.code_chunks(spark.createDataFrame(FILES, "path string, code string"))).cache()
    got = [(r.id, r.short, r.calls) for r in rows.collect()]
    assert {i.split("::")[1] for i, *_ in got} == {"Store", "Store.load", "Store.save", "check", "parse", "split", "handler"}
    vectors = embed(rows.select("id", "text"))
    keyed = {r.id: np.array(r.embedding, dtype=float) for r in vectors.collect()}
    ids = sorted(keyed)
    numbered = spark.createDataFrame([(k, keyed[i].tolist()) for k, i in enumerate(ids)], "vec_id long, embedding array<float>")
    near = [(ids[r.a], ids[r.b], r.similarity) for r in graph.near_pairs(numbered, 0.3, recall=0.999).collect()]
    built = symbols.SymbolGraph.build(rows, spark.createDataFrame(near, "src string, dst string, weight double") if near else None)
    assert {r.id: r["rank"] for r in built.rank(rounds=5).collect()} == pytest.approx(brute(got, near, rounds=5), abs=1e-12)

    question = "reads a document into tokens."
    q = np.array(embed(spark.createDataFrame([(question,)], "text string")).first().embedding, dtype=float)
    want = sorted(((-round(float(v @ q / max(np.linalg.norm(v) * np.linalg.norm(q), 1e-300)), 6), i) for i, v in keyed.items()))
    found = [(-r.score, r.id) for r in symbols.search(rows, question, 3).collect()]
    assert [i for _, i in found] == [i for _, i in want[:3]] and found[0][1].startswith("parse.py::parse")
    assert {r.id.split("::")[0] for r in symbols.search(rows, question, 5, "store.py").collect()} == {"store.py"}

    near_first = [r.id.split("::")[1] for r in symbols.related(rows, built, question, k=4, seeds=1, rounds=5).collect()]
    assert near_first[0] == "parse" and {"split", "handler"} & set(near_first)
