"""Rule files with their tests, cells of hyperplanes by recall, PageRank by both ways."""

from __future__ import annotations

import re

import numpy as np
import pytest

from weftline.operators import graph, rules

FILE = r"""
[filters.build]
description = "compiler output"
match_command = "^make|cargo"
strip_ansi = true
strip_lines_matching = ["^Compiling", "^\\s*$"]
truncate_lines_at = 10
max_lines = 4
on_empty = "ok"
unknown = 1

[filters.tail]
match_command = "LOGS"
head_lines = 5
tail_lines = 2

[filters.wrong]
match_command = "a(b"
strip_lines_matching = ["(", "x"]
keep_lines_matching = ["keep"]

[[tests.build]]
name = "empty"
input = "Compiling a\nCompiling b\n"
expected = "ok"

[[tests.build]]
name = "fails"
input = "x"
expected = "y"

[[tests.none]]
input = "x"
expected = "x"
"""


def applied(rule, text):
    """The stages in plain Python."""
    lines = text.splitlines()
    if rule.strip_ansi:
        lines = [re.sub(rules.ANSI, "", x) for x in lines]
    for patterns, keep in ((rule.strip_lines_matching, False), (rule.keep_lines_matching, True)):
        try:
            lines = [x for x in lines if not patterns or any([re.search(p, x) for p in patterns]) == keep]
        except re.error:
            pass
    lines = [x[: rule.truncate_lines_at] if rule.truncate_lines_at else x for x in lines]
    lines = lines[: rule.head_lines] if rule.head_lines else lines
    lines = lines[-rule.tail_lines :] if rule.tail_lines else lines
    if rule.max_lines and len(lines) > rule.max_lines:
        half = rule.max_lines // 2
        lines = [*lines[:half], f"... ({len(lines) - 2 * half} lines omitted) ...", *(lines[-half:] if half else [])]
    return rule.on_empty if rule.on_empty and not "\n".join(lines).strip() else "\n".join(lines)


def test_rules_match_plain_python(spark):
    found = rules.RuleSet.parse(FILE)
    texts = ["", "\n\n", "one", "one\r\ntwo\rthree\n", "\x1b[31mred\x1b[0m text that is long", "Compiling x\n" * 3, "\n".join(f"line {k}" for k in range(12)), "keep this\nnot this\nkeep", None]
    commands = {"make all": "build", "cargo test": "build", "show logs": "tail", "a(b c": "wrong", "ls": None, None: None}
    rows = [(k, c, t) for k, (c, t) in enumerate((c, t) for c in commands for t in texts)]
    got = found.applied(spark.createDataFrame(rows, "id int, command string, text string")).collect()
    by_name = {r.name: r for r in found.rules}
    for r in got:
        name = commands[r.command]
        assert r.rule == name
        assert r.filtered == (None if name is None or r.text is None else applied(by_name[name], r.text)), (r.command, r.text)


def test_rule_files_and_their_tests(spark):
    found = rules.RuleSet.parse(FILE)
    rows = [(r.rule, r.name, r.passed) for r in found.verified(spark).collect()]
    assert rows == [("build", "empty", True), ("build", "fails", False), ("none", "unnamed", False)]
    assert rules.RuleSet.parse("not [toml").rules == [] and rules.RuleSet.parse("").verified(spark).count() == 0
    first = rules.RuleSet.parse('[filters.mine]\nmatch_command = "make"\non_empty = "mine"')
    both = (first + found).applied(spark.createDataFrame([("make", "")], "command string, text string")).first()
    assert (both.rule, both.filtered) == ("mine", "mine")
    odd = rules.Rule("odd", max_lines=1)
    assert spark.createDataFrame([("a\nb\nc",)], "t string").select(odd.applied(__import__("pyspark").sql.functions.col("t"))).first()[0] == applied(odd, "a\nb\nc")


def near_vectors(seed, n=1500, width=48):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, width))
    copies = base[rng.integers(0, n, n // 3)] + rng.normal(size=(n // 3, width)) * rng.uniform(0.02, 0.5, size=(n // 3, 1))
    return np.vstack([base, copies, base[:20], base[:1].repeat(30, 0)]).astype(np.float32)


@pytest.mark.parametrize("threshold", [0.8, 0.95])
def test_cells_reach_their_recall(spark, threshold):
    v = near_vectors(1)
    nodes = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(9000, [0.0] * 48), (9001, None)], "vec_id long, embedding array<float>")
    got = {(r.a, r.b): r.similarity for r in graph.near_pairs(nodes, threshold).collect()}
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    first = {}
    for i, x in enumerate(v):
        first.setdefault(x.tobytes(), i)
    named = [first[x.tobytes()] for x in v]
    copies = {(k, i) for i, k in enumerate(named) if k != i}
    a, b = np.nonzero(np.triu(unit @ unit.T > threshold, 1))
    want = {(int(x), int(y)) for x, y in zip(a, b, strict=True) if named[x] == x and named[y] == y}
    pairs = set(got) - copies
    assert copies <= set(got) and pairs <= want and len(want) > 100
    assert len(pairs) >= 0.95 * len(want)
    assert all(abs(s - unit[x] @ unit[y]) < 1e-4 for (x, y), s in got.items())


def test_cells_are_small_and_few(spark):
    v = near_vectors(2)
    nodes = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    placed = graph.cells(nodes, 0.9, size=50)
    rows = placed.count()
    assert rows < len(v) ** 1.5 and placed.groupBy("cell").count().agg({"count": "avg"}).first()[0] < 200
    assert graph.near_pairs(nodes.limit(0), 0.9).count() == 0


@pytest.mark.parametrize("loose", [False, True])
def test_pagerank_is_one_rule(spark, loose):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 25, 60), rng.integers(0, 25, 60), rng.random(60), strict=True)]
    edges += [(100, 101, 0.0), (101, 102, 0.0), (3, 100, 0.0), (7, 7, 0.5)] if loose else []
    table = spark.createDataFrame(edges, "src long, dst long, weight double")
    small = {r.node: r["rank"] for r in graph.pagerank(table, rounds=9, tolerance=0).collect()}
    joined = {r.node: r["rank"] for r in graph.pagerank(table, in_task=0, rounds=9, every=3, tolerance=0).collect()}
    assert small.keys() == joined.keys() and sum(joined.values()) == pytest.approx(1, abs=1e-6)
    assert all(joined[k] == pytest.approx(small[k], rel=1e-9) for k in small)
    assert graph.pagerank(table.limit(0), in_task=-1).count() == 0
