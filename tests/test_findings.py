"""Cases that a review found: each failed before its finding was mended."""

import re

import numpy as np
from pyspark.sql import functions as F

from weftline.functions import metatokens, text as tx
from weftline.operators import clifilter, dedup, graph, grouped, memory, postings, promptcache, reingest, retrieval, savings, tfidf
from weftline.sources import connectors


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_budget_levels_go_by_the_rounded_use(spark):
    # 0.1 + 0.2 + ... of ten tenths stays just below 1 in doubles
    events = spark.createDataFrame([(k, 1, k, 0.1) for k in range(10)], "event_id int, user_id int, ts int, value double")
    last = savings.budget(events, 2).orderBy(F.desc("event_id")).first()
    assert (last.used, last.level) == (1.0, "notice")


def test_contradictions_take_words_as_ascii(spark):
    rows = spark.createDataFrame([(1, "a", "f\u00fcr und\u00dfheite"), (2, "a", "und"), (3, "a", "of")], "memory_id int, category string, text string")
    found = memory.contradictions(rows, [(r"\bund\b", r"\bof\b")]).first()
    assert (found.n_positive, found.first_positive, found.n_negative) == (2, 1, 1)


def test_json_is_the_whole_text(spark):
    drift = promptcache.drift(F.col("a"), F.col("b"))
    cases = (("2024 x", "2024 x more"), ("1", "1 more"), ("[1] x", "[1] y"), ("1", "1, 2"), ("null", " null\n,"), ("[1, 2]", "[1,2]"), ("null", "[null][0]"))
    assert [one(spark, drift, a=a, b=b) for a, b in cases] == ["semantic"] * 5 + ["json", "semantic"]
    kinds = [one(spark, connectors.structured_kind(F.col("t")), t=t) for t in ('{"a": 1}', '{"a": 1} x', "[1]", "[1] x", '{"a": 1}\n{"b": 2}', '{"a": 1}\n{"b": 2} x')]
    assert kinds == ["json_object", None, "json_array", None, "jsonl", None]


def test_pruned_scores_that_are_equal_as_shown_go_by_id(spark):
    rows = spark.createDataFrame([(7, "a", [0.6 + 1e-9, 0.8]), (3, "a", [0.6, 0.8]), (9, "a", [0.0, 1.0])], "vec_id int, label string, embedding array<double>")
    assert [(r.vec_id, r["rank"]) for r in retrieval.prune_by_relevance(rows, [1.0, 0.0], 0.5).orderBy("rank").collect()] == [(3, 1), (7, 2)]


def test_repeated_runs_of_rows_with_one_id_count_together_and_only_texts_are_exchanged(spark):
    texts = [(1, "a b c"), (2, "x\x1cy z x\x1cy z"), (None, "p q p q p q p q"), (1, "b c a b c"), (3, None)]
    found = dedup.repeated_ngrams(spark.createDataFrame(texts, "doc_id int, text string"), 2, 20)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "Aggregate" not in plan
    got = {(r.id, r.n, r.ngram): (r.freq, r.savings) for r in found.collect()}
    assert got == {(1, 2, "b c"): (3, 1), (None, 2, "p q"): (4, 2), (None, 2, "q p"): (3, 1), (None, 3, "p q p"): (3, 3), (None, 3, "q p q"): (3, 3), (None, 4, "p q p q"): (3, 5), (None, 4, "q p q p"): (2, 2), (None, 5, "p q p q p"): (2, 3), (None, 5, "q p q p q"): (2, 3)}


def test_vectors_are_copied_to_a_bounded_number_of_blocks(spark):
    import numpy as np

    m = np.random.default_rng(3).normal(size=(1200, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = spark.createDataFrame([(k, k % 2, v.tolist()) for k, v in enumerate(m)], "vec_id long, label int, embedding array<double>")
    n = spark.createDataFrame([(x,) for x in (0, 1, 600, 40_000, 500_000, 2_000_000)], "n long").select(graph._blocks(F.col("n"), 512).alias("b"))
    assert [r.b for r in n.collect()] == [1, 1, 2, 32, 32, 123]
    w = m @ m.T
    want = {(i, j) for i, j in zip(*np.nonzero(w > 0.95)) if i < j}
    for block in (200, 5000):  # many small blocks once, and one that takes several strips
        got = {(r.src, r.dst) for r in graph.similarity_edges(rows.withColumn("label", F.lit(1)), 0.95, block=block).collect()}
        assert got == want
        got = {(r.a, r.b) for r in graph.cross_group_pairs(rows, 0.95, block=block).collect()}
        assert got == {(i, j) for i, j in want if (i + j) % 2}


def test_components_are_linked_by_spanning_pairs_only(spark):
    rows = spark.createDataFrame([(k, k % 2, [1.0, k / 1000]) for k in range(40)] + [(99, 0, [0.0, 1.0])], "vec_id long, label int, embedding array<double>")
    pairs, few = (graph.cross_group_pairs(rows, 0.9, spanning=s) for s in (False, True))
    assert pairs.count() == 400 and few.count() == 39
    assert {tuple(r) for r in dedup.components(few).collect()} == {tuple(r) for r in dedup.components(pairs).collect()} == {(k, 0) for k in range(40)}


def test_term_counts_leave_the_tasks_summed(spark):
    docs = spark.createDataFrame([(1, "café CAFE the cafe"), (1, "cafe noir"), (None, None), (2, "noir café")], "doc_id int, text string").coalesce(1)
    words = tfidf.Vocabulary.fit(docs, max_df=1.0)
    assert {(r.term, r.df) for r in words.table.collect()} == {("cafe", 3), ("noir", 2), ("cafe cafe", 1), ("cafe noir", 1), ("noir cafe", 1)}
    found = words.weights(docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "MapInArrow" in plan
    got = {(r.id, r.term): r.weight for r in found.collect()}
    assert set(got) == {(1, "cafe"), (1, "cafe cafe"), (1, "noir"), (1, "cafe noir"), (2, "cafe"), (2, "noir"), (2, "noir cafe")}
    assert abs(sum(w * w for (i, _), w in got.items() if i == 1) - 1) < 1e-9 and got[1, "cafe"] > got[1, "cafe noir"]


def test_repeated_runs_are_those_of_all_windows():
    import random
    from collections import Counter

    rng = random.Random(5)
    for _ in range(200):
        lines = [[rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(0, 5))]
        want = {(n, r, f) for n in range(2, 9) for r, f in Counter(tuple(x[i : i + n]) for x in lines for i in range(len(x) - n + 1)).items() if f > 1}
        assert {(n, tuple(r), f) for n, r, f in metatokens.repeated_runs(lines, 8)} == want


def test_few_ranks_are_sent_to_the_edges(spark, monkeypatch):
    plans, staged = [], graph.staged

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return staged(df, name)

    monkeypatch.setattr(graph, "staged", noted)
    edges = spark.createDataFrame([(k, k + 1, 1.0) for k in range(6)], "src long, dst long, weight double")
    graph.pagerank(edges, rounds=3, in_task=0, tolerance=0).collect()
    rounds = [p for name, p in plans if name == "ranks"][1:]
    assert len(rounds) == 3 and all("strategy=broadcast" in p for p in rounds)


def test_links_of_vectors_are_counted_and_exact(spark, monkeypatch):
    monkeypatch.setattr(graph, "COUNTED", 300)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(200, 16))
    v = np.vstack([base, base[rng.integers(0, 200, 700)] + rng.normal(size=(700, 16)) * 0.15, base[:1].repeat(400, 0), base[:20]]).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9000, [0.0] * 16), (9001, None)]
    nodes = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    first, copies = {}, {}
    for i, x in enumerate(v):
        k = first.setdefault(x.tobytes(), i)
        copies[k] = copies.get(k, 0) + 1
    ids = sorted(copies)
    links = dict(zip(ids, ((unit[ids] @ unit[ids].T > 0.9).sum(axis=1) - 1).tolist(), strict=True))
    want = {(i, k := first[x.tobytes()], copies[k], links[k]) for i, x in enumerate(v)} | {(9000, 9000, 1, 0), (9001, 9001, 1, 0)}
    assert {tuple(r) for r in graph.near_links(nodes, 0.9).collect()} == want and sum(links.values()) > 1000
    assert graph.near_links(nodes.limit(0), 0.9).count() == 0


def test_large_groups_are_ranked_by_joins(spark):
    rng = np.random.default_rng(4)
    edges = [(g, int(a), int(b), float(w)) for g, n in (("x", 90), ("y", 70), ("z", 5)) for a, b, w in zip(rng.integers(0, 25, n), rng.integers(0, 25, n), rng.random(n), strict=True)]
    edges += [("x", 100, 101, 0.0), ("y", 3, 3, 0.5)]
    table = spark.createDataFrame(edges, "label string, src long, dst long, weight double").repartition(4)
    want = {(r.label, r.node): r["rank"] for r in graph.pagerank_by_group(table).collect()}
    found = graph.pagerank_of_groups(table, in_task=20)
    got = {(r.label, r.node): r["rank"] for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    none = table.limit(0)
    assert graph.pagerank_of_groups(none, in_task=20).count() == 0
    assert {(r.label, r.node) for r in graph.pagerank_of_groups(table).collect()} == want.keys()


def test_percentiles_rank_ranges_not_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(g, float(v)) for g, n in (("a", 700), (None, 300), ("b", 1)) for v in rng.integers(0, 90, n)] + [("a", None), ("c", None)]
    found = savings.percentiles(spark.createDataFrame(rows, "g string, v double").repartition(3), "g", "v")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "windowspecdefinition(g#" in plan
    want = {g: sorted(v for k, v in rows if k == g and v is not None) for g in ("a", None, "b")}
    assert {tuple(r) for r in found.collect()} == {(g, *(v[min(int(len(v) * q), len(v) - 1)] for q in (0.5, 0.95, 0.99))) for g, v in want.items()}


def test_slow_patterns_wait_for_what_they_need(spark):
    docs = spark.createDataFrame([(0, "see src/a-b/main.py:12:3 or x.y"), (1, "no place here, x.y"), (2, None), (3, "end.py:7")], "i int, text string")
    pattern = tx.IDENTIFIERS["file_path_loc"]
    every = {r.i: r.x for r in docs.select("i", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("x")).collect()}
    found = {r.i: r.x for r in docs.select("i", tx.identifiers(F.col("text")).alias("x")).collect()}
    assert every[0] == ["src/a-b/main.py:12:3"] and every[3] == ["end.py:7"] and found[2] is None
    assert found[0][0] == every[0][0] and found[3][0] == every[3][0] and found[1] == ["place", "here"] and tx.NEEDED.keys() <= tx.IDENTIFIERS.keys()


def test_groups_of_arrays_span_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = spark.createDataFrame([(k, i) for k, n in (("a", 7), (None, 4), ("b", 1)) for i in range(n)], "g string, x long")
        found = grouped.by_group_arrays(rows, ["g"], lambda b: (np.array([b.num_rows]), np.array([b.column("x").to_numpy().sum()])), "g string, n long, s long", at_once=1)
        assert {tuple(r) for r in found.collect()} == {("a", 7, 21), (None, 4, 6), ("b", 1, 0)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_f10_searches_exchange_no_pairs_of_queries_and_documents(spark, monkeypatch):
    texts = ["red fish", "red bird", "red fish", None, "", "fish fish bird_2 RED", "blue"] * 9
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    asked = spark.createDataFrame([(7, "red red fish"), (8, "bird_2 blue"), (9, "none such"), (None, "bird")], "query_id long, query string")
    monkeypatch.setattr(postings, "CELLS", 20)
    monkeypatch.setattr(postings, "TERMS", 5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        index = postings.Index.build(docs)
        found = index.search(asked, 13)
        assert not re.search(r"hashpartitioning\(query_id#\d+L?, id#", found._jdf.queryExecution().executedPlan().toString())
        rows = sorted(map(str, found.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    monkeypatch.setattr(postings, "SMALL_TABLE", 0)
    joined = index.search(asked, 13)
    assert joined.dtypes == found.dtypes
    assert rows == sorted(map(str, joined.collect())) and len(rows) == 13 + 13 + 9


def test_f15_outputs_are_filtered_and_guarded_without_exchanges(spark):
    trace = "\n".join(["Error"] + [f"  at f{k} (a.js:{k})" for k in range(9)] + ["x", "x", "", "    at g (b.js:1)", ""])
    texts = [trace, "x", "", None, "a\na\na\nb\na\n", "This is really the code E_FAIL1 at 12.5% of https://a.b/c the very end. " * 9, "\x1b[1mred\x1b[0m\n\n\n\n\n\nNAME_ONE füré 12e5"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for made in (clifilter.intercepted(docs, least=5), clifilter.generic(docs), clifilter.collapse_runs(docs), clifilter.elide_frames(docs)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    shown = {r.id: r.text for r in clifilter.generic(docs).collect()}
    assert shown[0].split("\n") == ["Error", *[f"  at f{k} (a.js:{k})" for k in range(5)], "    ... 2 frames elided", "  at f7 (a.js:7)", "  at f8 (a.js:8)", "x (repeated 2 times)", "", "    at g (b.js:1)", ""]
    assert (shown[1], shown[2], shown[4], shown[6]) == ("x", "", "a (repeated 3 times)\nb\na\n", "red\n\nNAME_ONE füré 12e5") and 3 not in shown
    names = tx.identifiers(F.col("text")).alias("x")
    assert docs.filter("doc_id = 6").select(names).first().x == ["NAME_ONE", "12e5"]
    assert docs.filter("doc_id = 5").select(names).first().x == ["E_FAIL1", "https://a.b/c", "12.5%", "This", "really", "the", "code", "https", "very", "end"]


def test_f25_two_versions_are_exchanged_once_together(spark):
    parts = F.split(F.col("text"), " ")
    old = spark.createDataFrame([(1, "a b a c"), (2, "x")], "doc_id long, text string")
    new = spark.createDataFrame([(1, "a c d a a"), (3, "y")], "doc_id long, text string")
    found = reingest.matched(reingest.chunked(old, parts).withColumn("embedding", F.array(F.lit(1.0))), reingest.chunked(new, parts))
    assert len(re.findall(r"Exchange hashpartitioning", found._jdf.queryExecution().executedPlan().toString())) == 1
    rows = sorted((r.file_id, r.status, -1 if r.position is None else r.position, -1 if r.old_position is None else r.old_position) for r in found.collect())
    assert rows == [(1, "gone", -1, 1), (1, "kept", 0, 0), (1, "moved", 1, 3), (1, "moved", 3, 2), (1, "new", 2, -1), (1, "new", 4, -1), (2, "gone", -1, 0), (3, "new", 0, -1)]
