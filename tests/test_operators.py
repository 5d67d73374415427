"""Operators on small English, code and log fixtures that the tables lack."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from weftline.functions import numbers as num, text as tx
from weftline.operators import clifilter, code, dedup, dialogue, graph, memory, promptcache, quality, retrieval, savings, scopes, skeleton, temporal
from weftline.sources import connectors, sinks
from weftline.streaming import jobs


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_text_functions(spark):
    t = F.col("t")
    assert one(spark, tx.sentences(t), t="One. Two! Three? 四。五") == ["One.", "Two!", "Three?", "四。", "五"]
    assert one(spark, tx.heading_level(t), t="## Title\nbody") == 2 and one(spark, tx.heading_text(t), t="## Title\nbody") == "Title"
    assert one(spark, tx.first_heading_query(t), t="x\n# What is it\ny") == "What is it"
    assert [one(spark, tx.has_lexical_shape(t), t=x) for x in ('say "exact words"', "don't stop", "snake_case", "camelCase", "v2", "plain words")] == [True, False, True, True, True, False]
    assert one(spark, tx.key_entities(t), t="We met Alice in Paris. Then Bob left (Rome).")[:2] == ["Alice", "Paris"]
    assert one(spark, tx.summary(t, 30), t="# Head\n\nThe **quick** [fox](http://x) jumps over it all.").endswith("...")
    assert one(spark, tx.sanitize_segment(t), t="--a/b  c--") == "a-b-c" and one(spark, tx.sanitize_segment(t), t="///") == "item"
    assert one(spark, tx.escape_cell(t), t="a,b\\c\nd") == "a\\,b\\\\c\\nd"
    assert one(spark, tx.refined(t, 0.7), t="This is really the very simple answer that we need here") != "This is really the very simple answer that we need here"
    found = one(spark, tx.identifiers(t), t="at main (src/app.py:12) ECONNREFUSED 404 https://x.io/a 1.58.7 $1,234.50")
    assert {"src/app.py:12", "ECONNREFUSED", "404", "1.58.7", "$1,234.50"} <= set(found)
    assert "ECONNREFUSED" in one(spark, tx.guarded(t, F.lit("short")), t="failed with ECONNREFUSED")


def test_numbers(spark):
    v = F.col("a"), F.col("b")
    assert one(spark, num.cosine(*v), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(math.sqrt(0.5))
    assert one(spark, num.cosine(*v), a=[0.0, 0.0], b=[1.0, 1.0]) == 0
    assert [one(spark, num.finite_vector(F.col("a"), 2), a=x) for x in ([1.0, 2.0], [1.0, float("nan")], [float("inf"), 1.0], [1.0])] == [True, False, False, False]
    assert [one(spark, num.budget_status(F.col("a"), F.lit(100)), a=x) for x in (39, 40, 60, 75)] == ["ok", "warning", "urgent", "critical"]
    assert one(spark, num.rate_level(F.col("a"), F.col("a"), F.col("a")), a=0.5) == 0.2
    assert one(spark, num.nth_percentile(F.col("a"), 0.95), a=[float(x) for x in range(100)]) == 95


def test_bm25_repeats_and_stems(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha gamma"), (3, "delta"), (4, None)], "doc_id long, text string")
    once = {r.id: r.score for r in retrieval.bm25(docs, "alpha").collect()}
    twice = {r.id: r.score for r in retrieval.bm25(docs, "alpha alpha").collect()}
    assert set(once) == {1, 2} and twice[1] == pytest.approx(2 * once[1])
    long = spark.createDataFrame([(1, "compression"), (2, "compressed"), (3, "comp")], "doc_id long, text string")
    assert {r.id for r in retrieval.bm25(long, "compressing", stem=8).collect()} == {1, 2}


def test_graph(spark):
    v = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, [0.9, 0.1]), (0, 3, [0.0, 1.0]), (1, 4, [1.0, 0.0])], "label int, vec_id long, embedding array<float>")
    edges = graph.similarity_edges(v, 0.5, block=1, unit=False)
    assert [(r.src, r.dst) for r in edges.collect()] == [(1, 2)]
    chain = spark.createDataFrame([(0, 1, 2, 1.0), (0, 2, 3, 1.0)], "label int, src long, dst long, weight double")
    small = {r.node: r["rank"] for r in graph.pagerank_by_group(chain).collect()}
    assert sum(small.values()) == pytest.approx(1) and small[2] > small[1] == pytest.approx(small[3])
    large = {r.node: r["rank"] for r in graph.pagerank(chain, every=20, in_task=0).collect()}
    assert all(large[k] == pytest.approx(small[k], abs=1e-3) for k in small)
    chunks = spark.createDataFrame([(1, "# Head\nx", 0.1), (1, "CRITICAL finding", 0.1), (1, "plain", 0.1)], "file_id long, text string, importance double")
    got = {r.text: r.importance for r in graph.boosted(chunks).collect()}
    assert got["plain"] == 0 and got["CRITICAL finding"] == 1


def test_mmr_against_naive(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.normal(size=(12, 4))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    imp = rng.random(12)
    df = spark.createDataFrame([(0, i, m[i].tolist(), float(imp[i])) for i in range(12)], "label int, vec_id long, embedding array<double>, importance double")
    got = [r.id for r in skeleton.mmr(df, 5).orderBy("pick").collect()]
    base = 0.25 * (imp - imp.min()) / (imp.max() - imp.min()) + 0.75
    picked = []
    for _ in range(5):
        best = max((i for i in range(12) if i not in picked), key=lambda i: base[i] - 0.5 * max([0, *(float(m[i] @ m[j]) for j in picked)]))
        picked.append(best)
    assert got == picked


def test_chunks_and_skeleton(spark):
    text = "# Top\n\nintro words here\n\n## One\n\n" + "alpha beta gamma. " * 60 + "\n\n## Two\n\nshort"
    rows = skeleton.chunk_documents(spark.createDataFrame([(1, text), (2, "only one paragraph"), (3, ""), (4, None)], "doc_id long, text string"), budget=60).collect()
    assert [r.text for r in rows if r.file_id == 2] == ["only one paragraph"] and not [r for r in rows if r.file_id in (3, 4)]
    ones = [r for r in rows if r.file_id == 1]
    assert all(r.text.startswith("#") for r in ones) and {r.heading_text for r in ones} >= {"One", "Two"}
    picked = skeleton.select_top(spark.createDataFrame([(1, k, float(k), "text of it all", 4) for k in range(10)], "file_id long, position int, importance double, text string, tokens int"), 0.3)
    assert sorted(r.position for r in picked.filter("kept").collect()) == [7, 8, 9]
    assert skeleton.rendered(picked).first().anchor_nodes == 3


def test_components_and_distinct(spark):
    pairs = spark.createDataFrame([(0, 2), (1, 2), (5, 6)], "a long, b long")
    assert {r.node: r.component for r in dedup.components(pairs).collect()} == {0: 0, 1: 0, 2: 0, 5: 5, 6: 5}
    nodes = spark.createDataFrame([(i, f"t{i}") for i in (0, 1, 2, 5, 6, 9)], "id long, text string")
    got = {r.id: (r.occurrence_count, r.collapsed_from) for r in dedup.collapsed(nodes, pairs).collect()}
    assert got == {0: (3, [1, 2]), 5: (2, [6]), 9: (1, [])}
    rows = spark.createDataFrame([("a", 1, "use the cache"), ("a", 2, "Use the cache!"), ("a", 3, "other thing")], "category string, memory_id long, text string")
    assert sorted(r.memory_id for r in dedup.greedy_distinct(rows, 0.65, "category", "memory_id").collect()) == [1, 3]
    q = dedup.overlap_quality(spark.createDataFrame([(1, 1), (1, 2)], "g int, id int"), spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "g int, id int"), "g", "id").first()
    assert (q.precision, round(q.recall, 4), round(q.f1, 4)) == (0.5, 0.3333, 0.4)


DIFF = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n+one\n-two\n+three\ndiff --git a/y.py b/y.py\n+++ b/y.py\n+z"


def test_command_filters(spark):
    docs = lambda *t: spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    got = {r.file: (r.added, r.removed, r.changes) for r in clifilter.diff_stats(docs(DIFF)).collect()}
    assert got == {"x.py": (2, 1, ["+one", "-two", "+three"]), "y.py": (1, 0, ["+z"])}
    assert one(spark, clifilter.strip_ansi(F.col("t")), t="\x1b[31mred\x1b[0m\r") == "red"
    kinds = [DIFF, "On branch main\n", "=== FAILURES ===\n", "a.py:1:2: E501 long", "2024-01-01 10:00:00 x", "[1, 2]", "words"]
    assert [r.k for r in docs(*kinds).orderBy("doc_id").select(clifilter.command_kind(F.col("text")).alias("k")).collect()] == ["git_diff", "git_status", "test", "lint", "log", "json", "generic"]
    assert {r.state: r.files for r in clifilter.status_groups(docs("\tmodified:   a.py\n\tmodified:   b.py\n\tdeleted:    c.py")).collect()} == {"modified": ["a.py", "b.py"], "deleted": ["c.py"]}
    assert [(r.rule, r.n, r.files) for r in clifilter.lint_groups(docs("a.py:1:2: E501 long\nb.py:3:4: E501 long")).collect()] == [("E501", 2, 2)]
    trace = "start\n" + "\n".join(f"    at f{k} (x.js:{k})" for k in range(12)) + "\nend"
    out = clifilter.elide_frames(docs(trace)).first().text.split("\n")
    assert len(out) == 2 + 5 + 1 + 2 and "5 frames elided" in out[6]
    fails = clifilter.test_failures(docs("____ test_a ____\nE   assert 1 == 2\n____ test_b ____\nE   boom")).orderBy("block").collect()
    assert [(r.title, len(r.assertions)) for r in fails] == [("test_a", 1), ("test_b", 1)]
    runs = clifilter.line_runs(docs("2024-01-01 10:00:00 up\n2024-01-01 10:00:01 up\nx"), masked=True).orderBy("start").collect()
    assert [r.n for r in runs] == [2, 1]
    table = clifilter.table_columns(docs("CONTAINER ID  IMAGE  STATUS\nabc  web:1  Up"), ["IMAGE", "STATUS"]).first()
    assert table["values"] == ["web:1", "Up"]
    tree = {r.directory: r.n for r in clifilter.tree_groups(docs("a/x\na/y\nz")).collect()}
    assert tree == {"a": 2, ".": 1}
    rule = {"match": "log", "drop_lines": ["^DEBUG"], "head": 1, "tail": 1, "on_empty": "ok"}
    rows = spark.createDataFrame([("log", "DEBUG x\na\nb\nc"), ("log", "DEBUG only"), ("other", "DEBUG y")], "kind string, text string")
    assert [r.text for r in clifilter.apply_rules(rows, [rule]).collect()] == ["a\n... (1 lines omitted)\nc", "ok", "DEBUG y"]


def test_dialogue(spark):
    turns = spark.createDataFrame([(1, 0, "system", "Be brief."), (1, 1, "user", "I have a severe peanut allergy"), (1, 2, "assistant", "I prefer tea"), (1, 3, "user", "hello there"), (1, 4, "assistant", "bye")], "conv_id long, turn long, role string, text string")
    levels = [r.x for r in turns.select("turn", dialogue.importance(F.col("text"), F.col("role")).alias("x")).orderBy("turn").collect()]
    assert levels == ["RELEVANT", "CRITICAL", "RELEVANT", "TRIVIAL", "TRIVIAL"]
    like = dialogue.misspelt(["allergy", "life-threatening", "must not"])
    assert [one(spark, like(F.col("w")), w=w) for w in ("my alergy", "energy", "lif", "threatning", "must knot", "")] == [True, False, False, True, False, False]
    scored = dialogue.scored(skeleton.embed(turns))
    assert scored.filter("turn = 1").first().relevance == 1
    packed = dialogue.pack(scored, 20).collect()
    used = 0
    for r in sorted(packed, key=lambda r: r.turn):
        used += r.tokens
        assert used <= 20
    assert len(packed) == 5 and {r.used_fidelity for r in packed} <= {"FULL", "COMPRESSED", "PLACEHOLDER", "DROPPED"}
    done = dialogue.compacted(turns, 2).first()
    assert done.system == "[system] Be brief." and done.tail == "[user] hello there\n[assistant] bye" and "allergy" in done.older


def test_memory(spark):
    turns = spark.createDataFrame([(1, 0, "We decided to use Parquet for storage. ok. The weather is fine today, nothing more."), (1, 1, "[user]: We decided to use Parquet for storage.")], "conv_id long, turn long, text string")
    assert [(r.signal, r.first_turn) for r in memory.insights(turns).collect()] == [("decision", 0)]
    category, confidence = memory.classify(F.col("t"))
    assert one(spark, category, t="watch out for this gotcha, a pitfall") == "gotcha" and one(spark, category, t="plain") == "general" and one(spark, confidence, t="plain") == 0.3
    rows = spark.createDataFrame([("a", 1, "Always use caching"), ("a", 2, "never do that"), ("b", 3, "always")], "category string, memory_id long, text string")
    assert [(r.category, r.first_positive, r.first_negative) for r in memory.contradictions(rows).collect()] == [("a", 1, 2)]
    pairs = memory.similar_pairs(spark.createDataFrame([("a", 1, "use the cache"), ("a", 2, "use the caches"), ("a", 3, "other")], "category string, memory_id long, text string")).collect()
    assert [(r.a, r.b) for r in pairs] == [(1, 2)]
    deltas = spark.createDataFrame([(1, 1, "add", "x"), (1, 2, "update", "y"), (2, 1, "add", "z"), (2, 3, "remove", "z")], "bullet_id long, version long, op string, text string")
    assert [(r.bullet_id, r.text) for r in memory.latest_state(deltas).collect()] == [(1, "y")]
    links = memory.cross_links(spark.createDataFrame([("a", "red green blue"), ("b", "red green"), ("c", "other")], "category string, article string")).collect()
    assert [(r.a, r.b) for r in links] == [("a", "b")]


def test_temporal_arrival_beats_observation(spark):
    rows = [("d", "f", "v1", 10, 1), ("d", "f", "v1", 20, 2), ("d", "f", "v2", 30, 3), ("d", "f", "v3", 5, 4)]
    obs = spark.createDataFrame(rows, "doc_id string, fact_id string, content string, observed_at long, arrival_seq long")
    versions = temporal.scd2(obs)
    assert [(r.content, r.version, r.invalidated_at) for r in versions.orderBy("arrival_seq").collect()] == [("v1", 1, 30), ("v2", 2, 5), ("v3", 3, None)]
    assert temporal.latest_before(versions, F.lit(12)).first().content == "v3"
    closed = temporal.invalidate(versions, spark.createDataFrame([("d", "f")], "doc_id string, fact_id string"), F.lit(99), "manual")
    assert closed.filter("content = 'v3'").first().invalidated_at == 99
    known = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x")], "path string, modified long, checksum string")
    found = spark.createDataFrame([("a", 2, "x"), ("b", 2, "y"), ("d", 1, "z")], "path string, modified long, checksum string")
    assert {r.path: r.status for r in temporal.file_sync(known, found).collect()} == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "added"}
    v = spark.createDataFrame([(1, 1, "a\nb"), (1, 2, "a\nc")], "doc_id long, version_id long, content string")
    assert "-b" in temporal.unified_diff(v).filter("version_id = 2").first()["diff"]


def test_savings(spark):
    docs = spark.createDataFrame([(1, 50), (2, 300), (3, 4000)], "doc_id long, n_chars long")
    assert {r.id: r.action for r in savings.discovery(docs).collect()} == {1: "skip", 2: "direct", 3: "compress"}
    journal = spark.createDataFrame([("s", 1, "ingest", 1.0, '{"tool":"t","original_tokens":100,"compressed_tokens":40}'), ("s", 2, "ingest", 2.0, '{"tool":"u","original_tokens":10,"compressed_tokens":40}'), ("s", 3, "other", 3.0, '{"profile":"p"}')], "session_id string, id long, event_type string, timestamp double, data_json string")
    r = savings.session_summary(journal).first()
    assert (r.events, r.tools, r.saved, r.profile) == (3, 2, 60.0, "p")


def test_quality_and_audit(spark):
    assert one(spark, quality.in_order(F.col("t"), F.array(F.lit("a"), F.lit("b"))), t="xaxb") and not one(spark, quality.in_order(F.col("t"), F.array(F.lit("b"), F.lit("a"))), t="xaxb")
    chain = quality.chained(spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "z")], "g int, seq int, body string"), "g", "seq", F.col("body"))
    assert quality.verified(chain, "g", "seq", F.col("body")).first().broken == 0
    forged = chain.withColumn("body", F.when(F.col("seq") == 2, "forged").otherwise(F.col("body")))
    assert quality.verified(forged, "g", "seq", F.col("body")).first().broken == 2
    floors = spark.createDataFrame([("m", "a", "ratio", 2.0), ("m", "b", "ratio", 2.0)], "mode string, case_id string, metric string, floor double")
    report = spark.createDataFrame([("m", "a", "ratio", 1.5)], "mode string, case_id string, metric string, value double")
    assert quality.guard(report, floors).count() == 2
    docs = spark.createDataFrame([(1, "say: the quick brown fox jumps over it"), (2, "nothing here")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, "e quick brown fox jumps ov"), (2, "here"), (3, "absent words that are not there")], "item_id long, span string")
    assert {(r.doc_id, r.item_id) for r in quality.span_gate(docs, spans).collect()} == {(1, 1), (2, 2)}


CODE = 'import os\nfrom pkg.util import helper\n\nclass A:\n    """Doc."""\n    def run(self):\n        return helper(1)\n\nasync def main():\n    A().run()\n'
SCRIPT = "export function go(a) {\n  // }\n  return '}' + help(a);\n}\nclass B {\n}\nconst help = (x) => { return x; };\n"


def test_code(spark):
    files = spark.createDataFrame([("src/a.py", CODE), ("pkg/util.py", "def helper(x):\n    return x\n"), ("pkg/unused.py", "x = 1\n"), ("b.js", SCRIPT), ("bad.py", "def (:\n")], "path string, code string")
    chunks = code.code_chunks(files)
    got = {(r.path, r.kind, r.name): (r.start_line, r.end_line) for r in chunks.collect()}
    assert got["src/a.py", "class", "A"] == (4, 7) and got["src/a.py", "function", "A.run"] == (6, 7) and ("src/a.py", "function", "main") in got
    assert got["b.js", "function", "go"] == (1, 4) and ("b.js", "class", "B") in got and ("b.js", "function", "help") in got and ("bad.py", "block", "lines_1") in got
    assert ("src/a.py::A.run", "pkg/util.py::helper") in {(r.src, r.dst) for r in code.dependency_edges(chunks).collect()}
    assert "pkg/util.py" not in {r.path for r in code.dead_files(files).collect()} and "pkg/unused.py" in {r.path for r in code.dead_files(files).collect()}
    assert code.code_skeleton(chunks).filter("path = 'src/a.py'").first().shown == 1
    assert one(spark, code.language(F.col("p")), p="x/y.TSX") == "typescript"


def test_prompt_cache(spark):
    assert [one(spark, promptcache.drift(F.col("a"), F.col("b")), a=a, b=b) for a, b in (("x y", "x y"), ("x  y", "x y"), ('{"a":1}', '{ "a": 1 }'), ("x", "y"))] == ["none", "whitespace", "json", "semantic"]
    assert [one(spark, promptcache.first_difference(F.col("a"), F.col("b")), a=a, b=b) for a, b in (("abc", "abd"), ("abc", "abc"), ("ab", "abc"))] == [2, -1, 2]
    score, ok = promptcache.section_audit(F.split("s", ","), F.col("t"))
    assert one(spark, score, s="system,tools,user", t="plain") == 100 and one(spark, score, s="user,system", t="at 2024-01-01 10:00") == 55


def test_scopes(spark):
    composed = scopes.composed(F.col("f"), {"workspace_id": F.col("w"), "user_id": F.lit(None).cast("string")})
    assert one(spark, composed, f="my_file a", w="team_x=1") == "scope__w=team%5Fx%3D1__f=my%5Ffile%20a"
    df = spark.createDataFrame([("scope__w=team%5Fx%3D1__f=my%5Ffile%20a",), ("plain_n1",)], "s string")
    got = [(r.file_id, r.workspace_id) for r in df.select(*[c.alias(k) for k, c in scopes.parsed(F.col("s")).items()]).collect()]
    assert got == [("my_file a", "team_x=1"), ("plain_n1", None)]
    rows = spark.createDataFrame([(1, "w", None, None, None), (2, None, None, None, None)], "id int, workspace_id string, user_id string, agent_id string, session_id string")
    assert [r.id for r in scopes.in_scope(rows, {}).collect()] == [2] and [r.id for r in scopes.in_scope(rows, {"workspace_id": "w"}).collect()] == [1]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "repo.json").write_text('{"repo": "a/b", "files": [{"path": "x y.py", "content": "code"}]}')
    (tmp_path / "chat.json").write_text('{"channels": [{"name": "gen", "messages": [{"ts": "2", "user": "u", "text": "b"}, {"ts": "1", "user": "v", "text": "a"}]}]}')
    assert connectors.repository_export(spark, str(tmp_path / "repo.json")).first().file_id == "github-a-b-x-y.py"
    assert connectors.channel_export(spark, str(tmp_path / "chat.json")).first().text == "[1] v: a\n[2] u: b"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "doc.txt").write_text("hello\nworld")
    assert connectors.folder(spark, str(tmp_path / "in"), "*.txt").first().text == "hello\nworld"
    kinds = ["[1, 2]", '{"a": 1}', '{"a": 1}\n{"a": 2}', "a,b\n1,2", "words"]
    assert [one(spark, connectors.structured_kind(F.col("t")), t=k) for k in kinds] == ["json_array", "json_object", "jsonl", "csv", None]
    assert [r.slug for r in connectors.markdown_sections(spark.createDataFrame([(1, "# One\nx\n## Two Three\ny")], "doc_id long, text string")).orderBy("position").collect()] == ["one", "two-three"]
    rows = spark.createDataFrame([("a,b\\c\nd", 1.5), (None, None)], "t string, v double")
    lines = sinks.tabular_rows(rows, ["t", "v"])
    assert [tuple(r) for r in sinks.parsed_tabular(lines, ["t", "v"]).collect()] == [("a,b\\c\nd", "1.500"), ("", "")]
    assert [r.value for r in sinks.tabular(rows, ["t", "v"]).orderBy("pos").collect()][0] == "results[2]{t,v}:"
    sinks.write_reports(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "json")).count() == 2
    hidden = sinks.redacted(spark.createDataFrame([({"api_key": "x", "name": "y"},)], "context map<string,string>")).first().context
    assert hidden == {"api_key": "[REDACTED]", "name": "y"}


def test_streams_match_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = jobs.event_stream(spark, str(tmp_path / "events"), files_per_trigger=1)
    got = {tuple(r) for r in jobs.to_memory(jobs.access_counts(stream), "access_test").collect()}
    assert got == {tuple(r) for r in jobs.access_counts(events).collect()}
    one_file = jobs.event_stream(spark, str(tmp_path / "events"))
    allowed = jobs.to_memory(jobs.token_bucket(one_file, 3.0, 1 / 86_400), "bucket_test", "append")
    batch = jobs.token_bucket_batch(events, 3.0, 1 / 86_400)
    assert {(r.event_id, r.allowed) for r in allowed.collect()} == {(r.event_id, r.allowed) for r in batch.collect()}


def test_upserts_keep_the_latest(spark, tmp_path):
    run = jobs.upsert_facts(str(tmp_path / "facts"))
    run(spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], "key string, content string, ts long"), 0)
    run(spark.createDataFrame([("a", "2", 2), ("a", "3", 3)], "key string, content string, ts long"), 1)
    assert {(r.key, r.content) for r in spark.read.parquet(str(tmp_path / "facts/v1")).collect()} == {("a", "3"), ("b", "1")}


def test_advice(spark):
    from weftline.operators import advice

    f = advice.fidelity(F.col("u"), F.col("n"), F.col("b"))
    assert [one(spark, f, u=u, n=n, b=b) for u, n, b in (("question_answering", 5, 300), ("question_answering", 3, 0), ("exact_quotes", 1, 100), ("quick_summary", 1000, 5))] == ["STRUCTURE", "DETAILED", "DETAILED", "ABSTRACT"]
    assert [one(spark, advice.window_ratio(F.col("w"), F.col("t")), w=w, t=t) for w, t in ((50_000, 0.8), (1_000_000, 0.8), (1, 0.8))] == [0.1, 0.5, 0.01]
    assert [one(spark, advice.should_compress(F.col("n"), F.col("s")), n=n, s=s) for n, s in (("a.PNG", 9), ("a.pdf", 9), ("a.md", 9), ("a.md", 9000))] == ["SKIP", "CONVERT", "DIRECT_READ", "COMPRESS"]


def test_prompts(spark):
    from weftline.operators import prompts

    v = spark.createDataFrame([("p", 1, "s", "t", None, "c", "u"), ("p", 2, "s", "t", None, "d", "u"), ("p", 3, "S", "t", None, "d", "u")], "prompt string, version long, system string, tools string, policies string, context string, user string")
    got = {r.version: (r.stable_changes, r.volatile_changes) for r in prompts.changed_fields(v).collect()}
    assert got == {1: ([], []), 2: ([], ["context"]), 3: (["system"], [])}
    labels = spark.createDataFrame([("p", "prod", 1)], "prompt string, label string, version long")
    wanted = lambda n: spark.createDataFrame([("p", "prod", n)], "prompt string, label string, version long")
    assert [tuple(prompts.deployed(labels, wanted(n), v).select("version", "refused").first()) for n in (2, 3)] == [(2, False), (1, True)]
    asked = spark.createDataFrame([(1, "p", None, 2), (2, "p", "prod", None), (3, "p", None, None)], "request_id long, prompt string, label string, version long")
    assert {r.request_id: r.version for r in prompts.resolved(asked, v, labels).collect()} == {1: 2, 2: 1, 3: 3}
    assert prompts.rendered(v).filter("version = 1").first().text == "## system\ns\n\n## tools\nt\n\n## context\nc\n\n## user\nu"


def test_records(spark):
    from weftline.sources import records

    docs = spark.createDataFrame([(1, '[{"a": 1},  [2, "x]"], 3e2]'), (2, '{"a": 1}\n{"b": 2}'), (3, "h,i\n1,2\n3,4"), (4, "prose"), (5, '{"a": [1, 2]}')], "doc_id long, text string")
    got = {(r.id, r.position): r.record for r in records.records(docs).collect()}
    assert got == {(1, 0): '{"a": 1}', (1, 1): '[2, "x]"]', (1, 2): "3e2", (2, 0): '{"a": 1}', (2, 1): '{"b": 2}', (3, 0): "h,i\n1,2", (3, 1): "h,i\n3,4", (5, 0): '{"a": [1, 2]}'}
    chunks = records.packed(records.records(docs), 4).collect()
    assert all(r.text for r in chunks) and {r.id for r in chunks} == {1, 2, 3, 5}


def test_metatokens(spark):
    from weftline.functions import metatokens

    text = "the quick brown fox ran\nthe quick brown fox hid § here\n" + "a b c d e f " * 9
    small = metatokens.compressed(text)
    assert len(small.split()) < len(text.split())
    assert [line.split() for line in metatokens.restored(small).split("\n")] == [line.split() for line in text.split("\n")]
    rows = spark.createDataFrame([(text,), ("",), ("one",)], "t string").select(metatokens.restore(metatokens.compress("t")).alias("t"))
    assert [r.t.split() for r in rows.collect()] == [text.split(), [], ["one"]]


def test_playbook(spark):
    from weftline.operators import playbook

    b = spark.createDataFrame([(1, 1, 0.9, [1.0, 0.0], 3, 1), (1, 2, 0.5, [0.99, 0.05], 0, 0), (1, 3, 0.4, [0.0, 1.0], 0, 6), (2, 4, 0.4, [1.0, 0.0], 1, 0)], "context_id long, bullet_id long, confidence double, embedding array<double>, success_count long, failure_count long")
    assert sorted(r.bullet_id for r in playbook.deduplicated(b).collect()) == [1, 3, 4]
    assert sorted(r.bullet_id for r in playbook.curated(b, 1).collect()) == [1, 4]
    assert [r.bullet_id for r in playbook.best_bullets(b, [1.0, 0.0], 1).orderBy("context_id").collect()] == [1, 4]
    new = spark.createDataFrame([(1, 10, [0.0, 1.0]), (1, 11, [0.7, -0.7])], "context_id long, insight_id long, embedding array<double>")
    assert {r.insight_id: r.bullet_id for r in playbook.integrated(b, new).collect()} == {10: 3, 11: None}
    assert playbook.reflection(playbook.trajectory(playbook.best_bullets(b, [1.0, 0.0], 1)), True).filter("context_id = 1").first().steps == 5
    assert playbook.stats(b).filter("context_id = 1").first().success_rate == 0.3


def test_intercept(spark):
    long = "It is really very simple that the server at 10.0.0.1 failed with ECONNREFUSED in src/app.py:12 today. " * 4
    got = {r.id: r.text for r in clifilter.intercepted(spark.createDataFrame([(1, long), (2, "short")], "doc_id long, text string")).collect()}
    assert got[2] == "short" and "ECONNREFUSED" in got[1] and "src/app.py:12" in got[1] and "really" not in got[1].split(".")[0]


def test_queries_take_runs_of_2_to_20_words(spark, tmp_path):
    from collections import Counter

    from weftline.functions import metatokens
    from weftline.plans import catalogue

    run = " ".join(f"w{i}" for i in range(25))
    texts = [(1, f"{run} then {run} end"), (2, "a b a b a b a b"), (3, "one"), (4, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r[c] for c in ("id", "n", "ngram", "freq", "savings")) for r in catalogue.queries()["repeated_ngrams_2_20"](spark, str(tmp_path)).collect()}
    want = set()
    for i, t in texts:
        w = t.split()
        for n in range(2, min(20, len(w) // 2 + 1) + 1):
            found = Counter(" ".join(w[k : k + n]) for k in range(len(w) - n + 1))
            want |= {(i, n, g, f, f * (n - 1) - n) for g, f in found.items() if f > 1 and f * (n - 1) - n > 0}
    assert got == want and {n for _, n, *_ in got} == set(range(2, 21))
    small = {r.doc_id: r.compressed for r in catalogue.queries()["meta_tokens"](spark, str(tmp_path)).collect()}
    assert small == {i: metatokens.compressed(t, 20) for i, t in texts} and "§0=" + " ".join(run.split()[:20]) in small[1].split("\n")
