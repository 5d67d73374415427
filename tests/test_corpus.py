"""Corpus-fitted operators against brute force: TF-IDF, postings, token gains, semantic chunks, versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.functions import gain, text as tx
from weftline.operators import postings, reingest, retrieval, semantic, tfidf


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# -- TF-IDF


def test_vocabulary_is_chosen_by_frequency_and_share(spark):
    docs = docs_of(spark, ["Crème brûlée tasty", "the creme tasty", "tasty soup, creme soup", None, ""])
    found = {r.term: (r["index"], r.df, r.idf) for r in tfidf.Vocabulary.fit(docs, max_df=0.5).table.collect()}
    assert "tasty" not in found and "the" not in found and "creme" not in found  # in 3 of 5
    assert set(found) == {"brulee", "soup", "creme brulee", "brulee tasty", "creme tasty", "tasty soup", "soup creme", "creme soup"}
    assert found["soup"][1:] == (1, pytest.approx(math.log(6 / 2) + 1))
    few = tfidf.Vocabulary.fit(docs, max_features=2).table.orderBy("index").collect()
    assert [(r["index"], r.term) for r in few] == [(0, "creme"), (1, "tasty")]


def test_vectors_have_length_one_or_nothing(spark):
    docs = docs_of(spark, ["red fish", "red red bird bird bird", None, "of the"])
    rows = {r.id: r for r in tfidf.Vocabulary.fit(docs, high=1).vectors(docs).collect()}
    assert rows[2].values == [] == rows[3].indices
    assert rows[0].indices == sorted(rows[0].indices) and sum(v * v for v in rows[1]["values"]) == pytest.approx(1)
    bird, red = 3 * (math.log(5 / 2) + 1), 2 * (math.log(5 / 3) + 1)
    assert rows[1]["values"] == pytest.approx([bird / math.hypot(bird, red), red / math.hypot(bird, red)])


def test_tfidf_search(spark):
    docs = docs_of(spark, ["red fish", "blue bird", "red bird", None])
    voc = tfidf.Vocabulary.fit(docs)
    assert [r.id for r in voc.search(docs, "red fish", 3).orderBy("rank").collect()] == [0, 2]
    assert voc.search(docs, "nothing known", 3).count() == 0


# -- postings


@pytest.mark.parametrize("small", [10**6, 0])
def test_index_scores_as_one_query_at_a_time(spark, sf_dir, tmp_path, monkeypatch, small):
    monkeypatch.setattr(postings, "SMALL_QUERIES", small)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    asked = ["the of tion", "the the queque", "thanedble", "unknownword", ""]
    postings.Index.build(docs).save(str(tmp_path))
    index = postings.Index.load(spark, str(tmp_path))
    found = index.search(spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"), 7).collect()
    for k, q in enumerate(asked):
        want = retrieval.top_k(retrieval.bm25(docs.fillna("", "text"), q).withColumn("score", F.round("score", 6)), 7).collect() if q else []
        assert sorted((r["rank"], r.id, r.score) for r in found if r.query_id == k) == sorted((r["rank"], r.id, r.score) for r in want)


def test_index_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert postings.Index.build(none).search(spark.createDataFrame([(1, "a b")], "query_id int, query string"), 3).count() == 0


# -- token gains


def brute_gains(tokens, query, redundancy=0.5, features=500):
    """Every free token looked at for every pick, dense vectors."""
    forced = [bool((b := t.strip(gain.MARKS)) and re.match(tx.KEPT_TOKEN, b)) for t in tokens]
    if not query.strip():
        return [1.0 if f else 0.5 for f in forced]
    bags = [Counter(re.findall(r"\w\w+", t.lower())) for t in [*tokens, query]]
    total = sum(bags, Counter())
    words = sorted(total, key=lambda w: (-total[w], w))[:features]
    if not words:
        return [1.0 if f else 0.5 for f in forced]
    idf = [math.log((1 + len(bags)) / (1 + sum(w in b for b in bags))) + 1 for w in words]
    vectors = [[b[w] * i for w, i in zip(words, idf, strict=True)] for b in bags]

    def cosine(a, b):
        n = math.hypot(*a) * math.hypot(*b)
        return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0

    asked = vectors.pop()
    scores = [1.0 if f else None for f in forced]
    most = [max((cosine(v, vectors[j]) for j, f in enumerate(forced) if f), default=0.0) for v in vectors]
    while None in scores:
        now = [(-round(cosine(vectors[i], asked) - redundancy * most[i], 9), i) for i, s in enumerate(scores) if s is None]
        below, at = min(now)
        scores[at] = max(0.01, min(1.0, 0.5 - below))
        most = [max(m, cosine(v, vectors[at])) for m, v in zip(most, vectors, strict=True)]
    return scores


def test_gains_match_brute_force():
    rng = random.Random(1)
    vocabulary = ["data", "spark", "the", "a", "run-time", "time", "join-data", "42", "x_y", "--", "Spark,", "data-spark-join", "join"]
    for _ in range(200):
        tokens = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 25))]
        query = rng.choice(["spark join", "data", "time data spark", "", "?", "unknown"])
        features = rng.choice([500, 3])
        assert gain.token_gains(tokens, query, 0.5, features) == pytest.approx(brute_gains(tokens, query, 0.5, features), abs=1e-6)


def test_gains_of_a_long_text_are_quick():
    tokens = [f"word{i % 5000}" for i in range(60_000)] + ["same"] * 60_000
    scores = gain.token_gains(tokens, "word1 same")
    assert len(scores) == 120_000 and scores[1] > scores[10] > scores[5010]


def test_gain_columns(spark):
    docs = docs_of(spark, ["alpha beta alpha 42 gamma", None, ""])
    rows = docs.select("doc_id", "text", gain.gains(F.col("text"), "beta").alias("s"))
    got = {r.doc_id: r for r in rows.select("doc_id", "s", gain.refined(F.col("text"), F.col("s"), 0.4).alias("kept")).collect()}
    assert got[0].kept == "beta 42" and got[1].kept is None and got[2].kept == "" and got[2].s == []


# -- semantic chunks


def brute_chunks(units, threshold, budget):
    chunks, last = [], None
    for s in units:
        bag, n = Counter(s.lower().split()), len(s.split())
        cut = last is not None and semantic.likeness(last, bag) < threshold
        if not chunks or cut or sum(len(u.split()) for u in chunks[-1]) + n > budget:
            chunks.append([])
        chunks[-1].append(s)
        last = bag
    return chunks


@pytest.mark.parametrize(("threshold", "budget"), [(0.3, 20), (0.0, 5), (1.1, 100), (0.2, 10**6)])
def test_semantic_chunks_match_brute_force(spark, threshold, budget):
    rng = random.Random(2)
    texts = [" ".join(" ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) + "." for _ in range(rng.randrange(1, 30))) for _ in range(30)] + [None, "", "No end", "x. " * 3]
    docs = docs_of(spark, texts).unionByName(docs_of(spark, ["same id. same id."])).repartition(3)
    found = {}
    for r in semantic.semantic_chunks(docs, threshold, budget).orderBy("id", "position").collect():
        found.setdefault(r.id, []).append(r)
    for i, t in enumerate(texts):
        units = [u.strip() for u in re.split(r"(?<=[.!?])\s+", t or "") if u.strip()]
        want = [" ".join(c) for c in brute_chunks(units, threshold, budget)]
        if i:  # two rows have id 0
            assert [r.text for r in found.get(i, [])] == want and [r.position for r in found.get(i, [])] == list(range(len(want)))
    assert sum(r.units for r in found[0]) == len(re.findall(r"\.", texts[0])) + 2


def test_semantic_chunks_of_a_very_long_text(spark):
    text = "one two three. four five six. " * 340_000  # 10 MB
    row = semantic.semantic_chunks(docs_of(spark, [text]), 0.5, 512).agg(F.count("*"), F.sum("units"), F.max("tokens")).first()
    assert tuple(row) == (680_000, 680_000, 3)


# -- versions


def test_reingest_keeps_embeddings_and_replays(spark, tmp_path):
    store, seen = str(tmp_path), []
    first = docs_of(spark, ["a\nb\nb\nc", "x\ny", "stays"])
    parts = F.split(F.col("text"), "\n")

    def marked(chunks):
        seen.append(sorted(r.text for r in chunks.collect()))
        return chunks.withColumn("embedding", F.array(F.lit(float(len(seen))).cast("float")))

    reingest.ingest(reingest.chunked(first, parts), store, embedded=marked)
    second = spark.createDataFrame([(0, "b\nb\nnew\na"), (1, "x\ny"), (9, "fresh")], "doc_id long, text string")
    for _ in range(2):  # the same version again
        counts = reingest.reingest(reingest.chunked(second, parts), store, 1, embedded=marked)
        assert sorted(tuple(r) for r in counts.collect()) == [(0, 0, 3, 1, 1), (1, 2, 0, 0, 0), (9, 0, 0, 1, 0)]
        now = sorted((r.file_id, r.position, r.text, r.embedding[0] == 1.0) for r in reingest.read_version(spark, store, 1).collect())
        assert now == [(0, 0, "b", True), (0, 1, "b", True), (0, 2, "new", False), (0, 3, "a", True), (1, 0, "x", True), (1, 1, "y", True), (2, 0, "stays", True), (9, 0, "fresh", False)]
    assert seen[1:] == [["fresh", "new"]] * 2


def test_stream_of_versions(spark, tmp_path):
    store, source = str(tmp_path / "store"), str(tmp_path / "in")
    parts = F.split(F.col("text"), "\n")
    reingest.ingest(reingest.chunked(docs_of(spark, ["a\nb"]), parts), store)
    docs_of(spark, ["b\nc"]).write.json(source)
    put = reingest.stream_into(store, lambda d: reingest.chunked(d, parts))
    stream = spark.readStream.schema("doc_id long, text string").json(source).writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert [r.text for r in reingest.read_version(spark, store, 1).orderBy("position").collect()] == ["b", "c"]
