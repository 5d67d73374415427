"""Verification and reading against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.operators import reading, verification as vf

OPERATION = "doc_id long, document string, path string, level string, skeleton string, node_map map<string,string>, original_tokens int, skeleton_tokens int"
GOOD = (1, "some text", "a/b.md", "STRUCTURE", "[n1] some", {"n1": "some"}, 90, 20)


def operation(k=1, **changed):
    names = [c.split()[0] for c in OPERATION.split(", ")]
    return tuple({**dict(zip(names, GOOD)), "doc_id": k, **changed}[n] for n in names)


CASES = [
    ({}, set()),
    ({"document": ""}, {"non_empty_document"}),
    ({"document": None}, {"non_empty_document", "document_is_string", "valid_utf8", "document_size_limit", "no_null_bytes"}),
    ({"document": "a\0b"}, {"no_null_bytes"}),
    ({"level": "structure"}, set()),
    ({"level": "COARSE"}, {"valid_fidelity_level"}),
    ({"level": None}, {"valid_fidelity_level"}),
    ({"path": "../x"}, {"safe_file_path"}),
    ({"path": "C:\\Windows\\x"}, {"safe_file_path"}),
    ({"path": None}, set()),
    ({"skeleton": ""}, {"skeleton_non_empty"}),
    ({"original_tokens": 900_000, "skeleton_tokens": 50_001}, {"skeleton_token_limit"}),
    ({"node_map": None}, {"valid_node_map", "node_map_populated"}),
    ({"node_map": {}}, {"node_map_populated"}),
    ({"node_map": {}, "original_tokens": 50}, set()),
    ({"node_map": {"": "x"}}, {"valid_node_ids"}),
    ({"node_map": {"a": None}}, {"valid_node_ids"}),
    ({"skeleton_tokens": 60}, set()),
    ({"skeleton_tokens": 61}, {"compression_achieved"}),
    ({"skeleton_tokens": 90}, {"compression_achieved", "tokens_reduced"}),
    ({"skeleton_tokens": 95, "level": "RAW", "node_map": {}}, set()),
    ({"original_tokens": 0, "skeleton_tokens": 0}, {"compression_achieved", "tokens_reduced"}),
]


def test_contracts(spark):
    rows = [operation(k, **changed) for k, (changed, _) in enumerate(CASES)]
    found = {r.doc_id: r for r in vf.verified(spark.createDataFrame(rows, OPERATION)).collect()}
    for k, (_, broken) in enumerate(CASES):
        assert {v.contract for v in found[k].violations} == broken, CASES[k]
        assert found[k].verified == (not broken)
    assert len(found[0].checks) == 14 and len(found[9].checks) == 13
    assert {v.kind for v in found[2].violations} == {"precondition"}


def brute_composition(nodes, edges, skeletons):
    out = {}
    for k, text in skeletons:
        mine = {n for d, n in nodes if d == k and n is not None}
        links = [(s, t) for d, s, t in edges if d == k]
        refs = [a or b for a, b in re.findall(vf.REFERENCE, text or "")]
        out[k] = (len({e for p in links for e in p} - mine), sum(c - 1 for c in Counter(links).values()), sum(r not in mine for r in refs))
    return out


def test_composition_brute_force(spark):
    rng = random.Random(4)
    ids = ["a", "b", "c", "node x", "7", None]
    nodes = [(rng.choice([0, 0, 0, 1, 2]), rng.choice(ids)) for _ in range(12)]
    edges = [(rng.choice([0, 0, 0, 1, 2, 3]), rng.choice(ids), rng.choice(ids)) for _ in range(90)]
    skeletons = [(0, "[a] x [a] [zz] (node_b) (node_q) []"), (1, "no references"), (2, None), (3, "[a\nb] [c]"), (4, "")]
    found = vf.composition(
        spark.createDataFrame(nodes, "doc_id long, node_id string"), spark.createDataFrame(edges, "doc_id long, src string, dst string"), spark.createDataFrame(skeletons, "doc_id long, skeleton string"))
    assert {r.doc_id: (r.missing_nodes, r.duplicate_edges, r.invalid_references) for r in found.collect()} == brute_composition(nodes, edges, skeletons)


def test_composition_of_a_hot_key(spark):
    edges = spark.range(20_000).select(F.lit(1).alias("doc_id"), F.col("id").cast("string").alias("src"), F.concat(F.lit("x"), (F.col("id") % 7).cast("string")).alias("dst"))
    nodes = spark.range(19_990).select(F.lit(1).alias("doc_id"), F.col("id").cast("string").alias("node_id"))
    row = vf.composition(nodes, edges.union(edges.limit(5)), spark.createDataFrame([(1, "[3] [x1]")], "doc_id int, skeleton string")).collect()
    assert [tuple(r) for r in row] == [(1, 17, 5, 1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], OPERATION)
    edges, nodes = spark.createDataFrame([], "doc_id long, src string, dst string"), spark.createDataFrame([], "doc_id long, node_id string")
    assert vf.composition(nodes, edges, none).count() == 0
    assert vf.batch(vf.verified(none)).count() == 0
    assert vf.verified_bundles(vf.bundles(vf.verified(none), "x")).count() == 0


def test_invariants_only_warn(spark):
    rows = spark.createDataFrame([operation(1), operation(2), operation(3, document="")], OPERATION)
    composed = spark.createDataFrame([(1, 2, 0, 1), (3, 0, 4, 0)], "doc_id long, missing_nodes long, duplicate_edges long, invalid_references long")
    found = {r.doc_id: r for r in vf.verified(rows, composed).collect()}
    assert found[1].verified and [(v.contract, v.severity) for v in found[1].violations] == [("edge_endpoints_valid", "warning"), ("skeleton_refs_valid", "warning")]
    assert found[2].verified and not found[2].violations
    assert not found[3].verified and [v.contract for v in found[3].violations] == ["no_duplicate_edges", "non_empty_document"]


@pytest.mark.parametrize("column,value", [("input_hash", "0" * 64), ("output_tokens", 1), ("level", "RAW"), ("outcomes", "non_empty_document+"), ("previous_hash", ""), ("bundle_hash", None), ("operation", None)])
def test_tampered_bundles(spark, column, value):
    sealed = vf.bundles(vf.verified(spark.createDataFrame([operation(1, document=""), operation(2)], OPERATION)), "compress")
    intact = {r.doc_id: r for r in vf.verified_bundles(sealed).collect()}
    assert [v.contract for v in intact[1].violations] == ["non_empty_document"] and intact[2].verified
    kind = sealed.schema[column].dataType
    for r in vf.verified_bundles(sealed.withColumn(column, F.lit(value).cast(kind))).collect():
        assert [v.contract for v in r.violations] == ["bundle_integrity"] and not r.verified


def test_seal_keeps_fields_apart(spark):
    sealed = vf.bundles(vf.verified(spark.createDataFrame([operation(1)], OPERATION)), "a")
    split = [sealed.withColumns({"operation": F.lit(a), "input_hash": F.lit(b)}).select(vf.seal().alias("h")).first().h for a, b in (("a|1:b", "c"), ("a", "b|1:c"), ("", None), (None, ""))]
    assert len(set(split)) == 4


def test_batch(spark):
    rows = [operation(1), operation(2, document=""), operation(3, document="", skeleton=""), operation(4)]
    found = {r.contract: tuple(r)[1:] for r in vf.batch(vf.verified(spark.createDataFrame(rows, OPERATION))).collect()}
    assert found == {"*": (3, 4, 2, 0.5), "non_empty_document": (2, 2, 0, 0.0), "skeleton_non_empty": (1, 1, 0, 0.0)}


# -- reading


def slug(s):
    return re.sub(r"[^a-z0-9]+", "-", s.lower()).strip("-") or "docs"


def brute_excerpt(text, anchor, most):
    words = text.split()
    if len(words) <= most:
        return text
    middle = 0
    if anchor:
        lines, counts = text.split("\n"), []
        for line in lines:
            counts.append(len(line.split()))
        heads = [i for i, x in enumerate(lines) if (m := re.match(r"#{1,6}[ \t]+(.*)", x)) and slug(m.group(1)) == anchor]
        terms = set(re.findall("[a-z0-9_]+", anchor.replace("-", " ")))
        shared = [len(terms & set(re.findall("[a-z0-9_]+", x.lower()))) for x in lines]
        middle = sum(counts[: heads[0] if heads else shared.index(max(shared))])
    start = max(0, middle - most // 2)
    end = min(len(words), start + most)
    start = max(0, end - most)
    return ("[...]\n" if start else "") + " ".join(words[start:end]) + ("\n[...]" if end < len(words) else "")


def test_excerpts_brute_force(spark):
    rng = random.Random(7)
    pool = ["Set Up", "use", "the", "api-key", "Cache", "of", "pages", "x_1", "##", "#"]
    rows = []
    for k in range(300):
        lines = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.6:
            lines.insert(rng.randint(0, len(lines)), "## Set Up, the Cache")
        rows.append((k, "\n".join(lines), rng.choice(["set-up-the-cache", "api-key", "nothing", "", None])))
    for most in (1, 6, 15):
        df = spark.createDataFrame(rows, "k long, text string, anchor string")
        for r in df.withColumn("got", reading.excerpt(F.col("text"), F.col("anchor"), most)).collect():
            assert r.got == brute_excerpt(r.text, r.anchor, most), (r, most)


def test_markdown_lines(spark):
    html = "<head><title>t</title></head><body><nav><a>x</a></nav><H2 class=a>The <b>Cache</b></H2><p>one\n  two</p><script>p()</script>three<br>four<style>a{}</style></body>"
    frame = spark.createDataFrame([(html,), (None,), ("",), ("plain",)], "html string")
    assert [r[0] for r in frame.select(reading.markdown(F.col("html"))).collect()] == ["x\n## The Cache\none two\nthree\nfour", "", "", "plain"]


def test_read_by_slug_and_address(spark):
    body = "\n".join(["intro words here"] * 4 + ["## Deep Part", "the part itself"] + ["more"] * 9)
    docs = spark.createDataFrame([("guide", "https://d.org/guide", body), ("deep-part", "https://d.org/other", "short text"), ("none", None, None)], "slug string, url string, text string")
    asked = [(1, "guide"), (2, "https://d.org/guide#deep-part"), (3, " Deep Part "), (4, "missing"), (5, None), (6, "none"), (7, "https://d.org/guide")]
    found = {r.request_id: r for r in reading.read(docs, spark.createDataFrame(asked, "request_id long, wanted string"), 6).collect()}
    assert found[2].excerpt == brute_excerpt(body, "deep-part", 6)
    assert found[1].excerpt == brute_excerpt(body, "guide", 6) and found[7].excerpt == brute_excerpt(body, None, 6)
    assert found[3].excerpt == "short text" and found[4].url is None and found[5].excerpt is None and found[6].excerpt is None and len(found) == 7
