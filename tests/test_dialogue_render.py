"""Renderings of turns in a packed context and repeated runs of words, against plain Python."""

import random
from collections import Counter

from pyspark.sql import functions as F

from weftline.operators import dedup, dialogue

WORDS = ["plan", "critical", "the", "Never", "store", "a", "value", "sum", "allergy", "x1", "of"]


def count(text):
    return int(len(text.split()) * 1.3 + 1e-9)


def brute_summary(text, target):
    ss = [p if p.endswith(".") else p + "." for p in (x.strip() for x in text.split(". ")) if p]
    if not ss:
        return text[: target * 4]
    score = lambda i: max(0.1, 1 - abs(count(ss[i]) - 15) / 30) * (1 - i / len(ss) * 0.3) * (1.2 if any(w in ss[i].lower() for w in dialogue.WEIGHTY) else 1.0)
    taken, used = [], 0
    for i in sorted(range(len(ss)), key=lambda i: (-score(i), i)):
        if used + count(ss[i]) <= target:
            taken.append(i)
            used += count(ss[i])
        if used >= target * 0.9:
            break
    if not taken:
        return ss[0][: target * 4] + ("..." if len(ss[0]) > target * 4 else "")
    said = " ".join(ss[i] for i in sorted(taken))
    return said[: target * 4] + "..." if count(said) > target else said


def brute_stub(role, turn, text, most=12):
    stub = f"[{role} turn {turn}]"
    left = most - count(stub)
    return stub + (f" {text[: left * 4]}" + ("..." if len(text) > left * 4 else "") if left > 3 else "")


def test_renderings_equal_plain_python(spark):
    rng = random.Random(5)
    texts = ["", "   ", "One.", "a. b. c", "word " * 200, "no end. " * 40 + "\n\ttail", None]
    texts += [". ".join(" ".join(rng.choices(WORDS, k=rng.choice([1, 4, 12, 30]))) for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    df = spark.createDataFrame([(k, "user", t) for k, t in enumerate(texts)], "turn int, role string, text string")
    got = df.select("text", "turn", dialogue.compressed(F.col("role"), F.col("text")).alias("c"), dialogue.placeholder(F.col("role"), F.col("turn"), F.col("text")).alias("p")).collect()
    for r in got:
        if r.text is None:
            assert r.c is None and r.p is None
            continue
        assert r.c == "[user summarized]: " + brute_summary(r.text, max(10, int(count(r.text) * 0.33 + 1e-9))), r.text
        assert r.p == brute_stub("user", r.turn, r.text)


def test_rendered_follows_packing(spark):
    turns = spark.createDataFrame([("c", k, "user", f"Sentence {k} of some words. " * 6, f) for k, f in enumerate(["FULL", "COMPRESSED", "PLACEHOLDER", "FULL"])], "conv_id string, turn long, role string, text string, fidelity string")
    packed = dialogue.pack(turns, 70)
    shown = {r.turn: (r.used_fidelity, r.shown) for r in dialogue.rendered(turns, packed).collect()}
    text = {r.turn: r.text for r in turns.collect()}
    assert shown[0] == ("FULL", text[0])
    assert shown[1][0] == "COMPRESSED" and shown[1][1].startswith("[user summarized]: Sentence 1")
    assert all(shown[k][1].startswith(f"[user turn {k}] Sentence {k}") for k in shown if shown[k][0] == "PLACEHOLDER")
    sizes = {r.turn: r.tokens for r in packed.collect()}
    assert all(count(t) == sizes[k] for k, (_, t) in shown.items()) and sum(sizes.values()) <= 70


def test_repeated_runs_equal_plain_python(spark):
    rng = random.Random(9)
    texts = [None, "", "one", "a a", "a b a b a b a b", " ".join("same run of words".split() * 30)] + [" ".join(rng.choices("abc", k=rng.randrange(2, 90))) for _ in range(20)]
    want = set()
    for i, t in enumerate(texts):
        w = (t or "").split()
        for n in range(2, min(20, len(w) // 2 + 1) + 1):
            for gram, f in Counter(" ".join(w[k : k + n]) for k in range(len(w) - n + 1)).items():
                if f >= 2 and f * (n - 1) - n > 0:
                    want.add((i, n, gram, f, f * (n - 1) - n))
    found = dedup.repeated_ngrams(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), 2, 20).collect()
    assert {(r.id, r.n, r.ngram, r.freq, r.savings) for r in found} == want and len(found) == len(want)
