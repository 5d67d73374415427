"""Resampling, near duplicates by signatures and conversation repair against brute force and edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from functools import cache

import numpy as np
import pytest

from tests.llm.test_operators import brute_classes
from weftline.llm import common, conversations, minhash, resample
from weftline.llm.shingles import mixed, shingle_set

LONG = "Very long, text " * 20_000
TEXTS = [None, "", " - ", "one", "two words", "same text here", "same text here", "ÜNÏcödé ☃ text 7a_b", "a b a b a b c " * 4, LONG]


# -- 11 importance resampling


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features_of(text, low, high):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)]


def brute_resample(rows, target, low, high, buckets, share, least, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in rows for f in features_of(x, low, high)), Counter(bucket(f) for x in target for f in features_of(x, low, high))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    out = []
    for key, x in rows:
        f = features_of(x, low, high)
        weight = sum(gain(bucket(v)) for v in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(x))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: share * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r) for r in out), key=str)


@pytest.mark.parametrize(("low", "high"), [(1, 1), (1, 2), (2, 3)])
def test_resample_matches_brute_force(spark, sf_dir, low, high, monkeypatch):
    monkeypatch.setattr(resample, "PIECE", 1000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows += [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(1005, "same text here"), (None, "no id at all " * 9)]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()] + [None, ""]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, score string, bucket int")
    found = resample.importance_resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"), low, high, 500, 30, 5, 7)
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"], r.n_words) for r in found.collect()), key=str)
    assert got == brute_resample(rows, target, low, high, 500, 30, 5, 7)
    kept = resample.drawn(docs, spark.createDataFrame([(t,) for t in target], "text string"), low=low, high=high, buckets=500, share=30, least_words=5, seed=7)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in got if r[4] and r[0] is not None}


def test_resample_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    assert resample.importance_resampled(none, none).count() == 0
    assert resample.importance_resampled(some, none, least_words=1, share=100).first()["rank"] == 1


def test_resample_pieces_end_between_words(monkeypatch):
    monkeypatch.setattr(resample, "PIECE", 50)
    between = re.compile(resample.SEPARATOR)
    for text in ("", "word " * 100, "x" * 500, "é" * 70 + " " + "y" * 200):
        pieces = list(resample._pieces(text, between))
        assert "".join(pieces) == text and [w for p in pieces for w in words_of(p)] == words_of(text)


# -- 12 near duplicates by signatures


def plain_signature(members):
    """SuperMinHash of one set, an element at a time and without an early stop."""
    full, best = 2**64 - 1, [2**64 - 1] * minhash.SLOTS
    mix = lambda x: int(mixed(np.array([x & full], dtype=np.uint64))[0])
    for x in members:
        e, order = mix(int(x)), list(range(minhash.SLOTS))
        for level in range(minhash.SLOTS):
            drawn = mix(e + int(minhash._A) * (2 * level + 1))
            at = level + mix(drawn ^ int(minhash._B)) % (minhash.SLOTS - level)
            order[level], order[at] = order[at], order[level]
            best[order[level]] = min(best[order[level]], level << 56 | drawn >> 8)
    return [(b ^ b >> 32) & 0xFFFFFFFF for b in best]


def test_signatures_match_one_by_one():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 7, 40, 300, 3)]
    assert minhash.signatures(sets).tolist() == [plain_signature(s) for s in sets]
    assert minhash.signatures([]).shape == (0, minhash.SLOTS)


def test_signatures_estimate_with_less_variance():
    rng, errors = np.random.default_rng(4), []
    for _ in range(300):
        x = rng.integers(0, 2**63, 25).astype(np.uint64)
        a, b = np.unique(x[:20]), np.unique(x[5:])  # 15 of 25 shared
        one, two = minhash.signatures([a, b])
        errors.append((one == two).mean() - 0.6)
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < 0.8 * 0.6 * 0.4 / minhash.SLOTS  # independent minima would have 0.6 * 0.4 / SLOTS


def test_screen_keeps_pairs_at_the_threshold():
    least, rng = minhash.least_equal(0.85), np.random.default_rng(5)
    assert 140 < least < 180 and minhash.least_equal(1.0) == minhash.SLOTS
    for _ in range(200):
        x = rng.integers(0, 2**63, 200).astype(np.uint64)
        one, two = minhash.signatures([np.unique(x[:185]), np.unique(x[15:])])  # 170 of 200 shared
        assert (one == two).sum() >= least and (minhash.band_keys(one[None]) == minhash.band_keys(two[None])).any()


def near_texts(seed, n=60):
    rng, out = random.Random(seed), []
    for i in range(n):
        if not out or rng.random() < 0.3:
            out.append(" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randrange(1, 90))))
        else:
            w = rng.choice(out).split()
            for _ in range(rng.randrange(3)):
                w.insert(rng.randrange(len(w) + 1), rng.choice(["new", "NEW", "other"]))
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("block", "bound"), [(2_000, 10**6), (3, 2)])
def test_near_duplicates_match_all_pairs(spark, sf_dir, monkeypatch, block, bound):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(common, "LOOKUP_ROWS", bound)
    rows = list(enumerate([*TEXTS, *near_texts(block)])) + [(5, "same text here"), (3, "one")]
    rows += [(500 + i, "hot copy of one text that stands in very many rows") for i in range(300)] + [(900 + i, None) for i in range(50)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, n int").repartition(3)
    found = minhash.near_duplicates(docs, 5, "0.85").collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found} == set(brute_classes(rows, 5, Fraction("0.85")))
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_on_the_fixture(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = minhash.near_duplicates(docs, 5, "0.85").collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(brute_classes(rows, 5, Fraction("0.85")))
    kept = minhash.without_near_duplicates(docs, 5, "0.85")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.component_id for r in found}


def test_near_duplicates_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(none).count() == 0
    lone = spark.createDataFrame([(None, "a b c d e f"), (None, None), (4, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(lone).collect()), key=str)
    assert got == sorted([(None, 4, False), (None, None, True), (4, 4, True)], key=str)
    assert minhash.without_near_duplicates(lone).count() == 3
    with pytest.raises(ValueError, match="similarity"):
        minhash.near_duplicates(lone, similarity="0.2")
    assert len(shingle_set("a b", 5)) == 1


# -- 13 conversation repair


def cheapest(rows):
    """(cost, audit, lines) of the ASCII-least of the cheapest edits, by recursion over all of them."""
    follows = {("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    @cache
    def best(i, last, inserted):
        found = []
        if i == len(rows) and last in ("", "a"):
            found.append((0, "", ()))
        if inserted < 3:
            for c, name in (("u", "user"), ("a", "assistant")):
                if (last, c) in follows:
                    cost, audit, lines = best(i, c, inserted + 1)
                    found.append((cost + 3, "I" + audit, (f"{name}:", *lines)))
        if i < len(rows):
            role, text, fault = rows[i]
            cost, audit, lines = best(i + 1, last, 0)
            found.append((cost + 4, "D" + audit, lines))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                for c, name, e, price in [(role[:1], role, "K", 0), ("u", "user", "R", 3), ("a", "assistant", "R", 3)]:
                    if (last, c) in follows or (c == "s" and last == ""):
                        cost, audit, lines = best(i + 1, c, 0)
                        found.append((cost + price + more, e + audit, (f"{name}:{text}", *lines)))
        return min(found, key=lambda f: f[:2], default=(10**9, "", ()))

    return best(0, "", 0)


def brute_repair(turns):
    """One row a conversation from (conv_id, turn, role, text) rows."""
    out = []
    for conv in {r[0] for r in turns}:
        mine = sorted(((t, " " if r is None else r, " " if x is None else x) for c, t, r, x in turns if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, rows = set(), []
        for _, role, text in mine:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            rows.append((role, text, fault))
        known = [t for t, *_ in mine if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, lines = cheapest(tuple(rows))
        counts = Counter(f for *_, f in rows)
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def random_turns(seed, conversations=40):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None], ["Yes.", "No!", "cut of", "", " \n", "Long? ", "a. ", None, "é."]
    out = []
    for c in range(conversations):
        for t in range(rng.randrange(1, 9)):
            row = (c, rng.choice([t, t, t, None, t + rng.randrange(4)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"Text {rng.random()}.")
            out += [row] * rng.choice([1, 1, 1, 2])
    return [*out, (None, 1, "user", "Whose?"), (None, None, "assistant", "x" * 100_000 + ".")]


def rows_of(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("bits", [7, 1, 0])
def test_repair_matches_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(conversations, "BLOCK_BITS", bits)
    turns = random_turns(bits)
    table = spark.createDataFrame([(*r, "x", 1) for r in turns], "conv_id long, turn long, role string, text string, code string, at int").repartition(3)
    assert rows_of(conversations.repaired(table)) == brute_repair(turns)


def test_repair_long_conversation(spark, monkeypatch):
    """Blocks compose: one conversation of many blocks, split over partitions, gives what one block gives."""
    rng = random.Random(5)
    turns = [("c", t // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "cut", f"T{t}."])) for t in range(700)]
    table = spark.createDataFrame(turns, "conv_id string, turn long, role string, text string")
    whole = rows_of(conversations.repaired(table))
    monkeypatch.setattr(conversations, "BLOCK_BITS", 2)
    assert rows_of(conversations.repaired(table.repartition(7))) == whole
    import sys

    monkeypatch.setattr(sys, "setrecursionlimit", sys.setrecursionlimit)
    sys.setrecursionlimit(20_000)
    assert whole == brute_repair(turns)


def test_damage_report_keeps_every_conversation(spark, sf_dir):
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = []
    for r in convs.collect():
        kind = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", r.text) if kind == 2 else r.text
        rows += [] if kind == 0 else [(r.conv_id, r.turn, "user" if kind == 4 else r.role, text)] * (2 if kind == 3 else 1)
    gone = {r.conv_id for r in convs.collect()} - {r[0] for r in rows}
    want = brute_repair(rows) + [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone]
    assert rows_of(conversations.damage_report(convs)) == sorted(want, key=str)
    dropped = next(t for t in range(100) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    only = spark.createDataFrame([(7, dropped, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert rows_of(conversations.damage_report(only)) == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repair_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repaired(none).count() == 0 and conversations.damage_report(none).count() == 0
