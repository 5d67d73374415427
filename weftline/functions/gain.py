"""Marginal information gain of a text's tokens for a query."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F

from . import text as tx

KEPT = re.compile(tx.KEPT_TOKEN)
TERM = re.compile(r"\w\w+")
MARKS = ".,;:!?()[]{}\"'"


@lru_cache(200_000)
def _forced(token: str) -> bool:
    bare = token.strip(MARKS)
    return bool(bare and KEPT.match(bare))


@lru_cache(200_000)
def _bag(token: str) -> dict[str, int]:
    found = TERM.findall(token.lower())
    return {found[0]: 1} if len(found) == 1 else dict(Counter(found))


def token_gains(tokens: list[str], query: str, redundancy: float = 0.5, features: int = 500) -> list[float]:
    """A score of .01 to 1 for each token: its likeness to the query less ``redundancy`` times its likeness to what was picked before.

    Each token and the query are documents of TF-IDF weights over the ``features`` most frequent terms (ties by term). Picks are
    greedy, ties go to the first token; tokens of ``KEPT_TOKEN`` are picked beforehand and score 1. Without a query or a term, all others
    score .5. Gains only fall as more is picked: a heap holds each distinct vector once with the gain last known, its running
    maximum is raised only by picks that share a term, and repeats of a picked vector have their final gain at once.
    """
    forced = [_forced(t) for t in tokens]
    plain = [1.0 if f else 0.5 for f in forced]
    if not query.strip():
        return plain
    bags = {t: _bag(t) for t in tokens}
    bags[query] = dict(Counter(TERM.findall(query.lower())))
    times = Counter(tokens)
    times[query] += 1
    total, held = defaultdict(int), defaultdict(int)
    for t, k in times.items():
        for w, n in bags[t].items():
            total[w] += n * k
            held[w] += k
    chosen = heapq.nsmallest(features, total, key=lambda w: (-total[w], w))
    if not chosen:
        return plain
    idf = {w: math.log((2 + len(tokens)) / (1 + held[w])) + 1 for w in chosen}

    def vector(t: str) -> tuple[tuple[str, float], ...]:
        bag = bags[t]
        if len(bag) == 1:
            ((w, n),) = bag.items()
            return ((w, (v := n * idf[w]) / math.sqrt(v * v)),) if w in idf else ()
        found = {w: n * idf[w] for w, n in bag.items() if w in idf}
        length = math.sqrt(sum(v * v for v in found.values()))
        return tuple(sorted((w, v / length) for w, v in found.items()))

    places: dict[tuple, list[int]] = defaultdict(list)
    known: dict[str, tuple] = {}
    for i, t in enumerate(tokens):
        if t not in known:
            known[t] = vector(t)
        places[known[t]].append(i)
    asked, scores = dict(vector(query)), plain[:]
    with_term: dict[str, list[tuple]] = defaultdict(list)
    for v in places:
        for w, _ in v:
            with_term[w].append(v)
    relevance = {v: v[0][1] * asked.get(v[0][0], 0.0) if len(v) == 1 else sum(x * asked.get(w, 0.0) for w, x in v) for v in places}
    most = dict.fromkeys(places, 0.0)
    # a vector that shares no term with another is changed by picks of its own only
    for v, at in list(places.items()):
        if len(v) == 1 and len(with_term[v[0][0]]) > 1 or len(v) > 1 and any(len(with_term[w]) > 1 for w, _ in v):
            continue
        del places[v]
        first = max(0.01, min(1.0, relevance[v] + 0.5))
        after = max(0.01, min(1.0, relevance[v] - redundancy + 0.5)) if v else first
        if v and any([forced[i] for i in at]):
            first = after
        for i in at:
            if not forced[i]:
                scores[i], first = first, after

    def picked(v: tuple) -> None:
        mine = dict(v)
        for other in {o for w, _ in v for o in with_term[w]}:
            most[other] = 1.0 if other == v else max(most[other], sum(x * mine.get(w, 0.0) for w, x in other))

    def gain(v: tuple) -> float:
        return relevance[v] - redundancy * most[v]

    def score(v: tuple) -> float:
        return max(0.01, min(1.0, gain(v) + 0.5))

    for v, at in places.items():
        if any(forced[i] for i in at):
            picked(v)
    heap = []
    for v, at in places.items():
        free = [i for i in at if not forced[i]]
        if free:
            heap.append((-gain(v), free[0], v, free))
    heapq.heapify(heap)
    while heap:
        below, first, v, free = heapq.heappop(heap)
        if -below > gain(v):  # less than was thought
            heapq.heappush(heap, (-gain(v), first, v, free))
            continue
        scores[first] = score(v)
        picked(v)
        for i in free[1:]:
            scores[i] = score(v)
    return scores


def gains(text: Column, query: str, redundancy: float = 0.5, features: int = 500) -> Column:
    """``token_gains`` of the words of each text, Arrow batches at a time; null for a null text."""

    @F.pandas_udf("array<double>")
    def scored(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else token_gains(t.split(), query, redundancy, features))

    return scored(text)


def refined(text: Column, scores: Column, ratio: float) -> Column:
    """The ceil(n * ratio) best words by ``scores`` in their order, ties to the first."""

    def pick(ws: Column) -> Column:
        ordered = F.array_sort(F.transform(F.arrays_zip(ws.alias("w"), scores.alias("s")), lambda e, i: F.struct((-e["s"]).alias("less"), i.alias("i"), e["w"].alias("w"))))
        best = F.slice(ordered, F.lit(1), F.ceil(F.size(ws) * F.lit(ratio)).cast("int"))
        return F.array_join(F.transform(F.array_sort(F.transform(best, lambda e: F.struct(e["i"], e["w"]))), lambda e: e["w"]), " ")

    return tx.let(F.filter(F.split(text, tx.WORD_SPACE), lambda w: w != ""), pick)
