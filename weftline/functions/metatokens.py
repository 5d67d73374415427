"""Repeated word runs as short symbols with a dictionary: smaller texts that read back to the same words."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F, types as T

MARK = "§"


def repeated_runs(lines: list[list[str]], longest: int) -> Iterator[tuple[int, list[str], int]]:
    """(n, run, times) of runs of 2 to ``longest`` words that stand twice or more in the lines, overlaps included.

    A run repeats only where the run of one word less does: each round looks at the places that are left.
    """
    import numpy as np

    flat = [w for line in lines for w in line]
    names: dict[str, int] = {}
    codes = np.fromiter((names.setdefault(w, len(names)) for w in flat), dtype=np.int64, count=len(flat))
    sizes = np.array([len(line) for line in lines], dtype=np.int64)
    last = np.repeat(np.cumsum(sizes), sizes)
    at, run = np.arange(len(flat)), codes
    for n in range(1, longest + 1):
        if n > 1:
            fit = at + n <= last[at]
            at, run = at[fit], run[fit] * len(names) + codes[at[fit] + n - 1]
        _, first, run, counts = np.unique(run, return_index=True, return_inverse=True, return_counts=True)
        if n > 1:
            for k in np.flatnonzero(counts > 1).tolist():
                yield n, flat[at[first[k]] : at[first[k]] + n], int(counts[k])
        kept = counts[run] > 1
        at, run = at[kept], run[kept]
        if not len(at):
            return


def compressed(text: str, longest: int = 20, most: int = 50) -> str:
    """``text``'s words with the runs that save most replaced; runs never cross lines, marks in the text are doubled."""
    lines = [[w.replace(MARK, MARK * 2) for w in line.split()] for line in text.split("\n")]
    runs = {tuple(r): f * (n - 1) - n for n, r, f in repeated_runs(lines, min(longest, sum(map(len, lines)) // 2 + 1)) if f * (n - 1) - n > 0}
    names: dict[tuple, str] = {}
    for run, _ in heapq.nsmallest(most, runs.items(), key=lambda x: (-x[1], -len(x[0]), x[0])):
        name, used, out, n, (one, two, *_) = f"{MARK}{len(names)}", 0, [], len(run), run
        for line in lines:
            new, done, i = [], 0, -1
            try:
                while True:
                    i = line.index(one, i + 1)
                    if line[i + 1 : i + 2] == [two] and tuple(line[i : i + n]) == run:
                        new += [*line[done:i], name]
                        done, used = i + n, used + 1
                        i = done - 1
            except ValueError:  # no further place
                out.append(new + line[done:] if done else line)
        if used * (len(run) - 1) - len(run) > 0:
            names[run], lines = name, out
    head = [f"{name}={' '.join(run)}" for run, name in names.items()]
    return "\n".join([str(len(head)), *head, *(" ".join(line) for line in lines)])


def restored(text: str) -> str:
    """The words of the original, one space between them."""
    rows = text.split("\n")
    n = int(rows[0])
    names = dict(r.split("=", 1) for r in rows[1 : n + 1])

    def words(line: str) -> list[str]:
        return [x for w in line.split() for x in (words(names[w]) if w in names else [w])]

    return "\n".join(" ".join(words(line)).replace(MARK * 2, MARK) for line in rows[n + 1 :])


def compressor(longest: int = 20, most: int = 50):
    """A column function that compresses texts; null stays null."""

    @F.pandas_udf(T.StringType())
    def compress(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else compressed(t, longest, most))

    return compress


compress = compressor()


@F.pandas_udf(T.StringType())
def restore(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else restored(t))
