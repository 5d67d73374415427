"""Repair of conversation structure by least edits, over turns and the state of a grammar.

A repaired conversation's role initials follow ``(s?(ua)+)?``. Rows are kept, given the role that the grammar
wants next (rerole), deleted, or preceded by inserted empty rows; ``COST`` holds the prices. Blank rows and
repeats of a row with the same role and text must go; a truncated row that stays costs more.

1. Rows are sorted over ranges of (conversation, turn) and cut into blocks of at most 2 ** ``BLOCK_BITS`` rows, so that
   a long conversation is many rows of bounded size; which rows repeat an earlier one is a grouped minimum.
2. Each block becomes a table of least costs from state to state (a min-plus matrix), all blocks in parallel; the
   costs to go at the end of each block are products of the blocks after it: a few numbers a block.
3. With its costs to go, each block walks forward from every state and takes, of the transitions that
   lose no cost (tight ones), the one whose edit has the least letter: all blocks in parallel again.
4. Blocks of a conversation are read in order once more: the state that one block ends in picks the walk of
   the next; the kept rows are hashed as they come, so that only a block is ever held.

Costs to go, less their minimum, take few values: a step of the recursion is looked up after its first use.

Defined results: a null role or text is one space (a role of no known initial, a blank text); rows without a turn come
first; rows of one turn come by role and text, equal ones in any order, as they are alike; a null conv_id is a conversation
of its own; empty and very long texts are whole; extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftline.session import reachable

from .common import dropped, spread, staged, task_started

#: Rows in a block at most: a power of two.
BLOCK_BITS = 7
#: What the edits cost, and what a truncated row adds that isn't deleted.
COST = {"D": 4, "I": 3, "K": 0, "R": 3}
TRUNCATED = 3

#: States: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state after an inserted or reroled row.
NEXT = (USER, USER, ASSISTANT, USER)
#: The state after a kept row, by its initial (s, u, a, any other) and the state before; None where the grammar refuses it.
KEPT = ((SYSTEM, None, None, None), (USER, USER, None, USER), (None, None, ASSISTANT, None), (None,) * 4)
#: Costs to go after the last row: what must be inserted to end well.
END = (0, 6, 3, 0)
FAR = 1 << 40
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Bits of a row's code above its initial.
IS_TRUNCATED, IS_BLANK, IS_DUPLICATE = 4, 8, 16
SPACE = "\t\n\x0b\x0c\r "


@lru_cache(maxsize=100_000)
def _step(code: int, later: tuple[int, ...]) -> tuple[int, tuple[int, ...], tuple[tuple[str, int], ...]]:
    """The costs to go before a row from those after it, less their minimum, which comes first; and for each state the tight edits up to the row's with the state after."""
    more = TRUNCATED if code & IS_TRUNCATED else 0
    choices = []
    for q in STATES:
        found = {"D": (COST["D"] + later[q], q)}
        if not code & (IS_BLANK | IS_DUPLICATE):
            found["R"] = (COST["R"] + more + later[NEXT[q]], NEXT[q])
            if (after := KEPT[code & 3][q]) is not None:
                found["K"] = (COST["K"] + more + later[after], after)
        choices.append(found)
    cost = [min(c for c, _ in found.values()) for found in choices]
    for _ in range(2):  # a third insertion only comes back to a state
        cost = [min(cost[q], COST["I"] + cost[NEXT[q]]) for q in STATES]
    walks = []
    for q in STATES:
        edits, at = "", q
        while True:
            tight = {e: to for e, (c, to) in choices[at].items() if c == cost[at]}
            if COST["I"] + cost[NEXT[at]] == cost[at]:
                tight["I"] = NEXT[at]
            e = min(tight)
            edits, at = edits + e, tight[e]
            if e != "I":
                break
        walks.append((edits, at))
    least = min(cost)
    return least, tuple(min(c - least, FAR) for c in cost), tuple(walks)


def matrix(codes: bytes) -> list[int]:
    """Least costs from each state before a block to each state after it, row by row; ``FAR`` where there is no way."""
    columns = []
    for q in STATES:
        total, later = 0, tuple(0 if p == q else FAR for p in STATES)
        for code in reversed(codes):
            least, later, _ = _step(code, later)
            total += least
        columns.append([min(total + c, FAR) for c in later])
    return [columns[p][q] for q in STATES for p in STATES]


def walks(codes: bytes, later: tuple[int, ...]) -> list[tuple[str, int]]:
    """(edits, state after) of a block from each state before it, ASCII-least among the cheapest."""
    steps = []
    for code in reversed(codes):
        _, now, picks = _step(code, later)
        steps.append(picks)
        later = now
    steps.reverse()
    out = []
    for q in STATES:
        edits, at = [], q
        for picks in steps:
            e, at = picks[at]
            edits.append(e)
        out.append((",".join(edits), at))
    return out


def _fault(text: Column, first: Column) -> Column:
    """The code bit of a row's first fault: blank, a repeat, truncated."""
    body = F.rtrim(text, F.lit(SPACE))
    return F.when(body == "", IS_BLANK).when(~first, IS_DUPLICATE).when(~F.substring(body, -1, 1).isin(".", "!", "?"), IS_TRUNCATED).otherwise(0)


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def blocks(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, at, turns, roles, texts, codes): each conversation's rows in order, ``at`` orders its blocks and names each."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "tie"]
    # equal rows are told apart by a row number, so that no value of the key fills a task
    ordered = rows.withColumn("tie", F.monotonically_increasing_id()).orderBy(*order).drop("tie")
    ordered = staged(ordered.withColumn("pos", F.monotonically_increasing_id()), "turns")
    firsts = ordered.groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    code = (_initial(F.col("role")) + _fault(F.col("text"), F.col("first").isNotNull())).cast("int")
    coded = ordered.join(firsts, "pos", "left").select("conv_id", "pos", "turn", "role", "text", code.alias("code"))
    parts = coded.groupBy("conv_id", F.shiftright("pos", BLOCK_BITS).alias("part")).agg(F.array_sort(F.collect_list(F.struct("pos", "turn", "role", "text", "code"))).alias("r"))
    out = staged(parts.select("conv_id", F.get("r", F.lit(0))["pos"].alias("at"), *[F.col(f"r.{c}").alias(f"{c}s") for c in ("turn", "role", "text", "code")]), "turn-blocks")
    dropped(ordered)
    return out


def _by_conversation(rows: DataFrame, backwards: bool) -> DataFrame:
    """Whole conversations in a task, their blocks in order: rows of bounded size, read one after the other."""
    end = F.desc("at") if backwards else F.asc("at")
    return rows.repartition(spread(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", end)


def _rows(found: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    task_started()
    for batch in found:
        for at in range(0, batch.num_rows, 16):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 16).columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        weight += 200 + sum(len(x) for x in row if isinstance(x, str))
        if weight > size:
            yield out()
            held, weight = [], 0
    if held:
        yield out()


def _solved(cut: DataFrame) -> DataFrame:
    """(at, edits, after) of each block: for each state before it, the edits of its rows and the state after."""
    kind = cut.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    conv, ints = to_arrow_type(kind), pa.list_(pa.int64())
    costs = pa.schema([("conv_id", conv), ("at", pa.int64()), ("codes", pa.list_(pa.int32())), ("costs", ints)])
    text = f"conv_id {kind.simpleString()}, at long, codes array<int>, costs array<long>"

    def measured(found):
        return _batches(((c, at, codes, matrix(bytes(codes))) for c, at, codes in _rows(found)), costs)

    def togo(found):
        """Costs to go after each block, from the last block of a conversation to its first."""
        now, later = (), END

        def each():
            nonlocal now, later
            for c, at, codes, m in _rows(found):
                if (c,) != now:
                    now, later = (c,), END
                yield c, at, codes, list(later)
                before = [min(m[4 * q + p] + later[p] for p in STATES) for q in STATES]
                least = min(before)
                later = tuple(b - least for b in before)

        return _batches(each(), costs)

    def walked(found):
        def each():
            for _, at, codes, later in _rows(found):
                ways = walks(bytes(codes), tuple(later))
                yield at, [e for e, _ in ways], [to for _, to in ways]

        return _batches(each(), pa.schema([("at", pa.int64()), ("edits", pa.list_(pa.string())), ("after", pa.list_(pa.int32()))]))

    later = _by_conversation(cut.select("conv_id", "at", "codes").mapInArrow(measured, text), backwards=True).mapInArrow(togo, text)
    return later.repartition(spread(cut.sparkSession), "at").mapInArrow(walked, "at long, edits array<string>, after array<int>")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class _Conversation:
    """What has been read of a conversation: counts, the audit and a running hash."""

    LEGAL = {(0, 1), (1, 2), (2, 1)}

    def __init__(self, conv_id):
        self.conv_id, self.state, self.initial, self.first, self.last, self.turns = conv_id, START, None, None, None, 0
        self.n = dict.fromkeys(COUNTS, 0)
        self.audit, self.hash, self.empty = [], hashlib.sha256(), True

    def write(self, role: str, text: str) -> None:
        self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def insert(self, edits: str) -> None:
        for _ in edits:
            self.state = NEXT[self.state]
            self.n["cost"] += COST["I"]
            self.write(ROLES[self.state], "")

    def read(self, turns, roles, texts, codes, edits) -> None:
        steps = edits[self.state].split(",")
        self.audit += steps
        for turn, role, text, code, step in zip(turns, roles, texts, codes, steps, strict=True):
            if turn is not None and turn != self.last:
                self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
            if self.initial is not None and (self.initial, code & 3) not in self.LEGAL:
                self.n["illegal"] += 1
            self.initial = code & 3
            for name, bit in (("blank", IS_BLANK), ("duplicate", IS_DUPLICATE), ("truncated", IS_TRUNCATED)):
                self.n[name] += bool(code & bit)
            self.insert(step[:-1])
            self.n["cost"] += COST[step[-1]]
            if step[-1] != "D":
                self.state = NEXT[self.state] if step[-1] == "R" else KEPT[code & 3][self.state]
                self.n["cost"] += TRUNCATED if code & IS_TRUNCATED else 0
                self.write(ROLES[self.state] if step[-1] == "R" else role, text)

    def done(self) -> tuple:
        rest = "I" * (END[self.state] // COST["I"])
        self.insert(rest)
        self.n["gaps"] = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv_id, *[self.n[c] for c in COUNTS], "".join(self.audit) + rest, self.hash.hexdigest())


def repaired(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of ``turns``.

    ``audit`` holds the initials of the edits in order; the hash is of the repaired ``role:text`` rows, joined by newlines.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    reachable(turns.sparkSession)
    cut = blocks(turns, conv_id, turn, role, text)
    kind = cut.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def read(found):
        def each():
            now = None
            for c, _, *columns in _rows(found):
                if now is None or c != now.conv_id:
                    if now is not None:
                        yield now.done()
                    now = _Conversation(c)
                now.read(*columns)
            if now is not None:
                yield now.done()

        return _batches(each(), schema)

    both = cut.join(_solved(cut).select("at", "edits"), "at").select("conv_id", "at", "turns", "roles", "texts", "codes", "edits")
    longs = ", ".join(f"{c} long" for c in COUNTS)
    return _by_conversation(both, backwards=False).mapInArrow(read, f"conv_id {kind.simpleString()}, {longs}, audit string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with known faults, by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2 takes out its sentence ends, 3 repeats it, 4 makes it the user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def damage_report(turns: DataFrame) -> DataFrame:
    """``repaired`` of the damaged rows, with a row for every conversation of ``turns``: one of which nothing is left has zeros, an empty audit and the hash of an empty text."""
    found = repaired(damaged(turns)).withColumnRenamed("conv_id", "_conv")
    every = turns.groupBy("conv_id").agg(F.lit(1).alias("_")).drop("_")
    both = every.join(found, every["conv_id"].eqNullSafe(found["_conv"]), "left").drop("_conv")
    return both.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
