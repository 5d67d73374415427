"""Compact text forms of nested results, a row each, and their reading back: tables in blocks, skeletons, dialogues, statistics, hand-overs.

Text is escaped (backslash, line feed, comma), so that an encoded value never breaks its line and comes back as it was. Numbers with a
fraction have three places. Null and the empty string are written alike and come back as the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from weftline.functions import text as tx

#: Fields of a hand-over's results and of a skeleton's nodes, and the keys of a hand-over in order.
RESULT_FIELDS = ["node_id", "similarity", "importance", "summary"]
NODE_FIELDS = ["node_id", "importance", "type", "summary"]
BUNDLE_KEYS = [
    "bundle_id", "doc_id", "created_at", "query", "summary", "skeleton_text", "skeleton_total_nodes", "skeleton_tokens",
    "compression_ratio", "context_summary", "replay_text",
]
NUMBERS = {"similarity", "importance", "compression_ratio"}
WHOLE = {"skeleton_total_nodes", "skeleton_tokens"}


def cell(value: Column, number: bool = False) -> Column:
    text = F.format_string("%.3f", value.cast("double")) if number else tx.escape_cell(value.cast("string"))
    return F.when(value.isNotNull(), text).otherwise("")


def _marked(row: Column) -> Column:
    """A row with its escapes marked by line feeds, which no encoded row holds: what a backslash is left over for is then plain."""
    pairs = F.replace(row, F.lit("\\\\"), F.lit("\n0"))
    return F.replace(F.replace(pairs, F.lit("\\,"), F.lit("\n1")), F.lit("\\n"), F.lit("\n2"))


def _unmarked(value: Column) -> Column:
    plain = F.replace(F.replace(value, F.lit("\n1"), F.lit(",")), F.lit("\n0"), F.lit("\\"))
    return F.replace(plain, F.lit("\n2"), F.lit("\n"))


def unescaped(value: Column) -> Column:
    return _unmarked(_marked(value))


def cells(row: Column) -> Column:
    """The cells of an encoded row as text, parted at commas that aren't escaped."""
    return F.transform(F.split(_marked(row), ",", -1), _unmarked)


def indented(text: Column, by: int) -> Column:
    return F.concat(F.lit(" " * by), F.replace(text, F.lit("\n"), F.lit("\n" + " " * by)))


def rows_of(name: str, rows: Column, fields: list[str], numbers: set[str] = NUMBERS) -> Column:
    """An array of structs as ``name[n]{fields}:`` and a line each, led by a space; ``name[0]{}`` where there are none."""
    line = lambda r: F.concat(F.lit(" "), F.array_join(F.array(*[cell(r[f], f in numbers) for f in fields]), ","))
    head = F.concat(F.lit(f"{name}["), F.size(rows).cast("string"), F.lit("]{" + ",".join(fields) + "}:\n"))
    return F.when(F.coalesce(F.size(rows), F.lit(0)) > 0, F.concat(head, F.array_join(F.transform(rows, line), "\n"))).otherwise(f"{name}[0]{{}}")


def read_rows(text: Column, fields: list[str], numbers: set[str] = NUMBERS) -> Column:
    """Structs of a table of ``rows_of``, its lines still indented or not; numbers that are none give null."""

    def row(line: Column) -> Column:
        return tx.let(cells(line), lambda c: F.struct(*[(F.get(c, F.lit(k)).try_cast("double") if f in numbers else F.get(c, F.lit(k))).alias(f) for k, f in enumerate(fields)]))

    depth = F.length(F.regexp_extract(text, "^( *)", 1)) + 1
    lines = F.split(text, "\n", -1)
    return F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: row(F.substr(x, depth + 1)))


def skeleton(file_id: Column, total_nodes: Column, ratio: Column, nodes: Column) -> Column:
    """A skeleton: what it is of, then its nodes (node_id, importance, type, summary) as a table."""
    head = [F.lit("skeleton:"), F.concat(F.lit(" file_id: "), F.coalesce(tx.escape_cell(file_id.cast("string")), F.lit("unknown"))),
            F.concat(F.lit(" total_nodes: "), F.coalesce(total_nodes, F.lit(0)).cast("string")),
            F.concat(F.lit(" compression_ratio: "), F.format_string("%.1f", F.coalesce(ratio.cast("double"), F.lit(1.0)))), F.lit("")]
    return F.array_join(F.array(*head, indented(rows_of("results", nodes, NODE_FIELDS), 1)), "\n")


def stats(values: Column, name: str = "stats") -> Column:
    """A map of figures, a line each by key."""
    entries = F.array_sort(F.map_entries(values))
    lines = F.transform(entries, lambda e: F.concat(F.lit(" "), e["key"], F.lit(": "), cell(e["value"])))
    return F.array_join(F.concat(F.array(F.lit(f"{name}:")), lines), "\n")


def dialogue(values: Column, messages: Column, most: int | None = None) -> Column:
    """Figures and messages (role, content) of a context; ``most`` shortens contents to so many characters and three dots, None keeps them."""
    shown = messages
    if most is not None:
        cut = lambda m: F.when(F.length(m["content"]) > most, F.concat(F.substring(m["content"], 1, most), F.lit("..."))).otherwise(m["content"])
        shown = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), cut(m).alias("content")))
    return F.concat_ws("\n", F.lit("afm_context:"), indented(stats(values), 1), F.lit(""), indented(rows_of("results", shown, ["role", "content"]), 1))


def bundle(values: dict[str, Column], results: Column) -> Column:
    """A hand-over: the keys of ``BUNDLE_KEYS``, those left out empty (numbers: 0), then its search results."""

    def shown(key: str) -> Column:
        value = values.get(key, F.lit(None))
        if key in WHOLE:
            return F.coalesce(value.cast("long"), F.lit(0)).cast("string")
        return cell(F.coalesce(value.cast("double"), F.lit(0.0)), True) if key in NUMBERS else cell(value)

    lines = [F.concat(F.lit(f" {k}: "), shown(k)) for k in BUNDLE_KEYS]
    return F.array_join(F.array(F.lit("handoff_bundle:"), *lines, F.lit(" search_results:"), indented(rows_of("results", results, RESULT_FIELDS), 2)), "\n")


def read_bundle(text: Column) -> Column:
    """A struct of a hand-over's keys and ``search_results`` (an array); null where the text is none. Keys that are missing give null."""

    def parsed(lines: Column) -> Column:
        def value(key: str) -> Column:
            lead = f" {key}: "
            line = F.get(F.filter(lines, lambda x: F.startswith(x, F.lit(lead))), F.lit(0))
            plain = unescaped(F.substr(line, F.lit(len(lead) + 1)))
            return plain.try_cast("long") if key in WHOLE else plain.try_cast("double") if key in NUMBERS else plain

        place = F.array_position(lines, " search_results:").cast("int")
        table = F.array_join(F.slice(lines, place + 1, F.size(lines)), "\n")
        kind = "array<struct<" + ",".join(f"{f}:{'double' if f in NUMBERS else 'string'}" for f in RESULT_FIELDS) + ">>"
        results = F.when(place > 0, read_rows(table, RESULT_FIELDS)).otherwise(F.array().cast(kind))
        return F.struct(*[value(k).alias(k) for k in BUNDLE_KEYS], results.alias("search_results"))

    valid = F.startswith(text, F.lit("handoff_bundle:\n"))
    return F.when(valid, tx.let(F.split(text, "\n", -1), parsed))
