"""Structural outlines of code files: one pass over tokens with a stack of open definitions.

Python nests by indentation, the other languages by braces; strings and comments never count. A file's symbols are rows, and its
outline and savings are aggregated from them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weftline.session import reachable

from .code import language

#: A string never runs past its end or, if it has none, its line (the text, for those of several lines).
_SHORT = r"\"(?:[^\"\\\n]|\\.)*+\"?|'(?:[^'\\\n]|\\.)*+'?"
PYTHON = re.compile(r"(?s)(?P<string>[rRbBuUfFtT]{0,2}(?:\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+(?:\"\"\")?|'''(?:[^'\\]|\\.|'(?!''))*+(?:''')?|" + _SHORT + r"))|(?P<skip>#[^\n]*+|\\\n)|(?P<word>\w++)|(?P<line>\n)|(?P<space>[ \t\r\f]++)|(?P<mark>.)")
#: In Rust and C a quote holds one character, or names a lifetime.
_CHAR = r"\"(?:[^\"\\]|\\.)*+\"?|'(?:\\.[^'\n]{0,8}|[^'\\\n])'"
_BRACES = r"|(?P<skip>//[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?)|(?P<word>[\w$]++)|(?P<space>\s++)|(?P<mark>.)"
SCRIPT = re.compile(r"(?s)(?P<string>`(?:[^`\\]|\\.)*+`?|" + _SHORT + ")" + _BRACES)
SYSTEM = re.compile(r"(?s)(?P<string>`[^`]*+`?|" + _CHAR + ")" + _BRACES)
SCRIPTS = {"javascript", "typescript", "css"}

#: Words that open a container, and those before a brace that open no definition.
CONTAINERS = {"class", "interface", "struct", "enum", "trait", "impl", "namespace", "module", "mod", "union", "record", "type"}
CONTROL = {"if", "for", "while", "switch", "catch", "else", "do", "try", "finally", "return", "match", "loop", "select", "with", "synchronized", "await", "throw", "unsafe", "case", "default"}
IMPORTS = {"import", "use", "require", "include", "package"}


#: Names of open definitions that qualify a symbol's, and steps of indentation, at most: the innermost count.
NAMES, STEPS = 8, 32


def _qualified(stack: list[tuple], name: str) -> str:
    return ".".join([*(s[-1] for s in stack[-NAMES:]), name])


def _split(text: str, at: str = ",") -> list[str]:
    """Parts of ``text`` between marks ``at`` outside brackets and strings."""
    parts, depth, now = [], 0, []
    for m in PYTHON.finditer(text):
        t = m[0]
        depth += (t in "([{") - (t in ")]}") if m.lastgroup == "mark" else 0
        if t == at and depth == 0 and m.lastgroup == "mark":
            parts.append("".join(now))
            now = []
        else:
            now.append(t)
    return [*parts, "".join(now)]


def _squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _parameter(text: str) -> str:
    """A parameter with ``...`` for its default."""
    head, *value = _split(text, "=")
    return _squeezed(head) + (" = ..." if value else "")


def _statements(code: str) -> Iterator[tuple[int, int, list[tuple[str, str]]]]:
    """(line, indent, tokens) of each logical line of Python: brackets, strings and a last backslash join lines."""
    line, first, indent, depth, tokens, start = 1, 1, 0, 0, [], True
    for m in PYTHON.finditer(code):
        kind, t = m.lastgroup, m[0]
        if kind == "line" and depth <= 0:
            if tokens:
                yield first, indent, tokens
            tokens, start, indent, depth = [], True, 0, 0
        elif kind == "space" and start and not tokens:
            indent = len(t.expandtabs(8))
        elif kind not in ("skip", "line", "space") or tokens:
            if not tokens:
                first, start = line, False
            if kind == "mark":
                depth += (t in "([{") - (t in ")]}")
            tokens.append((kind, " " if kind in ("skip", "line") else t))
        line += t.count("\n")
    if tokens:
        yield first, indent, tokens


def _signature(text: str) -> str:
    """A Python header up to its colon, defaults left out."""
    head = _split(text, ":")[0] if text.startswith("class") else text
    at = head.find("(")
    if at < 0:
        return _squeezed(head).rstrip(":")
    depth, end = 0, len(head)
    for m in PYTHON.finditer(head, at):
        depth += (m[0] in "([{") - (m[0] in ")]}") if m.lastgroup == "mark" else 0
        if depth == 0 and m.lastgroup == "mark" and m[0] in ")]}":
            end = m.end()
            break
    inside = [_parameter(p) for p in _split(head[at + 1 : end - 1]) if p.strip()]
    after = _squeezed(_split(head[end:], ":")[0])
    return f"{_squeezed(head[:at])}({', '.join(inside)})" + (f" {after}" if after else "")


def python_symbols(code: str) -> Iterator[tuple]:
    """(line, depth, kind, name, signature) of imports, classes with fields and methods, functions and constants, outermost and in classes."""
    stack: list[tuple[int, str, str]] = []  # indent, kind, name
    marks: list[str] = []
    inner = 0  # functions that are open: nothing inside them is part of the outline
    for line, indent, tokens in _statements(code):
        while stack and indent <= stack[-1][0]:
            inner -= stack.pop()[1] != "class"
        text = "".join(t for _, t in tokens)
        words = [t for k, t in tokens if k != "space"]
        held, depth = not inner, len(stack)
        if words[0] == "@":
            marks.append(_squeezed(text))
            continue
        head = words[1:] if words[0] == "async" else words
        if len(head) > 1 and head[0] in ("def", "class"):
            kind = "class" if head[0] == "class" else "method" if stack else "function"
            if held:
                yield line, depth, kind, _qualified(stack, head[1]), "\n".join([*marks, _signature(text)])
            stack.append((indent, kind, head[1]))
            inner += kind != "class"
        elif words[-1] == ":" and head[0] in ("if", "else", "elif", "try", "except", "finally", "with", "for", "while"):
            pass  # definitions under conditions belong to what is around them
        elif words[0] in ("import", "from"):
            if held and not stack:
                yield line, depth, "import", "", _squeezed(text)
        elif held and stack and len(words) > 2 and words[1] == ":" and tokens[0][0] == "word":
            annotation, *value = _split(text.split(":", 1)[1], "=")
            yield line, depth, "field", _qualified(stack, words[0]), f"{words[0]}: {_squeezed(annotation)}" + (" = ..." if value else "")
        elif held and not stack and len(words) > 2 and words[1] == "=" and words[0].isupper():
            yield line, depth, "constant", words[0], f"{words[0]} = ..."
        marks = []


def brace_symbols(code: str, tokens: re.Pattern, css: bool = False) -> Iterator[tuple]:
    """The same of languages with braces: what stands before a brace tells what it opens."""
    stack: list[tuple[str, str]] = []
    header: list[str] = []
    line, first, round_, inner = 1, 1, 0, 0
    for m in tokens.finditer(code):
        kind, t = m.lastgroup, m[0]
        if kind == "skip":
            header.append(" ") if header else None
        elif t == "{" and kind == "mark" and round_ <= 0:
            text = _squeezed("".join(header))
            what, name = _header(text, css, bool(stack))
            if what and not inner:
                yield first, len(stack), what, _qualified(stack, name), text
            stack.append((what, name))
            inner += what != "class"
            header = []
        elif t in "};" and kind == "mark" and round_ <= 0:
            text = _squeezed("".join(header))
            if text and not inner:
                lead = text.removeprefix("#").split(" ", 1)[0].split("(", 1)[0]
                if lead in IMPORTS and not stack:
                    yield first, 0, "import", "", text
                elif t == ";" and stack and "(" in text and "=" not in text:
                    what, name = _header(text, css, True)
                    if what == "method":
                        yield first, len(stack), "method", _qualified(stack, name), text
            if t == "}" and stack:
                inner -= stack.pop()[0] != "class"
            header = []
        else:
            if kind == "mark" and t in "()":
                round_ += 1 if t == "(" else -1
            if not header and kind != "space":
                first = line
            if header or kind != "space":
                header.append(t)
            if kind == "space" and "\n" in t and len(header) > 1 and (header[0] == "#" or header[0] in IMPORTS) and not stack and "{" not in t:
                text = _squeezed("".join(header))  # a directive or an import ends with its line
                if not text.endswith(("(", ",")):
                    yield first, 0, "import", "", text
                    header, round_ = [], 0
        line += t.count("\n")


_NAME = re.compile(r"([\w$~]+)\s*(?:<[^<>()]*>)?\s*\(")


def _header(text: str, css: bool, inside: bool) -> tuple[str, str]:
    """(kind, name) of what a brace after ``text`` opens; no kind for blocks and values."""
    if css:
        return ("rule", text) if text else ("", "")
    words = re.findall(r"[\w$]+", re.sub(r"<[^<>]*>", " ", text.split("(", 1)[0]))
    for k, w in enumerate(words):
        if w in CONTAINERS and k + 1 < len(words) and "=" not in text.split("{")[0].split("<")[0]:
            return "class", words[-1] if w == "impl" else words[k + 1]
    if not words or words[0] in CONTROL or words[0] == "new" or words[-1] in CONTROL:
        return "", ""
    arrow = re.match(r"(?:export\s+)?(?:default\s+)?(?:const|let|var)\s+([\w$]+)[^=]*=\s*(?:async\s*)?(?:\(|[\w$]+\s*=>)", text)
    if arrow:
        return ("function", arrow[1]) if text.endswith("=>") else ("", "")
    named = _NAME.search(re.sub(r"^(?:func|fn)\s*\([^)]*\)", "func", text))
    if named and "=" not in text[: text.find("(")] and named[1] not in CONTROL and text.rstrip()[-1:] not in "=,(":
        return "method" if inside else "function", named[1]
    return "", ""


def symbols_of(lang: str, code: str) -> Iterator[tuple]:
    return python_symbols(code) if lang == "python" else brace_symbols(code, SCRIPT if lang in SCRIPTS else SYSTEM, lang == "css")


def symbols(files: DataFrame, path: str = "path", code: str = "code") -> DataFrame:
    """(path, language, line, depth, kind, name, signature) of each file's symbols; null code has none, and code that doesn't parse what can be told."""
    reachable(files.sparkSession)
    lang = F.when(F.lower(F.col(path)).endswith(".css"), "css").otherwise(language(F.col(path)))
    rows = files.select(F.col(path).alias("path"), lang.alias("language"), F.coalesce(F.col(code), F.lit("")).alias("code"))
    schema = pa.schema([("path", to_arrow_type(rows.schema["path"].dataType)), ("language", pa.string()), ("line", pa.int32()), ("depth", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("signature", pa.string())])

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for at in range(0, batch.num_rows, 100):
                out = [(p, n, *s) for p, n, c in zip(*(x.to_pylist() for x in batch.slice(at, 100).columns), strict=True) for s in symbols_of(n, c)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return rows.mapInArrow(read, "path string, language string, line int, depth int, kind string, name string, signature string")


def outlines(files: DataFrame, path: str = "path", code: str = "code") -> DataFrame:
    """(path, language, line_count, symbol_count, summary_text, summary_tokens, original_tokens, savings_pct) of each file, paths being unique.

    The outline has a line with the file's name and length, then its symbols in order, indented by depth, bodies left out. Tokens are four characters.
    """
    found = symbols(files, path, code)
    parts = F.transform(F.split("signature", "\n"), lambda s: F.concat(F.repeat(F.lit("    "), F.least(F.col("depth"), F.lit(STEPS))), s))
    body = F.concat(F.array_join(parts, "\n"), F.when(F.col("kind").isin("class", "rule"), ":").when(F.col("kind").isin("function", "method"), ": ...").otherwise(""))
    lines = found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "depth", "name", body.alias("body")))).alias("x"), F.count(F.when(F.col("kind").isin("class", "function", "method"), 1)).alias("symbol_count"))
    text = F.coalesce(F.col(code), F.lit(""))
    n = F.when(text == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, r"\r?\n\z", ""), "\n")))
    lang = F.when(F.lower(F.col(path)).endswith(".css"), "css").otherwise(language(F.col(path)))
    heads = files.select(F.col(path).alias("path"), lang.alias("language"), n.cast("int").alias("line_count"), F.floor(F.length(text) / 4).alias("original_tokens"))
    both = heads.join(lines, "path", "left").withColumn("symbol_count", F.coalesce("symbol_count", F.lit(0)))
    head = F.format_string("# %s (%d lines)", F.substring_index("path", "/", -1), F.col("line_count"))
    full = F.when(F.col("x").isNull(), head).otherwise(F.concat(head, F.lit("\n\n"), F.array_join(F.transform("x", lambda e: e["body"]), "\n")))
    both = both.withColumn("summary_text", full).withColumn("summary_tokens", F.floor(F.length("summary_text") / 4))
    pct = F.round((F.col("original_tokens") - F.col("summary_tokens")) / F.greatest(F.col("original_tokens"), F.lit(1)) * 100, 1)
    return both.select("path", "language", "line_count", "symbol_count", "summary_text", "summary_tokens", "original_tokens", pct.alias("savings_pct"))
