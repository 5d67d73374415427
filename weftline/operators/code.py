"""Code files: languages, imports, dead files, outlines and chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Language by file extension.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust", "cpp": "cpp", "cc": "cpp", "c": "c", "h": "c"}
IMPORT = r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))"


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext), F.lit("unknown"))


def imports(files: DataFrame, path: str = "path", code: str = "code") -> DataFrame:
    """(path, module) of imports in Python files, each once."""
    found = F.concat(F.regexp_extract_all(F.col(code), F.lit(IMPORT), F.lit(1)), F.regexp_extract_all(F.col(code), F.lit(IMPORT), F.lit(2)))
    return files.select(path, F.explode(F.array_distinct(F.filter(found, lambda m: m != ""))).alias("module"))


def dead_files(files: DataFrame, entry: str = r"(?:^|/)(?:main|__main__|setup|conftest|__init__)\.py$|(?:^|/)tests?/", path: str = "path", code: str = "code") -> DataFrame:
    """Python files that none other imports and that aren't entry points."""
    own = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"/__init__$", ""), "/", ".")
    named = files.select(path, F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split(own, r"\."))), lambda i: F.array_join(F.slice(F.split(own, r"\."), i, F.size(F.split(own, r"\."))), "."))).alias("module"))
    used = imports(files, path, code).withColumnRenamed(path, "importer")
    # "from a import b" may name the file a/b.py: match the module and what it leads
    hit = named.join(used, "module").filter(F.col(path) != F.col("importer")).select(path).distinct()
    return files.select(path).filter(F.col(path).endswith(".py") & ~F.col(path).rlike(entry)).join(hit, path, "left_anti")


def _python_parts(path: str, code: str) -> list[tuple]:
    """(kind, name, signature, docstring, start, end, calls) of a Python source; one block of lines where it doesn't parse."""
    import ast

    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        lines = code.split("\n")
        return [("block", f"lines_{k + 1}", lines[k].strip()[:120], "", k + 1, min(k + 50, len(lines)), []) for k in range(0, len(lines), 50)]
    out = []
    heads = [n for n in tree.body if isinstance(n, ast.Import | ast.ImportFrom)]
    if heads:
        out.append(("imports", "imports", "", "", heads[0].lineno, heads[-1].end_lineno, sorted({a.name for n in heads for a in n.names})))

    def walk(node, above: str) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                name = f"{above}.{n.name}" if above else n.name
                kind = "class" if isinstance(n, ast.ClassDef) else "function"
                calls = {c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(n) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name | ast.Attribute)}
                out.append((kind, name, code.split("\n")[n.lineno - 1].strip(), ast.get_docstring(n) or "", n.lineno, n.end_lineno, sorted(calls)))
                walk(n, name)
            elif not isinstance(n, ast.expr):
                walk(n, above)

    walk(tree, "")
    return out


def _script_parts(path: str, code: str) -> list[tuple]:
    """The same of JavaScript and TypeScript, by signatures and a brace matcher that knows strings and comments."""
    import re

    out = []
    blank = re.sub(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", lambda m: re.sub(r"[^\n]", " ", m[0]), code, flags=re.S)
    for m in re.finditer(r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?(?:(async\s+)?function\s*\*?\s*(\w+)|class\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>)", blank):
        start = blank.find("{", m.end())
        if start < 0:
            continue
        depth, at = 0, start
        while at < len(blank):
            depth += {"{": 1, "}": -1}.get(blank[at], 0)
            at += 1
            if not depth:
                break
        first, last = code.count("\n", 0, m.start()) + 1, code.count("\n", 0, at) + 1
        calls = sorted(set(re.findall(r"\b(\w+)\s*\(", blank[start:at])) - {"if", "for", "while", "switch", "return", "function", "catch"})
        out.append(("class" if m[3] else "function", m[2] or m[3] or m[4], code[m.start() : start].strip(), "", first, last, calls))
    return out


PART = "kind string, name string, signature string, docstring string, start_line int, end_line int, calls array<string>"


def code_chunks(files: DataFrame, path: str = "path", code: str = "code") -> DataFrame:
    """(path, language, kind, name, signature, docstring, start_line, end_line, calls) of each definition; parsing is Arrow-batched Python."""
    @F.pandas_udf(f"array<struct<{','.join(x.strip().replace(' ', ':', 1) for x in PART.split(', '))}>>")
    def parts(paths: pd.Series, codes: pd.Series) -> pd.Series:
        def of(p: str, c: str) -> list[dict]:
            found = _python_parts(p, c or "") if p.endswith(".py") else _script_parts(p, c or "")
            return [dict(zip(("kind", "name", "signature", "docstring", "start_line", "end_line", "calls"), f, strict=True)) for f in found]

        return pd.Series([of(p, c) for p, c in zip(paths, codes, strict=True)])

    rows = files.select(path, language(F.col(path)).alias("language"), F.explode(parts(F.col(path), F.col(code))).alias("p"))
    return rows.select(path, "language", "p.*")


def dependency_edges(chunks: DataFrame, path: str = "path") -> DataFrame:
    """(src, dst) of definitions whose code calls another by its last name; self-calls aside, each once."""
    ids = chunks.filter("kind <> 'imports'").select(F.concat_ws("::", path, "name").alias("id"), F.substring_index("name", ".", -1).alias("short"), "calls")
    calls = ids.select(F.col("id").alias("src"), F.explode("calls").alias("short"))
    return calls.join(ids.select(F.col("id").alias("dst"), "short"), "short").filter("src <> dst").select("src", "dst").distinct()


def code_stats(chunks: DataFrame, path: str = "path") -> DataFrame:
    return chunks.groupBy(path).agg(F.count("*").alias("chunks"), *[F.count(F.when(F.col("kind") == k, 1)).alias(f"{k}_chunks") for k in ("imports", "function", "class", "block")], F.sum(F.col("end_line") - F.col("start_line")).alias("lines"))


def code_skeleton(chunks: DataFrame, ratio: float = 0.25, path: str = "path") -> DataFrame:
    """(path, shown, hidden, skeleton): the signatures of the longest quarter of definitions in source order."""
    from pyspark.sql import Window as W

    w = W.partitionBy(path)
    rows = chunks.filter("kind <> 'imports'").withColumns({"r": F.row_number().over(w.orderBy(F.desc(F.col("end_line") - F.col("start_line")), "start_line", "name")), "n": F.count("*").over(w)})
    kept = F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") * ratio))
    line = F.concat("signature", F.when(F.col("docstring") != "", F.concat(F.lit("  # "), F.get(F.split("docstring", "\n"), F.lit(0)))).otherwise(""))
    done = rows.groupBy(path).agg(F.count(F.when(kept, 1)).alias("shown"), F.count(F.when(~kept, 1)).alias("hidden"), F.array_sort(F.collect_list(F.when(kept, F.struct("start_line", "name", line.alias("line"))))).alias("x"))
    return done.select(path, "shown", "hidden", F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("skeleton"))
