"""Filters for command output, as expressions over arrays of lines and as line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weftline.functions import text as tx

ANSI = r"\x1b\[[0-9;?]*[ -/]*[@-~]|\x1b\][^\x07]*\x07|\r"
#: Command kinds in the order in which they are tried, with what tells them.
KINDS = {
    "git_diff": r"(?m)^diff --git ",
    "git_status": r"(?m)^(?:On branch |Changes (?:not staged|to be committed))",
    "test": r"(?m)^(?:=+ (?:FAILURES|test session starts|short test summary)|FAILED |PASS |FAIL )",
    "install": r"(?m)^(?:added \d+ packages|Collecting |Requirement already satisfied|Successfully installed|npm (?:WARN|ERR))",
    "lint": r"(?m)^\S+:\d+:\d+: [A-Z]+\d+ ",
    "docker": r"(?m)^(?:CONTAINER ID|REPOSITORY)\s+",
    "json": r"^\s*[\[{]",
    "tree": r"(?m)^(?:[│ ]*[├└]── )",
    "log": r"(?m)^\[?\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}",
    "progress": r"(?m)(?:\d{1,3}%|[⠋⠙⠹⠸⠼⠴⠦⠧⠇⠏])",
}
NOISE = r"^\s*(?:\d{1,3}%.*|[⠋⠙⠹⠸⠼⠴⠦⠧⠇⠏|/\\-]\s*|\.{3,}|[=>#\s\[\]-]+\d{1,3}%.*)$"
STAMP = r"^\[?\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?\]?$"
MASK = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def command_kind(text: Column) -> Column:
    out = F.lit("generic")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(text.rlike(pattern), kind).otherwise(out)
    return out


def lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))


def line_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", masked: bool = False) -> DataFrame:
    """(id, start, line, n): runs of equal lines (equal but for times and ids, if masked) in order."""
    rows = lines(docs, id_col, text)
    w = W.partitionBy("id").orderBy("pos")
    key = F.regexp_replace("line", MASK, "<>") if masked else F.col("line")
    rows = rows.withColumn("key", key).withColumn("new", (F.coalesce(F.lag("key").over(w) != F.col("key"), F.lit(True))).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(w))
    return rows.groupBy("id", "run").agg(F.min("pos").alias("start"), F.min_by("line", "pos").alias("line"), F.count("*").alias("n")).select("id", "start", "line", "n")


def _starts(flags: Column) -> Column:
    """The places at which an array's value differs from the one before, the first among them."""
    return F.filter(F.sequence(F.lit(0), F.size(flags) - 1), lambda i: (i == 0) | (F.get(flags, i) != F.get(flags, i - 1)))


def runs_collapsed(text: Column) -> Column:
    """A text with each run of equal lines as one line and its count."""

    def joined(ls: Column) -> Column:
        def shown(at: Column) -> Column:
            n = lambda i: F.coalesce(F.get(at, i + 1), F.size(ls)) - F.get(at, i)
            line = lambda s, i: F.when(n(i) > 1, F.concat(F.get(ls, s), F.format_string(" (repeated %d times)", n(i)))).otherwise(F.get(ls, s))
            return F.when(F.size(at) == F.size(ls), text).otherwise(F.array_join(F.transform(at, line), "\n"))

        return tx.let(_starts(ls), shown)

    return tx.let(F.split(text, "\n"), joined)


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text) with each run of equal lines as one line and its count; ids are taken to be unique."""
    return docs.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), runs_collapsed(F.col(text)).alias("text"))


def _kept(text: Column, keep) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), keep), "\n")


def strip_progress(text: Column) -> Column:
    return _kept(text, lambda x: ~x.rlike(NOISE) | (F.trim(x) == ""))


def drop_stamps(text: Column) -> Column:
    return _kept(text, lambda x: ~F.trim(x).rlike(STAMP))


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"(?:[ \t]*\n){4,}", "\n\n")


def install_summary(text: Column) -> Column:
    return _kept(text, lambda x: x.rlike(r"(?i)\b(?:added|removed|changed|audited|installed|vulnerabilit|warn|error|fail)"))


#: A line of a stack trace.
FRAME = r"^\s+(?:at |File \")"


def frames_elided(text: Column, most: int = 8, head: int = 5, tail: int = 2) -> Column:
    """A text whose blocks of more than ``most`` stack frames keep their first and last."""

    def joined(ls: Column) -> Column:
        def blocks(v: Column) -> Column:
            at, flags = v["at"], v["flags"]

            def block(s: Column, i: Column) -> Column:
                end = F.coalesce(F.get(at, i + 1), F.size(ls))
                n = end - s
                few = F.concat(F.slice(ls, s + 1, F.lit(head)), F.array(F.format_string("    ... %d frames elided", n - head - tail)), F.slice(ls, end - tail + 1, F.lit(tail)))
                return F.when(F.get(flags, s) & (n > max(most, head + tail)), few).otherwise(F.slice(ls, s + 1, n))

            return F.array_join(F.flatten(F.transform(at, block)), "\n")

        flags = F.transform(ls, lambda x: x.rlike(FRAME))
        return tx.let(tx.let(flags, lambda f: F.struct(_starts(f).alias("at"), f.alias("flags"))), blocks)

    # most texts hold no frame: they stay as they are
    return F.when(text.rlike("(?m)" + FRAME), tx.let(F.split(text, "\n"), joined)).otherwise(text)


def elide_frames(docs: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = 8, head: int = 5, tail: int = 2) -> DataFrame:
    """(id, text): blocks of more than ``most`` stack frames keep their first and last; ids are taken to be unique."""
    return docs.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), frames_elided(F.col(text), most, head, tail).alias("text"))


def diff_stats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shown: int = 3) -> DataFrame:
    """(id, file, added, removed, changes): changed lines a file of a unified diff, with the first few."""
    rows = lines(docs, id_col, text).withColumn("file", F.nullif(F.regexp_extract("line", r"^diff --git a/.* b/(.*)$", 1), F.lit("")))
    w = W.partitionBy("id").orderBy("pos")
    rows = rows.withColumn("file", F.last("file", ignorenulls=True).over(w)).filter("file IS NOT NULL")
    plus = F.col("line").startswith("+") & ~F.col("line").startswith("+++")
    minus = F.col("line").startswith("-") & ~F.col("line").startswith("---")
    firsts = F.slice(F.array_sort(F.collect_list(F.when(plus | minus, F.struct("pos", "line")))), F.lit(1), F.lit(shown))
    return rows.groupBy("id", "file").agg(F.count(F.when(plus, 1)).alias("added"), F.count(F.when(minus, 1)).alias("removed"), F.transform(firsts, lambda x: x["line"]).alias("changes"))


def status_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, state, files) of a status listing."""
    rows = lines(docs, id_col, text).select("id", F.regexp_extract("line", r"^\s+(modified|new file|deleted|renamed):\s+(.*)$", 1).alias("state"), F.trim(F.regexp_extract("line", r"^\s+(modified|new file|deleted|renamed):\s+(.*)$", 2)).alias("file"))
    return rows.filter("state <> ''").groupBy("id", "state").agg(F.array_sort(F.collect_set("file")).alias("files"))


def lint_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, rule, n, files, first_message) of lint lines path:line:column: RULE message."""
    p = r"^(\S+?):(\d+):(\d+): ([A-Z]+\d+) (.*)$"
    rows = lines(docs, id_col, text).filter(F.col("line").rlike(p)).select("id", "pos", F.regexp_extract("line", p, 4).alias("rule"), F.regexp_extract("line", p, 1).alias("file"), F.regexp_extract("line", p, 5).alias("message"))
    return rows.groupBy("id", "rule").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"), F.min_by("message", "pos").alias("first_message"))


def test_failures(docs: DataFrame, id_col: str = "doc_id", text: str = "text", blocks: int = 5, asserts: int = 5) -> DataFrame:
    """(id, block, title, assertions): the first failure blocks of a test run with their assertion lines."""
    rows = lines(docs, id_col, text).withColumn("title", F.nullif(F.regexp_extract("line", r"^_{3,} (.*?) _{3,}$", 1), F.lit("")))
    w = W.partitionBy("id").orderBy("pos")
    rows = rows.withColumns({"block": F.count("title").over(w), "title": F.last("title", ignorenulls=True).over(w)}).filter(F.col("block").between(1, blocks))
    hits = F.slice(F.array_sort(F.collect_list(F.when(F.col("line").rlike(r"^E\s|AssertionError|assert "), F.struct("pos", "line")))), F.lit(1), F.lit(asserts))
    return rows.groupBy("id", "block").agg(F.first("title").alias("title"), F.transform(hits, lambda x: x["line"]).alias("assertions"))


def table_columns(docs: DataFrame, wanted: list[str], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, pos, values) of tables whose columns are set apart by two spaces or more, only the wanted columns."""
    rows = lines(docs, id_col, text).withColumn("cells", F.split(F.trim("line"), r"\s{2,}"))
    head = rows.filter("pos = 0").select("id", F.col("cells").alias("names"))
    both = rows.filter("pos > 0 AND trim(line) <> ''").join(head, "id")
    return both.select("id", "pos", F.transform(F.array(*[F.lit(x) for x in wanted]), lambda n: F.get(F.col("cells"), F.array_position("names", n).cast("int") - 1)).alias("values"))


def tree_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, directory, n, names) of a listing of paths."""
    rows = lines(docs, id_col, text).filter("trim(line) <> ''").select("id", F.trim("line").alias("path"))
    rows = rows.withColumns({"directory": F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).otherwise("."), "name": F.regexp_extract("path", r"([^/]*)$", 1)})
    return rows.groupBy("id", "directory").agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_list("name")), F.lit(1), F.lit(10)), ", ").alias("names"))


def generic(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The conservative pipeline: escape codes, progress, stamps, blank runs, equal runs, frames."""
    return docs.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), filtered(F.col(text)).alias("text"))


def filtered(text: Column) -> Column:
    """What ``generic`` makes of a text, without exchanges."""
    body = collapse_blanks(drop_stamps(strip_progress(strip_ansi(text))))
    return tx.let(tx.let(body, runs_collapsed), lambda t: frames_elided(t))


def json_outline(value: Column) -> Column:
    """The type of a JSON text's top levels."""
    return F.when(F.try_parse_json(value).isNotNull(), F.schema_of_variant(F.try_parse_json(value)))


def apply_rule(text: Column, rule: dict) -> Column:
    """One declarative rule: strip codes, replace, match-and-answer, keep or drop lines, cut lines, head and tail, limit, answer if empty."""
    out = strip_ansi(text) if rule.get("strip_ansi") else text
    for pattern, by in rule.get("replace", []):
        out = F.regexp_replace(out, pattern, by)
    if "short_circuit" in rule:
        pattern, answer = rule["short_circuit"]
        hit = out.rlike(pattern)
    ls = F.split(out, "\n")
    if rule.get("drop_lines"):
        ls = F.filter(ls, lambda x: ~x.rlike("|".join(f"(?:{p})" for p in rule["drop_lines"])))
    if rule.get("keep_lines"):
        ls = F.filter(ls, lambda x: x.rlike("|".join(f"(?:{p})" for p in rule["keep_lines"])))
    if rule.get("line_length"):
        ls = F.transform(ls, lambda x: F.substring(x, 1, rule["line_length"]))
    head, tail = rule.get("head"), rule.get("tail")
    if head and tail:
        gap = F.size(ls) - head - tail
        ls = F.when(gap > 0, F.concat(F.slice(ls, F.lit(1), F.lit(head)), F.array(F.format_string("... (%d lines omitted)", gap)), F.slice(ls, F.greatest(F.size(ls) - tail + 1, F.lit(1)), F.lit(tail)))).otherwise(ls)
    elif head:
        ls = F.slice(ls, F.lit(1), F.lit(head))
    elif tail:
        ls = F.slice(ls, F.greatest(F.size(ls) - tail + 1, F.lit(1)), F.lit(tail))
    if rule.get("max_lines"):
        ls = F.slice(ls, F.lit(1), F.lit(rule["max_lines"]))
    done = F.array_join(ls, "\n")
    if rule.get("on_empty"):
        done = F.when(F.trim(done) == "", F.lit(rule["on_empty"])).otherwise(done)
    return F.when(hit, F.lit(answer)).otherwise(done) if "short_circuit" in rule else done


def apply_rules(docs: DataFrame, rules: list[dict], kind: str = "kind", text: str = "text") -> DataFrame:
    """The first rule whose ``match`` a row's kind fits."""
    out = F.col(text)
    for rule in reversed(rules):
        out = F.when(F.col(kind).rlike(rule["match"]), apply_rule(F.col(text), rule)).otherwise(out)
    return docs.withColumn(text, out)


def intercepted(docs: DataFrame, id_col: str = "doc_id", text: str = "text", ratio: float = 0.7, least: int = 200) -> DataFrame:
    """(id, text): long outputs filtered, refined sentence by sentence, and guarded so that no identifier is lost."""
    shorter = lambda t: F.array_join(F.transform(tx.sentences(t), lambda s: tx.refined(s, ratio)), " ")
    out = F.when(F.length(text) >= least, tx.guarded(F.col(text), tx.let(filtered(F.col(text)), shorter))).otherwise(F.col(text))
    return docs.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), out.alias("text"))
