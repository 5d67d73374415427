"""Filter rules of users: a file of rules with their own tests, compiled to one column expression."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed value: what colours and titles of a terminal look like.
ANSI = r"\x1b\[[0-9;]*[a-zA-Z]|\x1b\].*?\x07|\r"
#: Where a text has line ends, as Python's ``splitlines`` has them.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


@dataclass
class Rule:
    """What to do with the output of commands that ``match_command`` finds; stages that aren't set change nothing."""

    name: str
    description: str = ""
    match_command: str = ""
    strip_ansi: bool = False
    strip_lines_matching: list[str] = field(default_factory=list)
    keep_lines_matching: list[str] = field(default_factory=list)
    truncate_lines_at: int = 0
    head_lines: int = 0
    tail_lines: int = 0
    max_lines: int = 0
    on_empty: str = ""

    def matches(self, command: Column) -> Column:
        """Whether the rule is for a command, whatever the case; a pattern that is none is looked for as it stands."""
        if not self.match_command:
            return F.lit(False)
        if _is_pattern(self.match_command):
            return command.rlike(f"(?i){self.match_command}")
        return F.contains(F.lower(command), F.lit(self.match_command.lower()))

    def applied(self, text: Column) -> Column:
        """``text`` through the stages in order: colours, lines out, lines kept, width, head, tail, middle, and what to say of nothing."""
        ls = F.split(text, LINE_ENDS)
        ls = F.when(F.element_at(ls, -1) == "", F.slice(ls, F.lit(1), F.size(ls) - 1)).otherwise(ls)
        if self.strip_ansi:
            ls = F.transform(ls, lambda x: F.regexp_replace(x, ANSI, ""))
        for patterns, keep in ((self.strip_lines_matching, False), (self.keep_lines_matching, True)):
            if patterns and all(map(_is_pattern, patterns)):  # a stage with a wrong pattern is left out
                any_of = "|".join(f"(?:{p})" for p in patterns)
                ls = F.filter(ls, _line_test(any_of, keep))
        if self.truncate_lines_at > 0:
            ls = F.transform(ls, lambda x: F.substring(x, 1, self.truncate_lines_at))
        if self.head_lines > 0:
            ls = F.slice(ls, F.lit(1), F.lit(self.head_lines))
        if self.tail_lines > 0:
            ls = F.slice(ls, F.greatest(F.size(ls) - self.tail_lines + 1, F.lit(1)), F.lit(self.tail_lines))
        if self.max_lines > 0:
            ls = _middle_out(ls, self.max_lines)
        done = F.array_join(ls, "\n")
        return F.when(F.trim(F.regexp_replace(done, r"\s+", " ")) == "", self.on_empty).otherwise(done) if self.on_empty else done


def _line_test(pattern: str, keep: bool):
    return lambda x: x.rlike(pattern) if keep else ~x.rlike(pattern)


def _middle_out(ls: Column, most: int) -> Column:
    half, n = most // 2, F.size(ls)
    gap = F.array(F.format_string("... (%d lines omitted) ...", n - 2 * half))
    if not half:
        return F.when(n > most, gap).otherwise(ls)
    return F.when(n > most, F.concat(F.slice(ls, F.lit(1), F.lit(half)), gap, F.slice(ls, F.greatest(n - half + 1, F.lit(1)), F.lit(half)))).otherwise(ls)


def _is_pattern(p: str) -> bool:
    try:
        re.compile(p)
    except re.error:
        return False
    return True


@dataclass
class RuleSet:
    """Rules by order, and their tests (rule, name, input, expected)."""

    rules: list[Rule]
    tests: list[tuple[str, str, str, str]]

    @classmethod
    def parse(cls, toml: str) -> RuleSet:
        """The sections ``filters.NAME`` and ``tests.NAME`` of a file; one that isn't TOML has no rules, unknown keys are ignored."""
        import tomllib

        try:
            data = tomllib.loads(toml)
        except tomllib.TOMLDecodeError:
            return cls([], [])
        known = {f.name for f in fields(Rule)} - {"name"}
        rules = [Rule(name, **{k: v for k, v in cfg.items() if k in known}) for name, cfg in data.get("filters", {}).items() if isinstance(cfg, dict)]
        cases = [(rule, t) for rule, found in data.get("tests", {}).items() if isinstance(found, list) for t in found if isinstance(t, dict)]
        return cls(rules, [(rule, t.get("name", "unnamed"), t.get("input", ""), t.get("expected", "")) for rule, t in cases])

    def __add__(self, other: RuleSet) -> RuleSet:
        """These rules first, as a project's come before its user's."""
        return RuleSet([*self.rules, *other.rules], [*self.tests, *other.tests])

    def applied(self, docs: DataFrame, command: str = "command", text: str = "text") -> DataFrame:
        """``docs`` with ``rule``, the first that matches, and ``filtered``, the text through it; null where none does."""
        name, out = F.lit(None).cast("string"), F.lit(None).cast("string")
        for rule in reversed(self.rules):
            hit = F.coalesce(rule.matches(F.col(command)), F.lit(False))
            name, out = F.when(hit, rule.name).otherwise(name), F.when(hit, rule.applied(F.col(text))).otherwise(out)
        return docs.withColumns({"rule": name, "filtered": out})

    def verified(self, spark: SparkSession) -> DataFrame:
        """(rule, name, passed, expected, actual) of each test; one of a rule that there isn't fails."""
        rows = spark.createDataFrame(self.tests, "rule string, name string, input string, expected string")
        actual = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            actual = F.when(F.col("rule") == rule.name, rule.applied(F.col("input"))).otherwise(actual)
        space = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
        done = rows.withColumn("actual", actual)
        return done.select("rule", "name", F.coalesce(space(F.col("actual")) == space(F.col("expected")), F.lit(False)).alias("passed"), "expected", "actual")
