"""Globs, ignore rules and the fixed path predicates, as Java regular expressions for rlike."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What makes a path a test, and what frameworks load by convention.
TEST_PATHS = (r"(?i)\.(test|spec)\.[cm]?[jt]sx?$", r"(?i)(^|[\\/])__tests__[\\/]", r"(?i)(^|[\\/])tests?[\\/]")
FRAMEWORK_PATHS = (
    r"(?i)(^|[\\/])pages[\\/]",
    r"(?i)(^|[\\/])app[\\/].*[\\/]?(page|layout|route|loading|error|template|not-found)\.[cm]?[jt]sx?$",
    r"(?i)(^|[\\/])middleware\.[cm]?[jt]s$",
    r"(?i)(^|[\\/])next\.config\.[cm]?[jt]s$",
    r"(?i)(^|[\\/])vite\.config\.[cm]?[jt]s$",
    r"(?i)(^|[\\/])tailwind\.config\.[cm]?[jt]s$",
)


def any_of(path: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, (path.rlike(p) for p in patterns), F.lit(False))


def is_test(path: Column) -> Column:
    return any_of(path, TEST_PATHS)


def is_framework(path: Column) -> Column:
    return any_of(path, FRAMEWORK_PATHS)


_TOKEN = re.compile(r"\*\*/|\*\*|\*|\?|\{|\}|,|[^*?{},]+")


def glob_regex(glob: str) -> str:
    """An anchored, case-sensitive expression: **/ is any folders, ** anything, * and ? stay in one
    segment, {a,b} is a choice. An empty glob or braces that do not match are errors."""
    glob = glob.replace("\\", "/").strip()
    if not glob:
        raise ValueError("an empty glob")
    depth, out = 0, []
    for token in _TOKEN.findall(glob):
        if token == "{":
            depth += 1
            out.append("(?:")
        elif token == "}":
            depth -= 1
            out.append(")")
        elif token == "," and depth:
            out.append("|")
        else:
            out.append({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(token) or re.sub(r"([\\.^$|()\[\]+])", r"\\\1", token))
        if depth < 0:
            raise ValueError(f"unbalanced braces: {glob}")
    if depth:
        raise ValueError(f"unbalanced braces: {glob}")
    return f"^{''.join(out)}$"


def ignore_rules(text: str, base: str = "") -> list[tuple[int, bool, str]]:
    """(line, negated, expression) of the rules of an ignore file in the folder base.

    A pattern with a slash before its end is anchored at the folder, another matches at any depth;
    a trailing slash asks for a folder, that is for something below. The last rule that matches a
    path decides.
    """
    out = []
    for n, line in enumerate(text.splitlines(), 1):
        rule = line.rstrip()
        if not rule or rule.startswith("#"):
            continue
        negated = rule.startswith("!")
        rule = rule[1:] if negated else rule.removeprefix("\\")
        folder, rule = rule.endswith("/"), rule.strip("/") if "/" in rule.rstrip("/") else rule.rstrip("/")
        anchored = "/" in line.lstrip("!").rstrip("/")
        body = glob_regex(rule)[1:-1]
        start = re.sub(r"([\\.^$|()\[\]+*?{}])", r"\\\1", base + "/") if base else ""
        out.append((n, negated, f"^{start}{'' if anchored else '(?:.*/)?'}{body}{'/.*' if folder else '(?:/.*)?'}$"))
    return out


def ignored(path: Column, rules: list[tuple[int, bool, str]]) -> Column:
    """Whether the last rule that matches a path is not a negation; rules come in their order."""
    out = F.lit(False)
    for _, negated, expression in rules:
        out = F.when(path.rlike(expression), not negated).otherwise(out)
    return out
