"""Shell globs as Column predicates.

One case-sensitive dialect is used wherever globs appear: ``*`` (any run,
``/`` and ``.`` included), ``?`` (one character), ``[abc]`` / ``[!a-c]``,
``{x,y}`` alternatives and ``\\`` to quote the next character.  The log's scan
once had a dialect of its own in which ``_`` could not be matched and letter
case was ignored; here every read behaves alike.

Exact and prefix patterns become ``=`` and ``startswith`` so that they reach
the Parquet scan; the rest become one anchored regular expression.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_META = set("*?[]{}\\")


def _class_at(pattern: str, start: int) -> tuple[str, int]:
    """Regex for the character class opening at ``start``; index after it."""
    i = start + 1
    negated = i < len(pattern) and pattern[i] in "!^"
    if negated:
        i += 1
    first = i
    while i < len(pattern) and (pattern[i] != "]" or i == first):
        i += 1
    if i >= len(pattern):
        raise ValueError(f"glob {pattern!r}: unclosed character class")
    body = re.sub(r"([\\\[\]^&~])", r"\\\1", pattern[first:i])
    return f"[{'^' if negated else ''}{body}]", i + 1


def glob_regex(pattern: str) -> str:
    """Anchored regular expression equal to the glob."""
    out: list[str] = []
    depth = 0
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            if not out or out[-1] != ".*":
                out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            piece, i = _class_at(pattern, i)
            out.append(piece)
            continue
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}":
            if depth == 0:
                raise ValueError(f"glob {pattern!r}: unopened alternatives")
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\":
            i += 1
            if i >= len(pattern):
                raise ValueError(f"glob {pattern!r}: dangling escape")
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"glob {pattern!r}: unclosed alternatives")
    return "(?s)^(?:" + "".join(out) + r")\z"


def glob_match(col: Column, pattern: str) -> Column:
    if not _META & set(pattern):
        return col == F.lit(pattern)
    stem = pattern[:-1]
    if pattern.endswith("*") and not _META & set(stem):
        return col.isNotNull() if not stem else col.startswith(stem)
    return col.rlike(glob_regex(pattern))


PATTERN_SET = "exact array<string>, prefixes array<string>, regex string"


def pattern_set(patterns: Sequence[str]) -> dict:
    """Patterns as one value of a configuration table, of type `PATTERN_SET`."""
    exact, prefixes, rest = [], [], []
    for pattern in patterns:
        stem = pattern[:-1]
        if not _META & set(pattern):
            exact.append(pattern)
        elif pattern.endswith("*") and not _META & set(stem):
            prefixes.append(stem)
        else:
            rest.append(glob_regex(pattern).removeprefix("(?s)^").removesuffix(r"\z"))
    regex = f"(?s)^(?:{'|'.join(rest)})\\z" if rest else None
    return {"exact": exact, "prefixes": prefixes, "regex": regex}


def in_pattern_set(col: Column, patterns: Column) -> Column:
    """`any_glob` for patterns that come with the row; the regular expression is the last resort."""
    return (
        F.array_contains(patterns["exact"], col)
        | F.exists(patterns["prefixes"], lambda p: F.startswith(col, p))
        | F.when(patterns["regex"].isNotNull(), F.rlike(col, patterns["regex"])).otherwise(F.lit(False))
    )


def any_glob(col: Column, patterns: Sequence[str]) -> Column:
    """True where a pattern matches; no patterns match nothing (scopes)."""
    if not patterns:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [glob_match(col, p) for p in patterns])


def glob_filter(col: Column, patterns: Sequence[str] | None) -> Column:
    """Read-side rule: missing or empty pattern lists do not restrict."""
    return any_glob(col, patterns) if patterns else F.lit(True)


def time_between(col: Column, start_ms: int | None, end_ms: int | None) -> Column:
    """Half-open ``[start, end)``; either bound may be missing."""
    cond = F.lit(True)
    if start_ms is not None:
        cond = col >= F.lit(start_ms)
    if end_ms is not None:
        upper = col < F.lit(end_ms)
        cond = upper if start_ms is None else cond & upper
    return cond
