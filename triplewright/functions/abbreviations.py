"""Abbreviations that a text defines in brackets, and their expansion, in an Arrow function."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BRACKET = re.compile(r"\(([^()]{2,10})\)")


def definition(short: str, before: str) -> str | None:
    """The shortest run of words at the end of before whose letters, read from the right, spell short; its first letter starts a word."""
    at = len(before) - 1
    for k in range(len(short) - 1, -1, -1):
        letter = short[k].lower()
        if not letter.isalnum():
            continue
        while at >= 0 and (before[at].lower() != letter or (k == 0 and at > 0 and before[at - 1].isalnum())):
            at -= 1
        if at < 0:
            return None
        at -= 1
    start = before.rfind(" ", 0, at + 2) + 1
    long = before[start:].strip()
    n = sum(c.isalnum() for c in short)
    return long if len(long) > len(short) and len(long.split()) <= min(n + 5, 2 * n) and short not in long.split() else None


def pairs(lines: list[str]) -> dict[str, str]:
    """Abbreviations of a document and their definitions, the last definition of each."""
    found: dict[str, str] = {}
    for line in lines:
        for m in BRACKET.finditer(line):
            short = m.group(1).strip()
            if short[:1].isalnum() and any(c.isalpha() for c in short) and len(short.split()) <= 2:
                long = definition(short, line[: m.start()].rstrip())
                if long:
                    found[short] = long
    return found


def expand(line: str, known: dict[str, str]) -> str:
    """line with each abbreviation that no letter touches replaced; of overlapping or adjacent places the first counts."""
    places = []
    for short, long in {**{k.lower(): v for k, v in known.items()}, **known}.items():
        for m in re.finditer(re.escape(short), line):
            a, b = m.span()
            if not (a and line[a - 1].isalpha()) and not (b < len(line) and line[b].isalpha()):
                places.append((a, b, long))
    kept, end = [], -1
    for a, b, long in sorted(places, key=lambda p: p[:2]):
        if a > end:
            kept.append((a, b, long))
            end = b
    for a, b, long in reversed(kept):
        line = line[:a] + long + line[b:]
    return line


def expanded(lines: Column) -> Column:
    """The lines of a document with its own abbreviations expanded; null stays null."""

    @F.pandas_udf("array<string>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else [expand(line, known) for known in [pairs(list(x))] for line in x])

    return run(lines)


def abbreviations(lines: Column) -> Column:
    """The abbreviations of a document as (abbreviation, definition), in alphabetical order."""

    @F.pandas_udf("array<struct<abbreviation: string, definition: string>>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else [{"abbreviation": a, "definition": d} for a, d in sorted(pairs(list(x)).items())])

    return run(lines)
