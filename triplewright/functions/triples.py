"""Column functions on model answers and triples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A triple in an answer, and its three parts (greedy).
FOUND = r"\(.+?;.+?;.+?\)"
PARTS = r"\((.+);(.+);(.+)\)"
FIELDS = ("subject", "predicate", "object")


def parse(answer: Column) -> Column:
    """Array of (subject, predicate, object) in an answer, line by line; spaces inside the parts stay."""
    lines = F.transform(F.split(answer, r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    found = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(FOUND), F.lit(0))))
    return F.transform(found, lambda m: F.struct(*(F.regexp_extract(m, PARTS, k + 1).alias(f) for k, f in enumerate(FIELDS))))


def plain(part: Column) -> Column:
    """Lower-case letters, digits, hyphens and spaces of a part."""
    return F.regexp_replace(F.lower(part), "[^a-zA-Z0-9 -]", "")


# The ends of a word between Unicode white space.
BEGIN, END = r"(?U)(?<!\S)", r"(?!\S)"


def squeezed(part: Column) -> Column:
    """Words with one space between them."""
    return F.regexp_replace(F.regexp_replace(part, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def _dropped(part: Column, pattern: str) -> Column:
    return squeezed(F.regexp_replace(part, BEGIN + pattern + END, ""))


def _any_of(words: list[str]) -> str:
    return "(?:" + "|".join("\\Q" + w + "\\E" for w in words) + ")"


def without(part: Column, words: list[str]) -> Column:
    return _dropped(part, _any_of(words)) if words else squeezed(part)


def lean_predicate(predicate: Column, fillers: list[str], trim: bool = False) -> Column:
    """A predicate of several words without filler verbs and words of one character; a single word stays as it is."""
    several = _dropped(predicate, "(?:" + "|".join([*([_any_of(fillers)] if fillers else []), r"\S"]) + ")")
    return F.when(F.rlike(predicate, F.lit(r"(?U)\S\s+\S")), several).otherwise(F.trim(predicate) if trim else predicate)


def long_words(part: Column, least: int) -> Column:
    """The words of more than least characters."""
    return _dropped(part, rf"\S{{1,{least}}}") if least > 0 else squeezed(part)


def no_repeats(part: Column) -> Column:
    """Words that differ from the one before."""
    return F.regexp_replace(squeezed(part), BEGIN + r"(\S+)(?: \1)+" + END, "$1")


def short(part: Column, most: int) -> Column:
    return F.regexp_count(part, F.lit(r"(?U)\S+")) <= most
