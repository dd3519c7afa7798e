"""Column functions on paper texts and file names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: citations in brackets: a year or number with letters, digits and marks beside it, or a number alone.
CITATION = r"""\[\d{4}[a-zA-Z0-9 .,!/\-"']*\]|\[\d+\]|\[[a-zA-Z0-9 .,!/\-"']*\d{4}\]|\([a-zA-Z0-9 .,!/\-"']*\d{4}\)|\(\d{4}[a-zA-Z0-9 .,!/\-"']*\)|\(\d+\)"""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, wherever the optimiser copies the expression."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def tokens(text: Column) -> Column:
    """Words between Unicode white space; none for an empty text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def find(text: Column, needle: str) -> Column:
    """Position of the first occurrence from 0, or -1."""
    return F.locate(needle, text) - 1


def rfind(text: Column, needle: str) -> Column:
    """Position of the last occurrence from 0, or -1."""
    back = F.locate(needle[::-1], F.reverse(text))
    return F.when(back == 0, F.lit(-1)).otherwise(F.length(text) - back - len(needle) + 1)


def abstract(text: Column, average: int = 1250, ignore_case: bool = True) -> Column:
    """The part of a text that its abstract and introduction headings mark."""
    searched = F.lower(text) if ignore_case else text
    a, i = find(searched, "abstract"), find(searched, "introduction")
    both, ordered = (a >= 0) & (i >= 0), a < i
    start = F.when(both, F.least(a, i)).otherwise(F.when((a < 0) & (i < 0), F.lit(100)).otherwise(F.greatest(a, i)))
    size = F.when(both & ordered, F.greatest(i - a, F.lit(average))).otherwise(F.lit(average))
    return F.substring(text, start + 1, size)


def body(text: Column) -> Column:
    """A text from its abstract or introduction to its references or, in its second half, acknowledgements."""
    lower = F.lower(text)
    a, i = find(lower, "abstract"), find(lower, "introduction")
    start = F.when((a >= 0) & (i >= 0), F.least(a, i)).otherwise(F.greatest(a, i))
    start = F.when(start < 0, F.lit(100)).otherwise(start)
    reference, thanks = rfind(lower, "reference"), rfind(lower, "acknowledgement")
    end = F.when((thanks >= 0) & (thanks < reference) & (thanks > F.length(text) / 2), thanks).otherwise(reference)
    end = F.when(end < 0, F.length(text)).otherwise(end)
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def mend_line_breaks(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)(\w)-\s+(\w)", "$1$2")


def strip_citations(line: Column) -> Column:
    return F.regexp_replace(line, CITATION, "")


def sentences(text: Column) -> Column:
    """Sentences of a text without line ends, split after . ! ? and white space; a tokenizer of one's own can replace it."""
    return F.filter(F.split(F.regexp_replace(text, "\n", " "), r"(?<=[.!?])\s+"), lambda s: s != "")


def joined_et_al(sentences: Column) -> Column:
    """Sentences, each of which that ends with 'et al.' is joined with the next; each is read once, through the places where runs begin."""
    none = F.array().cast("array<string>")
    goes_on = lambda s, i: F.coalesce(F.endswith(F.get(s, i - 2), F.lit("et al.")), F.lit(False))
    begins = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | ~goes_on(s, F.greatest(i, F.lit(2))))
    run = lambda s, at: F.transform(at, lambda i, k: F.array_join(F.slice(s, i, F.coalesce(F.get(at, k + 1), F.size(s) + 1) - i), " "))
    return F.when(F.size(sentences) > 0, let(sentences, lambda s: let(begins(s), lambda at: run(s, at)))).otherwise(F.when(sentences.isNotNull(), none))


def chunks(lines: Column, size: int) -> Column:
    """Texts of size consecutive lines, joined by a space."""
    starts = F.when(F.size(lines) > 0, F.sequence(F.lit(1), F.size(lines), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(lines, i, size), " "))


def contains_any(text: Column, terms: list[str], ignore_case: bool = True) -> Column:
    """Whether a text holds one of the terms; false without terms."""
    if not terms:
        return F.lit(False)
    searched = F.lower(text) if ignore_case else text
    return F.coalesce(F.greatest(F.lit(False), *(F.contains(searched, F.lit(t.lower() if ignore_case else t)) for t in terms)), F.lit(False))


def base_id(name: Column) -> Column:
    """Identity of <base>v<version>.<suffix>, or the name without suffix."""
    return F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z]+$", ""), r"v\d+$", "")


def version(name: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(name, r"v(\d+)\.[A-Za-z]+$", 1), F.lit("")), F.lit("999999999")).cast("int")


def period(path: Column) -> Column:
    """YYMM of a folder name in a path."""
    return F.regexp_extract(path, r"/(\d{4})/", 1)


def change_mask(old: Column, starts: Column, ends: Column) -> Column:
    """A marker line for a change log: * where a range of the old line was changed, - elsewhere."""
    size = F.length(old)
    stars = lambda z: F.greatest(F.least(z["b"], size) - z["a"], F.lit(0))
    marked = lambda line, z: F.when(stars(z) > 0, F.overlay(line, F.repeat(F.lit("*"), stars(z)), z["a"] + 1)).otherwise(line)
    return F.aggregate(F.arrays_zip(starts.alias("a"), ends.alias("b")), F.repeat(F.lit("-"), size), marked)


def change_log(old: Column, new: Column, line: Column, starts: Column, ends: Column, kind: str) -> Column:
    """An entry of a change log: the old line, its mask, where and why it changed, and the new line."""
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    where = F.concat(F.lit("Line: "), line.cast("string"), F.lit(", start: "), listed(starts), F.lit(", end: "), listed(ends), F.lit(f", type: {kind}"))
    return F.concat(F.concat_ws("\n", old, change_mask(old, starts, ends), where, new), F.lit("\n\n\n"))


def name_of(first: Column, last: Column) -> Column:
    part = lambda c: F.nullif(F.nullif(c, F.lit("unknown")), F.lit(""))
    return F.trim(F.concat_ws(" ", part(first), part(last)))


def organisation(name: Column, city: Column, country: Column) -> Column:
    part = lambda c: F.nullif(F.nullif(c, F.lit("unknown")), F.lit(""))
    return F.trim(F.concat_ws(", ", part(name), part(city), part(country)))
