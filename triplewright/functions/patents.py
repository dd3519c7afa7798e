"""Column functions on patent records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any

# Fixed value: a classification code such as G06F 17/30.
CODE = r"^([A-Z])([0-9]{2})([A-Z])\s?([0-9]{1,4})\s?/\s?([0-9]{2,6})"


def codes(section: Column, klass: Column, subclass: Column, group: Column, subgroup: Column) -> Column:
    """(section, section_class, section_class_subclass, section_class_subclass_group) of the parts of a code."""
    whole = F.concat(section, klass, subclass)
    return F.struct(section.alias("section"), F.concat(section, klass).alias("section_class"), whole.alias("section_class_subclass"), F.concat(whole, F.lit(" "), group, F.lit("/"), subgroup).alias("section_class_subclass_group"))


def parsed_code(code: Column) -> Column:
    """codes() of a classification string, null where it has another form."""
    part = [F.regexp_extract(code, CODE, k) for k in range(1, 6)]
    return F.when(F.rlike(code, F.lit(CODE)), codes(*part))


def full_text(title: Column, abstract: Column, claims: Column, descriptions: Column | None = None) -> Column:
    head = F.concat(title, F.lit(" "), F.array_join(abstract, " "), F.lit(" "), F.array_join(claims, " "))
    return head if descriptions is None else F.concat(head, F.lit(" "), F.array_join(descriptions, "\n"))


def has_keyword(title: Column, abstract: Column, claims: Column, keywords: list[str]) -> Column:
    """Whether title, abstract or claims hold a keyword; without keywords every patent does, a null text none."""
    return contains_any(full_text(title, abstract, claims), keywords) if keywords else F.lit(True)


def cited_numbers(references: Column, field: str = "publication_number") -> Column:
    return F.transform(references, lambda r: r[field])
