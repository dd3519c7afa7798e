"""Patent records from XML documents, and their texts and attributes."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..config import PATENT_ATTRIBUTES
from ..functions import patents as P

# Document types of related documents by tag.
RELATED = {t: t for t in ("continuation", "division", "continuation-in-part", "reissue", "substitution")} | {"us-reexamination-reissue-merger": "reissue", "continuing-reissue": "reissue"}
# What a document id holds about a relative, by the tag around it: name in the record, tag, whether it must be there.
RELATIVES = {
    "parent-grant-document": [("reference", "doc-number", True)],
    "parent-pct-document": [("metadata.parent_pct_number", "doc-number", True), ("metadata.parent_pct_country", "country", True), ("metadata.parent_pct_date", "date", False)],
    "parent-doc": [("metadata.application_number", "doc-number", True), ("country", "country", True), ("metadata.application_date", "date", False)],
    "child-doc": [("metadata.child_application_number", "doc-number", True), ("metadata.parent_country", "country", True)],
}
# Related documents without relatives: their type, and what they hold.
SINGLE = {
    "us-provisional-application": ("provisional", [("country", "country", True), ("reference", "doc-number", True), ("metadata.application_date", "date", True)]),
    "related-publication": ("prior", [("reference", "doc-number", True), ("country", "country", True), ("kind", "kind", True), ("metadata.date", "date", True)]),
}
CODE = re.compile(P.CODE)


class _Node:
    """Short access to an element: texts of first and all descendants by tag pattern."""

    def __init__(self, element: ET.Element):
        self.element = element

    def all(self, pattern: str) -> list[_Node]:
        return [_Node(e) for e in self.element.iter() if e is not self.element and re.fullmatch(pattern, str(e.tag))]

    def first(self, pattern: str) -> _Node | None:
        return next(iter(self.all(pattern)), None)

    def text(self) -> str:
        return html.unescape("".join(self.element.itertext()))

    def value(self, pattern: str, needed: bool = False) -> str | None:
        found = self.first(pattern)
        if found is None and needed:
            raise KeyError(f"no {pattern} in {self.element.tag}")
        return None if found is None else found.text()


def _parts(node: _Node, tags: tuple[str, ...], between: str) -> str:
    return between.join(v for t in tags if (v := node.value(t)) and v != "unknown").strip()


def _distinct(values: list[str]) -> list[str]:
    return list(dict.fromkeys(values))


def _related(doc: _Node, blank: dict) -> dict:
    """Record of a related document, as RELATIVES and SINGLE say."""
    tag, out = doc.element.tag, dict(blank, cited_by_examiner=False, metadata={})
    if tag in SINGLE:
        out["document_type"], fields = SINGLE[tag]
        sources = [(doc, fields)]
    elif tag in RELATED:
        out["document_type"] = RELATED[tag]
        sources = [(_Node(e), fields) for around, fields in RELATIVES.items() for relative in doc.all(around) for e in relative.element.findall("document-id")]
    else:
        raise KeyError(f"related document {tag} is not known")
    for node, fields in sources:
        for name, part, needed in fields:
            where = out["metadata"] if name.startswith("metadata.") else out
            where[name.removeprefix("metadata.")] = node.value(part, needed)
    return out


def _cited(ref: _Node, blank: dict) -> dict:
    doc = ref.first("document-id")
    out = dict(blank, cited_by_examiner="examiner" in ref.value("category", True), metadata={})
    if doc is None:
        return out | {"reference": ref.value("othercit", True), "document_type": "other-reference", "country": ref.value("country")}
    return out | {"reference": doc.value("doc-number", True), "document_type": "patent-reference", "country": doc.value("country"), "kind": doc.value("kind"), "metadata": {"name": doc.value("name"), "date": doc.value("date")}}


def _codes(root: _Node) -> list[tuple[str, ...]]:
    """(section, class, subclass, main group, subgroup) of each classification of the patent itself."""
    found = [tuple(e.value(t, True) for t in ("section", "class", "subclass", "main-group", "subgroup")) for own in root.all("classifications-ipcr") for e in own.all("classification-ipcr")]
    if found:
        return found
    for head in root.all("us-bibliographic-data-(grant|application)"):
        parent = {c: p for p in head.element.iter() for c in p}
        for e in head.all(".*(classification-ipcr?|classification-cpc(-text)?).*"):
            if "citation" not in parent[e.element].tag and (m := CODE.match((e.value("main-classification") or e.text()).strip())):
                found.append(m.groups())
    return found


def parse(xml: str) -> dict | None:
    """Record of one document, null for sequence listings and other kinds of documents; errors are raised."""
    if "<sequence-cwu" in xml:
        return None
    root = _Node(ET.fromstring(re.sub(r"<\?xml.*?\?>|<!DOCTYPE[^>\[]*(\[.*?\])?\s*>", "", xml, flags=re.S).strip()))
    if root.element.tag not in ("us-patent-grant", "us-patent-application"):
        return None
    granted = root.element.tag == "us-patent-grant"
    number = root.element.attrib["file"].split("-")[0]
    application = root.first("application-reference")
    if application is None:
        raise KeyError("no application-reference")
    numbers = {"publication_number": number, "patent_office": "uspto", "application_number": application.value("doc-number", True)}
    blank = numbers | dict.fromkeys(("reference", "cited_by_examiner", "document_type", "country", "kind"))
    related = root.first("us-related-documents")
    references = [_related(_Node(e), blank) for e in related.element] if related else []
    cited = root.first(".*-references-cited")
    references += [_cited(r, blank) for r in cited.all(".*-citation")] if cited else []
    claims = root.first("priority-claims")
    for c in claims.all("priority-claim") if claims else []:
        references.append(blank | {"reference": c.value("doc-number", True), "cited_by_examiner": False, "document_type": "other-reference", "country": c.value("country"), "metadata": {"date": c.value("date")}})
    codes = _codes(root)
    books = {role: [a for parties in root.all(".*parties") for group in parties.all(pattern) for a in group.all("addressbook")] for role, pattern in (("authors", "inventors|applicants|.*(inventors|applicants).*"), ("organizations", ".*applicants"))}
    lawyers = [a for parties in root.all(".*parties") for group in parties.all(".*agents") for agent in group.all("agent") if agent.element.get("rep-type") == "attorney" for a in agent.all("addressbook")]
    person = lambda a: _parts(a, ("first-name", "last-name"), " ")
    firm = lambda a: _parts(a, ("orgname", "city", "country"), ", ")
    listed = lambda items, f: [v for a in items if (v := f(a))]
    return numbers | {
        "publication_title": root.value("invention-title", True),
        "publication_date": _Node(root.first("publication-reference").element).value("date", True),
        "grant_date": root.element.get("date-produced") if granted else None,
        "application_type": application.element.attrib["appl-type"],
        "application_date": application.value("date", True),
        "application_status": "granted" if granted else "pending",
        "authors": listed(books["authors"], person),
        "organizations": listed(books["organizations"], firm),
        "attorneys": listed(lawyers, person),
        "attorney_organizations": listed(lawyers, firm),
        "referential_documents": references,
        "sections": _distinct([c[0] for c in codes]),
        "section_classes": _distinct([c[0] + c[1] for c in codes]),
        "section_class_subclasses": _distinct(["".join(c[:3]) for c in codes]),
        "section_class_subclass_groups": _distinct([f"{''.join(c[:3])} {c[3]}/{c[4]}" for c in codes]),
        "abstract": [e.text().strip("\n") for e in root.all("abstract")],
        "descriptions": [e.text().strip("\n") for e in root.all("description")],
        "claims": [e.text().strip("\n") for e in root.all("claim")],
    }


FIELDS = [f.split(":")[0].strip() for f in re.sub(r"<.*?>+", "", schema.PATENT).replace(" string", ":").replace(" array", ":").split(",")]


def parsed(documents: DataFrame, column: str = "xml") -> DataFrame:
    """Records of documents, error (null if none) and skipped. A document that fails gives a row with its error only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, blank = [], dict.fromkeys(FIELDS)
            for xml in b[column]:
                try:
                    record = parse(xml or "")
                    rows.append(blank | (record or {}) | {"error": None, "skipped": record is None})
                except Exception as e:
                    rows.append(blank | {"error": f"{type(e).__name__}: {e}", "skipped": False})
            yield pd.DataFrame(rows, columns=[*FIELDS, "error", "skipped"], dtype=object)

    return documents.select(column).mapInPandas(run, f"{schema.PATENT}, error string, skipped boolean")


def counts(records: DataFrame) -> DataFrame:
    failed = F.col("error").isNotNull()
    return records.agg(F.count_if(~failed & ~F.col("skipped")).alias("n_success"), F.count_if(failed).alias("n_failed"), F.count_if(F.col("skipped")).alias("n_skipped"))


def with_keywords(records: DataFrame, keywords: list[str]) -> DataFrame:
    return records.filter(P.has_keyword(F.col("publication_title"), F.col("abstract"), F.col("claims"), keywords))


def texts(records: DataFrame) -> DataFrame:
    """publication_number, period (YYMM of the publication date) and text."""
    text = P.full_text(F.col("publication_title"), F.col("abstract"), F.col("claims"), F.col("descriptions"))
    return records.select("publication_number", F.substring("publication_date", 3, 4).alias("period"), text.alias("text"))


def attributes(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Chosen attributes; related documents by their numbers."""
    out = records.withColumn("referential_documents", P.cited_numbers(F.col("referential_documents")))
    return out.select(*(keys or PATENT_ATTRIBUTES))
