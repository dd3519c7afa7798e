"""Schemas of all tables, as DDL strings."""

METADATA = "id string, categories string"
RAW_OUTPUT = "text string, triplets string, paper_id string"
TRIPLE = "struct<subject: string, predicate: string, object: string>"
TRIPLES = "paper_id string, pos int, subject string, predicate string, object string"
NESTED_TRIPLES = f"paper_id string, triplets array<{TRIPLE}>"
CHAT = "array<struct<role: string, content: string>>"
REFERENCE = (
    "struct<publication_number: string, patent_office: string, application_number: string, reference: string, cited_by_examiner: boolean, "
    "document_type: string, country: string, kind: string, metadata: map<string, string>>"
)
PATENT = (
    "publication_title string, publication_number string, publication_date string, grant_date string, application_number string, "
    "application_type string, application_date string, application_status string, patent_office string, authors array<string>, "
    "organizations array<string>, attorneys array<string>, attorney_organizations array<string>, "
    f"referential_documents array<{REFERENCE}>, sections array<string>, section_classes array<string>, "
    "section_class_subclasses array<string>, section_class_subclass_groups array<string>, abstract array<string>, "
    "descriptions array<string>, claims array<string>"
)
FOOTPRINT = "map<string, map<string, double>>"
