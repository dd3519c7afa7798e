"""Settings with the defaults of the extraction pipeline."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

# Filler verbs that a predicate of several words loses.
FILLER_VERBS = (
    "can will shall may could would should has are is have was were had do does did am be being been get got gets getting gotten "
    "make makes made making let lets letting to must might having"
).split()
# The attributes of a patent that are kept.
PATENT_ATTRIBUTES = "publication_title publication_number publication_date grant_date application_type application_status patent_office referential_documents sections section_classes section_class_subclasses section_class_subclass_groups".split()
INF = float("inf")
# Distance of n-grams by their lengths (1 to 7); infinite ones are not compared.
DISTANCES = [
    [1, 1, 1, INF, INF, INF, INF],
    [1, 2, 2, 2, INF, INF, INF],
    [1, 2, 2, 3, 3, 3, INF],
    [INF, 2, 3, 3, 3, 3, 3],
    [INF, INF, 3, 3, 3, 4, 4],
    [INF, INF, 3, 3, 4, 4, 4],
    [INF, INF, INF, 3, 4, 4, 4],
]


@dataclass(frozen=True)
class Loading:
    inverse: bool = False
    subset: float | None = None
    categories: tuple[str, ...] = ()
    filter_categories: bool = False
    filter_by_version: bool = False
    filter_for_terms_in_abstract: bool = False
    terms: tuple[str, ...] = ()
    average_abstract_length: int = 1250
    max_num_pages: int = 100
    seed: int = 42
    split_sentences: Callable[[Column], Column] | None = None  # in place of the regular expression


@dataclass(frozen=True)
class Extraction:
    model_type: str = "meta-llama/Meta-Llama-3-8B-Instruct"
    max_input_length: int = 50000
    max_new_tokens: int = 400
    num_lines_per_model_call: int = 15
    use_fewshot_prompting: bool = True
    use_sampling: bool = False
    temperature: float = 1.0
    top_p: float = 1.0
    repetition_penalty: float = 1.0
    seed: int = 42


@dataclass(frozen=True)
class Cleaning:
    max_length: int = 6
    min_num_characters: int = 3
    use_lemmatization: bool = True
    filler_verbs: tuple[str, ...] = tuple(FILLER_VERBS)
    stopwords: tuple[str, ...] | None = None
    trim: bool = False


@dataclass(frozen=True)
class Filtering:
    min_num_appearances_for_frequency: int = 10
    cutoff_bookcorpus: float = 0.1
    max_length_book: int = 30000
    min_num_counts_term_in_single_book: int = 5
    min_num_paper_appearances_term_bookcorpus_scores: int = 5
    subset_book_corpus: float | None = 0.3
    use_entropy: bool = True
    entropy_percentile_threshold: float = 0.85
    min_num_counts_term_in_single_paper: int = 5
    min_num_paper_appearances_term: int = 5
    seed: int = 42


@dataclass(frozen=True)
class Settings:
    loading: Loading = field(default_factory=Loading)
    extraction: Extraction = field(default_factory=Extraction)
    cleaning: Cleaning = field(default_factory=Cleaning)
    filtering: Filtering = field(default_factory=Filtering)
