"""The whole ways from papers and patents to final triples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Filtering, Loading, Settings
from ..functions import abbreviations
from ..functions import text as X
from ..operators import inference, patents, selection, vocabulary
from ..operators import triples as T
from ..staging import release, stage


def loaded(papers: DataFrame, s: Loading | None = None, done: DataFrame | None = None) -> DataFrame:
    """paper_id and sentences of papers (file_name, categories, raw_text) that the settings choose."""
    s = s or Loading()
    out = papers if done is None else selection.not_done(papers, done)
    if s.filter_categories:
        out = selection.in_categories(out, list(s.categories), s.inverse)
    if s.filter_by_version:
        out = selection.newest_versions(out)
    out = selection.sample(out, s.subset, "file_name", s.seed)
    if s.filter_for_terms_in_abstract:
        out = selection.with_terms(out, list(s.terms), "raw_text", s.average_abstract_length)
    out = selection.non_empty(out, "raw_text")
    split = s.split_sentences or X.sentences
    bodies = T.once(out.select(X.base_id(F.col("file_name")).alias("paper_id"), X.body(F.col("raw_text")).alias("body")))
    parted = T.once(bodies.select("paper_id", split(F.col("body")).alias("sentences")))
    return T.once(parted.select("paper_id", X.joined_et_al(F.col("sentences")).alias("sentences")))


def normalised(texts: DataFrame, expand: bool = True) -> DataFrame:
    """Line breaks mended, citations removed, abbreviations expanded."""
    mended = F.transform("sentences", lambda s: X.strip_citations(X.mend_line_breaks(s)))
    texts = T.once(texts.select("paper_id", mended.alias("sentences")))
    return texts.select("paper_id", (abbreviations.expanded(F.col("sentences")) if expand else F.col("sentences")).alias("sentences"))


def removal_words(triples: DataFrame, books: DataFrame, counts: DataFrame, files: DataFrame, n_books: int | Column, n_papers: int | Column, s: Filtering, entropy: DataFrame | None = None) -> DataFrame:
    """Words to remove: rare ones, those of lowest score against the books, and those of high entropy.

    Scores and entropies are rounded to 9 digits, so that cuts don't hang on the order in which tasks add them up.
    """
    steady = lambda table, value: table.withColumn(value, F.round(value, 9))
    words = vocabulary.vocabulary(triples)
    in_books = vocabulary.document_frequency(books, s.min_num_counts_term_in_single_book, max_length=s.max_length_book)
    scores = vocabulary.term_scores(in_books, vocabulary.pooled(counts), n_books, n_papers, s.min_num_paper_appearances_term_bookcorpus_scores)
    lists = [vocabulary.rare_words(triples, s.min_num_appearances_for_frequency), vocabulary.lowest_words(words, steady(scores, "score"), s.cutoff_bookcorpus)]
    if s.use_entropy:
        entropy = vocabulary.entropies(counts, files, s.min_num_paper_appearances_term) if entropy is None else entropy
        lists.append(vocabulary.high_entropy_words(words, steady(entropy, "entropy"), s.entropy_percentile_threshold))
    return vocabulary.union(*lists)


def papers_to_triples(papers: DataFrame, settings: Settings | None = None, model: Callable[[list[str]], list[str]] = inference.stand_in, lemmatise: Callable[[str], str] | None = None) -> DataFrame:
    """Clean triples of papers, before the vocabulary filter."""
    s = settings or Settings()
    answers = inference.extract(normalised(loaded(papers, s.loading)), s.extraction, model)
    return T.cleaned(T.parsed(answers), s.cleaning, lemmatise)


def filtered(triples: DataFrame, books: DataFrame, papers: DataFrame, settings: Filtering | None = None, entropy: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Kept and removed triples by the words that are rare, close to the books or of high entropy over categories.

    triples: staged or stored, for they are read four times; they meet the removal words once, for both results. books:
    book_id, text; settings choose the share of them that is used. papers: category, text, which scores and entropies
    are counted over.
    """
    s = settings or Filtering()
    chosen = selection.sample(books, s.subset_book_corpus, "book_id", s.seed)
    counts = stage(vocabulary.category_counts(papers, s.min_num_counts_term_in_single_paper), "counts")  # read by scores and entropies
    files = papers.groupBy("category").agg(F.count(F.lit(1)).alias("n_files"))
    sizes = [d.agg(F.count(F.lit(1))).scalar() for d in (chosen, papers)]
    words = stage(removal_words(triples, chosen, counts, files, *sizes, s, entropy), "removal")
    split = stage(vocabulary.split_by_words(triples, words), "split")
    release(counts, words)
    return split.filter("kept").drop("kept"), split.filter("NOT kept").drop("kept")


def patents_to_texts(documents: DataFrame, keywords: list[str]) -> tuple[DataFrame, DataFrame]:
    """Texts and attributes of patents with a keyword."""
    records = patents.with_keywords(patents.parsed(documents).filter("error IS NULL AND NOT skipped"), keywords)
    return patents.texts(records), patents.attributes(records)
