"""Word statistics of triples and background corpora, and the vocabulary filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, tokens
from ..staging import stage

ALL = float("inf")
BINS = 65_536  # of scores
SORTED = 100_000  # words that one task sorts
# Fixed value: ASCII punctuation.
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def occurrences(triples: DataFrame) -> DataFrame:
    """word of each occurrence in a subject or object."""
    return triples.select(F.explode(F.concat(tokens(F.col("subject")), tokens(F.col("object")))).alias("word"))


def frequency(triples: DataFrame) -> DataFrame:
    return occurrences(triples).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(triples: DataFrame) -> DataFrame:
    return occurrences(triples).distinct()


def rare_words(triples: DataFrame, least: int, counts: DataFrame | None = None) -> DataFrame:
    """Words of fewer than least occurrences; counts (word, n) of a larger corpus replace the triples' own, words it lacks have 0."""
    if counts is None:
        return frequency(triples).filter(F.col("n") < least).select("word")
    return vocabulary(triples).join(counts, "word", "left").filter(F.coalesce("n", F.lit(0)) < least).select("word")


def often(text: Column, least: int) -> Column:
    """Distinct lower-case words that a text holds least times or more.

    Words are sorted inside the row: one occurs that often if it begins a run and the word least - 1 places on is equal.
    Rarer words, which are most, never leave the row.
    """
    begins = lambda words, w, i: ((i == 0) | (w != F.get(words, F.greatest(i - 1, F.lit(0)))))
    runs = lambda words: F.filter(words, lambda w, i: begins(words, w, i) & F.coalesce(F.get(words, i + (max(least, 1) - 1)) == w, F.lit(False)))
    return let(F.sort_array(tokens(F.lower(text))), runs)


def document_frequency(books: DataFrame, least: int, text: str = "text", max_length: int | None = None) -> DataFrame:
    """word and n: number of books (one a row) that hold a word least times or more, over their first max_length characters."""
    body = F.col(text) if max_length is None else F.substring(text, 1, max_length)
    return books.select(F.explode(often(body, least)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def category_counts(docs: DataFrame, least: int, category: str = "category", text: str = "text") -> DataFrame:
    """category, term and n_papers: papers (one a row) that hold a term least times or more."""
    return docs.select(category, F.explode(often(F.col(text), least)).alias("term")).groupBy(category, "term").agg(F.count(F.lit(1)).alias("n_papers"))


def pooled(counts: DataFrame) -> DataFrame:
    """term and n over all categories, positive ones only."""
    return counts.groupBy("term").agg(F.sum("n_papers").alias("n")).filter("n > 0")


def total_files(files: DataFrame) -> DataFrame:
    return files.agg(F.sum("n_files").alias("n_files"))


def term_scores(corpus: DataFrame, papers: DataFrame, n_corpus: int | Column, n_papers: int | Column, least: int) -> DataFrame:
    """term and score: log share of papers over log share of the corpus; rare ones -inf, those of papers alone +inf.

    corpus and papers: word or term, and n. Sizes may be columns, such as a scalar subquery. Terms with punctuation, of digits only or of one character are left out.
    """
    c = corpus.toDF("term", "c")
    p = papers.toDF("term", "p")
    whole = lambda n: n.cast("double") if isinstance(n, Column) else F.lit(float(n))
    ratio = -F.log(F.col("c") / whole(n_corpus)) + F.log(F.col("p") / whole(n_papers))
    score = F.when(F.coalesce("p", F.lit(0)) < least, F.lit(-ALL)).when(F.col("c").isNull(), F.lit(ALL)).otherwise(ratio)
    clean = ~F.rlike("term", F.lit(PUNCTUATION)) & ~F.rlike("term", F.lit(r"^\d+$")) & (F.length("term") >= 2)
    return c.join(p, "term", "full_outer").filter(clean).select("term", score.alias("score"))


def _lower_part(rest: DataFrame, left: int, bins: Column) -> tuple[DataFrame, DataFrame, int, int]:
    """Rows of the bins below the one that holds row number left, the rows of that bin, and left and size in it."""
    counts = sorted((r[0], r[1]) for r in rest.groupBy(bins.alias("bin")).count().collect())  # as many as bins
    for at, n in counts:
        if n >= left:
            return rest.filter(bins < at), rest.filter(bins == at), left, n
        left -= n
    raise ValueError("fewer rows than asked for")


def lowest_words(words: DataFrame, scores: DataFrame, cutoff: float) -> DataFrame:
    """word of the lowest share of a vocabulary by score, rounded down; words without a score count as +inf, ties by word.

    The cut is found by counting, at once: words by BINS bins of their scores, again inside the bin that holds the cut,
    and words of one score by more and more of their letters, until SORTED or fewer are left to be sorted. So no task
    takes the cut as a whole.
    """
    scored = stage(words.join(scores.withColumnRenamed("term", "word"), "word", "left").select("word", F.coalesce("score", F.lit(ALL)).alias("score")), "scored")
    size = scored.count()
    left, rest, parts = int(cutoff * size), scored, []
    if left <= 0:
        return scored.select("word").limit(0)
    if left >= size:
        return scored.select("word")
    score, letters = F.col("score"), 0
    while size > SORTED:
        finite = ~score.isin(ALL, -ALL)
        least, most, low, high = rest.agg(F.min(score), F.max(score), F.min(F.when(finite, score)), F.max(F.when(finite, score))).first()
        if least != most:
            place = F.least(F.floor((score - F.lit(low)) / F.lit(max(high - low, 1e-300)) * BINS), F.lit(BINS - 1)) if low is not None else F.lit(0)
            bins = F.when(score == -ALL, F.lit(-1)).when(score == ALL, F.lit(BINS)).otherwise(place)
        else:
            letters += 1
            bins = F.substring("word", letters, 1)
        below, rest, left, size = _lower_part(rest, left, bins)
        parts.append(below)
    return union(*(p.select("word") for p in parts), rest.orderBy("score", "word").limit(left).select("word"), distinct=False)


def high_entropy_words(words: DataFrame, entropy: DataFrame, percentile: float) -> DataFrame:
    """Words above the percentile (linear interpolation) of all entropies."""
    cut = entropy.agg(F.percentile("entropy", F.lit(percentile)).alias("cut"))
    above = entropy.join(F.broadcast(cut), F.col("entropy") > F.col("cut")).select(F.col("term").alias("word"))
    return words.join(above.distinct(), "word", "left_semi")


def uncovered_share(words: DataFrame, entropy: DataFrame) -> DataFrame:
    """Share of the vocabulary that the entropies lack."""
    known = entropy.select(F.col("term").alias("word"), F.lit(1).alias("known")).distinct()
    return words.join(known, "word", "left").agg(F.count_if(F.col("known").isNull()).alias("n_missing"), (F.count_if(F.col("known").isNull()) / F.count(F.lit(1))).alias("share"))


def entropies(counts: DataFrame, files: DataFrame, least: int = 5) -> DataFrame:
    """term and entropy over categories of the share of a category's files that hold the term. A definition of our own.

    counts: category, term, n_papers; files: category, n_files. Terms in fewer than least papers are left out.
    """
    rate = counts.join(files, "category").withColumn("r", F.col("n_papers") / F.col("n_files"))
    sums = rate.groupBy("term").agg(F.sum("r").alias("s"), F.sum(F.col("r") * F.log("r")).alias("l"), F.sum("n_papers").alias("n"))
    return sums.filter(F.col("n") >= least).select("term", (F.log("s") - F.col("l") / F.col("s")).alias("entropy"))


def union(*lists: DataFrame, distinct: bool = True) -> DataFrame:
    """Words of several lists, each once if distinct."""
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    return out.distinct() if distinct else out


def split_by_words(triples: DataFrame, removal: DataFrame, keys: tuple[str, ...] = ("paper_id", "pos")) -> DataFrame:
    """triples with kept: false where all words of the subject, or all of the object, are in removal; no words count as all.

    Words are looked up once each; keys name a triple.
    """
    part = lambda c: F.transform(tokens(F.col(c)), lambda w: F.struct(F.lit(c).alias("part"), w.alias("word")))
    words = triples.select(*keys, F.explode(F.concat(part("subject"), part("object"))).alias("w")).select(*keys, "w.part", "w.word")
    spared = words.join(removal.select("word").distinct(), "word", "left_anti")
    both = spared.groupBy(*keys).agg((F.max(F.col("part") == "subject") & F.max(F.col("part") == "object")).alias("__spared"))
    return triples.join(both, list(keys), "left").withColumn("kept", F.coalesce("__spared", F.lit(False))).drop("__spared")


def kept_triples(triples: DataFrame, removal: DataFrame) -> DataFrame:
    return split_by_words(triples, removal).filter("kept").drop("kept")


def removed_triples(triples: DataFrame, removal: DataFrame) -> DataFrame:
    return split_by_words(triples, removal).filter("NOT kept").drop("kept")


def ngram_distances(matrix: list[list[float]]) -> list[tuple[int, int, float]]:
    """(length, length, distance) of the finite entries of a matrix of n-gram distances."""
    return [(i + 1, j + 1, float(d)) for i, row in enumerate(matrix) for j, d in enumerate(row) if d != ALL]


def with_distance(pairs: DataFrame, matrix: list[list[float]], left: str = "left", right: str = "right") -> DataFrame:
    """pairs of n-grams that can be compared, with distance by their numbers of words; the matrix is broadcast."""
    table = pairs.sparkSession.createDataFrame(ngram_distances(matrix), "__i int, __j int, distance double")
    size = lambda c: F.size(tokens(F.col(c)))
    return pairs.join(F.broadcast(table), (size(left) == F.col("__i")) & (size(right) == F.col("__j"))).drop("__i", "__j")
