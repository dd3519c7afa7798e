"""Line-first cleaning: rules drop single lines, then documents that lose too much text are rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACE_CLASS, free, let

SYMBOLS = "#*$%&|<>"
SYMBOL_CLASS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_KEPT_PERCENT = 50
FEW = 12  # repeated windows up to which they are looked up one by one
# Phrases of page furniture, in lower case.
NAVIGATION = [
    *("home |", "| home", "next page", "previous page", "back to top", "skip to content", "read more", "click here", "sign in", "log in", "main menu", "site map"),
    *("n\u00e4chste seite", "vorherige seite", "zur startseite", "nach oben", "weiterlesen", "hier klicken", "jetzt anmelden", "zum inhalt springen"),
    *("page suivante", "page pr\u00e9c\u00e9dente", "retour en haut", "lire la suite", "cliquez ici", "se connecter", "aller au contenu", "plan du site"),
    *("p\u00e1gina siguiente", "p\u00e1gina anterior", "volver arriba", "leer m\u00e1s", "haga clic aqu\u00ed", "iniciar sesi\u00f3n", "saltar al contenido", "mapa del sitio"),
]
BOILERPLATE = [
    *("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "use of cookies", "enable javascript", "subscribe to our newsletter", "lorem ipsum"),
    *("alle rechte vorbehalten", "datenschutzerkl\u00e4rung", "nutzungsbedingungen", "verwendung von cookies", "newsletter abonnieren"),
    *("tous droits r\u00e9serv\u00e9s", "politique de confidentialit\u00e9", "conditions g\u00e9n\u00e9rales", "utilisation de cookies", "mentions l\u00e9gales"),
    *("todos los derechos reservados", "pol\u00edtica de privacidad", "condiciones de uso", "uso de cookies", "aviso legal"),
]
# Fixed value: the end of a teaser.
ENDS = r"(\.\.\.|\x{2026})[\x20\x09-\x0D]*\z"


def _squeezed(c: Column) -> Column:
    """The characters of all words."""
    return F.translate(c, SPACE_CHARS, "")


def _words(text: Column) -> Column:
    trimmed = F.call_function("btrim", text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE_CLASS}]+"))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _filled(line: Column) -> Column:
    """Whether a line holds a word."""
    return F.rlike(line, F.lit(f"[^{SPACE_CLASS}]"))


def line_fails(line: Column) -> Column:
    """Whether a line breaks a rule; lines without a word never do.

    punctuation: 3 or more symbols (#*$%&|<>) that are a twentieth of its characters or more, or no letter and no digit;
    shouting: 5 words or more with capitals and without a lower-case letter;
    navigation and boilerplate: under 25 words with a phrase of page furniture in English, German, French or Spanish,
    with 3 or more separators | or \u00bb, or cut off by an ellipsis at the end.
    """
    symbols = _count(line, SYMBOL_CLASS)
    words = _count(line, f"[{SPACE_CLASS}]+") + 1
    phrase = F.rlike(F.lower(line), F.lit("|".join("\\Q" + p + "\\E" for p in NAVIGATION + BOILERPLATE)))
    bars = _count(line, "[|\u00bb]")
    shouting = ~F.rlike(line, F.lit(r"\p{Ll}")) & F.rlike(line, F.lit(r"\p{Lu}")) & (words >= 5)
    marks = ((symbols >= 3) & (symbols * 20 >= F.length(_squeezed(line)))) | ~F.rlike(line, F.lit(r"[\p{L}\p{N}]"))
    return _filled(line) & (marks | shouting | ((words < 25) & ((bars >= 3) | phrase | F.rlike(line, F.lit(ENDS)))))


def _repeated(words: Column) -> Column:
    """Number of words in windows of 3 that are in the text twice or more.

    Windows are compared by 64-bit hashes of their words. Hashes are sorted once; texts without equal neighbours, which
    are most, end there. Where few windows repeat each position is looked up; else positions are sorted with hashes.
    """

    def covered(starts: Column) -> Column:
        reach = F.transform(starts, lambda s, i: F.when(i + 1 < F.size(starts), F.least(F.lit(3), F.get(starts, i + 1) - s)).otherwise(F.lit(3)))
        return F.aggregate(reach, F.lit(0), lambda a, b: a + b)

    def beside(pairs: Column) -> Column:
        equal = lambda x, i: F.coalesce(F.get(pairs, F.greatest(i - 1, F.lit(0)))["h"] == x["h"], F.lit(False)) & (i > 0) | F.coalesce(F.get(pairs, i + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(pairs, equal), lambda x: x["i"]))

    def starts(hashes: Column, twice: Column) -> Column:
        few = F.filter(F.transform(hashes, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda i: i.isNotNull())
        many = let(F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), beside)
        return F.when(F.size(twice) <= FEW, few).otherwise(many)

    def counted(hashes: Column) -> Column:
        doubles = lambda s: F.array_distinct(F.filter(s, lambda x, i: F.coalesce(x == F.get(s, i + 1), F.lit(False))))
        twice = let(F.sort_array(hashes), doubles)
        return let(twice, lambda t: F.when(F.size(t) == 0, F.lit(0)).otherwise(let(starts(hashes, t), covered)))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(windows, counted))


def _judged(text: Column, min_kept: int) -> Column:
    """n, chars, repeat, dup, symbols, base_failed, kept and passed (the lines) of a text, as one struct."""

    def verdict(x: Column) -> Column:
        w, l = x["w"], x["l"]
        failed = (w["n"] < MIN_WORDS) | (100 * w["repeat"].cast("bigint") > MAX_REPEAT_PERCENT * w["n"].cast("bigint"))
        left = 100 * F.length(_squeezed(F.array_join(l["passed"], "\n"))).cast("bigint") >= min_kept * w["chars"].cast("bigint")
        kept = F.when(F.size(l["passed"]) == l["all"], F.lit(min_kept <= 100)).otherwise(left)
        return F.struct(w["n"].alias("n"), w["chars"].alias("chars"), w["repeat"].alias("repeat"), l["dup"].alias("dup"), x["symbols"].alias("symbols"), failed.alias("base_failed"), (~failed & kept).alias("kept"), l["passed"].alias("passed"))

    text = F.coalesce(text, F.lit(""))
    words = let(_words(text), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeated(w).alias("repeat")))
    lines = let(
        F.split(text, "\n"),
        lambda l: F.struct(
            let(F.filter(l, _filled), lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("dup"),
            F.size(l).alias("all"),
            F.filter(l, lambda x: ~line_fails(x)).alias("passed"),
        ),
    )
    return let(F.struct(words.alias("w"), lines.alias("l"), _count(text, SYMBOL_CLASS).alias("symbols")), verdict)


def quality_rules(docs: DataFrame, min_kept: int = MIN_KEPT_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept of each row.

    Words are [^\\x20\\x09-\\x0D]+. base_failed: under 50 words, or over half of them in 3-word windows that repeat.
    kept: not base_failed, and the lines that pass line_fails() hold min_kept percent or more of the words' characters.
    Null and empty texts have no words and fail. Repeated rows and null ids are kept; an empty table gives an empty
    result. Nothing is shuffled: each row is judged by its own text.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), _judged(F.col(text_col), min_kept).alias("j"))
    counts = {"n_words": "n", "word_chars": "chars", "n_symbols": "symbols", "n_dup_lines": "dup", "n_repeat_words": "repeat"}
    return d.select("doc_id", *(F.col(f"j.{c}").cast("bigint").alias(n) for n, c in counts.items()), "j.base_failed", "j.kept")


def clean_documents(docs: DataFrame, min_kept: int = MIN_KEPT_PERCENT, text_col: str = "text") -> DataFrame:
    """The rows of docs that quality_rules() keeps, all columns, without the lines that fail."""
    judged = free(docs, "judged")
    d = docs.withColumn(judged, _judged(F.col(text_col), min_kept)).filter(F.col(judged)["kept"])
    return d.withColumn(text_col, F.array_join(F.col(judged)["passed"], "\n")).select(*docs.columns)
