"""Small document tables and the words of the shared definition."""

import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def docs(spark, rows, extra=""):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def table(spark, sf, name="documents"):
    return spark.read.parquet(f"{sf}/{name}.parquet")


ODD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one"),
    (5, "Two words"),
    (6, "a b c d e f g h i j k l m n o p"),
    (7, "a b c d e f g h i j k l m n o p"),
    (7, "a b c d e f g h i j k l m n o p"),
    (None, "A B c d e f g h i j k l m n o p q"),
    (8, "the " * 3000),
    (9, "x" * 20000),
    (10, "Ünï çödé 日本語 <|endoftext|>   end of  text\x1c."),
    (11, "line one.\nline two.\n\nline one.\r\n"),
]
