from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in every column, empty and white-space texts, repeated rows, ties, no letters.
ODD = [
    (1, "one two three four five six seven", "en", "a", 33),
    (2, None, None, None, None),
    (None, "no id at all but some words", "en", "a", None),
    (3, "", "de", "b", 0),
    (4, " \t\n ", "de", "b", 4),
    (5, "one two three four five six seven", "en", None, 33),
    (6, "12345 !!! ???", "fr", "c", 13),
    (7, "word", "fr", "c", 4),
    (7, "word", "fr", "c", 4),
    (8, "naïve café déjà vu " * 40, "fr", "c", 760),
    (9, "<|endoftext|> a  b   c d", "en", "d", 20),
]


def odd(spark):
    """The odd rows, with an extra column that has an operator's word for its name."""
    return spark.createDataFrame([(*r, f"x{i}") for i, r in enumerate(ODD)], DOCS + ", target string")


def empty(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
