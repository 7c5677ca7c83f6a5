"""Small documents with every odd case, and texts made from a seed."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "se", "to", "Va", "né") for b in ("bi", "do", "fa", "ng", "pe", "x.")]


def text(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(words))


def odd_rows() -> list[tuple]:
    """NULLs in every column, empty and blank texts, repeated rows, an id used twice, copies, a long text."""
    copy = text(1, 80)
    near = " ".join([*copy.split()[:-1], "other"])
    return [
        (1, copy, "en", "a", 1),
        (2, copy, None, None, None),
        (2, copy, None, None, None),
        (3, near, "en", "a", 1),
        (4, None, "en", "a", None),
        (5, "", "en", None, 0),
        (6, " \t\n ", "de", "b", 4),
        (7, "one", "en", "a", 3),
        (7, "two words", "en", "a", 9),
        (None, text(2, 60), None, "a", 1),
        (None, None, None, None, None),
        (None, None, None, None, None),
        (8, text(3, 5000), "en", "a", 1),
        (9, "12 34 !!", "en", "a", 8),
        (10, text(4, 40) + "  tail", "en", "a", 1),
        (11, "one two three four five", "en", "a", 1),
        (12, copy, "en", "a", 1),
    ]


def documents(spark, rows):
    return spark.createDataFrame(rows, DOC_SCHEMA)


def clashing(df):
    """The same rows with columns that have the names of results and helpers."""
    from pyspark.sql import functions as F

    names = ("fp", "size", "shard", "slot", "lang_pred", "score", "key", "ids", "group", "n_words", "component_id")
    return df.select("*", *[F.lit("x").alias(n) for n in names if n not in df.columns])
