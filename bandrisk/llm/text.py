"""Words of texts, as column expressions and on bytes inside tasks.

White space is the six ASCII characters space and U+0009 to U+000D; ``bytes.split`` and the pattern
below agree on it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def lower_ascii(text: Column) -> Column:
    """The text with A-Z lower-cased and all else unchanged."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text in order; no words for NULL."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAP)
    return F.filter(parts, lambda word: word != "")


def as_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; none for NULL."""
    return F.coalesce(text, F.lit("")).cast("binary")


def text_key(text: Column) -> Column:
    """A hash that tells rows with the same id and different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
