"""Column expressions on text that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that separates words: tab, line feed, vertical tab, form feed, carriage return, space.
SPACE_CLASS = r"\x20\x09-\x0D"
_SPACES = "\t\n\x0b\x0c\r "


def words(text: Column) -> Column:
    """Runs of characters other than white space, in order; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE_CLASS}]+", -1))


def word_count(text: Column) -> Column:
    """Number of words as a long."""
    return F.size(words(text)).cast("long")


#: What separates words of letters and digits: all other ASCII. Characters beyond ASCII belong to words.
ALNUM_APART = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
_ALNUM_APART = "".join(map(chr, (*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def alnum_words(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, in order, with A-Z as a-z; null has none."""
    trimmed = F.btrim(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), F.lit(_ALNUM_APART))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{ALNUM_APART}]+", -1))
