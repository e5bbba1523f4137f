"""Column expressions that several text operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def lower_az(text: Column) -> Column:
    """``text`` with A-Z in lower case and every other character as it was.

    ``lower`` does just that to ASCII texts and is fast; others go through ``translate``.
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    changed = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(ascii_only, F.lower(text)).otherwise(changed)


def spaced_words(text: Column) -> Column:
    """Words between white space; a text without words gives one empty word."""
    return F.split(F.btrim(text, F.lit(SPACES)), SPACE_RUN)


def count_words(text: Column) -> Column:
    """Number of words between white space, as a long; null and empty texts have none."""
    words = spaced_words(text)
    one = F.when(F.element_at(words, 1) == "", 0).otherwise(F.size(words))
    return F.when(text.isNull(), F.lit(0)).otherwise(one).cast("long")
