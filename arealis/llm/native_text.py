"""Words and shingles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arealis.llm.common import SPACE

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are; null is empty.

    ``lower`` is far faster than ``translate`` and does the same wherever no other
    letter has a lower case.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^A-Z]]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def spaced_words(lowered: Column) -> Column:
    """What stands between ASCII white space; an empty array for none."""
    trimmed = F.btrim(lowered, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"))


def shingles(words: Column, n: int = 5) -> Column:
    """All runs of ``n`` words; fewer words are one run, no words none. ``words`` is a column, not an expression."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.concat_ws(" ", *(F.get(words, i + k) for k in range(n))))
    return F.when(F.size(words) >= n, runs).when(F.size(words) > 0, F.array(F.concat_ws(" ", words))).otherwise(F.array().cast("array<string>"))
