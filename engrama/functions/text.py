"""Text expressions: tokens, chunks, prefixes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = re.compile(r"[\W_]+")


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def tokens_of(text: str | None) -> list[str]:
    """``tokenize`` outside of Spark."""
    return [t for t in _SPLIT.split((text or "").lower()) if t]


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def chunks(text: Column, size: int = 800, overlap: int = 120) -> Column:
    """Overlapping pieces of a text as an array; an empty text has none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(text) - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(F.char_length(text) > 0, F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def prefixed(text: Column, prefix: str) -> Column:
    """Prefix for models that embed queries and passages differently."""
    return F.concat(F.lit(prefix), text)
