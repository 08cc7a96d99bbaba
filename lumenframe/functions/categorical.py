"""Categorical cleaning as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
MISSING = "__missing__"
BLANK_WORDS = ("", "nan", "none")


def strip(c: Column) -> Column:
    """Trim all Unicode white space; Spark's trim takes blanks only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_category(c: Column, missing: str = MISSING) -> Column:
    """Lower-case and trim; null, blank, ``nan`` and ``none`` become ``missing``."""
    text = F.lower(strip(c.cast("string")))
    return F.when(text.isNull() | text.isin(*BLANK_WORDS), F.lit(missing)).otherwise(text)


def gate(cleaned: Column, vocabulary: Iterable[str], missing: str = MISSING) -> Column:
    """A cleaned category if it is in the vocabulary (a literal set), else ``missing``."""
    known = sorted(set(vocabulary))
    return F.when(cleaned.isin(*known), cleaned).otherwise(F.lit(missing)) if known else F.lit(missing)


def is_blank(c: Column) -> Column:
    text = F.lower(strip(c.cast("string")))
    return text.isNull() | text.isin(*BLANK_WORDS)
