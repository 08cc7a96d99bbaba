"""Evaluate a value once inside an expression that uses it many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` as a one-element transform: without it the tree of ``value`` is
    copied at each use, and nested uses multiply until the code no longer compiles."""
    return F.transform(F.array(value), body)[0]
