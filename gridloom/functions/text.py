"""Text expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Runs of letters and digits, lower case, in order; null text gives an empty array."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once.

    The optimizer may inline a projected column into a lambda that reads it, where it
    would be computed anew for each element; a lambda's own variable can't be inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
