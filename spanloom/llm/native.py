"""Column helpers of the native operators: plain Spark SQL expressions, no Python on executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row, however often the body (or a lambda in it) reads it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def windows(items: Column, n: int, body: Callable[[Column], Column]) -> Column:
    """``body`` of each run of ``n`` consecutive items; an empty array for fewer items. ``items`` should be bound by let()."""
    starts = F.when(F.size(items) >= n, F.sequence(F.lit(1), F.size(items) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: body(F.slice(items, i, n)))
