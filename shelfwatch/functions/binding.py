"""Use a computed value several times in one expression without repeating it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once.

    Column expressions are trees: a value mentioned five times is planned and
    often evaluated five times, and nesting multiplies that. Mapping over a
    one-element array gives the value a name instead.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
