"""Names for intermediate values inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it.

    Building a large expression from Python repeats every column it uses; a
    lambda over a one-element array binds it instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rows_of(struct: Column) -> Column:
    """A one-row generator of a struct.

    Filters on its fields stay above it, so the expressions below are computed
    once and are not copied into the filter.
    """
    return F.inline(F.array(struct))
