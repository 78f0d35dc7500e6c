"""The natural order of query ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lapwise.operators.numbering import number_rows


def query_number(query: str | Column = "id") -> Column:
    """First digit run of an id as a number, null without digits."""
    column = F.col(query) if isinstance(query, str) else query
    return F.nullif(F.regexp_extract(column, "[0-9]+", 0), F.lit("")).try_cast("decimal(38,0)")


def natural_order(query: str = "id") -> list[Column]:
    """Sort keys: numbered ids by number, then by locale; ids without digits last."""
    return [query_number(query).asc_nulls_last(), F.collate(F.col(query), "UNICODE"), F.col(query)]


def natural_positions(ids: DataFrame, keys: Sequence[str], query: str = "id", name: str = "position") -> DataFrame:
    """Position of every id within its group, from 1.

    Slices are the numbers themselves, so even a group with very many ids is
    not ordered in one task.
    """
    number = query_number(query)
    return number_rows(
        ids,
        keys=keys,
        slices=[number.isNull(), F.coalesce(number, F.lit(0))],
        order=[F.collate(F.col(query), "UNICODE"), F.col(query)],
        name=name,
    )
