"""Rewrites of benchmark SQL texts, as column expressions and for single statements.

The rewrites are regular expressions over a text column, so a corpus of any
number of queries is prepared in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A bare date literal; an optional ``date`` keyword before it is rebuilt.
DATE_LITERAL = r"(?i)(?<![a-z0-9_])(?:date\s+)?('[0-9]{4}-[0-9]{2}-[0-9]{2}')"
EPOCH_FUNCTION = r"(?i)to_timestamp_seconds\("
CREATE_VIEW = r"(?i)create\s+(?:or\s+replace\s+)?view\s+"
HAS_VIEW = r"(?i)create\s+view"
# The one corpus view whose column list some engines do not accept.
VIEW_COLUMNS = (
    r"(?is)create view revenue0 \(supplier_no, total_revenue\) as\s+select\s+l_suppkey,"
    r"\s+sum\(l_extendedprice \* \(1 - l_discount\)\)"
)
ALIASED_VIEW = (
    "create view revenue0 as select l_suppkey as supplier_no, "
    "sum(l_extendedprice * (1 - l_discount)) as total_revenue"
)


def date_literals(sql: Column) -> Column:
    """Give every bare date literal the ``DATE`` keyword, once."""
    return F.regexp_replace(sql, DATE_LITERAL, "DATE $1")


def epoch_function(sql: Column) -> Column:
    """Use the function that returns a timestamp rather than text."""
    return F.regexp_replace(sql, EPOCH_FUNCTION, "timestamp_seconds(")


def view_columns(sql: Column) -> Column:
    return F.regexp_replace(sql, VIEW_COLUMNS, ALIASED_VIEW)


def temporary_view(sql: Column) -> Column:
    return F.regexp_replace(sql, CREATE_VIEW, "CREATE OR REPLACE TEMPORARY VIEW ")


def without_terminator(sql: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(sql, r"^\s+|\s+\z", ""), r";+\z", "")


def statements(sql: Column) -> Column:
    """Non-blank statements of a text, trimmed."""
    parts = F.transform(F.split(sql, ";"), lambda s: F.regexp_replace(s, r"^\s+|\s+\z", ""))
    return F.filter(parts, lambda s: s != "")


def view_statements(sql: Column) -> Column:
    """The three statements of a view query, null for any other text, an error if not three."""
    parts = statements(sql)
    return F.when(
        sql.rlike(HAS_VIEW),
        F.when(F.size(parts) == 3, parts).otherwise(
            F.raise_error(F.lit("Expected CREATE VIEW benchmark query to contain three statements"))
        ),
    )


def prepared(sql: Column) -> Column:
    """The text as this engine runs it."""
    return epoch_function(date_literals(sql))
