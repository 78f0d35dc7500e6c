"""Registration of driver queries with the SQL each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lapwise import fixtures as fx
from lapwise.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VIEWS = {
    "fx_iterations": fx.ITERATIONS,
    "fx_comments": fx.COMMENTS,
    "fx_jobs": fx.JOBS,
    "fx_statement_pages": fx.STATEMENT_PAGES,
    "fx_listing_source": fx.LISTING_SOURCE,
    "fx_listing_target": fx.LISTING_TARGET,
    "fx_job_events": fx.JOB_EVENTS,
    "fx_timings": fx.TIMINGS,
    "fx_manifests": fx.MANIFESTS,
    "fx_branches": fx.BRANCHES,
    "fx_pull_requests": fx.PULL_REQUESTS,
    "fx_failures": fx.FAILURES,
    "fx_sql_texts": fx.SQL_TEXTS,
}


def query(name: str, sql: str | None = None):
    """Register a function of the fixtures under a key, with its check SQL if there is one."""

    def register(build: Callable[[fx.Fixtures], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(fx.Fixtures(tune(spark), sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return register


def with_views(sql: str) -> str:
    """Put the fixture views a text uses in front of it."""
    used = {v: text for v, text in VIEWS.items() if re.search(rf"\b{v}\b", sql)}
    if not used:
        return sql.strip()
    ctes = ",\n".join(f"{name} AS ({text.strip()})" for name, text in used.items())
    body = sql.strip()
    opening = re.match(r"(?i)with(\s+recursive)?\b", body)
    if opening:
        return f"{opening[0]} {ctes},\n{body[opening.end():].strip()}"
    return f"WITH {ctes}\n{body}"


def micros(column: str | Column) -> Column:
    """Timestamps are compared as microseconds since the epoch."""
    return F.unix_micros(F.col(column) if isinstance(column, str) else column)
