"""Registration of the driver queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lapwise.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a table reader under a key, with its check SQL if there is one."""

    def register(build: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(lambda table: read_table(spark, sf_dir, table))
        if sql is not None:
            ORACLES[name] = sql.strip()
        return build

    return register
