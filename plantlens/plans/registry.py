"""Name -> (Spark query, SQL twin)."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame

from ..session import Tables


class Entry(NamedTuple):
    run: Callable
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with the DuckDB text when SQL can express it."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Entry(lambda spark, sf_dir: fn(Tables(spark, sf_dir)), sql)
        return fn

    return add
