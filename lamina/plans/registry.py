"""Registered queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamina.plans.views import RECTS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, views: str = RECTS_SQL):
    """Registers a function by its name, with its SQL after the views it uses."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        with_ = "WITH RECURSIVE" if "RECURSIVE" in sql else "WITH"
        body = sql.replace("RECURSIVE", "")
        ORACLES[f.__name__] = f"{with_} {views}{',' if body.lstrip().startswith('@') else ''} {body.replace('@', '')}" if views else body
        return f

    return add
