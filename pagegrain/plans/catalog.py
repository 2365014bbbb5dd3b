"""The table of registered queries, each with its DuckDB SQL if there is some."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import spaced

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            # white space is Unicode's on this side too
            SQL[name] = re.sub(r"'[^']*'", lambda text: spaced(text[0]) if r"\s" in text[0].lower() else text[0], sql)
        return f

    return register
