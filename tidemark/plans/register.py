"""The register of queries: a name, a function of (spark, sf_dir), and DuckDB SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.views import CTES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None, *views: str):
    """Registers a query under its function's name; ``views`` are the domain views that its SQL reads."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            needed: dict[str, str] = {}

            def need(v: str) -> None:
                for other in CTES[v][1]:
                    need(other)
                needed[v] = CTES[v][0]

            for v in views:
                need(v)
            text = sql.strip()
            ctes = ",\n".join(f"{k} AS ({v.strip()})" for k, v in needed.items())
            if ctes:
                text = f"WITH {ctes},\n{text[5:]}" if text.upper().startswith("WITH ") else f"WITH {ctes}\n{text}"
            SQL[f.__name__] = text
        return f

    return add
