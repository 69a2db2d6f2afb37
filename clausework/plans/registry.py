"""The registry that the query modules of this folder fill: Spark queries and their independent SQL by name."""

from __future__ import annotations

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")
