"""Register of the queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..ship import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def shipped(f: Query) -> Query:
    """The query, after the package's code was sent to the executors."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def query(sql: str | None = None, **types: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name; ``sql`` gives the same rows in DuckDB,
    with columns cast to ``types`` where the engines' types differ."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = shipped(f)
        if sql:
            casts = ", ".join(f"{c}::{t} as {c}" for c, t in types.items())
            ORACLE[f.__name__] = f"select * replace ({casts}) from ({sql})" if casts else sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
