"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import durable, shared_dir  # noqa: F401

#: A side is broadcast only when it is known to be at most this many bytes.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read from ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_small(left: DataFrame, right: DataFrame, on, how: str, row_bytes: int) -> DataFrame:
    """Join that broadcasts ``right`` only after counting it.

    ``row_bytes`` bounds the width of a row of ``right``; above ``BROADCAST_BYTES`` in
    all, the join is shuffled (AQE then splits skewed keys). ``right`` should be cheap
    to compute twice or a durable table.
    """
    if right.count() * row_bytes <= BROADCAST_BYTES:
        right = F.broadcast(right)
    return left.join(right, on, how)


def site_of(url: str) -> str:
    """SQL text for the host of a URL column: lower case, no port, no leading www."""
    return (
        f"regexp_replace(regexp_extract(lower({url}), "
        r"'^[a-z][a-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\\.', '')"
    )
