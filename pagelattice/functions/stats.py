"""Aggregates with the rules of the reports: unknown is never zero; three medians."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def poisoning_sum(x: Column) -> Column:
    """Sum that is null as soon as one value is unknown."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))


def known_subtotal(x: Column) -> Column:
    """``struct(known, unknown)``: the sum of the known values, and whether one is not."""
    return F.struct(
        F.coalesce(F.sum(x), F.lit(0.0)).alias("known"), (F.count(x) < F.count(F.lit(1))).alias("unknown")
    )


def median(x: Column) -> Column:
    """Mean of the two middle values."""
    return F.percentile(x, F.lit(0.5))


# The others are values of the data, at an exact rank. Spark keeps a count per distinct
# value for them and combines these on the map side: no group is gathered as a list.


def upper_median(name: str) -> Column:
    """The value at ``n // 2`` of the sorted values of a column."""
    return F.expr(f"percentile_disc(0.5) within group (order by {name} desc)")


def lower_median(name: str) -> Column:
    """The value at ``(n - 1) // 2``."""
    return F.expr(f"percentile_disc(0.5) within group (order by {name})")


def p95(name: str) -> Column:
    """The value at ``floor(0.95 n)``."""
    return F.expr(f"percentile_disc(0.05) within group (order by {name} desc)")


def agreed(x: Column) -> Column:
    """The value if all known ones agree, else null."""
    return F.when(F.count_distinct(x) == 1, F.min(x))


def _upper(k: int, n: int, confidence: float = 0.95) -> float | None:
    """One-sided upper bound of a proportion (Clopper and Pearson), by bisection on the
    binomial tail; None for no trials."""
    if not n:
        return None
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
    lo, hi = k / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        tail = sum(math.exp(c + i * math.log(p) + (n - i) * math.log1p(-p)) for i, c in enumerate(logs)) if p < 1 else 0
        lo, hi = (p, hi) if tail > 1 - confidence else (lo, p)
    return (lo + hi) / 2


@F.pandas_udf(DoubleType())
def upper95(k: pd.Series, n: pd.Series) -> pd.Series:
    """Upper 95 % bound of ``k`` of ``n``; applied to aggregated rows only."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) else _upper(int(a), int(b)) for a, b in zip(k, n)], dtype="float64")
