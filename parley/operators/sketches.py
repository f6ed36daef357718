"""How far reports made with sketches are from the exact ones.

A rank is within its bound if the share of values below the estimate isn't above
the rank asked for, and the share up to it isn't below, by more than ``error``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranks_within(values: DataFrame, estimates: DataFrame, key: str, value: str, ranks: dict[str, int],
                 error: float = 0.01) -> DataFrame:
    """One row per ``key`` of ``estimates`` with ``<name>_within`` for each estimated rank.

    Estimates have one row per key; the values are read once and counted before the shuffle.
    """
    known = values.where(F.col(value).isNotNull()).join(estimates.select(key, *ranks), key)
    counts = known.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(value) < F.col(n)).alias(f"_below_{n}") for n in ranks],
        *[F.count_if(F.col(value) <= F.col(n)).alias(f"_upto_{n}") for n in ranks])
    return counts.select(key, *[_within(n, pct / 100, error) for n, pct in ranks.items()])


def _within(name: str, rank: float, error: float) -> Column:
    low, high = F.col("_n") * (rank - error), F.col("_n") * (rank + error)
    return ((F.col(f"_below_{name}") <= high) & (F.col(f"_upto_{name}") >= low)).alias(f"{name}_within")


def numbers_within(estimated: DataFrame, exact: DataFrame, key: str, columns: dict[str, float]) -> DataFrame:
    """The exact report with each column of ``columns`` replaced by whether the estimate is within that share of it."""
    both = exact.join(estimated.select(key, *[F.col(c).alias(f"_e_{c}") for c in columns]), key)
    checks = [(F.abs(F.col(f"_e_{c}") - F.col(c)) <= F.col(c) * share).alias(f"{c}_within") for c, share in columns.items()]
    return both.select(*[c for c in exact.columns if c not in columns], *checks)
