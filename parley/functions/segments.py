"""Ordered per-key state without gathering a large key in one task.

Every key is cut into fine segments (minutes, or blocks of positions). Windows run
inside a segment; the last row of a segment sums it up, and these few rows carry
the state from one segment to the next in the same way, by coarser segments. Only
the coarsest level (days) is ordered per whole key. There is one plan for all
keys, whatever their size, and none of it runs before the result is asked for.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

MINUTES = (1440,)  # a day of minutes is the next segment above minutes
BLOCKS = (4096,)


@dataclass(frozen=True)
class Previous:
    """Value of ``value`` on the row before."""
    value: Column


@dataclass(frozen=True)
class LastKnown:
    """Last non-null ``value`` on any earlier row."""
    value: Column


@dataclass(frozen=True)
class TotalBefore:
    """Sum of ``value`` over all earlier rows (0 on the first)."""
    value: Column


State = Previous | LastKnown | TotalBefore


def minute_segment(ts: str = "timestamp") -> Column:
    return F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / 60)


def block_segment(position: str, size: int = 256) -> Column:
    return F.floor(F.col(position) / size)


def _local(s: State, value: Column, window: WindowSpec) -> Column:
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    if isinstance(s, Previous):
        return F.lag(value, 1).over(window)
    if isinstance(s, LastKnown):
        return F.last(value, ignorenulls=True).over(earlier)
    return F.coalesce(F.sum(value).over(earlier), F.lit(0))


def _tail(s: State, value: Column, here: Column) -> Column:
    """What the last row of a segment hands on."""
    if isinstance(s, Previous):
        return value
    return F.coalesce(value, here) if isinstance(s, LastKnown) else here + F.coalesce(value, F.lit(0))


def _final(s: State, here: Column, carry: Column) -> Column:
    if isinstance(s, Previous):
        return F.when(F.col("_first"), carry).otherwise(here)
    return F.coalesce(here, carry) if isinstance(s, LastKnown) else here + F.coalesce(carry, F.lit(0))


def with_state(df: DataFrame, key: str, order: list[str], segment: Column, state: dict[str, State],
               coarser: tuple[int, ...] = MINUTES) -> DataFrame:
    """``df`` plus one column per entry of ``state``.

    ``segment`` is a whole number that grows with ``order``; ``coarser`` says how many
    segments make one of the next level, level by level.
    """
    src = df.withColumns({f"_v_{n}": s.value for n, s in state.items()}).withColumn("_seg", segment)
    inside = Window.partitionBy(key, "_seg").orderBy(*order)
    here = {f"_l_{n}": _local(s, F.col(f"_v_{n}"), inside) for n, s in state.items()}
    marked = src.withColumns(here | {"_first": F.row_number().over(inside) == 1})

    tails = src.withColumns(here | {"_last": F.lead(F.lit(1)).over(inside).isNull()}).where("_last").select(
        F.col(key).alias("_key"), F.col("_seg").alias("_at"),
        *[_tail(s, F.col(f"_v_{n}"), F.col(f"_l_{n}")).alias(f"_t_{n}") for n, s in state.items()])
    again = {f"_c_{n}": type(s)(F.col(f"_t_{n}")) for n, s in state.items()}
    if coarser:
        carried = with_state(tails, "_key", ["_at"], F.floor(F.col("_at") / coarser[0]), again, coarser[1:])
    else:
        whole = Window.partitionBy("_key").orderBy("_at")
        carried = tails.withColumns({n: _local(s, s.value, whole) for n, s in again.items()})
    carried = carried.select("_key", "_at", *again)

    joined = marked.join(carried, marked[key].eqNullSafe(carried["_key"]) & marked["_seg"].eqNullSafe(carried["_at"]))
    return joined.select(*[marked[c] for c in df.columns], *[
        _final(s, F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n, s in state.items()])
