"""Sliding rate limit per session: at most N accepted requests per window.

Rejected requests are not recorded, so a request's fate depends on earlier
decisions. The state is the times of at most N accepted requests.

Batch form: quiet gaps of a full window reset the state, so every session is
cut there and the pieces are independent. Only the distinct times of a piece
are read in order, as Arrow batches with bounded memory; within a batch the next
acceptable time is found by binary search, so a flood of rejected requests costs
no per-row work.
"""
from __future__ import annotations

import sys
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.kernels import event_time
from parley.functions.segments import Previous, TotalBefore, minute_segment, with_state
from parley.streaming.ordered import in_order

# The functions that run in tasks travel whole, so executors do not need this
# package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_REQUESTS, WINDOW_SECONDS = 30, 600


class _Limiter:
    """Decides a sorted run of times; keeps the accepted ones in the window."""

    def __init__(self, most: int, window_us: int, accepted=()):
        self.most, self.window = most, window_us
        self.accepted = deque(accepted, maxlen=most)

    def decide(self, times: np.ndarray) -> np.ndarray:
        allowed = np.zeros(len(times), dtype=bool)
        i = 0
        while i < len(times):
            if len(self.accepted) == self.most:
                free_at = self.accepted[0] + self.window
                if times[i] < free_at:
                    i = int(np.searchsorted(times, free_at, side="left"))
                    continue
            self.accepted.append(int(times[i]))
            allowed[i] = True
            i += 1
        return allowed


def _times(requests: DataFrame, window: int, most: int) -> DataFrame:
    """Distinct times of each session with their requests (``most`` at the most
    matter), numbered by the stretches between quiet gaps."""
    times = requests.groupBy("session_id", "_us").agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("_n"))
    segment = F.floor(F.col("_us") / 60_000_000)
    gaps = with_state(times, "session_id", ["_us"], segment, {"_before": Previous(F.col("_us"))})
    fresh = F.coalesce(F.col("_us") - F.col("_before") >= window * 1_000_000, F.lit(False)).cast("int")
    counted = with_state(gaps.withColumn("_fresh", fresh).drop("_before"), "session_id", ["_us"], segment,
                         {"_piece": TotalBefore(F.col("_fresh"))})
    return counted.withColumn("_piece", F.col("_piece") + F.col("_fresh")).drop("_fresh")


def rate_limit(requests: DataFrame, *, max_requests: int = MAX_REQUESTS,
               window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """``requests`` (session_id, request_id, timestamp) with ``allowed``.

    The ordered pass sees distinct times and counts only, under a number for the
    session, and passes on times with accepted requests, ``max_requests`` in a
    window at most. Of the requests of one time, those with the smallest ids are
    accepted.
    """
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    rows = requests.select("session_id", "request_id", "timestamp", us.alias("_us"))
    pieces = _times(rows, window_seconds, max_requests)
    ordered = (pieces.select("session_id", "_piece", "_us", "_n").repartition("session_id", "_piece")
               .sortWithinPartitions("session_id", "_piece", "_us"))
    window_us = window_seconds * 1_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, limiter = None, None
        for pdf in batches:
            names, numbers = pdf["session_id"].to_numpy(), pdf["_piece"].to_numpy()
            cuts = np.flatnonzero((names[1:] != names[:-1]) | (numbers[1:] != numbers[:-1])) + 1
            bounds = [0, *cuts.tolist(), len(pdf)]
            times, counts, accepted = pdf["_us"].to_numpy(), pdf["_n"].to_numpy(), np.zeros(len(pdf), dtype=np.int64)
            for a, b in zip(bounds, bounds[1:]):
                if a == b:
                    continue
                if (names[a], numbers[a]) != key:
                    key, limiter = (names[a], numbers[a]), _Limiter(max_requests, window_us)
                place = np.repeat(np.arange(a, b), counts[a:b])
                accepted[a:b] = np.bincount(place[limiter.decide(times[place])] - a, minlength=b - a)
            yield pdf[["session_id", "_us"]].assign(_accepted=accepted)[accepted > 0]

    kind = ordered.schema["session_id"].dataType.simpleString()
    accepted = ordered.mapInPandas(run, f"session_id {kind}, _us bigint, _accepted bigint")
    place = F.row_number().over(Window.partitionBy("session_id", "_us").orderBy("request_id"))
    ranked = rows.withColumn("_place", place)
    same = [ranked["session_id"].eqNullSafe(accepted["session_id"]), ranked["_us"].eqNullSafe(accepted["_us"])]
    return ranked.join(accepted, same, "left").select(
        ranked["session_id"], "request_id", "timestamp",
        F.coalesce(F.col("_place") <= F.col("_accepted"), F.lit(False)).alias("allowed"))


def rate_limit_stream(requests: DataFrame, *, max_requests: int = MAX_REQUESTS, window_seconds: int = WINDOW_SECONDS,
                      delay: str = "10 minutes") -> DataFrame:
    """The same on a stream, in the order of events.

    A request waits in the state of its session until the watermark has passed it,
    so one that comes late (within ``delay``) is decided where it belongs and the
    result equals the batch form. A flooded session writes its new requests only;
    besides those of one delay, the state holds the accepted times of a window, for
    as long as they can matter.
    """
    window_us = window_seconds * 1_000_000
    requests = event_time(requests.select("session_id", "request_id", "timestamp"), delay)
    fields = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    out = ", ".join(f"{c} {fields[c]}" for c in ("session_id", "request_id", "timestamp")) + ", allowed boolean"

    def step(key, rows: pd.DataFrame, accepted) -> tuple[pd.DataFrame, list[int]]:
        limiter = _Limiter(max_requests, window_us, accepted or ())
        us = rows["timestamp"].astype("datetime64[us]").astype("int64").to_numpy()
        made = rows[["session_id", "request_id", "timestamp"]].assign(allowed=limiter.decide(us))
        return made, list(limiter.accepted)

    return in_order(requests, "session_id", "request_id", out, step, window_seconds * 1000)
