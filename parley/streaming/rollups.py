"""Daily roll-ups that merge: a period is answered from days, not from turns.

Counts and sums add up; distinct sessions and latency ranks are kept as
sketches and are therefore approximate (HLL about 1 %, KLL about 1 % of rank).
The exact reports remain the reference; roll-ups serve long periods.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.kernels import HUNDRED, day, event_time, ratio, rounded

COUNTS = {"errors": "llm_error", "unanswered": "is_unanswered", "scope_rejections": "scope_rejected",
           "vulgar_blocks": "vulgar_flag", "injection_blocks": "prompt_injection_flag",
           "frustrated": "frustration_signal", "rec_gaps": "rec_gap"}


def rollup_columns():
    return [F.count(F.lit(1)).alias("requests"),
            *[F.count_if(F.col(c)).alias(n) for n, c in COUNTS.items()],
            F.sum(F.coalesce("ttft_ms", F.lit(0))).alias("ttft_sum"),
            F.sum(F.coalesce("estimated_cost_usd", F.lit(0.0))).alias("cost_sum"),
            F.hll_sketch_agg("session_id").alias("sessions_sketch"),
            F.expr("kll_sketch_agg_bigint(latency_ms)").alias("latency_sketch")]


def daily_rollup(chat_logs: DataFrame) -> DataFrame:
    return chat_logs.groupBy(day().alias("date")).agg(*rollup_columns())


def daily_rollup_stream(chat_logs: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The same on a stream: a day is emitted once the watermark has passed it."""
    daily = event_time(chat_logs, delay).groupBy(F.window("timestamp", "1 day").alias("_w"))
    return daily.agg(*rollup_columns()).withColumn("date", F.to_date("_w.start")).drop("_w")


def period_from_rollup(rollup: DataFrame) -> DataFrame:
    """One summary row over all days of ``rollup``."""
    n = F.sum("requests")
    rates = [rounded(ratio(F.sum(c) * F.lit(HUNDRED), n), 2).alias(f"{c}_rate_pct") for c in COUNTS]
    merged = rollup.agg(
        n.alias("requests"), *[F.sum(c).alias(c) for c in COUNTS], *rates,
        F.round(ratio(F.sum("ttft_sum"), n)).cast("bigint").alias("avg_ttft_ms"),
        rounded(F.sum("cost_sum"), 4).alias("total_cost_usd"),
        F.hll_sketch_estimate(F.hll_union_agg("sessions_sketch")).alias("approx_sessions"),
        F.expr("kll_merge_agg_bigint(latency_sketch)").alias("_latency"))
    quantiles = [F.expr(f"kll_sketch_get_quantile_bigint(_latency, {p / 100}D)").alias(f"approx_p{p}_latency_ms")
                 for p in (50, 95)]
    return merged.select("*", *quantiles).drop("_latency")


def checked_period(chat_logs: DataFrame, *, sessions_error: float = 0.05, rank_error: float = 0.02) -> DataFrame:
    """The period from roll-ups, with each sketch replaced by whether it holds its bound.

    ``sessions_within`` compares with the exact number of sessions; ``p50_within`` and
    ``p95_within`` ask whether the share of latencies up to the estimate is within
    ``rank_error`` of the rank asked for (ties may take it above).
    """
    rolled = period_from_rollup(daily_rollup(chat_logs))
    exact = chat_logs.agg(F.count_distinct("session_id").alias("_sessions"), F.count("latency_ms").alias("_n"))
    known = chat_logs.join(rolled.select("approx_p50_latency_ms", "approx_p95_latency_ms"), F.lit(True))
    ranks = known.agg(*[F.count_if(F.col("latency_ms") < F.col(f"approx_p{p}_latency_ms")).alias(f"_below{p}") for p in (50, 95)],
                      *[F.count_if(F.col("latency_ms") <= F.col(f"approx_p{p}_latency_ms")).alias(f"_upto{p}") for p in (50, 95)])
    out = rolled.join(exact, F.lit(True)).join(ranks, F.lit(True))
    within = [(F.abs(F.col("approx_sessions") - F.col("_sessions")) <= F.col("_sessions") * sessions_error).alias("sessions_within"),
              *[((F.col(f"_below{p}") <= F.col("_n") * (p / 100 + rank_error)) & (F.col(f"_upto{p}") >= F.col("_n") * (p / 100 - rank_error)))
                .alias(f"p{p}_within") for p in (50, 95)]]
    plain = [c for c in rolled.columns if not c.startswith("approx_")]
    return out.select(*plain, *within)
