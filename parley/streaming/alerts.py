"""Windowed alerts and monitoring series; the same functions run on tables and,
up to the island step, on streams.

``metrics`` tables have timestamp, series, value. A window is one alignment
period; "per second" rates divide by its length.
"""
from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.kernels import Rank, event_time, ratio, rounded, summarise
from parley.streaming.ordered import in_order

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The alert policies. Durations, alignments and auto-close in seconds.


@dataclass(frozen=True)
class Policy:
    name: str
    align: int
    aligner: str
    threshold: float
    duration: int = 0
    auto_close: int = 1800
    comparison: str = "gt"
    reducer: str | None = None


POLICIES = {p.name: p for p in [
    Policy("server_errors", 60, "rate", 0.01, 300, reducer="mean"),
    Policy("latency", 60, "p99", 10000, 300, reducer="mean"),
    Policy("database_cpu", 60, "mean", 0.8, 600),
    Policy("database_connections", 60, "mean", 80, 300),
    Policy("insert_errors", 60, "rate", 0, 300, 3600),
    Policy("uptime", 60, "count_false", 1, 120, 1800, "lt"),
    Policy("injection_spike", 300, "sum", 5, 0, 3600),
    Policy("request_flood", 300, "sum", 20, 0, 1800),
    Policy("rerank_errors", 300, "sum", 3, 0, 3600),
]}


PLACES = 6  # decimals that percentiles keep: values may be fractions


def aligned_window(seconds: int, ts: str = "timestamp") -> Column:
    return F.window(ts, f"{seconds} seconds")["start"]


def _aligners(seconds: int) -> dict[str, Callable[[], Column]]:
    v = F.col("value")
    return {
        "sum": lambda: F.sum(v).cast("double"), "mean": lambda: F.avg(v), "max": lambda: F.max(v).cast("double"),
        "rate": lambda: F.sum(v).cast("double") / seconds,
        "count_false": lambda: F.count_if(v == 0).cast("double"),
    }


def align(metrics: DataFrame, seconds: int, aligner: str, by: str = "series") -> DataFrame:
    """One value per series and window: (series, window_start, value).

    ``p95`` and ``p99`` are exact nearest ranks over whole values; on a stream
    they are approximate (one pass).
    """
    start = aligned_window(seconds)
    if aligner.startswith("p"):
        pct = int(aligner[1:])
        if metrics.isStreaming:
            value = F.percentile_approx("value", pct / 100, 10000).cast("double")
            out = metrics.groupBy(F.window("timestamp", f"{seconds} seconds").alias("_w"), by).agg(value.alias("value"))
            return out.select(by, F.col("_w.start").alias("window_start"), "value")
        keyed = metrics.withColumn("_start", start)
        ranked = summarise(keyed, {by: F.col(by), "window_start": F.col("_start")}, {"value": Rank("value", pct, PLACES)})
        return ranked.withColumn("value", F.col("value").cast("double"))
    out = metrics.groupBy(F.window("timestamp", f"{seconds} seconds").alias("_w"), by)
    return out.agg(_aligners(seconds)[aligner]().alias("value")).select(by, F.col("_w.start").alias("window_start"), "value")


def reduce_series(aligned: DataFrame, reducer: str, by: str | None = None) -> DataFrame:
    """Combines the series of each window: sum, mean or max, optionally per group."""
    how = {"sum": F.sum, "mean": F.avg, "max": F.max}[reducer]
    keys = ["window_start", *([by] if by else [])]
    return aligned.groupBy(*keys).agg(rounded(how("value"), 6).alias("value"))


def breaching(aligned: DataFrame, policy: Policy, threshold: float | None = None) -> DataFrame:
    limit = policy.threshold if threshold is None else threshold
    test = F.col("value") > limit if policy.comparison == "gt" else F.col("value") < limit
    return aligned.where(test)


def spikes(metrics: DataFrame, policy: Policy, *, threshold: float | None = None) -> DataFrame:
    """Windows whose sum breaches a policy that fires at once."""
    aligned = align(metrics, policy.align, policy.aligner)
    return breaching(aligned, policy, threshold).select(F.lit(policy.name).alias("policy"), "series", "window_start",
                                                        "value")


def sustained(aligned: DataFrame, policy: Policy, *, threshold: float | None = None, step: int | None = None,
              duration: int | None = None) -> DataFrame:
    """Islands of consecutive breaching windows that last ``duration``.

    The windows of a series are few (one per alignment period), so ordering
    them per series is bounded by time, not by events.
    """
    step = step or policy.align
    need = max(1, -(-(policy.duration if duration is None else duration) // step))
    bad = breaching(aligned, policy, threshold)
    seq = F.row_number().over(Window.partitionBy("series").orderBy("window_start"))
    number = F.floor(F.unix_timestamp(F.col("window_start").cast("timestamp")) / step)
    islands = bad.withColumn("_island", number - seq).groupBy("series", "_island").agg(
        F.min("window_start").alias("started_at"),
        (F.max("window_start") + F.make_dt_interval(secs=F.lit(step))).alias("ended_at"),
        F.count(F.lit(1)).alias("windows"), rounded(F.max("value"), 6).alias("peak"))
    return islands.where(F.col("windows") >= need).drop("_island")


def incidents(islands: DataFrame, auto_close: int) -> DataFrame:
    """Merges islands whose gap is at most ``auto_close`` seconds; an incident
    closes that long after its last breach."""
    w = Window.partitionBy("series").orderBy("started_at")
    gap = F.unix_timestamp(F.col("started_at").cast("timestamp")) - F.unix_timestamp(
        F.lag("ended_at").over(w).cast("timestamp"))
    opened = islands.withColumn("_new", F.coalesce(gap > auto_close, F.lit(True)).cast("int"))
    numbered = opened.withColumn("_n", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("series", "_n").agg(
        F.min("started_at").alias("opened_at"),
        (F.max("ended_at") + F.make_dt_interval(secs=F.lit(auto_close))).alias("closes_at"),
        F.count(F.lit(1)).alias("islands"), F.max("peak").alias("peak")).drop("_n")


def incident_windows(breaches: DataFrame, step: int, auto_close: int) -> DataFrame:
    """Incidents of breaching windows (series, window_start, value) as session windows, on tables and streams.

    A window joins an incident if it begins at most ``auto_close`` seconds after the last
    breaching one ended; the incident closes that long after its last breach.
    """
    gap = f"{(step + auto_close) * 1_000_000 + 1} microseconds"  # a session ends before its gap is over
    session = F.session_window("window_start", gap).alias("_s")
    made = breaches.groupBy("series", session).agg(F.count(F.lit(1)).alias("windows"), rounded(F.max("value"), 6).alias("peak"))
    closes = F.col("_s.end") - F.expr("INTERVAL 1 MICROSECOND")
    return made.select("series", F.col("_s.start").alias("opened_at"), closes.alias("closes_at"), "windows", "peak")


def sustained_windows(aligned: DataFrame, policy: Policy, *, threshold: float | None = None, step: int | None = None,
                      duration: int | None = None) -> DataFrame:
    """The breaching windows (series, window_start, value) of the islands that last ``duration``."""
    step = step or policy.align
    islands = sustained(aligned, policy, threshold=threshold, step=step, duration=duration).select(
        F.col("series").alias("_series"), "started_at", "ended_at")
    bad = breaching(aligned, policy, threshold)
    inside = bad["series"].eqNullSafe(F.col("_series")) & (F.col("window_start") >= F.col("started_at")) & (F.col("window_start") < F.col("ended_at"))
    return bad.join(islands, inside, "left_semi").select("series", "window_start", "value")


# --- held conditions on a stream ---------------------------------------------------

HELD = "series string, window_start timestamp, started_at timestamp, windows int, value double, state string"
FIRING, OVER = "firing", "over"


def aligned_stream(metrics: DataFrame, seconds: int, aligner: str) -> DataFrame:
    """``align`` for a stream with a watermark; ``timestamp`` is the end of the window, with the watermark."""
    value = (F.percentile_approx("value", int(aligner[1:]) / 100, 10000).cast("double") if aligner.startswith("p")
             else _aligners(seconds)[aligner]())
    out = metrics.groupBy("series", F.window("timestamp", f"{seconds} seconds").alias("window")).agg(value.alias("value"))
    return out.select("series", F.window_time("window").alias("timestamp"), F.col("window.start").alias("window_start"), "value")


def held(aligned: DataFrame, policy: Policy, *, threshold: float | None = None) -> DataFrame:
    """Conditions that hold for their duration, on a stream of aligned windows.

    The state of a series is its run of breaching windows: when it began, how many they
    are, the last one. A window that doesn't breach, or one that is missing, ends the
    run. Each breaching window from the one that completes the duration on goes out as
    ``firing``, with the windows before it when it completes; ``over`` tells the end.
    """
    limit = policy.threshold if threshold is None else threshold
    need, above = max(1, -(-policy.duration // policy.align)), policy.comparison == "gt"
    step_us = policy.align * 1_000_000
    names = [f.split()[0] for f in HELD.split(", ")]

    def rows(key, made: list) -> pd.DataFrame:
        out = pd.DataFrame([(key[0], *m) for m in made], columns=names)
        for c in ("window_start", "started_at"):
            out[c] = pd.to_datetime(out[c], unit="us")
        return out

    def step(key, windows: pd.DataFrame, carried) -> tuple[pd.DataFrame, tuple]:
        # a run: when it began, the number of its windows, the last one, and the first ones until it fires
        start, n, last, first = carried or (None, 0, None, [])
        made = []
        starts = windows["window_start"].astype("datetime64[us]").astype("int64").tolist()
        for at, value in zip(starts, windows["value"].tolist()):
            bad = value is not None and (value > limit if above else value < limit)
            if n and (not bad or at != last + step_us):
                if n >= need:
                    made.append((last, start, n, None, OVER))
                n, first = 0, []
            if bad:
                start, n, last = (start, n + 1, at) if n else (at, 1, at)
                if n < need:
                    first = [*first, (at, value)]
                else:
                    made += [(a, start, n, v, FIRING) for a, v in [*first, (at, value)]]
                    first = []
        return rows(key, made), (start, n, last, first)

    def end(key, carried) -> pd.DataFrame:
        start, n, last, _ = carried
        return rows(key, [(last, start, n, None, OVER)] if n >= need else [])

    return in_order(aligned, "series", "window_start", HELD, step, 2 * policy.align * 1000, end, "window_start")


def held_incidents(aligned: DataFrame, policy: Policy, *, threshold: float | None = None) -> DataFrame:
    """Incidents on a stream: session windows over the windows of held conditions."""
    firing = held(aligned, policy, threshold=threshold).where(F.col("state") == FIRING)
    return incident_windows(firing, policy.align, policy.auto_close)


def with_lateness(metrics: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return event_time(metrics, delay)


# --- the monitoring page -----------------------------------------------------------

# Fixed values: (aligner, reducer) of each chart; None keeps the series apart.
CHARTS = {
    "request_rate": ("rate", "sum"),
    "latency_p95": ("p95", "mean"),
    "instances": ("max", "sum"),
    "memory_p95": ("p95", "mean"),
    "database_cpu": ("mean", None),
    "database_connections": ("mean", None),
    "insert_errors": ("rate", None),
    "database_memory": ("mean", None),
}


def chart(metrics: DataFrame, name: str, *, seconds: int = 60, by: str | None = None) -> DataFrame:
    """Series of one chart: aligned per series, then combined. ``by`` keeps a
    label of the metrics (one value per series) as a group."""
    aligner, reducer = CHARTS[name]
    if by is None:
        aligned = align(metrics, seconds, aligner)
        return aligned if reducer is None else reduce_series(aligned, reducer)
    keyed = metrics.withColumn("_pair", F.struct(by, "series"))
    aligned = align(keyed, seconds, aligner, "_pair").select("window_start", F.col(f"_pair.{by}").alias(by), "value")
    return reduce_series(aligned, reducer, by)


# --- rolling summary -----------------------------------------------------------------

ROLLING = 1000
NO_CATEGORY = "General / Conversational"


def newest(chat_logs: DataFrame, n: int = ROLLING) -> DataFrame:
    """The newest turns that reached an answer; blocked ones never enter the live buffer."""
    blocked = F.coalesce("prompt_injection_flag", F.lit(False)) | F.coalesce("vulgar_flag", F.lit(False))
    return chat_logs.where(~blocked).orderBy(F.col("timestamp").desc(), F.col("message_id").desc()).limit(n)


def _picked(values: Column, pct: int) -> Column:
    """Value at floor(n * pct / 100) of the ordered values, 0 when empty."""
    ordered = F.array_sort(values)
    n = F.size(ordered)
    place = F.least(F.floor(n * pct / F.lit(100)), n - 1) + 1
    return F.when(n > 0, F.element_at(ordered, place.cast("int"))).otherwise(F.lit(0)).cast("bigint")


def rolling_summary(chat_logs: DataFrame, n: int = ROLLING) -> DataFrame:
    """One row over the newest ``n`` turns. Zero and NULL timings, tokens and
    costs are left out of their averages, as in the live summary."""
    turns = newest(chat_logs, n)
    rows = F.count(F.lit(1))

    def some(c: str) -> Column:
        return F.when(F.col(c) != 0, F.col(c))

    def pct(flag: str | Column) -> Column:
        hit = F.count_if(F.col(flag) if isinstance(flag, str) else flag)
        return rounded(ratio(hit, rows) * 100, 1)

    def mean(c: Column) -> Column:
        return F.coalesce(F.floor(F.avg(c)), F.lit(0)).cast("bigint")

    def per_turn(c: str, places: int) -> Column:
        return rounded(ratio(F.sum(F.coalesce(F.col(c), F.lit(0))), rows), places)

    steps = []
    for step in ("embed", "db", "rag", "llm", "ttft"):
        c = some(f"{step}_ms")
        steps += [mean(c).alias(f"{step}_avg_ms"), _picked(F.collect_list(c), 95).alias(f"{step}_p95_ms")]
    latency = F.collect_list("latency_ms")
    cost = some("estimated_cost_usd")
    return turns.agg(
        rows.alias("requests_sampled"),
        rounded((1 - ratio(F.count_if("is_unanswered"), rows)) * 100, 1).alias("containment_rate_pct"),
        pct("is_unanswered").alias("unanswered_rate_pct"), pct("llm_error").alias("error_rate_pct"),
        *[_picked(latency, p).alias(f"latency_p{p}_ms") for p in (50, 95, 99)],
        mean(F.col("latency_ms")).alias("latency_avg_ms"), *steps,
        rounded(F.avg(some("rag_confidence")), 4).alias("avg_confidence_score"),
        pct("rag_empty").alias("empty_results_rate_pct"), pct("price_filter_used").alias("price_filter_usage_rate_pct"),
        mean(some("tokens_in")).alias("avg_input_tokens"), mean(some("tokens_out")).alias("avg_output_tokens"),
        F.coalesce(rounded(F.avg(cost), 6), F.lit(0.0)).alias("avg_cost_per_request_usd"),
        F.coalesce(rounded(F.sum(cost), 4), F.lit(0.0)).alias("total_estimated_cost_usd"),
        rounded(F.avg("turn_number"), 1).alias("avg_turn_number"), pct(F.col("turn_number") == 1).alias("turn_1_rate_pct"),
        pct(F.col("turn_number") >= 3).alias("turn_3plus_rate_pct"), pct("wellbeing_triggered").alias("wellbeing_rate_pct"),
        pct("hallucination_flag").alias("hallucination_flag_rate_pct"),
        per_turn("dedup_removed_count", 2).alias("avg_dedup_removed"),
        per_turn("unique_brands_count", 2).alias("avg_unique_brands"),
        per_turn("unique_categories_count", 2).alias("avg_unique_categories"),
        per_turn("context_pct", 1).alias("avg_context_pct"),
        F.max(F.coalesce(F.col("context_pct"), F.lit(0.0))).alias("max_context_pct"))


def rolling_errors(chat_logs: DataFrame, n: int = ROLLING) -> DataFrame:
    found = newest(chat_logs, n).where("llm_error_type is not null and llm_error_type <> ''")
    return found.groupBy(F.col("llm_error_type").alias("error_type")).agg(F.count(F.lit(1)).alias("count"))


def rolling_categories(chat_logs: DataFrame, n: int = ROLLING) -> DataFrame:
    name = F.coalesce(F.when(F.col("detected_category") != "", F.col("detected_category")), F.lit(NO_CATEGORY))
    grouped = newest(chat_logs, n).groupBy(name.alias("category")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("is_unanswered").alias("unanswered"))
    rate = rounded(ratio(F.col("unanswered"), F.col("requests")) * 100, 1)
    return grouped.withColumn("unanswered_rate_pct", rate).orderBy(F.col("requests").desc(), "category")
