"""Reliability, latency and safety reports over chat_logs."""
from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from parley.functions.kernels import (
    Distinct, Rank, countif, day, int_avg, int_avg0, label, moment, null_if_empty, rate_pct,
    rounded, rows, since, summarise, top_n, with_share, zero)


def unanswered(include_scope_rejected: bool = False):
    """The two readings of "unanswered" found in the reports."""
    flag = F.col("is_unanswered")
    return flag | F.col("scope_rejected") if include_scope_rejected else flag


def get_devops_daily(t, *, as_of, days=7, include_scope_rejected=False):
    logs = since(t["chat_logs"], as_of, days=days)
    return summarise(logs, {"date": day()}, {
        "requests": rows(),
        "sessions": Distinct("session_id"),
        "errors": countif("llm_error"),
        "error_rate_pct": rate_pct("llm_error"),
        "p50_latency_ms": Rank("latency_ms", 50),
        "p95_latency_ms": Rank("latency_ms", 95),
        "avg_ttft_ms": int_avg0("ttft_ms"),
        "p95_ttft_ms": Rank(zero("ttft_ms"), 95),
        "unanswered_rate_pct": rate_pct(unanswered(include_scope_rejected)),
        "vulgar_blocks": countif("vulgar_flag"),
        "injection_blocks": countif("prompt_injection_flag"),
    }).orderBy("date")


def get_devops_summary(t, *, as_of, days=7, include_scope_rejected=False):
    logs = since(t["chat_logs"], as_of, days=days)
    return summarise(logs, {}, {
        "total_requests": rows(),
        "total_sessions": Distinct("session_id"),
        "total_errors": countif("llm_error"),
        "error_rate_pct": rate_pct("llm_error"),
        "p50_latency_ms": Rank("latency_ms", 50),
        "p95_latency_ms": Rank("latency_ms", 95),
        "avg_latency_ms": int_avg(F.col("latency_ms")),
        "avg_ttft_ms": int_avg0("ttft_ms"),
        "p95_ttft_ms": Rank(zero("ttft_ms"), 95),
        "unanswered_rate_pct": rate_pct(unanswered(include_scope_rejected)),
        "total_vulgar_blocks": countif("vulgar_flag"),
        "total_injection_blocks": countif("prompt_injection_flag"),
    })


def get_devops_latency_percentiles(t, *, as_of, days=7):
    logs = since(t["chat_logs"], as_of, days=days)
    ranks = {f"p{p}_ms": Rank("latency_ms", p) for p in (25, 50, 75, 95, 99)}
    return summarise(logs, {"date": day()}, ranks).orderBy("date")


def get_devops_ttft_trend(t, *, as_of, days=7):
    logs = since(t["chat_logs"], as_of, days=days)
    return summarise(logs, {"date": day()}, {
        "avg_ttft_ms": int_avg0("ttft_ms"),
        "p95_ttft_ms": Rank(zero("ttft_ms"), 95),
        "avg_llm_ms": int_avg0("llm_ms"),
    }).orderBy("date")


def error_types(t, *, as_of, days=7):
    logs = since(t["chat_logs"], as_of, days=days).where("llm_error")
    return summarise(logs, {"error_type": label("llm_error_type", "unknown")}, {"count": rows()})


def get_devops_error_types(t, *, as_of, days=7):
    shared = with_share(error_types(t, as_of=as_of, days=days), "count", "pct")
    return shared.orderBy(F.col("count").desc(), "error_type")


def get_devops_security_events(t, *, as_of, days=7):
    logs = since(t["chat_logs"], as_of, days=days)
    patterns = F.slice(F.array_sort(F.collect_set("injection_pattern")), 1, 5)
    return summarise(logs, {"date": day()}, {
        "injection_attempts": countif("prompt_injection_flag"),
        "vulgar_blocks": countif("vulgar_flag"),
        "top_injection_patterns": null_if_empty(patterns),
    }).orderBy("date")


def _daily_rate(t, as_of, days, flag, total, hits, rate):
    logs = since(t["chat_logs"], as_of, days=days)
    return summarise(logs, {"date": day()}, {
        total: rows(), hits: countif(flag), rate: rate_pct(flag)}).orderBy("date")


def get_devops_unanswered_trend(t, *, as_of, days=7):
    return _daily_rate(t, as_of, days, "is_unanswered", "total_messages", "unanswered", "unanswered_rate_pct")


def get_devops_scope_rejections(t, *, as_of, days=7):
    return _daily_rate(t, as_of, days, "scope_rejected", "total", "scope_rejections", "rejection_rate_pct")


def get_devops_session_activity(t, *, as_of, days=7):
    logs = since(t["chat_logs"], as_of, days=days)
    return summarise(logs, {"date": day()}, {
        "sessions": Distinct("session_id"),
        "avg_turn_number": rounded(F.avg("turn_number"), 1),
        "avg_message_length": int_avg(F.col("message_length")),
        "avg_response_length": int_avg(F.col("response_length")),
    }).orderBy("date")


def get_devops_recent_errors(t, *, as_of, hours=24):
    logs = since(t["chat_logs"], as_of, hours=hours).where("llm_error")
    shown = logs.select("message_id", "session_id", "timestamp",
                        label("llm_error_type", "unknown").alias("error_type"),
                        F.left("user_message", F.lit(120)).alias("user_message_preview"))
    return top_n(shown, 20, F.col("timestamp").desc(), F.col("message_id"))


def get_devops_cold_start_proxy(t, *, as_of, days=7):
    logs = since(t["chat_logs"], as_of, days=days).where("ttft_ms > 5000").where("turn_number = 1")
    return summarise(logs, {"date": day()}, {
        "slow_first_turns": rows(), "avg_ttft_ms": int_avg(F.col("ttft_ms"))}).orderBy("date")


def get_devops_weekly_comparison(t, *, as_of):
    logs = since(t["chat_logs"], as_of, days=14)
    week = moment(logs, as_of - timedelta(days=7))
    period = F.when(F.col("timestamp") >= week, "current_week").otherwise("prior_week")
    return summarise(logs, {"period": period}, {
        "requests": rows(),
        "sessions": Distinct("session_id"),
        "error_rate_pct": rate_pct("llm_error"),
        "p95_latency_ms": Rank("latency_ms", 95),
        "unanswered_rate_pct": rate_pct("is_unanswered"),
    }).orderBy(F.col("period").desc())
