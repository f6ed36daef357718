"""Retrieval, model, cost and quality reports over chat_logs."""
from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions.kernels import (
    Derived, Distinct, Rank, avg0, countif, day, first_n_values, int_avg0, label, rate_pct, ratio,
    rounded, rows, since, summarise, top_n, total0, with_share, zero)


def money(column: str, places: int):
    return rounded(total0(column), places)


def per_session_cost(places: int = 6):
    """Cost per session out of helper columns ``_cost`` and ``_sessions``."""
    return Derived(rounded(ratio(F.col("_cost"), F.col("_sessions")), places))


def get_tech_rag_daily(t, *, as_of, days=7):
    logs = since(t["chat_logs"], as_of, days=days)
    return summarise(logs, {"date": day()}, {
        "avg_rag_confidence": avg0("rag_confidence", 4),
        "avg_min_vec_distance": avg0("min_vec_distance", 4),
        "avg_ann_candidates": int_avg0("ann_candidates_count"),
        "rerank_used_pct": rate_pct("rerank_used"),
        "rag_empty_pct": rate_pct("rag_empty"),
    }).orderBy("date")


def get_tech_rag_summary(t, *, as_of, days=7):
    logs = since(t["chat_logs"], as_of, days=days)
    return summarise(logs, {}, {
        "avg_rag_confidence": avg0("rag_confidence", 4),
        "min_rag_confidence": rounded(F.min(zero("rag_confidence")), 4),
        "max_rag_confidence": rounded(F.max(zero("rag_confidence")), 4),
        "avg_min_vec_distance": avg0("min_vec_distance", 4),
        "best_vec_distance": rounded(F.min(zero("min_vec_distance")), 4),
        "rerank_used_pct": rate_pct("rerank_used"),
        "rag_empty_pct": rate_pct("rag_empty"),
        "hallucination_rate_pct": rate_pct("hallucination_flag"),
        "avg_sources_retrieved": int_avg0("sources_count"),
    })


def get_tech_embedding_quality(t, *, as_of, days=7):
    logs = since(t["chat_logs"], as_of, days=days).where("min_vec_distance is not null")
    return summarise(logs, {"date": day()}, {
        "avg_distance": avg0("min_vec_distance", 4),
        "p10_distance": Rank("min_vec_distance", 10, places=4),
        "p90_distance": Rank("min_vec_distance", 90, places=4),
    }).orderBy("date")


def get_tech_token_cost_daily(t, *, as_of, days=7):
    logs = since(t["chat_logs"], as_of, days=days)
    return summarise(logs, {"date": day()}, {
        "total_tokens_in": total0("tokens_in"),
        "total_tokens_out": total0("tokens_out"),
        "avg_tokens_in": int_avg0("tokens_in"),
        "avg_tokens_out": int_avg0("tokens_out"),
        "cost_usd": money("estimated_cost_usd", 6),
    }).orderBy("date")


def get_tech_cost_summary(t, *, as_of, days=7):
    logs = since(t["chat_logs"], as_of, days=days)
    per_request = ratio(F.col("_cost"), F.col("_requests"))
    return summarise(logs, {}, {
        "_cost": total0("estimated_cost_usd"),
        "_requests": rows(),
        "total_cost_usd": money("estimated_cost_usd", 4),
        "cost_per_session_usd": Derived(rounded(ratio(F.col("_cost"), F.col("sessions")), 6)),
        "cost_per_1k_requests_usd": Derived(rounded(per_request * 1000, 4)),
        "total_tokens_in": total0("tokens_in"),
        "total_tokens_out": total0("tokens_out"),
        "sessions": Distinct("session_id"),
    })


def intents(t, *, as_of, days=7):
    logs = since(t["chat_logs"], as_of, days=days)
    return summarise(logs, {"intent": label("intent", "unknown")}, {"count": rows()})


def get_tech_intent_distribution(t, *, as_of, days=7):
    shared = with_share(intents(t, as_of=as_of, days=days), "count", "pct")
    return shared.orderBy(F.col("count").desc(), "intent")


def _daily_rate(t, as_of, days, flag, total, hits, rate):
    logs = since(t["chat_logs"], as_of, days=days)
    return summarise(logs, {"date": day()}, {
        total: rows(), hits: countif(flag), rate: rate_pct(flag)}).orderBy("date")


def get_tech_frustration_trend(t, *, as_of, days=7):
    return _daily_rate(t, as_of, days, "frustration_signal", "messages", "frustrated", "frustration_rate_pct")


def get_tech_hallucination_rate(t, *, as_of, days=7):
    return _daily_rate(t, as_of, days, "hallucination_flag", "messages", "hallucinations", "hallucination_rate_pct")


def get_tech_query_rewrite_rate(t, *, as_of, days=7):
    return _daily_rate(t, as_of, days, "query_rewritten", "total", "rewritten_count", "rewrite_rate_pct")


def catalog_gaps(t, metrics, *, as_of, days, limit):
    logs = since(t["chat_logs"], as_of, days=days).where("is_unanswered")
    by = {"user_message": F.col("user_message"), "category": label("detected_category", "Unknown")}
    found = summarise(logs, by, {"frequency": rows(), **metrics})
    return top_n(found, limit, F.col("frequency").desc(), F.col("user_message"), F.col("category"))


def get_tech_catalog_gaps(t, *, as_of, days=7, limit=15):
    return catalog_gaps(t, {"avg_rag_confidence": avg0("rag_confidence", 4)},
                        as_of=as_of, days=days, limit=limit)


def get_tech_rerank_impact(t, *, as_of, days=7):
    logs = since(t["chat_logs"], as_of, days=days)
    return summarise(logs, {"rerank_used": F.col("rerank_used")}, {
        "messages": rows(),
        "avg_rag_confidence": avg0("rag_confidence", 4),
        "avg_vec_distance": avg0("min_vec_distance", 4),
        "unanswered_rate_pct": rate_pct("is_unanswered"),
    }).orderBy(F.col("rerank_used").desc_nulls_last())


def get_tech_rec_gap_analysis(t, *, as_of, days=7):
    logs = since(t["chat_logs"], as_of, days=days).withColumn("_intent", label("intent", "unknown"))
    counts = summarise(logs, {"intent": F.col("_intent")}, {
        "total": rows(), "rec_gap_count": countif("rec_gap"), "rec_gap_rate_pct": rate_pct("rec_gap")})
    samples = first_n_values(logs, "_intent", "user_intent_target", 5, "sample_targets",
                             "timestamp", "message_id").withColumnRenamed("_intent", "intent")
    return counts.join(samples, "intent", "left").orderBy(F.col("rec_gap_count").desc(), "intent")


def get_tech_context_window_pct(t, *, as_of, days=7, near_limit=0.9):
    logs = since(t["chat_logs"], as_of, days=days)
    return summarise(logs, {}, {
        "avg_context_pct": avg0("context_pct", 3),
        "p95_context_pct": Rank(zero("context_pct"), 95, places=3),
        "max_context_pct": rounded(F.max(zero("context_pct")), 3),
        "near_limit_count": countif(zero("context_pct") > near_limit),
    })


def category_performance(t, metrics, *, as_of, days):
    logs = since(t["chat_logs"], as_of, days=days)
    return summarise(logs, {"category": label("detected_category", "General")}, {
        "requests": rows(),
        "unanswered": countif("is_unanswered"),
        "unanswered_rate_pct": rate_pct("is_unanswered"),
        "avg_rag_confidence": avg0("rag_confidence", 4),
        **metrics,
    }).orderBy(F.col("requests").desc(), "category")


def get_tech_category_performance(t, *, as_of, days=7):
    return category_performance(t, {"avg_vec_distance": avg0("min_vec_distance", 4)}, as_of=as_of, days=days)


def get_tech_dedup_stats(t, *, as_of, days=7):
    logs = since(t["chat_logs"], as_of, days=days)
    return summarise(logs, {"date": day()}, {
        "avg_dedup_removed": int_avg0("dedup_removed_count"),
        "avg_unique_brands": int_avg0("unique_brands_count"),
        "avg_unique_categories": int_avg0("unique_categories_count"),
    }).orderBy("date")
