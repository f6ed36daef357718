"""Dashboard and endpoint variants of the reports. Each differs from the named
reports in its column list, its limits or its reading of a flag."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.kernels import (
    HUNDRED, Distinct, Rank, avg0, countif, day, int_avg, int_avg0, rate_pct, ratio, rounded, rows,
    since, summarise, top_n, total0, with_share)
from parley.operators import business as biz
from parley.operators import devops, tech
from parley.operators.tech import money, per_session_cost

SOURCES = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("price", T.StringType())]))


def devops_summary(t, *, as_of, days=7):
    logs = since(t["chat_logs"], as_of, days=days)
    return summarise(logs, {}, {
        "total_requests": rows(), "total_sessions": Distinct("session_id"),
        "error_rate_pct": rate_pct("llm_error"),
        "p50_latency_ms": Rank("latency_ms", 50), "p95_latency_ms": Rank("latency_ms", 95),
        "avg_ttft_ms": int_avg0("ttft_ms"),
        "unanswered_rate_pct": rate_pct("is_unanswered"),
        "scope_rejected_rate_pct": rate_pct("scope_rejected"),
        "vulgar_blocks": countif("vulgar_flag"), "injection_blocks": countif("prompt_injection_flag"),
    })


def devops_daily(t, *, as_of, days=7):
    logs = since(t["chat_logs"], as_of, days=days)
    return summarise(logs, {"date": day()}, {
        "requests": rows(), "sessions": Distinct("session_id"),
        "error_rate_pct": rate_pct("llm_error"),
        "p50_latency_ms": Rank("latency_ms", 50), "p95_latency_ms": Rank("latency_ms", 95),
        "avg_ttft_ms": int_avg0("ttft_ms"),
        "unanswered_rate_pct": rate_pct("is_unanswered"),
        "scope_rejected_rate_pct": rate_pct("scope_rejected"),
    }).orderBy("date")


def devops_error_types(t, *, as_of, days=7):
    return devops.error_types(t, as_of=as_of, days=days).orderBy(F.col("count").desc(), "error_type")


def _infra(requests, sessions, errors):
    return {
        requests: rows(), sessions: Distinct("session_id"), errors: countif("llm_error"),
        "error_rate_pct": rate_pct("llm_error"),
        "p95_latency_ms": Rank("latency_ms", 95), "p50_latency_ms": Rank("latency_ms", 50),
        "avg_latency_ms": int_avg(F.col("latency_ms")),
    }


def devops_infra_daily(t, *, as_of, days=14):
    logs = since(t["chat_logs"], as_of, days=days)
    return summarise(logs, {"date": day()}, _infra("requests", "sessions", "errors")).orderBy("date")


def devops_infra_summary(t, *, as_of, days=14):
    logs = since(t["chat_logs"], as_of, days=days)
    return summarise(logs, {}, _infra("total_requests", "total_sessions", "total_errors"))


def tech_summary(t, *, as_of, days=7):
    logs = since(t["chat_logs"], as_of, days=days)
    return summarise(logs, {}, {
        "_cost": total0("estimated_cost_usd"), "_sessions": Distinct("session_id"),
        "avg_rag_confidence": avg0("rag_confidence", 4),
        "frustration_rate_pct": rate_pct("frustration_signal"),
        "rec_gap_rate_pct": rate_pct("rec_gap"),
        "total_cost_usd": money("estimated_cost_usd", 4),
        "cost_per_session_usd": per_session_cost(),
        "citation_gap_rate_pct": rate_pct("hallucination_flag"),
        "rerank_used_pct": rate_pct("rerank_used"),
        "avg_turn_number": rounded(F.avg(F.coalesce(F.col("turn_number"), F.lit(1))), 1),
        "avg_sources_count": avg0("sources_count", 1),
        "query_rewritten_rate_pct": rate_pct("query_rewritten"),
        "wellbeing_triggered_count": countif("wellbeing_triggered"),
        "avg_tokens_in": int_avg0("tokens_in"), "avg_tokens_out": int_avg0("tokens_out"),
        "avg_context_pct": avg0("context_pct", 2),
        "rag_empty_rate_pct": rate_pct("rag_empty"),
        "price_filter_rate_pct": rate_pct("price_filter_used"),
        "avg_ann_candidates": int_avg0("ann_candidates_count"),
        "avg_unique_brands": avg0("unique_brands_count", 1),
    })


def tech_daily(t, *, as_of, days=7):
    logs = since(t["chat_logs"], as_of, days=days)
    return summarise(logs, {"date": day()}, {
        "avg_rag_confidence": avg0("rag_confidence", 4),
        "frustration_rate_pct": rate_pct("frustration_signal"),
        "rec_gap_rate_pct": rate_pct("rec_gap"),
        "cost_usd": money("estimated_cost_usd", 6),
    }).orderBy("date")


def tech_latency_breakdown(t, *, as_of, days=7):
    logs = since(t["chat_logs"], as_of, days=days)
    parts = {f"avg_{part}_ms": int_avg0(f"{part}_ms") for part in ("embed", "db", "llm")}
    return summarise(logs, {"date": day()}, parts).orderBy("date")


def tech_intents(t, *, as_of, days=7):
    return tech.intents(t, as_of=as_of, days=days).orderBy(F.col("count").desc(), "intent")


def tech_gaps(t, *, as_of, days=7, limit=15):
    return tech.catalog_gaps(t, {}, as_of=as_of, days=days, limit=limit)


def tech_model_daily(t, *, as_of, days=14):
    logs = since(t["chat_logs"], as_of, days=days)
    return summarise(logs, {"date": day()}, {
        "cost_usd": money("estimated_cost_usd", 6),
        "avg_ttft_ms": int_avg0("ttft_ms"), "avg_llm_ms": int_avg0("llm_ms"),
        "unanswered_rate_pct": rate_pct(devops.unanswered(True)),
        "avg_rag_confidence": avg0("rag_confidence", 4),
        "avg_tokens_in": int_avg0("tokens_in"), "avg_tokens_out": int_avg0("tokens_out"),
    }).orderBy("date")


def tech_model_summary(t, *, as_of, days=14):
    logs = since(t["chat_logs"], as_of, days=days)
    mean_cost = F.avg(F.coalesce(F.col("estimated_cost_usd"), F.lit(0)))
    return summarise(logs, {}, {
        "total_cost_usd": money("estimated_cost_usd", 4),
        "cost_per_1k_requests_usd": rounded(mean_cost * 1000, 4),
        "p95_ttft_ms": Rank("ttft_ms", 95), "avg_ttft_ms": int_avg0("ttft_ms"),
        "unanswered_rate_pct": rate_pct(devops.unanswered(True)),
        "avg_rag_confidence": avg0("rag_confidence", 4),
        "citation_gap_rate_pct": rate_pct("hallucination_flag"),
        "avg_tokens_in": int_avg0("tokens_in"), "avg_tokens_out": int_avg0("tokens_out"),
    })


def tech_category_performance(t, *, as_of, days=14):
    return tech.category_performance(t, {}, as_of=as_of, days=days)


def _satisfaction(t, columns, *, as_of, days):
    full = biz.get_business_satisfaction_summary(t, as_of=as_of, days=days)
    return full.select(*columns)


def biz_sat_summary(t, *, as_of, days=30):
    return _satisfaction(t, ["avg_stars", "total_reviews", "positive_rate_pct"], as_of=as_of, days=days)


def biz_sat_daily(t, *, as_of, days=30):
    return biz.get_business_satisfaction_daily(t, as_of=as_of, days=days).select("date", "avg_stars")


def biz_sat_full_summary(t, *, as_of, days=30):
    columns = ["avg_stars", "total_reviews", "positive_reviews", "positive_rate_pct"]
    return _satisfaction(t, columns, as_of=as_of, days=days)


def biz_feedback(t, *, as_of, days=30):
    return biz.feedback_summary(t, "thumbs_up_rate_pct", as_of=as_of, days=days).select("thumbs_up_rate_pct")


def biz_feedback_full(t, *, as_of, days=30):
    return biz.get_business_feedback_summary(t, as_of=as_of, days=days)


def conversion_daily(t, *, as_of, days=30):
    """Sessions with clicks against all sessions per day."""
    clicked = biz.get_business_chip_clicks_daily(t, as_of=as_of, days=days)
    logs = since(t["chat_logs"], as_of, days=days)
    totals = summarise(logs, {"date": day()}, {"total_sessions": Distinct("session_id")})
    rate = rounded(ratio(F.col("sessions_with_clicks") * F.lit(HUNDRED), F.col("total_sessions")), 2)
    return (clicked.join(totals, "date", "left").withColumn("conversion_rate_pct", rate)
            .select("date", "chip_clicks", "sessions_with_clicks", "total_sessions", "conversion_rate_pct")
            .orderBy("date"))


def biz_conversion(t, *, as_of, days=30):
    return conversion_daily(t, as_of=as_of, days=days).select("date", "conversion_rate_pct")


def biz_conversion_raw(t, *, as_of, days=30):
    return biz.get_business_chip_clicks_daily(t, as_of=as_of, days=days)


def biz_top_products(t, *, as_of, days=30, limit=10):
    return biz.top_products(t, {}, as_of=as_of, days=days, limit=limit)


def biz_category_demand(t, *, as_of, days=30):
    logs = since(t["chat_logs"], as_of, days=days).where("detected_category is not null")
    grouped = summarise(logs, {"category": F.col("detected_category")}, {"requests": rows()})
    return top_n(with_share(grouped, "requests", "pct", 1), 12, F.col("requests").desc(), F.col("category"))


def biz_outcomes(t, *, as_of, days=30):
    return biz.get_business_session_outcomes(t, as_of=as_of, days=days)


def overview(t, *, as_of, days=7):
    logs = since(t["chat_logs"], as_of, days=days)
    return summarise(logs, {}, {
        "total_messages": rows(), "unique_sessions": Distinct("session_id"),
        "avg_message_length": F.avg("message_length"),
        "avg_response_length": F.avg("response_length"),
        "avg_sources_per_response": F.avg("sources_count"),
        "messages_without_rag": countif(F.col("sources_count") == 0),
        "messages_with_rag": countif(F.col("sources_count") > 0),
    })


def top_questions(t, *, as_of, days=7, limit=20):
    logs = since(t["chat_logs"], as_of, days=days)
    found = summarise(logs, {"user_message": F.col("user_message")}, {
        "frequency": rows(), "avg_rag_sources": F.avg("sources_count")})
    return top_n(found, limit, F.col("frequency").desc(), F.col("user_message"))


def daily_volume(t, *, as_of, days=30):
    logs = since(t["chat_logs"], as_of, days=days)
    return summarise(logs, {"date": day()}, {
        "messages": rows(), "sessions": Distinct("session_id")}).orderBy(F.col("date").desc())


def rag_performance(t, *, as_of, days=7):
    logs = since(t["chat_logs"], as_of, days=days)
    grouped = summarise(logs, {"sources_count": F.col("sources_count")}, {"message_count": rows()})
    return with_share(grouped, "message_count", "percentage").orderBy("sources_count")


def top_products_mentioned(t, *, as_of, days=7, limit=10):
    logs = since(t["chat_logs"], as_of, days=days)
    sources = logs.select(F.explode(F.from_json("sources_used", SOURCES)).alias("s"))
    found = summarise(sources, {"product_name": F.col("s.name"), "price": F.col("s.price")}, {"mentions": rows()})
    return top_n(found, limit, F.col("mentions").desc(), F.col("product_name"), F.col("price"))


# --- the reports an analytics agent asks for ------------------------------------

def agent_devops_daily(t, *, as_of, days=7):
    return devops.get_devops_daily(t, as_of=as_of, days=days, include_scope_rejected=True)


def agent_devops_summary(t, *, as_of, days=7):
    return devops.get_devops_summary(t, as_of=as_of, days=days, include_scope_rejected=True)


def agent_tech_daily(t, *, as_of, days=7):
    logs = since(t["chat_logs"], as_of, days=days)
    return summarise(logs, {"date": day()}, {
        "avg_rag_confidence": avg0("rag_confidence", 4), "avg_min_vec_distance": avg0("min_vec_distance", 4),
        "avg_tokens_in": int_avg0("tokens_in"), "avg_tokens_out": int_avg0("tokens_out"),
        "cost_usd": money("estimated_cost_usd", 6),
        "frustration_rate_pct": rate_pct("frustration_signal"),
        "rerank_used_pct": rate_pct("rerank_used"), "rec_gap_rate_pct": rate_pct("rec_gap"),
        "avg_ann_candidates": int_avg0("ann_candidates_count"),
    }).orderBy("date")


def agent_tech_summary(t, *, as_of, days=7):
    logs = since(t["chat_logs"], as_of, days=days)
    return summarise(logs, {}, {
        "_cost": total0("estimated_cost_usd"), "_sessions": Distinct("session_id"),
        "avg_rag_confidence": avg0("rag_confidence", 4), "avg_min_vec_distance": avg0("min_vec_distance", 4),
        "total_tokens_in": total0("tokens_in"), "total_tokens_out": total0("tokens_out"),
        "total_cost_usd": money("estimated_cost_usd", 4), "cost_per_session_usd": per_session_cost(),
        "frustration_rate_pct": rate_pct("frustration_signal"),
        "rerank_used_pct": rate_pct("rerank_used"), "rec_gap_rate_pct": rate_pct("rec_gap"),
        "citation_gap_rate_pct": rate_pct("hallucination_flag"),
    })


def agent_intents(t, *, as_of, days=7):
    return tech.get_tech_intent_distribution(t, as_of=as_of, days=days)


def agent_gaps(t, *, as_of, days=7):
    return tech_gaps(t, as_of=as_of, days=days, limit=15)


def agent_satisfaction_daily(t, *, as_of, days=30):
    return biz.get_business_satisfaction_daily(t, as_of=as_of, days=days)


def agent_satisfaction_summary(t, *, as_of, days=30):
    columns = ["avg_stars", "total_reviews", "positive_reviews", "negative_reviews", "positive_rate_pct"]
    return _satisfaction(t, columns, as_of=as_of, days=days)


def agent_conversion(t, *, as_of, days=30):
    return conversion_daily(t, as_of=as_of, days=days)


def agent_top_products(t, *, as_of, days=30):
    return biz_top_products(t, as_of=as_of, days=days, limit=10)


def agent_outcomes(t, *, as_of, days=30):
    return biz.get_business_session_outcomes(t, as_of=as_of, days=days)


def agent_feedback(t, *, as_of, days=30):
    return biz.feedback_summary(t, "thumbs_up_rate_pct", as_of=as_of, days=days)
