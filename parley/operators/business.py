"""Satisfaction, engagement and conversion reports."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.kernels import (
    HUNDRED, Distinct, countif, day, dominant, label, rate_pct, ratio, rounded, rows, since, summarise, top_n,
    week_sunday, with_share)
from parley.operators.sessions import session_outcomes

# Report labels of the intent split.
INTENT_SPLIT = {
    "product_search": "Product Search",
    "DIY_advice": "DIY Advice",
    "price_comparison": "Price Comparison",
    "how_to_use": "How-To / Install",
    "complaint": "Complaint",
    "general_info": "General Info",
}
INTENT_SPLIT_OTHER = "Other / Unknown"


def clicks(t, *, as_of, days) -> DataFrame:
    return since(t["chat_events"], as_of, days=days).where("event_type = 'chip_click'")


def review_totals(t) -> DataFrame:
    """Reviews reduced to one row per session, ready to be joined."""
    return t["session_reviews"].groupBy("session_id").agg(
        F.count(F.lit(1)).alias("_reviews"), F.count("stars").alias("_rated"), F.sum("stars").alias("_stars"),
        F.max("stars").alias("_best"), F.count_if(F.col("stars") >= 4).alias("_positive"))


def mean_stars():
    return rounded(ratio(F.sum("_stars"), F.sum("_rated")), 2)


def get_business_satisfaction_daily(t, *, as_of, days=30):
    reviews = since(t["session_reviews"], as_of, days=days)
    return summarise(reviews, {"date": day()}, {
        "avg_stars": rounded(F.avg("stars"), 2),
        "review_count": rows(),
        "positive_count": countif(F.col("stars") >= 4),
        "negative_count": countif(F.col("stars") <= 2),
    }).orderBy("date")


def get_business_satisfaction_summary(t, *, as_of, days=30):
    reviews = since(t["session_reviews"], as_of, days=days)
    return summarise(reviews, {}, {
        "avg_stars": rounded(F.avg("stars"), 2),
        "total_reviews": rows(),
        "positive_reviews": countif(F.col("stars") >= 4),
        "negative_reviews": countif(F.col("stars") <= 2),
        "positive_rate_pct": rate_pct(F.col("stars") >= 4),
        "negative_rate_pct": rate_pct(F.col("stars") <= 2),
    })


def feedback_summary(t, rate: str, *, as_of, days):
    votes = since(t["feedback"], as_of, days=days)
    return summarise(votes, {}, {
        "thumbs_up": countif(F.col("rating") == 1),
        "thumbs_down": countif(F.col("rating") == -1),
        "total_feedback": rows(),
        rate: rate_pct(F.col("rating") == 1),
    })


def get_business_feedback_summary(t, *, as_of, days=30):
    return feedback_summary(t, "positive_rate_pct", as_of=as_of, days=days)


def get_business_chip_clicks_daily(t, *, as_of, days=30):
    return summarise(clicks(t, as_of=as_of, days=days), {"date": day()}, {
        "chip_clicks": rows(), "sessions_with_clicks": Distinct("session_id")}).orderBy("date")


def top_products(t, metrics, *, as_of, days, limit):
    named = clicks(t, as_of=as_of, days=days).where("product_name is not null")
    found = summarise(named, {"product_name": F.col("product_name")}, {"clicks": rows(), **metrics})
    return top_n(found, limit, F.col("clicks").desc(), F.col("product_name"))


def get_business_top_products(t, *, as_of, days=30, limit=10):
    return top_products(t, {"unique_sessions": Distinct("session_id")}, as_of=as_of, days=days, limit=limit)


def get_business_session_outcomes(t, *, as_of, days=30):
    ended = since(session_outcomes(t), as_of, days=days, ts="session_end_at")
    shared = with_share(summarise(ended, {"outcome": F.col("outcome")}, {"sessions": rows()}), "sessions", "pct")
    return shared.orderBy(F.col("sessions").desc(), "outcome")


def get_business_conversion_funnel(t, *, as_of, days=30):
    sessions = since(t["chat_logs"], as_of, days=days).select("session_id").distinct()
    clicked = (clicks(t, as_of=as_of, days=days).select("session_id").distinct()
               .withColumn("_clicked", F.lit(1)))
    both = F.count("_clicked")
    return sessions.join(clicked, "session_id", "left").agg(
        F.count("session_id").alias("total_sessions"), both.alias("sessions_with_click"),
        rounded(ratio(both * F.lit(HUNDRED), F.count("session_id")), 2).alias("click_through_rate_pct"))


def get_business_intent_split(t, *, as_of, days=30, labels=None):
    labels = INTENT_SPLIT if labels is None else labels
    named = F.lit(None).cast("string")
    for intent, text in labels.items():
        named = F.coalesce(named, F.when(F.col("intent") == intent, F.lit(text)))
    logs = since(t["chat_logs"], as_of, days=days)
    grouped = summarise(logs, {"intent_label": F.coalesce(named, F.lit(INTENT_SPLIT_OTHER))}, {"count": rows()})
    return with_share(grouped, "count", "pct").orderBy(F.col("count").desc(), "intent_label")


def _flag_impact(t, flag: str, out: str, *, as_of, days):
    """Sessions split by whether any turn had ``flag``, joined to all of their
    reviews (not limited by date)."""
    logs = since(t["chat_logs"], as_of, days=days)
    flagged = logs.groupBy("session_id").agg((F.count_if(flag) >= 1).alias(out))
    return flagged.join(review_totals(t), "session_id").groupBy(out)


def get_business_frustration_impact(t, *, as_of, days=30):
    return _flag_impact(t, "frustration_signal", "had_frustration", as_of=as_of, days=days).agg(
        F.count(F.lit(1)).alias("sessions"), mean_stars().alias("avg_stars"),
        rounded(ratio(F.sum("_positive") * F.lit(HUNDRED), F.sum("_reviews")), 2).alias("positive_rate_pct"))


def get_business_rec_gap_impact(t, *, as_of, days=30):
    return _flag_impact(t, "rec_gap", "had_rec_gap", as_of=as_of, days=days).agg(
        F.count(F.lit(1)).alias("sessions"), mean_stars().alias("avg_stars"))


def get_business_category_demand(t, *, as_of, days=30):
    logs = since(t["chat_logs"], as_of, days=days)
    grouped = summarise(logs, {"category": label("detected_category", "Unknown")}, {
        "queries": rows(), "unique_sessions": Distinct("session_id")})
    return top_n(with_share(grouped, "queries", "query_share_pct"), 15, F.col("queries").desc(), F.col("category"))


def get_business_session_length_dist(t, *, as_of, days=30):
    logs = since(t["chat_logs"], as_of, days=days)
    turns = logs.groupBy("session_id").agg(F.max("turn_number").alias("max_turn"))
    n = F.col("max_turn")
    depth = (F.when(n == 1, "1 turn").when(n.between(2, 3), "2-3 turns").when(n.between(4, 6), "4-6 turns")
              .when(n.between(7, 10), "7-10 turns").otherwise("11+ turns"))
    grouped = turns.groupBy(depth.alias("session_depth")).agg(
        F.count(F.lit(1)).alias("sessions"), F.min(n).alias("_from"))
    return (with_share(grouped, "sessions", "pct").orderBy(F.col("_from").asc_nulls_first())
            .select("session_depth", "sessions", "pct"))


def get_business_outcome_by_intent(t, *, as_of, days=30):
    logs = since(t["chat_logs"], as_of, days=days)
    main = dominant(logs, "session_id", "intent", "dominant_intent")
    ended = since(session_outcomes(t), as_of, days=days, ts="session_end_at").select("session_id", "outcome")
    grouped = summarise(main.join(ended, "session_id"), {
        "intent": label("dominant_intent", "unknown"), "outcome": F.col("outcome")}, {"sessions": rows()})
    return grouped.orderBy("intent", F.col("sessions").desc(), "outcome")


def get_business_unanswered_impact(t, *, as_of, days=30):
    logs = since(t["chat_logs"], as_of, days=days)
    quality = logs.groupBy("session_id").agg(
        rounded(ratio(F.count_if("is_unanswered"), F.count(F.lit(1))), 2).alias("_rate"))
    r = F.col("_rate")
    bucket = (F.when(r == 0, "No unanswered").when(r < 0.25, "1-25% unanswered")
               .when(r < 0.50, "26-50% unanswered").otherwise("50%+ unanswered"))
    joined = quality.join(review_totals(t), "session_id", "left")
    return (joined.groupBy(bucket.alias("unanswered_bucket"))
            .agg(F.count(F.lit(1)).alias("sessions"), mean_stars().alias("avg_stars"), F.min(r).alias("_from"))
            .orderBy("_from").drop("_from"))


def get_business_positive_sessions(t, *, as_of, days=30):
    good = since(session_outcomes(t), as_of, days=days, ts="session_end_at").where("outcome = 'success'")
    shown = good.select("session_id", "star_rating", "turn_count", "had_chip_click", "frustrated_turns")
    return top_n(shown, 20, F.col("star_rating").desc_nulls_last(), F.col("turn_count").desc_nulls_last(),
                 F.col("session_id"))


def get_business_weekly_volume(t, *, as_of, weeks=8):
    logs = since(t["chat_logs"], as_of, weeks=weeks)
    return summarise(logs, {"week_start": week_sunday()}, {
        "messages": rows(), "sessions": Distinct("session_id")}).orderBy("week_start")


def get_business_engagement_score(t, *, as_of, days=30):
    """One row; each side is reduced to a row per session before the joins."""
    logs = since(t["chat_logs"], as_of, days=days)
    base = logs.groupBy("session_id").agg(
        F.max("turn_number").alias("_depth"), F.count_if("frustration_signal").alias("_frustrated"))
    clicked = clicks(t, as_of=as_of, days=days).select("session_id").distinct().withColumn("_clicked", F.lit(1))
    joined = base.join(clicked, "session_id", "left").join(review_totals(t), "session_id", "left")
    click_pct = ratio(F.count("_clicked") * F.lit(HUNDRED), F.count(F.lit(1)))
    stars = F.avg(F.coalesce(F.col("_best"), F.lit(3)))
    frustration = ratio(F.count_if(F.col("_frustrated") > 0) * F.lit(HUNDRED), F.count(F.lit(1)))
    score = click_pct * 0.30 + ratio(stars - 1, F.lit(4)) * 100 * 0.40 + (F.lit(HUNDRED) - frustration) * 0.30
    return joined.agg(
        F.count(F.lit(1)).alias("sessions"), rounded(click_pct, 2).alias("click_rate_pct"),
        rounded(stars, 2).alias("avg_stars"), rounded(F.avg("_depth"), 1).alias("avg_depth"),
        rounded(frustration, 2).alias("frustration_rate_pct"), rounded(score, 1).alias("engagement_score_0_100"))


def get_business_satisfaction_by_category(t, *, as_of, days=30):
    logs = since(t["chat_logs"], as_of, days=days)
    main = dominant(logs, "session_id", "detected_category", "_top")
    return (main.join(review_totals(t), "session_id")
            .groupBy(label("_top", "Unknown").alias("category"))
            .agg(F.count(F.lit(1)).alias("reviews"), mean_stars().alias("avg_stars"))
            .where(F.col("reviews") >= 3)
            .orderBy(F.col("avg_stars").desc(), "category"))
