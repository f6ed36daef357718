"""Session outcomes: one row per distinct session review."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.kernels import ratio, rounded

SUCCESS, FAILURE, OPEN = "success", "failure", "inconclusive"


def session_outcomes(t, *, dedup: bool = False) -> DataFrame:
    """Outcome of every reviewed session.

    By default the turn counts carry the multiplication that a plain join of
    events, feedback and turns on the session would produce; ``dedup`` gives
    true counts. Each child table is reduced to one row per session before it
    is joined, so the multiplication is arithmetic, not rows.
    """
    key = ["session_id", "timestamp", "stars", "turn_count", "unanswered_count"]
    reviews = t["session_reviews"].groupBy(*key).agg(F.count(F.lit(1)).alias("_copies"))
    events = t["chat_events"].groupBy("session_id").agg(
        F.count(F.lit(1)).alias("_events"), F.count_if(F.col("event_type") == "chip_click").alias("_clicks"))
    feedback = t["feedback"].groupBy("session_id").agg(
        F.count_distinct("message_id").alias("_messages"), F.count(F.lit(1)).alias("_feedback"),
        F.avg("rating").alias("_rating"))
    logs = t["chat_logs"].groupBy("session_id").agg(
        F.count_if("frustration_signal").alias("_frustrated"), F.count_if("rec_gap").alias("_gaps"))

    joined = (reviews.join(events, "session_id", "left")
                     .join(feedback, "session_id", "left")
                     .join(logs, "session_id", "left"))

    def many(c: str):
        return F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(1))

    factor = F.lit(1) if dedup else many("_events") * many("_feedback") * F.col("_copies")
    shaped = joined.select(
        "session_id", F.col("timestamp").alias("session_end_at"), F.col("stars").alias("star_rating"),
        "turn_count", "unanswered_count",
        ratio(F.col("unanswered_count"), F.col("turn_count")).alias("_failing"),
        (F.coalesce(F.col("_clicks"), F.lit(0)) > 0).alias("had_chip_click"),
        F.coalesce(F.col("_messages"), F.lit(0)).alias("feedback_count"),
        rounded(F.col("_rating"), 2).alias("avg_message_feedback"),
        (F.coalesce(F.col("_frustrated"), F.lit(0)) * factor).cast("bigint").alias("frustrated_turns"),
        (F.coalesce(F.col("_gaps"), F.lit(0)) * factor).cast("bigint").alias("rec_gap_turns"),
    )
    stars = F.col("star_rating")
    outcome = (F.when(stars >= 4, SUCCESS)
                .when(F.col("had_chip_click") & (stars.isNull() | (stars >= 3)), SUCCESS)
                .when(stars <= 2, FAILURE)
                .when(F.col("_failing") > 0.5, FAILURE)
                .when(F.col("frustrated_turns") >= 2, FAILURE)
                .otherwise(OPEN))
    return shaped.select(
        "session_id", "session_end_at", "star_rating", "turn_count", "unanswered_count",
        rounded(F.col("_failing"), 3).alias("failure_rate"), "had_chip_click", "feedback_count",
        "avg_message_feedback", "frustrated_turns", "rec_gap_turns", outcome.alias("outcome"))


def session_detail(t, *, session_id: str) -> DataFrame:
    """All logged turns of one session in time order."""
    shown = ["message_id", "timestamp", "user_message", "assistant_response", "sources_used", "sources_count"]
    return (t["chat_logs"].where(F.col("session_id") == session_id)
            .select(*shown).orderBy("timestamp", "message_id"))
