"""Builds the chat_logs fact out of raw chat turns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import schemas
from parley.functions.kernels import rounded
from parley.functions.segments import BLOCKS, LastKnown, Previous, TotalBefore, minute_segment, with_state
from parley.operators import detectors as d

# Routes in guard order.
INJECTION, VULGAR, WELLBEING, ENDING, ANSWER = "injection", "vulgar", "wellbeing", "session_end", "answer"

# Inputs that may be absent; they become NULL columns of the stated type.
OPTIONAL = {
    "latency_ms": "bigint", "embed_ms": "bigint", "db_ms": "bigint", "rag_ms": "bigint", "llm_ms": "bigint",
    "ttft_ms": "bigint", "embed_model": "string", "llm_error_type": "string", "rag_confidence": "double",
    "min_vec_distance": "double", "ann_candidates_count": "bigint", "rag_empty": "boolean",
    "dedup_removed_count": "bigint", "unique_brands_count": "bigint", "unique_categories_count": "bigint",
    "rerank_used": "boolean", "session_started_at": "timestamp_ntz", "intent_text": "string",
    "target_text": "string", "intent_tokens_in": "bigint", "intent_tokens_out": "bigint",
}


def with_optional(turns: DataFrame) -> DataFrame:
    missing = {n: F.lit(None).cast(t) for n, t in OPTIONAL.items() if n not in turns.columns}
    out = turns.withColumns(missing) if missing else turns
    return out if "search_query" in out.columns else out.withColumn("search_query", F.col("user_message"))


def parse_sources(column: str = "retrieved_sources") -> Column:
    return F.from_json(F.col(column), schemas.SOURCES)


def with_history(turns: DataFrame) -> DataFrame:
    """Adds ``last_reply``, ``turn_number`` and ``history_chars``.

    Requests that carry their history are read row by row; otherwise the state
    comes from the earlier turns of the session.
    """
    if "history" in turns.columns:
        chars = F.aggregate(F.transform("history", lambda m: F.length(m["content"])), F.lit(0), lambda a, n: a + n)
        replies = F.size(F.filter("history", lambda m: m["role"] == "assistant"))
        return turns.withColumns({
            "last_reply": d.last_reply(F.col("history")),
            "turn_number": (F.greatest(replies, F.lit(0)) + 1).cast("bigint"),
            "history_chars": F.coalesce(chars, F.lit(0)).cast("bigint")})
    size = F.length("user_message") + F.length("assistant_response")
    out = with_state(turns, "session_id", ["timestamp", "message_id"], minute_segment(), {
        "last_reply": LastKnown(F.col("assistant_response")), "_turns": TotalBefore(F.lit(1)),
        "history_chars": TotalBefore(size)})
    return out.withColumn("turn_number", (F.col("_turns") + 1).cast("bigint")).drop("_turns")


def turn_numbers(messages: DataFrame, key: str, position: str, segment: Column) -> DataFrame:
    """Turn number of each user message in a long (key, position, role) table:
    one more than the assistant messages before it."""
    replied = (F.col("role") == "assistant").cast("int")
    out = with_state(messages, key, [position], segment, {"_replies": TotalBefore(replied)}, BLOCKS)
    return (out.where("role = 'user'").withColumn("turn_number", (F.col("_replies") + 1).cast("bigint"))
               .drop("_replies"))


def with_route(turns: DataFrame) -> DataFrame:
    """Adds the guard results and the route of each turn."""
    low, reply = F.col("_low"), F.col("_low_reply")
    lowered = turns.withColumns({"_low": F.lower("user_message"), "_low_reply": F.lower("last_reply")})
    out = lowered.withColumns({
        "_injection": d.injection_label(low, F.length("user_message")), "_vulgar": d.vulgar_label(low),
        "_wellbeing": d.wellbeing(low), "_ending": d.session_ending(low, reply)}).drop("_low", "_low_reply")
    route = (F.when(F.col("_injection").isNotNull(), INJECTION).when(F.col("_vulgar").isNotNull(), VULGAR)
              .when(F.col("_wellbeing"), WELLBEING).when(F.col("_ending"), ENDING).otherwise(ANSWER))
    return out.withColumn("route", route)


def with_replies(turns: DataFrame, replies: dict[str, str] | None) -> DataFrame:
    """Replaces the response of guarded turns by the canned text of the route."""
    if not replies:
        return turns
    text = F.coalesce(*[F.when(F.col("route") == r, F.lit(x)) for r, x in replies.items()],
                      F.col("assistant_response"))
    return turns.withColumn("assistant_response", text)


def with_quality(turns: DataFrame) -> DataFrame:
    """Adds the fields that follow from a single answered turn."""
    answered, response = F.col("route") == ANSWER, F.col("assistant_response")
    raw, low = F.col("retrieved_sources"), F.col("_low_response")
    none = F.array().cast(schemas.SOURCES)
    lowered = turns.withColumns({"_low_response": F.lower(response), "_low_query": F.lower("search_query")})
    final = F.when(answered, F.coalesce(d.mentioned(raw, low), none)).otherwise(none)
    out = lowered.withColumn("_final", final).withColumn("sources_count", F.size("_final").cast("bigint"))
    unanswered = answered & d.is_unanswered(low, F.col("sources_count"))
    out = out.withColumn("is_unanswered", F.coalesce(unanswered, F.lit(False)))
    searched = answered & raw.isNotNull()
    t_in = d.tokens_in(F.col("user_message"), F.col("history_chars"), d.printed_chars(raw))
    return out.withColumns({
        "sources_used": F.to_json("_final"),
        "message_length": F.length("user_message").cast("bigint"),
        "response_length": F.length(response).cast("bigint"),
        "scope_rejected": F.when(answered, d.scope_rejected(low)),
        "hallucination_flag": F.when(answered, d.citation_gap(raw, low)),
        "detected_category": F.when(searched, d.category(F.col("_low_query"))),
        "price_filter_value": F.when(searched, d.price_limit(F.col("_low_query"))),
        "tokens_in": F.when(answered, t_in), "tokens_out": F.when(answered, d.tokens_out(response)),
        "user_intent_target": d.intent_target(F.col("target_text")),
        "intent": d.intent_label(F.coalesce(F.col("intent_text"), F.lit(""))),
    }).drop("_low_response", "_low_query")


def with_frustration(turns: DataFrame) -> DataFrame:
    """Adds frustration signal and reason. Blocked turns never reach the answer
    buffer, so the previous "unanswered" skips them; the previous message does
    not. Expects logged turns only."""
    reached = ~F.col("route").isin(INJECTION, VULGAR)
    out = with_state(turns, "session_id", ["timestamp", "message_id"], minute_segment(), {
        "_previous": Previous(F.col("user_message")),
        "_previous_unanswered": LastKnown(F.when(reached, F.col("is_unanswered")))})
    lowered = out.withColumns({"_low": F.lower("user_message"), "_low_previous": F.lower("_previous")})
    reason = d.frustration_reason(F.col("_low"), F.col("_low_previous"), F.col("_previous_unanswered"))
    out = lowered.withColumn("frustration_reason", reason).drop(
        "_low", "_low_previous", "_previous", "_previous_unanswered")
    return out.withColumn("frustration_signal", F.col("frustration_reason").isNotNull())


def enrich_turns(turns: DataFrame, *, replies: dict[str, str] | None = None,
                 prices: dict[str, float] | None = None) -> DataFrame:
    """Raw turns to the chat_logs schema. Session-ending turns are not logged.

    ``turns`` has session_id, message_id, timestamp, user_message,
    assistant_response and retrieved_sources (NULL: nothing was searched), and
    any of the optional measurements and classifier outputs.
    """
    routed = with_replies(with_route(with_history(with_optional(turns))), replies)
    return shape_logs(with_frustration(with_quality(routed.where(F.col("route") != ENDING))), prices)


# Measurements that only an answered turn has.
ONLY_ANSWERED = [c for c in OPTIONAL if c != "latency_ms" and c in schemas.CHAT_LOGS.fieldNames()]


def shape_logs(logged: DataFrame, prices: dict[str, float] | None = None) -> DataFrame:
    """The chat_logs columns of logged turns: each route fills its own fields."""
    route = F.col("route")
    answered, timed = route == ANSWER, route.isin(ANSWER, WELLBEING)
    cost = rounded(d.call_cost(F.col("tokens_in"), F.col("tokens_out"), prices), 8)
    labels_cost = d.intent_cost(F.col("intent_tokens_in"), F.col("intent_tokens_out"), prices)

    made = {
        "latency_ms": F.when(timed, F.col("latency_ms")).otherwise(F.lit(0)),
        "turn_number": F.when(timed, F.col("turn_number")),
        "llm_error": F.when(answered, F.col("llm_error_type").isNotNull()),
        "price_filter_used": F.when(answered, F.col("price_filter_value").isNotNull()),
        "query_rewritten": F.when(answered, F.lit(False)),
        "wellbeing_triggered": F.when(timed, route == WELLBEING),
        "prompt_injection_flag": F.when(route == INJECTION, F.lit(True)).when(answered, F.lit(False)),
        "injection_pattern": F.col("_injection"),
        "vulgar_flag": F.when(route == VULGAR, F.lit(True)),
        "vulgar_pattern": F.when(route == VULGAR, F.col("_vulgar")),
        "estimated_cost_usd": rounded(F.when(answered, cost).otherwise(F.lit(0.0)) + labels_cost, 8),
        "context_pct": F.when(answered, d.context_pct(F.col("tokens_in"))),
        "rec_gap": d.rec_gap(F.col("user_intent_target"), F.col("_final"), F.col("is_unanswered")),
    }
    made |= {c: F.when(answered, F.col(c)) for c in ONLY_ANSWERED}
    return logged.select(*[made.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
                           for f in schemas.CHAT_LOGS.fields])
