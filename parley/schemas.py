"""Declared table schemas. Times are UTC; money is decimal."""
from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"s": T.StringType(), "i": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(),
          "t": T.TimestampNTZType(), "date": T.DateType(), "int": T.IntegerType(), "short": T.ShortType(),
          "money": T.DecimalType(10, 2), "rating": T.DecimalType(3, 2)}


def struct_of(text: str, required: str = "") -> T.StructType:
    must = set(required.split())
    pairs = (field.split(":") for field in text.split())
    return T.StructType([T.StructField(n, _TYPES[t], n not in must) for n, t in pairs])


SOURCE = struct_of("id:s name:s price:d category:s")
SOURCES = T.ArrayType(SOURCE)
MESSAGE = struct_of("role:s content:s")
HISTORY = T.ArrayType(MESSAGE)
ITEM = struct_of("product_id:s name:s quantity:int price:money")
ITEMS = T.ArrayType(ITEM)

CHAT_LOGS = struct_of(
    """session_id:s message_id:s timestamp:t user_message:s assistant_response:s sources_used:s message_length:i
    response_length:i latency_ms:i embed_ms:i db_ms:i rag_ms:i llm_ms:i ttft_ms:i embed_model:s tokens_in:i tokens_out:i
    estimated_cost_usd:d llm_error:b llm_error_type:s sources_count:i rag_confidence:d min_vec_distance:d
    ann_candidates_count:i rag_empty:b detected_category:s price_filter_used:b price_filter_value:d query_rewritten:b
    dedup_removed_count:i unique_brands_count:i unique_categories_count:i is_unanswered:b hallucination_flag:b
    wellbeing_triggered:b context_pct:d turn_number:i session_started_at:t scope_rejected:b rerank_used:b
    prompt_injection_flag:b injection_pattern:s vulgar_flag:b vulgar_pattern:s intent:s frustration_signal:b
    frustration_reason:s user_intent_target:s rec_gap:b""",
    "session_id message_id timestamp user_message assistant_response")
FEEDBACK = struct_of("message_id:s session_id:s timestamp:t rating:i user_message:s assistant_response:s turn_number:i"
                   " detected_category:s", "message_id session_id timestamp rating")
CHAT_EVENTS = struct_of("event_type:s session_id:s timestamp:t message_id:s product_id:s product_name:s product_price:d"
                      " product_category:s", "event_type session_id timestamp")
SESSION_REVIEWS = struct_of("session_id:s timestamp:t stars:i turn_count:i unanswered_count:i",
                          "session_id timestamp stars")
PRODUCTS = struct_of("id:s sku:s name:s description:s category:s brand:s price:money original_price:money stock:int"
                   " rating:rating review_count:int image_url:s is_featured:b specifications:s created_at:t", "sku")
PRODUCT_REVIEWS = struct_of("id:s product_id:s sku:s stars:short title:s body:s author:s review_date:date verified:b"
                          " created_at:t", "sku stars")
USERS = struct_of("id:s email:s hashed_password:s full_name:s is_active:b is_admin:b created_at:t", "email")
METADATA = struct_of("sku:s name:s price:d category:s brand:s avg_rating:d review_count:i")
KNOWLEDGE = T.StructType([
    T.StructField("doc_type", T.StringType(), False), T.StructField("source_id", T.StringType(), False),
    T.StructField("content", T.StringType(), False), T.StructField("metadata", METADATA),
    T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("created_at", T.TimestampNTZType())])
ORDERS = T.StructType([
    *struct_of("id:s user_id:s status:s").fields, T.StructField("items", ITEMS),
    *struct_of("subtotal:money tax:money shipping:money total:money shipping_address:s created_at:t").fields])

FAQ_FILE = struct_of("question:s answer:s category:s")
REVIEW = struct_of("stars:int title:s body:s author:s date:s verified:b")
REVIEW_FILE = T.StructType([
    *struct_of("sku:s name:s category:s brand:s price:d catalog_rating:d generated_avg:d").fields,
    T.StructField("reviews", T.ArrayType(REVIEW))])
CHAT_REQUEST = T.StructType([
    *struct_of("message:s session_id:s").fields, T.StructField("history", HISTORY),
    *struct_of("session_started_at:t").fields])
