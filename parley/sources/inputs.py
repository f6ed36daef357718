"""Further inputs derived from the bridge tables for the non-report operators."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.documents import metadata
from parley.operators.enrich import parse_sources
from parley.operators.orders import price


def texts(t) -> DataFrame:
    """Every text of the data: chat messages, conversation turns, documents."""
    turns = t["chat_turns_raw"].select(F.col("message_id").alias("text_id"), F.col("user_message").alias("body"))
    talk = t["conversations"].select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("text_id"),
                                     F.col("text").alias("body"))
    docs = t["documents"].select(F.concat(F.lit("d"), "doc_id").alias("text_id"), F.col("text").alias("body"))
    return turns.unionByName(talk).unionByName(docs)


def raw_turns(t) -> DataFrame:
    """Raw turns with parsed sources, measurements and outside model outputs."""
    k = F.col("k")
    label = (F.when(k % 9 == 1, "Product_Lookup.").when(k % 9 == 2, "project_advice, I think")
              .when(k % 9 == 3, "compatibility").when(k % 9 == 4, " pricing_availability ")
              .when(k % 9 == 5, "troubleshooting").when(k % 9 == 6, "general_chat").when(k % 9 >= 7, "other"))
    target = (F.when(k % 4 == 0, "general").when(k % 4 == 1, F.concat(F.lit("P"), (k % 10).cast("string"), F.lit(" tool")))
               .when(k % 4 == 2, "deck lumber").otherwise(""))
    return t["chat_turns_raw"].select(
        "session_id", "message_id", "timestamp", "user_message", "assistant_response",
        parse_sources().alias("retrieved_sources"),
        F.floor(F.col("value") * 100).cast("bigint").alias("latency_ms"), k.cast("bigint").alias("embed_ms"),
        F.floor(F.col("value") * 40).cast("bigint").alias("ttft_ms"),
        F.when(F.col("event_type") == "error", "Timeout").alias("llm_error_type"),
        F.when(k % 13 != 0, k * 0.01).alias("rag_confidence"), label.alias("intent_text"), target.alias("target_text"),
        (k + 40).cast("bigint").alias("intent_tokens_in"), (k % 5).cast("bigint").alias("intent_tokens_out"))


# --- knowledge base ----------------------------------------------------------------

def knowledge_base(t) -> DataFrame:
    meta = metadata(sku=F.lit(None), name=F.col("name"), price=F.col("price"), category=F.col("category"),
                    brand=F.col("brand"))
    return t["kb"].select("doc_type", "source_id", "content", meta.alias("metadata"), "embedding")


def search_queries(t) -> DataFrame:
    """Every distinct user message, with the mean vector of one label."""
    size = t["embeddings"].select("label", F.posexplode("embedding").alias("i", "x"))
    means = size.groupBy("label", "i").agg(F.round(F.avg("x"), 8).alias("m"))
    vectors = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))),
                                                     lambda p: p["m"].cast("double")).alias("embedding"))
    asked = t["chat_turns_raw"].groupBy("user_message").agg(F.min(F.col("k") % 10).alias("label"))
    return asked.join(vectors, "label").select(
        F.col("user_message").alias("query_id"), F.col("user_message").alias("query_text"), "embedding")


def ranker_scores(t, found: DataFrame) -> DataFrame:
    """Scores of an outside ranker for the candidates of about half of the queries."""
    value = t["kb"].select("doc_type", "source_id", ((F.col("vec_id") * 7919) % 1009).cast("double").alias("rerank_score"))
    short = found.where(F.md5("query_id") < "8").select("query_id", "doc_type", "source_id")
    return short.join(value, ["doc_type", "source_id"])


def faqs(t) -> DataFrame:
    return t["documents"].select(
        F.col("doc_id").alias("position"), F.concat(F.lit("What about "), "lang", F.lit("?")).alias("question"),
        F.col("text").alias("answer"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("category"))


REVIEW_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate"]


def raw_reviews(t) -> DataFrame:
    """Reviews as they arrive from a file, some of them incomplete."""
    n = F.col("l_linenumber")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return t["lineitem"].select(
        F.concat(F.lit("SKU-"), F.col("l_partkey") + 50).alias("sku"),
        F.when(n < 7, F.col("l_quantity").cast("int") % 5 + 1).alias("stars"),
        F.when(F.col("l_suppkey") % 9 > 0, F.concat(F.lit("T"), "l_returnflag")).alias("title"),
        F.concat(F.lit("body "), F.col("l_orderkey").cast("string"), F.lit(" "), F.repeat("l_returnflag", F.lit(250)))
        .alias("body"),
        F.when(n != 6, F.concat(F.lit("A"), F.col("l_suppkey") % 5)).alias("author"),
        F.when(n == 5, F.left(day, F.lit(7))).otherwise(day).alias("date"),
        F.when(n > 1, F.col("l_linestatus") == "O").alias("verified"), *REVIEW_ORDER)


def stored_documents(t) -> DataFrame:
    """Documents already stored, one per text."""
    return t["documents"].select(
        F.lit("doc").alias("doc_type"), F.col("doc_id").cast("string").alias("source_id"), F.col("text").alias("content"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00'").alias("created_at"))


def incoming_documents(t) -> DataFrame:
    """New versions: one per vector, then one per label row."""
    vectors = t["embeddings"].select(F.col("vec_id").alias("n"), F.concat(F.lit("vector of label "), "label").alias("content"),
                                     F.lit(1).alias("version"))
    labels = t["labels"].select(F.col("doc_id").alias("n"), F.concat(F.lit("quality "), "quality").alias("content"),
                                F.lit(2).alias("version"))
    both = vectors.unionByName(labels)
    return both.select(F.lit("doc").alias("doc_type"), (F.col("n") * 3).cast("string").alias("source_id"), "content",
                       "version")


# --- commerce -----------------------------------------------------------------------

def change_feed(t) -> DataFrame:
    """Product changes out of order lines; later lines win."""
    op = F.when(F.col("l_returnflag") == "A", "create").when(F.col("l_linenumber") == 3, "delete").otherwise("update")
    return t["lineitem"].select(
        (F.col("l_partkey") * 2).alias("id"), op.alias("op"),
        F.concat(F.lit("SKU-"), F.col("l_orderkey").cast("string")).alias("sku"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("price"), *REVIEW_ORDER)


def cart_log(t) -> DataFrame:
    """Cart events: one cart per supplier, items by part, one event per line."""
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    action = (F.when((n == 7) & (q == 50), "clear").when((n == 5) & (q < 10), "remove")
               .when(F.col("l_returnflag") == "R", "update").otherwise("add"))
    position = (F.col("l_orderkey") * 8 + n) * 1_000_000 + F.pmod(F.floor(F.col("l_extendedprice") * 100), F.lit(1_000_000))
    return t["lineitem"].select(
        F.col("l_suppkey").alias("cart"), (F.col("l_partkey") % 40).alias("item"), action.alias("action"),
        F.when(action == "update", q % 7 - 1).otherwise(q).alias("quantity"),
        price(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        position.cast("bigint").alias("position"))


def status_updates(t) -> DataFrame:
    n = F.col("l_linenumber")
    status = (F.when(n == 1, "pending").when(n == 2, "confirmed").when(n == 3, "shipped").when(n == 4, "delivered")
               .when(n == 5, "cancelled").when(n == 6, "lost"))
    return t["lineitem"].select(F.col("l_orderkey").alias("order_id"), status.alias("status"), "l_shipdate", n)


def stored_orders(t) -> DataFrame:
    return t["orders"].select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
                              F.lit("pending").alias("status"), F.col("o_totalprice").cast("decimal(12,2)").alias("total"),
                              F.col("o_orderdate").alias("created_at"))


def item_lists(t) -> DataFrame:
    """Orders whose items are JSON text, one list per order line."""
    each = price(F.col("l_extendedprice") / F.col("l_quantity"))
    text = F.concat(F.lit('[{"product_id":"'), F.col("l_partkey").cast("string"), F.lit('","name":"P'),
                    F.col("l_partkey").cast("string"), F.lit('","quantity":'), F.col("l_quantity").cast("int").cast("string"),
                    F.lit(',"price":'), each.cast("string"), F.lit('},{"product_id":"s'), F.col("l_suppkey").cast("string"),
                    F.lit('","name":"S","quantity":1,"price":2.50}]'))
    return t["lineitem"].select("l_orderkey", "l_linenumber", "l_extendedprice", text.alias("items"))


def registrations(t) -> tuple[DataFrame, DataFrame]:
    """Every customer registers, two per address; one address in three may be a user's already."""
    users = t["users"].select("email")
    again = t["customer"].select(
        F.concat(F.lit("u"), (F.floor(F.col("c_custkey") / 2) * 3).cast("string"), F.lit("@example.com")).alias("email"),
        F.col("c_name").alias("full_name"), "c_custkey")
    return users, again


# --- monitoring -----------------------------------------------------------------------

def latency_metrics(t) -> DataFrame:
    return t["chat_logs"].select("timestamp", F.regexp_extract("session_id", r"^s(\d+)-", 1).alias("series"),
                                 F.col("latency_ms").alias("value"), F.when(F.col("llm_error"), "5xx").otherwise("2xx")
                                 .alias("response_class"))


def error_metrics(t) -> DataFrame:
    return t["chat_logs"].select("timestamp", F.lit("chat").alias("series"), F.col("llm_error").cast("int").alias("value"))


def flag_metrics(t, flag) -> DataFrame:
    return t["chat_logs"].select("timestamp", F.lit("chat").alias("series"),
                                 F.coalesce(flag, F.lit(False)).cast("int").alias("value"))


def requests(t) -> DataFrame:
    """One request per event, all users of an event type as one busy session."""
    return t["events"].select(F.col("event_type").alias("session_id"), F.col("event_id").alias("request_id"),
                              F.col("ts").alias("timestamp"))
