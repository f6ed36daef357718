"""Every operator as a query over the test tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.kernels import day, since
from parley.functions.segments import block_segment
from parley.operators import detectors as d
from parley.operators import catalog, documents, enrich, halves, orders, retrieve, sessions, sketches, status, vectorindex, wordindex
from parley.plans import bundles
from parley.plans.registry import ALL, NAMED, VARIANTS
from parley.session import new_folder
from parley.sources import inputs, tables
from parley.sources.buckets import BucketedTable
from parley.sources.bridge import AS_OF, bridge
from parley.streaming import alerts, maintained, ratelimit, rollups

Query = Callable[[SparkSession, str], DataFrame]
SPANS = {"days": 30, "hours": 48, "weeks": 8}
# Reports that read the turn number; all others are made without it.
BY_TURN = {"get_devops_session_activity", "get_devops_cold_start_proxy", "get_business_session_length_dist",
           "get_business_engagement_score", "tech_summary"}


def flat(df: DataFrame) -> DataFrame:
    """Arrays of strings as one string, so that results compare as plain values."""
    cols = [F.array_join(F.col(f.name), "|").alias(f.name) if isinstance(f.dataType, T.ArrayType)
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def _report(name: str) -> Query:
    op = ALL[name]
    params = {p: v for p, v in SPANS.items() if p in op.parameters}
    return bridge(lambda t: flat(op(t, as_of=AS_OF, **params)), turn_numbers=name in BY_TURN)


def reports() -> dict[str, Query]:
    return {name: _report(name) for name in (*NAMED, *VARIANTS)}


def _sketched_percentiles(t) -> DataFrame:
    """Whether each daily latency percentile made with sketches is within 1 % of its rank."""
    found = ALL["get_devops_latency_percentiles"](t, as_of=AS_OF, days=30, approximate=True)
    logs = since(t["chat_logs"], AS_OF, days=30).withColumn("date", day())
    return sketches.ranks_within(logs, found, "date", "latency_ms", {f"p{p}_ms": p for p in (25, 50, 75, 95, 99)})


def _sketched_volume(t) -> DataFrame:
    """Daily volume with its sessions counted by sketches, against the exact ones."""
    report = ALL["daily_volume"]
    found, exact = (report(t, as_of=AS_OF, days=30, approximate=a) for a in (True, False))
    return sketches.numbers_within(found, exact, "date", {"sessions": 0.04})


def sketched_queries() -> dict[str, Query]:
    return {
        "sketched_latency_percentiles": bridge(_sketched_percentiles, turn_numbers=False),
        "sketched_daily_volume": bridge(_sketched_volume, turn_numbers=False),
        "sketched_outcome_by_intent": bridge(lambda t: ALL["get_business_outcome_by_intent"](
            t, as_of=AS_OF, days=30, approximate=True), turn_numbers=False),
    }


def _first_session(t) -> DataFrame:
    """Detail of the first session by name (its id is looked up, one row)."""
    first = t["chat_logs"].select(F.min("session_id")).scalar()
    return sessions.session_detail(t, session_id=first)


def _weekly(t) -> DataFrame:
    """One-row sections of the weekly run in long form."""
    made = bundles.weekly_run(t, as_of=AS_OF, days=30)
    parts = [status.long_form(sections[s]).withColumn("audience", F.lit(name)) for name, sections in made.items()
             for s in ("summary", "satisfaction_summary", "feedback_summary") if s in sections]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def session_queries() -> dict[str, Query]:
    return {
        "session_outcomes": bridge(sessions.session_outcomes, turn_numbers=False),
        "session_outcomes_dedup": bridge(lambda t: sessions.session_outcomes(t, dedup=True), turn_numbers=False),
        "session_detail": bridge(_first_session),
        "dashboard_status": bridge(lambda t: status.dashboard_status(t, as_of=AS_OF)),
        "report_status": bridge(lambda t: status.report_status(t, as_of=AS_OF), turn_numbers=False),
        "distance_trend": bridge(lambda t: status.distance_trend(t, as_of=AS_OF), turn_numbers=False),
        "conversion_trend": bridge(lambda t: status.conversion_trend(t, as_of=AS_OF), turn_numbers=False),
        "biz_conversion_mean": bridge(lambda t: status.mean_conversion(t, as_of=AS_OF), turn_numbers=False),
        "intent_display_names": bridge(lambda t: status.named_intents(t, as_of=AS_OF), turn_numbers=False),
        "weekly_run": bridge(_weekly, turn_numbers=False),
    }


def _labelled(flag: str, name: str, label) -> Query:
    return bridge(lambda t: d.detect(inputs.texts(t), "body", {name: label}).drop("body")
                  .withColumn(flag, F.col(name).isNotNull()))


def _routed(t) -> DataFrame:
    return enrich.with_route(enrich.with_history(enrich.with_optional(inputs.raw_turns(t))))


def _logged(t) -> DataFrame:
    return enrich.with_quality(_routed(t).where(F.col("route") != enrich.ENDING))


def enrichment_queries() -> dict[str, Query]:
    def body(make, name):
        return bridge(lambda t: flat(d.detect(inputs.texts(t), "body", {name: make}).drop("body")))

    return {
        "wellbeing_flag": body(d.wellbeing, "wellbeing"),
        "vulgar_flag": _labelled("vulgar_flag", "vulgar_pattern", d.vulgar_label),
        "injection_flag": _labelled("prompt_injection_flag", "injection_pattern",
                                    lambda low: d.injection_label(low, F.length("body"))),
        "category_detection": body(d.category, "detected_category"),
        "price_extraction": body(d.price_limit, "price_limit"),
        "keyword_lists": body(d.keyword_list, "keywords"),
        "turn_routes": bridge(lambda t: _routed(t).select(
            "message_id", "route", F.col("_injection").alias("injection_pattern"),
            F.col("_vulgar").alias("vulgar_pattern"), F.col("_wellbeing").alias("wellbeing"),
            F.col("_ending").alias("session_ending"))),
        "session_ending_flag": bridge(lambda t: _routed(t).select(
            "message_id", F.col("_ending").alias("session_ending"))),
        "answer_quality": bridge(lambda t: _logged(t).select(
            "message_id", "sources_count", "is_unanswered", "scope_rejected", "hallucination_flag",
            d.rec_gap(F.col("user_intent_target"), F.col("_final"), F.col("is_unanswered")).alias("rec_gap"),
            "intent", "user_intent_target")),
        "frustration_flag": bridge(lambda t: enrich.with_frustration(_logged(t)).select(
            "message_id", "frustration_signal", "frustration_reason")),
        "tokens_and_cost": bridge(lambda t: enrich.enrich_turns(inputs.raw_turns(t)).select(
            "message_id", "tokens_in", "tokens_out", "estimated_cost_usd", "context_pct")),
        "enrich_turns": bridge(lambda t: enrich.enrich_turns(inputs.raw_turns(t))),
        "conversation_turns": bridge(lambda t: enrich.turn_numbers(
            t["conversations"], "conv_id", "turn", block_segment("turn")).select(
            "conv_id", "turn", "text", "turn_number")),
    }


def _meta(df: DataFrame) -> DataFrame:
    """Document rows with the metadata fields as columns."""
    return df.select("doc_type", "source_id", "content", "metadata.*")


def _found(t, k: int = retrieve.CANDIDATES_WITHOUT_RANKER) -> DataFrame:
    return retrieve.candidates(retrieve.prepare_queries(inputs.search_queries(t)), inputs.knowledge_base(t), k=k)


def _plain(df: DataFrame) -> DataFrame:
    rounded = {c: F.round(c, 6) for c in ("vec_dist", "keyword_bonus", "hybrid_score") if c in df.columns}
    return df.withColumns(rounded)


def _retrieval(t, scored: bool) -> retrieve.Retrieval:
    queries_, kb = inputs.search_queries(t), inputs.knowledge_base(t)
    scores = inputs.ranker_scores(t, _found(t, retrieve.CANDIDATES)) if scored else None
    return retrieve.retrieve(queries_, kb, scores=scores)


def _context_lines(t) -> DataFrame:
    made = _retrieval(t, False).contexts
    return made.select("query_id", "context", F.to_json("sources").alias("sources"))


def _loaded(t) -> DataFrame:
    return documents.load_reviews(t["product_reviews"], inputs.raw_reviews(t), t["products"], *inputs.REVIEW_ORDER)


def _upserted(t) -> DataFrame:
    now = F.expr("timestamp_ntz '2024-01-31 00:00:00'")
    return documents.upsert_documents(inputs.stored_documents(t), inputs.incoming_documents(t), "version", now=now)


def _changed_in_buckets(t, stored: DataFrame, incoming: DataFrame, keys: list[str], merge) -> DataFrame:
    """``stored`` as a table of buckets, after a change that rewrites the buckets it touches."""
    table = BucketedTable(t.spark, new_folder(t.spark, "buckets"), keys, stored.schema)
    table.create(stored, 32)
    table.change(incoming, merge)
    return table.read()


def _upserted_in_buckets(t) -> DataFrame:
    now = F.expr("timestamp_ntz '2024-01-31 00:00:00'")
    return _changed_in_buckets(t, inputs.stored_documents(t), inputs.incoming_documents(t), ["doc_type", "source_id"],
                               lambda old, new: documents.upsert_documents(old, new, "version", now=now))


def _products_in_buckets(t) -> DataFrame:
    return _changed_in_buckets(t, t["products"].select("id", "sku", "price"), inputs.change_feed(t), ["id"],
                               lambda old, new: catalog.apply_changes(old, new, *inputs.REVIEW_ORDER))


def _statuses_in_buckets(t) -> DataFrame:
    updates = inputs.status_updates(t).withColumnRenamed("order_id", "id")
    return _changed_in_buckets(t, inputs.stored_orders(t), updates, ["id"], lambda old, new: orders.apply_statuses(
        old, new.withColumnRenamed("id", "order_id"), "l_shipdate", "l_linenumber"))


def _new_products(t) -> DataFrame:
    """Products whose documents aren't stored; stored are those under twice the number of a sold part."""
    docs = documents.product_documents(t["products"])
    sold = t["lineitem"].select(F.lit("product").alias("doc_type"), (F.col("l_partkey") * 2).cast("string").alias("source_id"))
    return documents.not_yet_ingested(docs, sold.distinct()).select("doc_type", "source_id")


def _vector_queries(t) -> DataFrame:
    """Every 50th vector as a query of its own, without text."""
    asked = t["embeddings"].where("vec_id % 50 = 0").select(
        F.concat(F.lit("v"), F.col("vec_id")).alias("query_id"), F.lit("").alias("query_text"), "embedding")
    return retrieve.prepare_queries(asked)


def _word_hits(t, prepared: DataFrame) -> DataFrame:
    index = wordindex.build_word_index(inputs.knowledge_base(t), new_folder(t.spark, "words"))
    return wordindex.documents_with(wordindex.keywords_of(prepared), index)


def _found_by_words(t) -> DataFrame:
    """The same candidates as by a scan of all texts, with the keyword hits of the word index."""
    prepared = retrieve.prepare_queries(inputs.search_queries(t))
    return retrieve.candidates(prepared, inputs.knowledge_base(t).drop("content").withColumn("content", F.lit(None).cast("string")),
                               k=retrieve.CANDIDATES_WITHOUT_RANKER, found=_word_hits(t, prepared))


def _found_by_cells(t) -> tuple[DataFrame, DataFrame]:
    """Approximate candidates of every 50th vector, with visits chosen for a recall of 0.95, and the exact ones."""
    prepared, kb = _vector_queries(t), inputs.knowledge_base(t)
    index = vectorindex.build_index(kb, new_folder(t.spark, "vectors"))
    probes = vectorindex.probes_for(prepared, kb, index, target=0.95)
    return vectorindex.approximate_candidates(prepared, index, probes=probes), retrieve.candidates(prepared, kb)


def _recall(t) -> DataFrame:
    found, exact = _found_by_cells(t)
    return vectorindex.recall(found, exact).agg(
        F.count(F.lit(1)).alias("queries"), F.sum("neighbours").alias("neighbours"),
        (F.sum("found") >= 0.9 * F.sum("neighbours")).alias("recall_reached"))


def _half_found(t) -> DataFrame:
    prepared, kb = _vector_queries(t), inputs.knowledge_base(t)
    found = halves.half_candidates(prepared, halves.half_base(kb), k=20)
    return _plain(halves.rescored(found, prepared, kb)).select(
        "query_id", "doc_type", "source_id", "vec_dist", "hybrid_rank", F.round("exact_dist", 6).alias("exact_dist"), "rank")


def knowledge_queries() -> dict[str, Query]:
    return {
        "approximate_candidates": bridge(lambda t: _plain(_found_by_cells(t)[0]).select(
            "query_id", "doc_type", "source_id", "vec_dist", "hybrid_rank")),
        "approximate_recall": bridge(_recall),
        "half_candidates": bridge(_half_found),
        "keyword_documents": bridge(lambda t: flat(_word_hits(t, retrieve.prepare_queries(inputs.search_queries(t))))),
        "hybrid_candidates_by_words": bridge(lambda t: _plain(_found_by_words(t)).drop(
            "name", "price", "category", "brand", "ann_candidates_count")),
        "product_documents": bridge(lambda t: _meta(documents.product_documents(t["products"]))),
        "faq_documents": bridge(lambda t: documents.faq_documents(inputs.faqs(t)).select(
            "source_id", "content", F.col("metadata.category").alias("category"))),
        "review_summaries": bridge(lambda t: _meta(documents.review_summaries(
            t["products"], inputs.raw_reviews(t), *inputs.REVIEW_ORDER, "body"))),
        "upsert_documents": bridge(_upserted),
        "upsert_documents_in_buckets": bridge(_upserted_in_buckets),
        "not_yet_ingested": bridge(_new_products),
        "load_reviews": bridge(_loaded),
        "metadata_filter": bridge(lambda t: retrieve.metadata_filter(
            inputs.knowledge_base(t), "garden", 905.0).select("doc_type", "source_id")),
        "query_analysis": bridge(lambda t: flat(retrieve.prepare_queries(inputs.search_queries(t)).drop("embedding", "query_text"))),
        "hybrid_candidates": bridge(lambda t: _plain(_found(t)).drop("name", "price", "category", "brand", "ann_candidates_count")),
        "reranked": bridge(lambda t: retrieve.rank(
            _found(t, retrieve.CANDIDATES), inputs.ranker_scores(t, _found(t, retrieve.CANDIDATES))).select(
            "query_id", "doc_type", "source_id", "rank", "rerank_used")),
        "retrieval_results": bridge(lambda t: _plain(_retrieval(t, False).results).select(
            "query_id", "doc_type", "source_id", "rank", "vec_dist", "keyword_bonus", "dedup_removed_count")),
        "retrieval_stats": bridge(lambda t: _retrieval(t, False).stats),
        "retrieval_stats_reranked": bridge(lambda t: _retrieval(t, True).stats),
        "retrieval_contexts": bridge(_context_lines),
    }


def _page_of_reviews(sort: str) -> Query:
    return bridge(lambda t: catalog.reviews_page(t["product_reviews"], sort=sort, limit=3, offset=2))


def _changed(t) -> DataFrame:
    return catalog.apply_changes(t["products"].select("id", "sku", "price"), inputs.change_feed(t),
                                 *inputs.REVIEW_ORDER)


def _bulk_load(t) -> DataFrame:
    incoming = inputs.raw_reviews(t).select("sku", F.col("author").alias("name"), *inputs.REVIEW_ORDER, "body")
    existing = t["products"].select(F.concat(F.lit("SKU-"), F.col("id") * 3).alias("sku"))
    return catalog.load_new_products(existing, incoming, *inputs.REVIEW_ORDER, "body").select("sku", "name", "body")


def _with_images(t) -> DataFrame:
    stored = t["products"].withColumn("image_url", F.when(F.col("is_featured"), F.lit("old"))).select("sku", "image_url")
    images = inputs.raw_reviews(t).select("sku", F.concat(F.lit("img/"), "author").alias("image_url"))
    return catalog.fill_images(stored, images)


def _orders_by_id(t) -> DataFrame:
    """Sold part numbers, some of which are not products."""
    return t["lineitem"].select((F.col("l_partkey") * 2).alias("id"))


def _parsed_items(t) -> DataFrame:
    parsed = orders.parse_items(inputs.item_lists(t))
    priced = orders.price_order_lists(parsed)
    return orders.serialise_items(priced).drop("tax", "shipping")


def _registered(t) -> DataFrame:
    stored, incoming = inputs.registrations(t)
    return orders.register_users(stored, incoming, "c_custkey")


def commerce_queries() -> dict[str, Query]:
    def search(t):
        return catalog.product_search(t["products"], category="o", search="ing", min_price=900.5, max_price=1500.0)

    return {
        "product_search": bridge(search),
        "product_page": bridge(lambda t: catalog.page(search(t), limit=20, offset=5)),
        "product_page_info": bridge(lambda t: catalog.page_info(search(t), limit=20, offset=5)),
        "products_by_id": bridge(lambda t: catalog.products_by_id(t["products"], _orders_by_id(t)).select("id", "sku")),
        "missing_product_ids": bridge(lambda t: catalog.missing_ids(t["products"], _orders_by_id(t))),
        "apply_product_changes": bridge(_changed),
        "product_changes_in_buckets": bridge(_products_in_buckets),
        "product_bulk_load": bridge(_bulk_load),
        "product_image_fill": bridge(_with_images),
        "featured_products": bridge(lambda t: catalog.featured_products(t["products"])),
        "discounts": bridge(lambda t: catalog.with_discount(t["products"]).select("sku", "discount_pct")),
        "reviews_recent": _page_of_reviews("recent"),
        "reviews_highest": _page_of_reviews("highest"),
        "reviews_lowest": _page_of_reviews("lowest"),
        "star_distribution": bridge(lambda t: catalog.star_distribution(t["product_reviews"])),
        "rating_summary": bridge(lambda t: catalog.rating_summary(catalog.star_distribution(t["product_reviews"]))),
        "order_pricing": bridge(lambda t: orders.order_pricing(t["order_items"])),
        "order_item_lists": bridge(_parsed_items),
        "newest_orders": bridge(lambda t: orders.newest_orders(inputs.stored_orders(t), 5)),
        "order_status_updates": bridge(lambda t: orders.apply_statuses(
            inputs.stored_orders(t), inputs.status_updates(t), "l_shipdate", "l_linenumber")),
        "order_statuses_in_buckets": bridge(_statuses_in_buckets),
        "rejected_status_updates": bridge(lambda t: orders.rejected_statuses(inputs.status_updates(t))),
        "cart_contents": bridge(lambda t: orders.merge_carts(inputs.cart_log(t))),
        "cart_totals": bridge(lambda t: orders.cart_totals(orders.merge_carts(inputs.cart_log(t)))),
        "user_registration": bridge(_registered),
    }


def _votes(t) -> tables.Checked:
    votes = t["chat_logs"].select("message_id", "session_id", "timestamp", "user_message",
                                  (F.col("embed_ms") % 4 - 1).alias("rating"))
    return tables.feedback_rows(votes, t["chat_logs"])


def _reviews(t) -> tables.Checked:
    rows = t["session_reviews"].withColumn("stars", F.col("stars") + F.col("turn_count") % 3 - 1)
    return tables.review_rows(rows)


def source_queries() -> dict[str, Query]:
    return {
        "feedback_rows": bridge(lambda t: _votes(t).accepted),
        "feedback_rejected": bridge(lambda t: _votes(t).rejected.select("message_id", "rating")),
        "event_rows": bridge(lambda t: tables.event_rows(t["chat_events"]).accepted),
        "review_rows": bridge(lambda t: _reviews(t).accepted),
        "review_rejected": bridge(lambda t: _reviews(t).rejected.select("session_id", "stars")),
        "chat_log_rows": bridge(lambda t: tables.chat_log_rows(t["chat_logs"]).accepted.select(
            "session_id", "message_id", "timestamp", "sources_count", "turn_number")),
    }


def _spikes(flag: str, policy: str, threshold: float) -> Query:
    def run(t):
        expr = {"injection": F.col("prompt_injection_flag"), "rerank": ~F.col("rerank_used")}[flag]
        return alerts.spikes(inputs.flag_metrics(t, expr), alerts.POLICIES[policy], threshold=threshold)
    return bridge(run)


def _limited(t) -> DataFrame:
    return ratelimit.rate_limit(inputs.requests(t), max_requests=5, window_seconds=7200)


def _flood(t) -> DataFrame:
    limited = _limited(t)
    hits = limited.select("timestamp", F.col("session_id").alias("series"), (~F.col("allowed")).cast("int").alias("value"))
    return alerts.spikes(hits, alerts.POLICIES["request_flood"], threshold=0)


def _sustained(metrics, policy: str, seconds: int, threshold: float, duration: int, how=alerts.sustained):
    """Aligned per series; where a policy combines its series, by their mean in each window."""
    p = alerts.POLICIES[policy]
    aligned = alerts.align(metrics, seconds, p.aligner)
    if p.reducer:
        aligned = alerts.reduce_series(aligned, p.reducer).withColumn("series", F.lit("chat"))
    return how(aligned, p, threshold=threshold, step=seconds, duration=duration)


def monitoring_queries() -> dict[str, Query]:
    hour = 3600
    return {
        "rate_limit": bridge(_limited),
        "injection_spikes": _spikes("injection", "injection_spike", 0),
        "rerank_error_spikes": _spikes("rerank", "rerank_errors", 1),
        "request_floods": bridge(_flood),
        "server_error_alerts": bridge(lambda t: _sustained(
            inputs.latency_metrics(t).withColumn("value", (F.col("response_class") == "5xx").cast("int")),
            "server_errors", hour, 0.00001, 2 * hour)),
        "latency_alerts": bridge(lambda t: _sustained(inputs.latency_metrics(t), "latency", hour, 5000, 3 * hour)),
        "connection_alerts": bridge(lambda t: _sustained(
            inputs.latency_metrics(t).withColumn("value", F.col("value") / 100), "database_connections", hour, 80, hour)),
        "insert_error_alerts": bridge(lambda t: _sustained(inputs.error_metrics(t), "insert_errors", hour, 0, 2 * hour)),
        "gauge_alerts": bridge(lambda t: _sustained(
            inputs.latency_metrics(t).withColumn("series", F.lit("chat")), "database_cpu", hour, 5000, 2 * hour)),
        "uptime_alerts": bridge(lambda t: _sustained(inputs.error_metrics(t), "uptime", hour, 6, 2 * hour)),
        "latency_incidents": bridge(lambda t: alerts.incidents(_sustained(
            inputs.latency_metrics(t), "latency", hour, 6000, hour), 2 * hour)),
        "latency_incident_windows": bridge(lambda t: alerts.incident_windows(_sustained(
            inputs.latency_metrics(t), "latency", hour, 6000, hour, alerts.sustained_windows), hour, 2 * hour)),
        "chart_request_rate": bridge(lambda t: alerts.chart(
            inputs.latency_metrics(t).withColumn("value", F.lit(1)), "request_rate", seconds=hour, by="response_class")),
        "chart_latency_p95": bridge(lambda t: alerts.chart(inputs.latency_metrics(t), "latency_p95", seconds=hour)),
        "chart_instances": bridge(lambda t: alerts.chart(inputs.latency_metrics(t), "instances", seconds=hour)),
        "chart_database_cpu": bridge(lambda t: alerts.chart(inputs.latency_metrics(t), "database_cpu", seconds=hour)
                                     .withColumn("value", F.round("value", 4))),
        "chart_memory_p95": bridge(lambda t: alerts.chart(
            inputs.latency_metrics(t).withColumn("value", F.col("value") / 20000), "memory_p95", seconds=hour)),
        "chart_database_connections": bridge(lambda t: alerts.chart(
            inputs.latency_metrics(t), "database_connections", seconds=hour).withColumn("value", F.round("value", 4))),
        "chart_insert_errors": bridge(lambda t: alerts.chart(inputs.error_metrics(t), "insert_errors", seconds=hour)
                                      .withColumn("value", F.round("value", 6))),
        "chart_database_memory": bridge(lambda t: alerts.chart(
            inputs.latency_metrics(t).withColumn("value", F.col("value") / 20000), "database_memory", seconds=hour)
            .withColumn("value", F.round("value", 6))),
        "rolling_summary": bridge(lambda t: alerts.rolling_summary(t["chat_logs"])),
        "rolling_errors": bridge(lambda t: alerts.rolling_errors(t["chat_logs"]), turn_numbers=False),
        "rolling_categories": bridge(lambda t: alerts.rolling_categories(t["chat_logs"]), turn_numbers=False),
        "rollup_totals": bridge(lambda t: rollups.period_from_rollup(rollups.daily_rollup(t["chat_logs"])).drop(
            "approx_sessions", "approx_p50_latency_ms", "approx_p95_latency_ms"), turn_numbers=False),
        "rollup_days": bridge(lambda t: maintained.checked_days(t["chat_logs"]), turn_numbers=False),
        "rollup_period": bridge(lambda t: rollups.checked_period(t["chat_logs"]), turn_numbers=False),
    }


def _numbers(query: Query) -> Query:
    """Decimals as doubles, so that results compare across engines."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = query(spark, folder)
        cols = [F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
                for f in df.schema.fields]
        return df.select(*cols) if any(isinstance(f.dataType, T.DecimalType) for f in df.schema.fields) else df
    return run


def queries() -> dict[str, Query]:
    every = {**reports(), **sketched_queries(), **session_queries(), **enrichment_queries(), **knowledge_queries(), **commerce_queries(),
             **source_queries(), **monitoring_queries()}
    return {name: _numbers(query) for name, query in every.items()}
