"""Checking SQL of the analytics reports (30 days up to the fixture time)."""
from __future__ import annotations

from oracle.base import AS_OF, DATE, SESS, a0, cnt, ia, ia0, pc, pct, q, r, register, share, win

W = f"FROM chat_logs WHERE {win()}"
BY_DAY = f"{W} GROUP BY CAST(timestamp AS DATE)"
UN, WIDE = "is_unanswered", "is_unanswered OR scope_rejected"
COST = "coalesce(estimated_cost_usd,0)"
SQL: dict[str, str] = {}
RAW: dict[str, str] = {}


def put(name, text):
    RAW[name] = text
    SQL[name] = q(text)


def _devops(daily: bool, un: str) -> str:
    head = f"SELECT {DATE}, count(*) AS requests, {SESS} AS sessions, {cnt('llm_error')} AS errors," if daily else \
        f"SELECT count(*) AS total_requests, {SESS} AS total_sessions, {cnt('llm_error')} AS total_errors," \
        f" {ia('latency_ms')} AS avg_latency_ms,"
    v, i = ("vulgar_blocks", "injection_blocks") if daily else ("total_vulgar_blocks", "total_injection_blocks")
    return (f"{head} {pct('llm_error')} AS error_rate_pct, {pc('latency_ms', 0.5)} AS p50_latency_ms,"
            f" {pc('latency_ms', 0.95)} AS p95_latency_ms, {ia0('ttft_ms')} AS avg_ttft_ms,"
            f" {pc('coalesce(ttft_ms,0)', 0.95)} AS p95_ttft_ms, {pct(un)} AS unanswered_rate_pct,"
            f" {cnt('vulgar_flag')} AS {v}, {cnt('prompt_injection_flag')} AS {i} {BY_DAY if daily else W}")


put("get_devops_daily", _devops(True, UN))
put("get_devops_summary", _devops(False, UN))
put("agent_devops_daily", _devops(True, WIDE))
put("agent_devops_summary", _devops(False, WIDE))
put("get_devops_latency_percentiles", f"SELECT {DATE}, " + ", ".join(
    f"{pc('latency_ms', p / 100)} AS p{p}_ms" for p in (25, 50, 75, 95, 99)) + f" {BY_DAY}")
put("sketched_latency_percentiles", f"SELECT {DATE}, " + ", ".join(f"true AS p{p}_ms_within" for p in (25, 50, 75, 95, 99)) + f" {BY_DAY}")
put("get_devops_ttft_trend", f"SELECT {DATE}, {ia0('ttft_ms')} AS avg_ttft_ms,"
    f" {pc('coalesce(ttft_ms,0)', 0.95)} AS p95_ttft_ms, {ia0('llm_ms')} AS avg_llm_ms {BY_DAY}")
ERR = "coalesce(llm_error_type,'unknown')"
put("get_devops_error_types", f"SELECT {ERR} AS error_type, count(*) AS count, {share()} AS pct {W} AND llm_error GROUP BY {ERR}")
put("devops_error_types", f"SELECT {ERR} AS error_type, count(*) AS count {W} AND llm_error GROUP BY {ERR}")
put("get_devops_security_events", f"""SELECT {DATE}, {cnt('prompt_injection_flag')} AS injection_attempts,
 {cnt('vulgar_flag')} AS vulgar_blocks,
 array_to_string(list_sort(list_distinct(list(injection_pattern) FILTER (WHERE injection_pattern IS NOT NULL)))[1:5], '|')
 AS top_injection_patterns {BY_DAY}""")


def _rate(flag, total, hits, rate):
    return f"SELECT {DATE}, count(*) AS {total}, {cnt(flag)} AS {hits}, {pct(flag)} AS {rate} {BY_DAY}"


put("get_devops_unanswered_trend", _rate(UN, "total_messages", "unanswered", "unanswered_rate_pct"))
put("get_devops_scope_rejections", _rate("scope_rejected", "total", "scope_rejections", "rejection_rate_pct"))
put("get_tech_frustration_trend", _rate("frustration_signal", "messages", "frustrated", "frustration_rate_pct"))
put("get_tech_hallucination_rate", _rate("hallucination_flag", "messages", "hallucinations", "hallucination_rate_pct"))
put("get_tech_query_rewrite_rate", _rate("query_rewritten", "total", "rewritten_count", "rewrite_rate_pct"))
put("get_devops_session_activity", f"SELECT {DATE}, {SESS} AS sessions, {r('avg(turn_number)', 1)} AS avg_turn_number,"
    f" {ia('message_length')} AS avg_message_length, {ia('response_length')} AS avg_response_length {BY_DAY}")
put("get_devops_recent_errors", f"SELECT message_id, session_id, timestamp, {ERR} AS error_type,"
    f" left(user_message, 120) AS user_message_preview FROM chat_logs WHERE llm_error"
    f" AND timestamp >= {AS_OF} - INTERVAL 48 HOUR ORDER BY timestamp DESC, message_id LIMIT 20")
put("get_devops_cold_start_proxy", f"SELECT {DATE}, count(*) AS slow_first_turns, {ia('ttft_ms')} AS avg_ttft_ms"
    f" {W} AND turn_number = 1 AND ttft_ms > 5000 GROUP BY CAST(timestamp AS DATE)")
put("get_devops_weekly_comparison", f"""WITH weeks AS (SELECT CASE WHEN {win(7)} THEN 'current_week' ELSE 'prior_week' END
 AS period, * FROM chat_logs WHERE {win(14)})
 SELECT period, count(*) AS requests, {SESS} AS sessions, {pct('llm_error')} AS error_rate_pct,
 {pc('latency_ms', 0.95)} AS p95_latency_ms, {pct(UN)} AS unanswered_rate_pct FROM weeks GROUP BY period""")

put("devops_summary", f"SELECT count(*) AS total_requests, {SESS} AS total_sessions, {pct('llm_error')} AS error_rate_pct,"
    f" {pc('latency_ms', 0.5)} AS p50_latency_ms, {pc('latency_ms', 0.95)} AS p95_latency_ms, {ia0('ttft_ms')} AS avg_ttft_ms,"
    f" {pct(UN)} AS unanswered_rate_pct, {pct('scope_rejected')} AS scope_rejected_rate_pct,"
    f" {cnt('vulgar_flag')} AS vulgar_blocks, {cnt('prompt_injection_flag')} AS injection_blocks {W}")
put("devops_daily", f"SELECT {DATE}, count(*) AS requests, {SESS} AS sessions, {pct('llm_error')} AS error_rate_pct,"
    f" {pc('latency_ms', 0.5)} AS p50_latency_ms, {pc('latency_ms', 0.95)} AS p95_latency_ms, {ia0('ttft_ms')} AS avg_ttft_ms,"
    f" {pct(UN)} AS unanswered_rate_pct, {pct('scope_rejected')} AS scope_rejected_rate_pct {BY_DAY}")
for _name, _date, _t, _from in (("devops_infra_daily", DATE + ",", "", BY_DAY), ("devops_infra_summary", "", "total_", W)):
    put(_name, f"SELECT {_date} count(*) AS {_t}requests, {SESS} AS {_t}sessions, {cnt('llm_error')} AS {_t}errors,"
        f" {pct('llm_error')} AS error_rate_pct, {pc('latency_ms', 0.95)} AS p95_latency_ms,"
        f" {pc('latency_ms', 0.5)} AS p50_latency_ms, {ia('latency_ms')} AS avg_latency_ms {_from}")

# technical
put("get_tech_rag_daily", f"SELECT {DATE}, {a0('rag_confidence', 4)} AS avg_rag_confidence, {a0('min_vec_distance', 4)}"
    f" AS avg_min_vec_distance, {ia0('ann_candidates_count')} AS avg_ann_candidates, {pct('rerank_used')} AS rerank_used_pct,"
    f" {pct('rag_empty')} AS rag_empty_pct {BY_DAY}")
put("get_tech_rag_summary", f"SELECT {a0('rag_confidence', 4)} AS avg_rag_confidence,"
    f" {r('min(coalesce(rag_confidence,0))', 4)} AS min_rag_confidence, {r('max(coalesce(rag_confidence,0))', 4)}"
    f" AS max_rag_confidence, {a0('min_vec_distance', 4)} AS avg_min_vec_distance,"
    f" {r('min(coalesce(min_vec_distance,0))', 4)} AS best_vec_distance, {pct('rerank_used')} AS rerank_used_pct,"
    f" {pct('rag_empty')} AS rag_empty_pct, {pct('hallucination_flag')} AS hallucination_rate_pct,"
    f" {ia0('sources_count')} AS avg_sources_retrieved {W}")
put("get_tech_embedding_quality", f"SELECT {DATE}, {a0('min_vec_distance', 4)} AS avg_distance,"
    f" {r('quantile_disc(min_vec_distance, 0.1)', 4)} AS p10_distance, {r('quantile_disc(min_vec_distance, 0.9)', 4)}"
    f" AS p90_distance {W} AND min_vec_distance IS NOT NULL GROUP BY CAST(timestamp AS DATE)")
TOK = "CAST(sum(coalesce(tokens_in,0)) AS BIGINT) AS total_tokens_in, CAST(sum(coalesce(tokens_out,0)) AS BIGINT) AS total_tokens_out"
AVGTOK = f"{ia0('tokens_in')} AS avg_tokens_in, {ia0('tokens_out')} AS avg_tokens_out"
put("get_tech_token_cost_daily", f"SELECT {DATE}, {TOK}, {AVGTOK}, {r(f'sum({COST})', 6)} AS cost_usd {BY_DAY}")
CPS = r(f"sum({COST})/nullif({SESS},0)", 6)
put("get_tech_cost_summary", f"SELECT {r(f'sum({COST})', 4)} AS total_cost_usd, {CPS} AS cost_per_session_usd,"
    f" {r(f'sum({COST})/nullif(count(*),0)*1000', 4)} AS cost_per_1k_requests_usd, {TOK}, {SESS} AS sessions {W}")
INT = "coalesce(intent,'unknown')"
for _n in ("get_tech_intent_distribution", "agent_intents"):
    put(_n, f"SELECT {INT} AS intent, count(*) AS count, {share()} AS pct {W} GROUP BY {INT}")
put("tech_intents", f"SELECT {INT} AS intent, count(*) AS count {W} GROUP BY {INT}")
CATU = "coalesce(detected_category,'Unknown')"
GAPS = f"{W} AND is_unanswered GROUP BY user_message, {CATU} ORDER BY frequency DESC, user_message, category LIMIT 15"
put("get_tech_catalog_gaps", f"SELECT user_message, {CATU} AS category, count(*) AS frequency,"
    f" {a0('rag_confidence', 4)} AS avg_rag_confidence {GAPS}")
for _n in ("tech_gaps", "agent_gaps"):
    put(_n, f"SELECT user_message, {CATU} AS category, count(*) AS frequency {GAPS}")
put("get_tech_rerank_impact", f"SELECT rerank_used, count(*) AS messages, {a0('rag_confidence', 4)} AS avg_rag_confidence,"
    f" {a0('min_vec_distance', 4)} AS avg_vec_distance, {pct(UN)} AS unanswered_rate_pct {W} GROUP BY rerank_used")
put("get_tech_rec_gap_analysis", f"""WITH w AS (SELECT *, {INT} AS label {W}),
 s AS (SELECT label, user_intent_target AS v, row_number() OVER (PARTITION BY label ORDER BY timestamp, message_id) AS n
   FROM w WHERE user_intent_target IS NOT NULL),
 a AS (SELECT label, array_to_string(list(v ORDER BY n), '|') AS sample_targets FROM s WHERE n <= 5 GROUP BY label)
 SELECT g.label AS intent, total, rec_gap_count, rec_gap_rate_pct, sample_targets FROM
 (SELECT label, count(*) AS total, {cnt('rec_gap')} AS rec_gap_count, {pct('rec_gap')} AS rec_gap_rate_pct FROM w GROUP BY label) g
 LEFT JOIN a ON a.label = g.label""")
put("get_tech_context_window_pct", f"SELECT {a0('context_pct', 3)} AS avg_context_pct,"
    f" {r('quantile_disc(coalesce(context_pct,0), 0.95)', 3)} AS p95_context_pct, {r('max(coalesce(context_pct,0))', 3)}"
    f" AS max_context_pct, {cnt('coalesce(context_pct,0) > 0.9')} AS near_limit_count {W}")
CATG = "coalesce(detected_category,'General')"
for _n, _x in (("get_tech_category_performance", f", {a0('min_vec_distance', 4)} AS avg_vec_distance"), ("tech_category_performance", "")):
    put(_n, f"SELECT {CATG} AS category, count(*) AS requests, {cnt(UN)} AS unanswered, {pct(UN)} AS unanswered_rate_pct,"
        f" {a0('rag_confidence', 4)} AS avg_rag_confidence{_x} {W} GROUP BY {CATG}")
put("get_tech_dedup_stats", f"SELECT {DATE}, {ia0('dedup_removed_count')} AS avg_dedup_removed,"
    f" {ia0('unique_brands_count')} AS avg_unique_brands, {ia0('unique_categories_count')} AS avg_unique_categories {BY_DAY}")
put("tech_summary", f"""SELECT {a0('rag_confidence', 4)} AS avg_rag_confidence, {pct('frustration_signal')} AS frustration_rate_pct,
 {pct('rec_gap')} AS rec_gap_rate_pct, {r(f'sum({COST})', 4)} AS total_cost_usd, {CPS} AS cost_per_session_usd,
 {pct('hallucination_flag')} AS citation_gap_rate_pct, {pct('rerank_used')} AS rerank_used_pct,
 {r('avg(coalesce(turn_number,1))', 1)} AS avg_turn_number, {a0('sources_count', 1)} AS avg_sources_count,
 {pct('query_rewritten')} AS query_rewritten_rate_pct, {cnt('wellbeing_triggered')} AS wellbeing_triggered_count, {AVGTOK},
 {a0('context_pct', 2)} AS avg_context_pct, {pct('rag_empty')} AS rag_empty_rate_pct,
 {pct('price_filter_used')} AS price_filter_rate_pct, {ia0('ann_candidates_count')} AS avg_ann_candidates,
 {a0('unique_brands_count', 1)} AS avg_unique_brands {W}""")
put("tech_daily", f"SELECT {DATE}, {a0('rag_confidence', 4)} AS avg_rag_confidence, {pct('frustration_signal')}"
    f" AS frustration_rate_pct, {pct('rec_gap')} AS rec_gap_rate_pct, {r(f'sum({COST})', 6)} AS cost_usd {BY_DAY}")
put("tech_latency_breakdown", f"SELECT {DATE}, {ia0('embed_ms')} AS avg_embed_ms, {ia0('db_ms')} AS avg_db_ms,"
    f" {ia0('llm_ms')} AS avg_llm_ms {BY_DAY}")
put("tech_model_daily", f"SELECT {DATE}, {r(f'sum({COST})', 6)} AS cost_usd, {ia0('ttft_ms')} AS avg_ttft_ms,"
    f" {ia0('llm_ms')} AS avg_llm_ms, {pct(WIDE)} AS unanswered_rate_pct, {a0('rag_confidence', 4)} AS avg_rag_confidence,"
    f" {AVGTOK} {BY_DAY}")
put("tech_model_summary", f"SELECT {r(f'sum({COST})', 4)} AS total_cost_usd, {r(f'avg({COST})*1000', 4)}"
    f" AS cost_per_1k_requests_usd, {pc('ttft_ms', 0.95)} AS p95_ttft_ms, {ia0('ttft_ms')} AS avg_ttft_ms,"
    f" {pct(WIDE)} AS unanswered_rate_pct, {a0('rag_confidence', 4)} AS avg_rag_confidence,"
    f" {pct('hallucination_flag')} AS citation_gap_rate_pct, {AVGTOK} {W}")
put("agent_tech_daily", f"SELECT {DATE}, {a0('rag_confidence', 4)} AS avg_rag_confidence, {a0('min_vec_distance', 4)}"
    f" AS avg_min_vec_distance, {AVGTOK}, {r(f'sum({COST})', 6)} AS cost_usd, {pct('frustration_signal')} AS frustration_rate_pct,"
    f" {pct('rerank_used')} AS rerank_used_pct, {pct('rec_gap')} AS rec_gap_rate_pct, {ia0('ann_candidates_count')}"
    f" AS avg_ann_candidates {BY_DAY}")
put("agent_tech_summary", f"SELECT {a0('rag_confidence', 4)} AS avg_rag_confidence, {a0('min_vec_distance', 4)}"
    f" AS avg_min_vec_distance, {TOK}, {r(f'sum({COST})', 4)} AS total_cost_usd, {CPS} AS cost_per_session_usd,"
    f" {pct('frustration_signal')} AS frustration_rate_pct, {pct('rerank_used')} AS rerank_used_pct,"
    f" {pct('rec_gap')} AS rec_gap_rate_pct, {pct('hallucination_flag')} AS citation_gap_rate_pct {W}")

# business
RV = f"FROM session_reviews WHERE {win()}"
STARS = f"{r('avg(stars)', 2)} AS avg_stars"
for _n in ("get_business_satisfaction_daily", "agent_satisfaction_daily"):
    put(_n, f"SELECT {DATE}, {STARS}, count(*) AS review_count, {cnt('stars>=4')} AS positive_count,"
        f" {cnt('stars<=2')} AS negative_count {RV} GROUP BY CAST(timestamp AS DATE)")
put("biz_sat_daily", f"SELECT {DATE}, {STARS} {RV} GROUP BY CAST(timestamp AS DATE)")
POS, NEG = f"{cnt('stars>=4')} AS positive_reviews", f"{cnt('stars<=2')} AS negative_reviews"
POSP = f"{pct('stars>=4')} AS positive_rate_pct"
put("get_business_satisfaction_summary", f"SELECT {STARS}, count(*) AS total_reviews, {POS}, {NEG}, {POSP},"
    f" {pct('stars<=2')} AS negative_rate_pct {RV}")
put("agent_satisfaction_summary", f"SELECT {STARS}, count(*) AS total_reviews, {POS}, {NEG}, {POSP} {RV}")
put("biz_sat_summary", f"SELECT {STARS}, count(*) AS total_reviews, {POSP} {RV}")
put("biz_sat_full_summary", f"SELECT {STARS}, count(*) AS total_reviews, {POS}, {POSP} {RV}")
FB = f"SELECT {cnt('rating=1')} AS thumbs_up, {cnt('rating=-1')} AS thumbs_down, count(*) AS total_feedback,"
for _n, _c in (("get_business_feedback_summary", "positive_rate_pct"), ("biz_feedback_full", "positive_rate_pct"),
               ("agent_feedback", "thumbs_up_rate_pct")):
    put(_n, f"{FB} {pct('rating=1')} AS {_c} FROM feedback WHERE {win()}")
put("biz_feedback", f"SELECT {pct('rating=1')} AS thumbs_up_rate_pct FROM feedback WHERE {win()}")
CL = f"FROM chat_events WHERE event_type='chip_click' AND {win()}"
for _n in ("get_business_chip_clicks_daily", "biz_conversion_raw"):
    put(_n, f"SELECT {DATE}, count(*) AS chip_clicks, {SESS} AS sessions_with_clicks {CL} GROUP BY CAST(timestamp AS DATE)")
TP = f"{CL} AND product_name IS NOT NULL GROUP BY product_name ORDER BY clicks DESC, product_name LIMIT 10"
put("get_business_top_products", f"SELECT product_name, count(*) AS clicks, {SESS} AS unique_sessions {TP}")
for _n in ("biz_top_products", "agent_top_products"):
    put(_n, f"SELECT product_name, count(*) AS clicks {TP}")
CONV = f"""WITH e AS (SELECT {DATE}, count(*) AS chip_clicks, {SESS} AS sessions_with_clicks {CL} GROUP BY CAST(timestamp AS DATE)),
 tt AS (SELECT {DATE}, {SESS} AS total_sessions {BY_DAY})"""
RATE = r("e.sessions_with_clicks*100.0/nullif(tt.total_sessions,0)", 2)
put("agent_conversion", f"{CONV} SELECT e.date, chip_clicks, sessions_with_clicks, total_sessions, {RATE}"
    " AS conversion_rate_pct FROM e LEFT JOIN tt ON e.date = tt.date")
put("biz_conversion", f"{CONV} SELECT e.date, {RATE} AS conversion_rate_pct FROM e LEFT JOIN tt ON e.date = tt.date")
put("biz_conversion_mean", f"{CONV} SELECT {r('avg(' + RATE + ')', 4)} AS mean_conversion_rate_pct FROM e LEFT JOIN tt ON e.date = tt.date")

# The session view as the literal four-way join.
FAIL = "s.unanswered_count*1.0/nullif(s.turn_count,0)"
CLICK = "(count(*) FILTER (WHERE e.event_type='chip_click') > 0)"


def _outcome(fr: str, click: str = CLICK, stars: str = "s.stars", fail: str = FAIL) -> str:
    return (f"CASE WHEN {stars} >= 4 THEN 'success' WHEN {click} AND ({stars} IS NULL OR {stars} >= 3) THEN 'success'"
            f" WHEN {stars} <= 2 THEN 'failure' WHEN {fail} > 0.5 THEN 'failure' WHEN {fr} >= 2 THEN 'failure'"
            " ELSE 'inconclusive' END AS outcome")


register("outcomes_view", f"""SELECT s.session_id, s.timestamp AS session_end_at, s.stars AS star_rating, s.turn_count,
 s.unanswered_count, {r(FAIL, 3)} AS failure_rate, {CLICK} AS had_chip_click, count(DISTINCT f.message_id) AS feedback_count,
 {r('avg(f.rating)', 2)} AS avg_message_feedback, {cnt('l.frustration_signal')} AS frustrated_turns,
 {cnt('l.rec_gap')} AS rec_gap_turns, {_outcome(cnt('l.frustration_signal'))}
 FROM session_reviews s LEFT JOIN chat_events e ON e.session_id = s.session_id
 LEFT JOIN feedback f ON f.session_id = s.session_id LEFT JOIN chat_logs l ON l.session_id = s.session_id
 GROUP BY s.session_id, s.timestamp, s.stars, s.turn_count, s.unanswered_count""")
put("session_outcomes", "SELECT * FROM outcomes_view")
put("session_outcomes_dedup", f"""SELECT s.session_id, s.timestamp AS session_end_at, s.stars AS star_rating, s.turn_count,
 s.unanswered_count, {r(FAIL, 3)} AS failure_rate, coalesce(e.clicks,0) > 0 AS had_chip_click, coalesce(f.n,0) AS feedback_count,
 {r('f.rating', 2)} AS avg_message_feedback, coalesce(l.fr,0) AS frustrated_turns, coalesce(l.gaps,0) AS rec_gap_turns,
 {_outcome('coalesce(l.fr,0)', 'coalesce(e.clicks,0) > 0')}
 FROM (SELECT DISTINCT * FROM session_reviews) s
 LEFT JOIN (SELECT session_id, {cnt("event_type='chip_click'")} AS clicks FROM chat_events GROUP BY 1) e ON e.session_id = s.session_id
 LEFT JOIN (SELECT session_id, count(DISTINCT message_id) AS n, avg(rating) AS rating FROM feedback GROUP BY 1) f ON f.session_id = s.session_id
 LEFT JOIN (SELECT session_id, {cnt('frustration_signal')} AS fr, {cnt('rec_gap')} AS gaps FROM chat_logs GROUP BY 1) l
 ON l.session_id = s.session_id""")
OW = f"FROM outcomes_view WHERE {win(30, 'session_end_at')}"
for _n in ("get_business_session_outcomes", "biz_outcomes", "agent_outcomes"):
    put(_n, f"SELECT outcome, count(*) AS sessions, {share()} AS pct {OW} GROUP BY outcome")
put("get_business_conversion_funnel", f"""WITH a AS (SELECT DISTINCT session_id {W}), c AS (SELECT DISTINCT session_id {CL})
 SELECT count(a.session_id) AS total_sessions, count(c.session_id) AS sessions_with_click,
 {r('count(c.session_id)*100.0/nullif(count(a.session_id),0)', 2)} AS click_through_rate_pct
 FROM a LEFT JOIN c ON a.session_id = c.session_id""")
put("get_business_intent_split", f"""WITH s AS (SELECT CASE intent WHEN 'product_search' THEN 'Product Search'
 WHEN 'DIY_advice' THEN 'DIY Advice' WHEN 'price_comparison' THEN 'Price Comparison' WHEN 'how_to_use' THEN 'How-To / Install'
 WHEN 'complaint' THEN 'Complaint' WHEN 'general_info' THEN 'General Info' ELSE 'Other / Unknown' END AS intent_label {W})
 SELECT intent_label, count(*) AS count, {share()} AS pct FROM s GROUP BY intent_label""")
put("get_business_frustration_impact", f"""WITH f AS (SELECT session_id, {cnt('frustration_signal')} >= 1 AS had_frustration {W} GROUP BY session_id)
 SELECT had_frustration, count(DISTINCT v.session_id) AS sessions, {r('avg(v.stars)', 2)} AS avg_stars,
 {pct('v.stars >= 4')} AS positive_rate_pct FROM f JOIN session_reviews v ON v.session_id = f.session_id GROUP BY had_frustration""")
put("get_business_rec_gap_impact", f"""WITH f AS (SELECT session_id, {cnt('rec_gap')} >= 1 AS had_rec_gap {W} GROUP BY session_id)
 SELECT had_rec_gap, count(DISTINCT v.session_id) AS sessions, {r('avg(v.stars)', 2)} AS avg_stars
 FROM f JOIN session_reviews v ON v.session_id = f.session_id GROUP BY had_rec_gap""")
put("get_business_category_demand", f"SELECT {CATU} AS category, count(*) AS queries, {SESS} AS unique_sessions,"
    f" {share()} AS query_share_pct {W} GROUP BY {CATU} ORDER BY queries DESC, category LIMIT 15")
put("biz_category_demand", f"SELECT detected_category AS category, count(*) AS requests, {share(1)} AS pct {W}"
    " AND detected_category IS NOT NULL GROUP BY detected_category ORDER BY requests DESC, category LIMIT 12")
put("get_business_session_length_dist", f"""WITH d AS (SELECT session_id, max(turn_number) AS m {W} GROUP BY session_id),
 b AS (SELECT CASE WHEN m = 1 THEN '1 turn' WHEN m BETWEEN 2 AND 3 THEN '2-3 turns' WHEN m BETWEEN 4 AND 6 THEN '4-6 turns'
 WHEN m BETWEEN 7 AND 10 THEN '7-10 turns' ELSE '11+ turns' END AS session_depth FROM d)
 SELECT session_depth, count(*) AS sessions, {share()} AS pct FROM b GROUP BY session_depth""")


def _dominant(col: str, out: str) -> str:
    return f"""(SELECT session_id, {col} AS {out} FROM (SELECT session_id, {col}, row_number() OVER (PARTITION BY session_id
 ORDER BY count(*) DESC, {col} ASC NULLS LAST) AS n {W} GROUP BY session_id, {col}) WHERE n = 1)"""


put("get_business_outcome_by_intent", f"""SELECT coalesce(d.di,'unknown') AS intent, o.outcome, count(*) AS sessions
 FROM {_dominant('intent', 'di')} d JOIN outcomes_view o ON o.session_id = d.session_id
 WHERE {win(30, 'o.session_end_at')} GROUP BY coalesce(d.di,'unknown'), o.outcome""")
put("sketched_outcome_by_intent", RAW["get_business_outcome_by_intent"])
put("get_business_satisfaction_by_category", f"""SELECT coalesce(d.c,'Unknown') AS category, count(DISTINCT v.session_id) AS reviews,
 {r('avg(v.stars)', 2)} AS avg_stars FROM {_dominant('detected_category', 'c')} d JOIN session_reviews v
 ON v.session_id = d.session_id GROUP BY coalesce(d.c,'Unknown') HAVING count(DISTINCT v.session_id) >= 3""")
put("get_business_unanswered_impact", f"""WITH sq AS (SELECT session_id, {r(cnt(UN) + '*1.0/nullif(count(*),0)', 2)} AS x {W} GROUP BY session_id),
 b AS (SELECT *, CASE WHEN x = 0 THEN 'No unanswered' WHEN x < 0.25 THEN '1-25% unanswered' WHEN x < 0.5 THEN '26-50% unanswered'
 ELSE '50%+ unanswered' END AS unanswered_bucket FROM sq)
 SELECT unanswered_bucket, count(DISTINCT b.session_id) AS sessions, {r('avg(v.stars)', 2)} AS avg_stars
 FROM b LEFT JOIN session_reviews v ON v.session_id = b.session_id GROUP BY unanswered_bucket""")
put("get_business_positive_sessions", f"SELECT session_id, star_rating, turn_count, had_chip_click, frustrated_turns {OW}"
    " AND outcome = 'success' ORDER BY star_rating DESC NULLS LAST, turn_count DESC NULLS LAST, session_id LIMIT 20")
WEEK = "CAST(CAST(timestamp AS DATE) - CAST(dayofweek(timestamp) AS INTEGER) AS DATE)"
put("get_business_weekly_volume", f"SELECT {WEEK} AS week_start, count(*) AS messages, {SESS} AS sessions"
    f" FROM chat_logs WHERE {win(56)} GROUP BY {WEEK}")
CLK = cnt("clicked=1") + "*100.0/nullif(count(*),0)"
FRU = cnt("fr>0") + "*100.0/nullif(count(*),0)"
put("get_business_engagement_score", f"""WITH b AS (SELECT l.session_id, max(l.turn_number) AS depth, {cnt('l.frustration_signal')} AS fr,
 max(CASE WHEN e.event_type = 'chip_click' THEN 1 ELSE 0 END) AS clicked, max(v.stars) AS stars
 FROM chat_logs l LEFT JOIN chat_events e ON e.session_id = l.session_id AND e.event_type = 'chip_click' AND {win(30, 'e.timestamp')}
 LEFT JOIN session_reviews v ON v.session_id = l.session_id WHERE {win(30, 'l.timestamp')} GROUP BY l.session_id)
 SELECT count(*) AS sessions, {r(CLK, 2)} AS click_rate_pct, {r('avg(coalesce(stars,3))', 2)} AS avg_stars,
 {r('avg(depth)', 1)} AS avg_depth, {r(FRU, 2)} AS frustration_rate_pct,
 {r(f'{CLK} * 0.30 + (avg(coalesce(stars,3)) - 1) / 4 * 100 * 0.40 + (100 - {FRU}) * 0.30', 1)} AS engagement_score_0_100 FROM b""")

# general
put("overview", f"""SELECT count(*) AS total_messages, {SESS} AS unique_sessions, avg(message_length) AS avg_message_length,
 avg(response_length) AS avg_response_length, avg(sources_count) AS avg_sources_per_response,
 {cnt('sources_count = 0')} AS messages_without_rag, {cnt('sources_count > 0')} AS messages_with_rag {W}""")
put("top_questions", f"SELECT user_message, count(*) AS frequency, avg(sources_count) AS avg_rag_sources {W}"
    " GROUP BY user_message ORDER BY frequency DESC, user_message LIMIT 20")
put("daily_volume", f"SELECT {DATE}, count(*) AS messages, {SESS} AS sessions {BY_DAY}")
put("sketched_daily_volume", f"SELECT {DATE}, count(*) AS messages, true AS sessions_within {BY_DAY}")
put("rag_performance", f"SELECT sources_count, count(*) AS message_count, {share()} AS percentage {W} GROUP BY sources_count")
put("top_products_mentioned", f"""WITH u AS (SELECT unnest(json_extract(sources_used, '$[*]')) AS src {W} AND sources_used IS NOT NULL)
 SELECT json_extract_string(src, '$.name') AS product_name, json_extract_string(src, '$.price') AS price, count(*) AS mentions
 FROM u GROUP BY 1, 2 ORDER BY mentions DESC, product_name, price LIMIT 10""")
put("session_detail", "SELECT message_id, timestamp, user_message, assistant_response, sources_used, sources_count"
    " FROM chat_logs WHERE session_id = (SELECT min(session_id) FROM chat_logs)")

# status, trends and display names
from parley.operators.status import DASHBOARD_RULES, INTENT_NAMES, REPORT_RULES  # noqa: E402


def _values(rows) -> str:
    def v(x):
        return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else repr(x)
    return ", ".join("(" + ", ".join(v(x) for x in row) + ")" for row in rows)


def _status(name: str, rules, pages: list[tuple[str, dict]]) -> None:
    """One SELECT per KPI over its report, then the rule table."""
    views, parts = [], []
    for i, (report, columns) in enumerate(pages):
        views.append(f"pg{i} AS ({RAW[report]})")
        parts += [f"SELECT '{kpi}' AS kpi, CAST({col} AS DOUBLE) AS value FROM pg{i}" for kpi, col in columns.items()]
    put(name, "WITH " + ", ".join(views) + f""", kv AS ({' UNION ALL '.join(parts)}),
 rl(kpi, direction, amber, red) AS (VALUES {_values(rules)})
 SELECT kv.kpi, coalesce(value, 0) AS value, CASE WHEN direction = 'above' AND coalesce(value, 0) > red THEN 'red'
 WHEN direction = 'below' AND coalesce(value, 0) < red THEN 'red' WHEN direction = 'above' AND coalesce(value, 0) > amber THEN 'amber'
 WHEN direction = 'below' AND coalesce(value, 0) < amber THEN 'amber' ELSE 'green' END AS status
 FROM kv JOIN rl ON kv.kpi = rl.kpi""")


def same(*names):
    return {n: n for n in names}


_status("dashboard_status", DASHBOARD_RULES, [
    ("devops_summary", same("error_rate_pct", "p95_latency_ms", "unanswered_rate_pct", "scope_rejected_rate_pct")),
    ("tech_summary", same("avg_rag_confidence", "rag_empty_rate_pct", "avg_unique_brands", "citation_gap_rate_pct",
                          "rec_gap_rate_pct", "frustration_rate_pct", "avg_turn_number", "cost_per_session_usd")),
    ("biz_sat_summary", same("avg_stars", "positive_rate_pct")), ("biz_feedback", same("thumbs_up_rate_pct")),
    ("biz_conversion_mean", {"conversion_rate_pct": "mean_conversion_rate_pct"})])
_status("report_status", REPORT_RULES, [
    ("agent_devops_summary", {**same("error_rate_pct", "p95_latency_ms", "unanswered_rate_pct", "avg_ttft_ms"),
                              "injection_blocks": "total_injection_blocks", "vulgar_blocks": "total_vulgar_blocks"}),
    ("agent_tech_summary", same("avg_rag_confidence", "rerank_used_pct", "cost_per_session_usd", "frustration_rate_pct",
                                "citation_gap_rate_pct", "rec_gap_rate_pct")),
    ("get_tech_context_window_pct", same("p95_context_pct")),
    ("agent_satisfaction_summary", same("avg_stars", "positive_rate_pct")), ("agent_feedback", same("thumbs_up_rate_pct")),
    ("get_business_session_outcomes", {"failure_rate_pct": "max(pct) FILTER (WHERE outcome = 'failure')"}),
    ("biz_conversion_mean", {"conversion_rate_pct": "mean_conversion_rate_pct"})])
put("distance_trend", f"""WITH w AS (SELECT {WEEK} AS week_start, {a0('min_vec_distance', 4)} AS avg_min_vec_distance
 FROM chat_logs WHERE {win(56)} GROUP BY {WEEK})
 SELECT a.*, coalesce(a.avg_min_vec_distance > (SELECT b.avg_min_vec_distance FROM w b WHERE b.week_start < a.week_start
 ORDER BY b.week_start DESC LIMIT 1), false) AS flagged FROM w a""")
WEEKD = "CAST(date - CAST(dayofweek(date) AS INTEGER) AS DATE)"
put("conversion_trend", f"""WITH c AS ({RAW['biz_conversion']}), w AS (SELECT {WEEKD} AS week_start,
 {r('avg(conversion_rate_pct)', 4)} AS conversion_rate_pct FROM c GROUP BY {WEEKD}),
 l AS (SELECT *, lag(conversion_rate_pct, 1) OVER o AS x, lag(conversion_rate_pct, 2) OVER o AS y FROM w WINDOW o AS (ORDER BY week_start))
 SELECT week_start, conversion_rate_pct, coalesce(conversion_rate_pct < x AND x < y, false) AS flagged FROM l""")
put("intent_display_names", f"""WITH n(intent, label) AS (VALUES {_values(INTENT_NAMES.items())}), i AS ({RAW['tech_intents']})
 SELECT i.intent, i.count, coalesce(n.label, i.intent) AS label FROM i LEFT JOIN n ON n.intent = i.intent""")
put("weekly_run", " UNION ALL ".join(
    f"SELECT '{audience}' AS audience, name AS kpi, value FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM ({RAW[report]}))"
    " ON COLUMNS(*) INTO NAME name VALUE value)"
    for audience, report in (("devops", "agent_devops_summary"), ("tech", "agent_tech_summary"),
                             ("business", "agent_satisfaction_summary"), ("business", "agent_feedback"))))
