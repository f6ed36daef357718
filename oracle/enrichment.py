"""Checking SQL of the turn detectors and of the whole enrichment."""
from __future__ import annotations

from oracle.base import q, r, register
from parley.functions import rules

SQL: dict[str, str] = {}


def put(name, text):
    SQL[name] = q(text)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(text: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), {lit(p)})" for p in phrases) + ")"


def hit(text: str, pattern: str) -> str:
    """Pattern match; a negative look-ahead is written as a count difference."""
    if "(?!" in pattern:
        head, tail = pattern.split("(?!")
        both = head + "(" + tail
        return (f"(len(regexp_extract_all(lower({text}), {lit(head)})) > "
                f"len(regexp_extract_all(lower({text}), {lit(both)})))")
    return f"regexp_matches(lower({text}), {lit(pattern)})"


def first(text: str, patterns) -> str:
    return "CASE " + " ".join(f"WHEN {hit(text, p)} THEN {lit(n)}" for p, n in patterns) + " END"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda w: w <> '')"


def injection(text: str) -> str:
    return f"CASE WHEN length({text}) > 4000 THEN 'message_too_long' ELSE {first(text, rules.INJECTION_PATTERNS)} END"


def ending(text: str, reply: str) -> str:
    low = f"regexp_replace(lower({text}), '^\\s+|\\s+$', '', 'g')"
    short = "(" + ", ".join(lit(w) for w in rules.SHORT_ENDINGS) + ")"
    return (f"(len({words(text)}) <= 6 AND ({has(text, rules.SESSION_END_PHRASES)} OR ({low} IN {short} AND"
            f" coalesce({has(reply, rules.WRAP_UP_PHRASES)}, false))))")


def category(text: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(text, k)} THEN {lit(n)}" for n, k in rules.CATEGORY_KEYWORDS.items()) + " END"


def price(text: str) -> str:
    parts = ", ".join(f"nullif(regexp_extract(lower({text}), {lit(p)}, 1), '')" for p in rules.PRICE_PATTERNS)
    return f"CAST(coalesce({parts}) AS DOUBLE)"


def keywords(text: str) -> str:
    stop = "[" + ", ".join(lit(w) for w in rules.KEYWORD_STOP_WORDS) + "]"
    return f"list_filter({words(text)}, lambda w: length(w) >= 4 AND NOT list_contains({stop}, w))"


def overlap(a: str, b: str) -> str:
    x, y = f"list_distinct({words(a)})", f"list_distinct({words(b)})"
    return (f"CASE WHEN len({x}) > 2 AND len({y}) > 2 THEN len(list_intersect({x}, {y})) * 1.0 /"
            f" len(list_distinct(list_concat({x}, {y}))) END")


# every text of the data: chat messages, conversation turns and whole documents
register("texts", """
select message_id as text_id, user_message as body from chat_turns_raw
union all select concat('c', conv_id, '-', turn), text from conversations
union all select concat('d', doc_id), text from documents""")

put("wellbeing_flag", f"SELECT text_id, {has('body', rules.WELLBEING_PHRASES)} AS wellbeing FROM texts")
put("vulgar_flag", f"""SELECT text_id, l IS NOT NULL AS vulgar_flag, l AS vulgar_pattern FROM
 (SELECT text_id, {first('body', rules.VULGAR_PATTERNS)} AS l FROM texts)""")
put("injection_flag", f"""SELECT text_id, l IS NOT NULL AS prompt_injection_flag, l AS injection_pattern FROM
 (SELECT text_id, {injection('body')} AS l FROM texts)""")
put("category_detection", f"SELECT text_id, {category('body')} AS detected_category FROM texts")
put("price_extraction", f"SELECT text_id, {price('body')} AS price_limit FROM texts")
put("keyword_lists", f"SELECT text_id, array_to_string({keywords('body')}, '|') AS keywords FROM texts")

# raw turns with parsed sources and the outputs of outside models
STRUCT = 'STRUCT(id VARCHAR, name VARCHAR, price DOUBLE, category VARCHAR)[]'
register("turns", f"""
select session_id, message_id, timestamp, user_message, assistant_response,
  from_json(retrieved_sources, '[{{"id":"VARCHAR","name":"VARCHAR","price":"DOUBLE","category":"VARCHAR"}}]')::{STRUCT} as retrieved_sources,
  cast(floor(value*100) as bigint) as latency_ms, cast(k as bigint) as embed_ms, cast(floor(value*40) as bigint) as ttft_ms,
  case when event_type = 'error' then 'Timeout' end as llm_error_type,
  case when k%13=0 then null else k*cast(0.01 as double) end as rag_confidence,
  case k%9 when 0 then null when 1 then 'Product_Lookup.' when 2 then 'project_advice, I think' when 3 then 'compatibility'
    when 4 then ' pricing_availability ' when 5 then 'troubleshooting' when 6 then 'general_chat' else 'other' end as intent_text,
  case k%4 when 0 then 'general' when 1 then concat('P', cast(k%10 as varchar(9)), ' tool') when 2 then 'deck lumber' else '' end as target_text,
  cast(40+k as bigint) as intent_tokens_in, cast(k%5 as bigint) as intent_tokens_out
from chat_turns_raw""")
PREV = "OVER (PARTITION BY session_id ORDER BY timestamp, message_id"
register("routed", f"""
select *, case when inj is not null then 'injection' when vul is not null then 'vulgar' when well then 'wellbeing'
  when ends then 'session_end' else 'answer' end as route
from (select *, {injection('user_message')} as inj, {first('user_message', rules.VULGAR_PATTERNS)} as vul,
  {has('user_message', rules.WELLBEING_PHRASES)} as well, {ending('user_message', 'last_reply')} as ends
  from (select *, lag(assistant_response) {PREV}) as last_reply, row_number() {PREV}) as turn_no,
    coalesce(sum(length(user_message) + length(assistant_response)) {PREV} rows between unbounded preceding and 1 preceding), 0)
      as history_chars from turns))""")
NAMED = "list_filter(retrieved_sources, lambda s: contains(lower(assistant_response), lower(s.name)))"
REPR = ("len(concat('[', array_to_string(list_transform(retrieved_sources, lambda s: concat('{''id'': ''', s.id, ''', ''name'': ''',"
        " s.name, ''', ''price'': ', cast(s.price as varchar), ', ''category'': ''', s.category, '''}')), ', '), ']'))")
register("logged", f"""
select *, case when route = 'answer' and retrieved_sources is not null then {NAMED} else [] end as final,
  case when route = 'answer' then len(coalesce({NAMED}, [])) else 0 end as n_final,
  case when route = 'answer' then (len(coalesce({NAMED}, [])) = 0 and {has('assistant_response', rules.UNCERTAINTY_PHRASES)}) else false end as un,
  case when route = 'answer' then greatest(1, (length(user_message) + history_chars
    + case when retrieved_sources is null then 0 else {REPR} end) // 4 + 512) end as t_in,
  case when route = 'answer' then greatest(1, length(assistant_response) // 4) end as t_out
from routed where route <> 'session_end'""")
register("framed", f"""
select *, lag(user_message) {PREV}) as prev_msg,
  last_value(case when route not in ('injection','vulgar') then un end ignore nulls) {PREV}
    rows between unbounded preceding and 1 preceding) as prev_un from logged""")
REASON = (f"coalesce({first('user_message', rules.FRUSTRATION_PATTERNS)}, case when {overlap('prev_msg', 'user_message')} > 0.6"
          " then 'repeated_rephrase' end, case when prev_un then 'after_unanswered' end)")
LABEL = ("regexp_replace(list_filter(regexp_split_to_array(lower(coalesce(intent_text, '')), '\\s+'), lambda w: w <> '')[1],"
         " '[.,]+$', '')")
INTENT = f"case when {LABEL} in ({', '.join(lit(x) for x in rules.INTENT_LABELS)}) then {LABEL} else 'unknown' end"
GAP = """case when lower(target_text) in ('', 'general') then false when un then true when n_final = 0 then false
  else len(list_filter(final, lambda s: len(list_filter(regexp_split_to_array(lower(target_text), '\\s+'),
    lambda w: w <> '' and contains(lower(s.name), w))) > 0)) = 0 end"""
ANS = "case when route = 'answer' then {} end"
CITE = (f"case when route = 'answer' and len(retrieved_sources) > 0 then len({NAMED}) = 0 end")
SEARCHED = "case when route = 'answer' and retrieved_sources is not null then {} end"

put("turn_routes", "SELECT message_id, route, inj AS injection_pattern, vul AS vulgar_pattern, well AS wellbeing,"
    " ends AS session_ending FROM routed")
put("session_ending_flag", "SELECT message_id, ends AS session_ending FROM routed")
put("answer_quality", f"""SELECT message_id, n_final AS sources_count, un AS is_unanswered,
 {ANS.format("contains(lower(assistant_response), " + lit(rules.SCOPE_MARKER) + ")")} AS scope_rejected, {CITE} AS hallucination_flag,
 {GAP} AS rec_gap, {INTENT} AS intent, left(target_text, 100) AS user_intent_target FROM logged""")
put("frustration_flag", f"""SELECT message_id, reason IS NOT NULL AS frustration_signal, reason AS frustration_reason FROM
 (SELECT message_id, {REASON} AS reason FROM framed)""")
COST = f"t_in/1e6*0.3 + t_out/1e6*2.5"
ICOST = "intent_tokens_in/1e6*0.3 + intent_tokens_out/1e6*2.5"
TOTAL = r(f"case when route = 'answer' then {r(COST, 8)} else 0 end + {ICOST}", 8)
put("tokens_and_cost", f"""SELECT message_id, CAST(t_in AS BIGINT) AS tokens_in, CAST(t_out AS BIGINT) AS tokens_out,
 {TOTAL} AS estimated_cost_usd, {r('t_in/1000000.0*100', 1)} AS context_pct FROM logged""")
put("enrich_turns", f"""SELECT session_id, message_id, timestamp, user_message, assistant_response,
 CASE WHEN n_final = 0 THEN '[]' ELSE CAST(to_json(final) AS VARCHAR) END AS sources_used,
 CAST(length(user_message) AS BIGINT) AS message_length, CAST(length(assistant_response) AS BIGINT) AS response_length,
 CASE WHEN route IN ('answer','wellbeing') THEN latency_ms ELSE 0 END AS latency_ms, {ANS.format('embed_ms')} AS embed_ms,
 CAST(NULL AS BIGINT) AS db_ms, CAST(NULL AS BIGINT) AS rag_ms, CAST(NULL AS BIGINT) AS llm_ms, {ANS.format('ttft_ms')} AS ttft_ms,
 CAST(NULL AS VARCHAR) AS embed_model, CAST(t_in AS BIGINT) AS tokens_in, CAST(t_out AS BIGINT) AS tokens_out,
 {TOTAL} AS estimated_cost_usd, {ANS.format('llm_error_type IS NOT NULL')} AS llm_error, {ANS.format('llm_error_type')} AS llm_error_type,
 CAST(n_final AS BIGINT) AS sources_count, {ANS.format('rag_confidence')} AS rag_confidence, CAST(NULL AS DOUBLE) AS min_vec_distance,
 CAST(NULL AS BIGINT) AS ann_candidates_count, CAST(NULL AS BOOLEAN) AS rag_empty,
 {SEARCHED.format(category('user_message'))} AS detected_category,
 {ANS.format('coalesce(' + SEARCHED.format(price('user_message') + ' IS NOT NULL') + ', false)')} AS price_filter_used,
 {SEARCHED.format(price('user_message'))} AS price_filter_value, {ANS.format('false')} AS query_rewritten,
 CAST(NULL AS BIGINT) AS dedup_removed_count, CAST(NULL AS BIGINT) AS unique_brands_count,
 CAST(NULL AS BIGINT) AS unique_categories_count, un AS is_unanswered, {CITE} AS hallucination_flag,
 CASE WHEN route IN ('answer','wellbeing') THEN route = 'wellbeing' END AS wellbeing_triggered,
 {r('t_in/1000000.0*100', 1)} AS context_pct, CASE WHEN route IN ('answer','wellbeing') THEN turn_no END AS turn_number,
 CAST(NULL AS TIMESTAMP) AS session_started_at,
 {ANS.format("contains(lower(assistant_response), " + lit(rules.SCOPE_MARKER) + ")")} AS scope_rejected,
 CAST(NULL AS BOOLEAN) AS rerank_used, CASE route WHEN 'injection' THEN true WHEN 'answer' THEN false END AS prompt_injection_flag,
 inj AS injection_pattern, CASE WHEN route = 'vulgar' THEN true END AS vulgar_flag,
 CASE WHEN route = 'vulgar' THEN vul END AS vulgar_pattern, {INTENT} AS intent, ({REASON}) IS NOT NULL AS frustration_signal,
 {REASON} AS frustration_reason, left(target_text, 100) AS user_intent_target, {GAP} AS rec_gap FROM framed""")
put("conversation_turns", """SELECT conv_id, turn, text, 1 + (SELECT count(*) FROM conversations b WHERE b.conv_id = a.conv_id
 AND b.turn < a.turn AND b.role = 'assistant') AS turn_number FROM conversations a WHERE role = 'user'""")
