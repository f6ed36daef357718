"""Checking SQL of knowledge, commerce, source and monitoring operators."""
from __future__ import annotations

from oracle.base import cnt, pct, q, r, register
from oracle.enrichment import category, keywords, price

SQL: dict[str, str] = {}


def put(name, text):
    SQL[name] = q(text)


META = ("CAST({sku} AS VARCHAR) AS sku, {name} AS name, CAST({price} AS DOUBLE) AS price, {category} AS category,"
        " {brand} AS brand, CAST({avg} AS DOUBLE) AS avg_rating, CAST({n} AS BIGINT) AS review_count")

# --- knowledge ---------------------------------------------------------------------
PRODUCT_DOC = """'Product: ' || name || chr(10) || 'SKU: ' || sku || chr(10) || 'Category: ' || category || ' | Brand: ' || brand
 || ' | Price: $' || CAST(CAST(price AS DECIMAL(12,2)) AS VARCHAR) || chr(10) || 'Description: ' || description || chr(10)
 || 'Specifications: ' || 'type: ' || json_extract_string(specifications, '$.type') || ' | size: '
 || json_extract_string(specifications, '$.size')"""
put("product_documents", f"SELECT 'product' AS doc_type, CAST(id AS VARCHAR) AS source_id, {PRODUCT_DOC} AS content, "
    + META.format(sku="sku", name="name", price="price", category="category", brand="brand", avg="NULL", n="NULL") + " FROM products")
put("faq_documents", """SELECT 'faq-' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(4, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') AS source_id,
 'Q: What about ' || lang || '?' || chr(10) || 'A: ' || text AS content,
 CASE WHEN doc_id % 3 > 0 THEN source ELSE 'General' END AS category FROM documents""")
register("raw_reviews", """
select 'SKU-' || (l_partkey + 50) as sku, case when l_linenumber < 7 then cast(l_quantity as int) % 5 + 1 end as stars,
  case when l_suppkey % 9 > 0 then 'T' || l_returnflag end as title,
  'body ' || l_orderkey || ' ' || repeat(l_returnflag, 250) as body,
  case when l_linenumber <> 6 then 'A' || (l_suppkey % 5) end as author,
  case when l_linenumber = 5 then left(strftime(l_shipdate, '%Y-%m-%d'), 7) else strftime(l_shipdate, '%Y-%m-%d') end as date,
  case when l_linenumber > 1 then l_linestatus = 'O' end as verified,
  l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate from lineitem""")
RO = "l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate"
put("review_summaries", f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY {RO}, body) AS pos FROM raw_reviews),
 c AS (SELECT sku, avg(coalesce(stars, 3)) AS a, count(*) AS n FROM raw_reviews GROUP BY sku),
 l AS (SELECT sku, string_agg('- ' || coalesce(CAST(stars AS VARCHAR), 'None') || '★ "' || coalesce(title, '') || '" — '
   || left(body, 200), chr(10) ORDER BY pos) AS lines FROM n WHERE pos <= 5 GROUP BY sku)
 SELECT 'review_summary' AS doc_type, p.sku AS source_id, 'Customer reviews for ' || p.name || ' (' || p.sku || '):' || chr(10)
 || 'Average rating: ' || CAST(CAST(ROUND(CAST(c.a AS DECIMAL(28,10)), 1) AS DECIMAL(10,1)) AS VARCHAR) || '/5 based on ' || c.n
 || ' reviews.' || chr(10) || l.lines AS content,
 {META.format(sku='p.sku', name='p.name', price='p.price', category='p.category', brand='p.brand', avg=r('c.a', 2), n='c.n')}
 FROM products p JOIN c ON c.sku = p.sku JOIN l ON l.sku = p.sku""")
put("upsert_documents", """WITH inc AS (SELECT CAST(vec_id * 3 AS VARCHAR) AS id, 'vector of label ' || label AS content, 1 AS v FROM embeddings
 UNION ALL SELECT CAST(doc_id * 3 AS VARCHAR), 'quality ' || quality, 2 FROM labels),
 one AS (SELECT id, arg_max(content, v) AS content FROM inc GROUP BY id),
 old AS (SELECT CAST(doc_id AS VARCHAR) AS id, text AS content FROM documents)
 SELECT 'doc' AS doc_type, coalesce(old.id, one.id) AS source_id, coalesce(one.content, old.content) AS content,
 CASE WHEN old.id IS NULL THEN TIMESTAMP '2024-01-31 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS created_at
 FROM old FULL OUTER JOIN one ON old.id = one.id""")
put("not_yet_ingested", """SELECT 'product' AS doc_type, CAST(id AS VARCHAR) AS source_id FROM products
 WHERE id NOT IN (SELECT l_partkey * 2 FROM lineitem)""")
put("load_reviews", f"""WITH s AS (SELECT p.id AS product_id, v.sku, coalesce(stars, 3) AS stars, title, body, author,
 CASE WHEN length(date) = 10 THEN CAST(date AS DATE) END AS review_date, coalesce(verified, false) AS verified, {RO}
 FROM raw_reviews v JOIN products p ON p.sku = v.sku),
 m AS (SELECT *, (author IS NOT NULL AND review_date IS NOT NULL AND title IS NOT NULL) AS whole FROM s),
 f AS (SELECT *, row_number() OVER (PARTITION BY whole, product_id, author, review_date, title ORDER BY {RO}) AS rn FROM m)
 SELECT product_id, sku, stars, title, body, author, review_date, verified FROM f
 WHERE NOT whole OR (rn = 1 AND NOT EXISTS (SELECT 1 FROM product_reviews e WHERE e.product_id = f.product_id
 AND e.author = f.author AND e.review_date = f.review_date AND e.title = f.title))""")
put("metadata_filter", "SELECT doc_type, source_id FROM kb WHERE category ILIKE '%garden%' AND price <= 905")

register("search_queries", f"""
select user_message as query_id, user_message as query_text, m.embedding, {category('user_message')} as detected_category,
  {price('user_message')} as price_filter_value, {keywords('user_message')} as keywords
from (select user_message, min(k % 10) as label from chat_turns_raw group by user_message) a join
  (select label, list(x order by i) as embedding from (select label, i, round(avg(x), 8) as x from
     (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) group by label, i)
   group by label) m on m.label = a.label""")
register("scored", f"""
select q.query_id, q.detected_category, q.price_filter_value, b.doc_type, b.source_id, b.content, b.name, b.price, b.category, b.brand,
  b.vec_id, round(1 - list_cosine_similarity(q.embedding::double[], b.embedding::double[]), 10) as vec_dist,
  case when len(list_filter(q.keywords, lambda w: contains(lower(b.content), w))) > 0 then 0.15::double else 0.0::double end as keyword_bonus
from search_queries q join kb b on (q.detected_category is null or lower(b.category) like '%' || lower(q.detected_category) || '%')
  and (q.price_filter_value is null or b.price <= q.price_filter_value)""")
register("cand", """
select * from (select *, row_number() over (partition by query_id order by round(vec_dist - keyword_bonus, 10), doc_type, source_id)
  as hybrid_rank from scored)""")


def _stages(prefix: str, k: int, scored: bool) -> None:
    """Candidates, ranked, deduplicated and final rows of one variant."""
    if scored:
        register(f"{prefix}ranked", f"""
select * from (select *, row_number() over (partition by query_id order by score desc nulls last, hybrid_rank) as rk,
  md5(query_id) < '8' as used from (select *, case when md5(query_id) < '8' then (vec_id * 7919) % 1009 end as score
  from cand where hybrid_rank <= {k})) where not used or rk <= 16""")
    else:
        register(f"{prefix}ranked", f"select *, hybrid_rank as rk, false as used from cand where hybrid_rank <= {k}")
    register(f"{prefix}dedup", f"""
select *, sum(case when copy > 1 and doc_type = 'product' then 1 else 0 end) over (partition by query_id) as removed
from (select *, row_number() over (partition by query_id, doc_type, case when doc_type = 'product' then coalesce(name, '') end
  order by rk) as copy from {prefix}ranked)""")
    register(f"{prefix}final", f"""
select * from (select *, row_number() over (partition by query_id order by rk) as place from {prefix}dedup
  where not (doc_type = 'product' and copy > 1)) where place <= 8""")


_stages("p_", 10, False)
_stages("s_", 50, True)
put("query_analysis", "SELECT query_id, detected_category, price_filter_value, array_to_string(keywords, '|') AS keywords FROM search_queries")
put("hybrid_candidates", """SELECT query_id, doc_type, source_id, round(vec_dist, 6) AS vec_dist, keyword_bonus,
 round(vec_dist - keyword_bonus, 6) AS hybrid_score, hybrid_rank FROM cand WHERE hybrid_rank <= 10""")
put("hybrid_candidates_by_words", """SELECT query_id, doc_type, source_id, round(vec_dist, 6) AS vec_dist, keyword_bonus,
 round(vec_dist - keyword_bonus, 6) AS hybrid_score, hybrid_rank FROM cand WHERE hybrid_rank <= 10""")
put("keyword_documents", """SELECT doc_type, source_id, array_to_string(list_sort(list(DISTINCT w)), '|') AS found FROM kb,
 (SELECT DISTINCT unnest(keywords) AS w FROM search_queries) WHERE contains(lower(content), w) GROUP BY ALL""")
put("approximate_recall", """SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0) AS queries,
 (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0) * least(50, (SELECT count(*) FROM embeddings)) AS neighbours, true AS recall_reached""")
put("half_candidates", """WITH number AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
 step AS (SELECT *, CASE WHEN x <> 0 THEN pow(2, greatest(floor(log2(abs(x))), -14) - 10) ELSE 1 END AS s FROM number),
 half AS (SELECT vec_id, list(round_even(x / s, 0) * s ORDER BY i) AS h FROM step GROUP BY vec_id),
 pair AS (SELECT 'v' || q.vec_id AS query_id, b.doc_type, b.source_id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], h.h), 10) AS d,
  round(1 - list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 10) AS e
  FROM embeddings q, kb b JOIN half h ON h.vec_id = b.vec_id WHERE q.vec_id % 50 = 0),
 best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, doc_type, source_id) AS hybrid_rank FROM pair),
 few AS (SELECT * FROM best WHERE hybrid_rank <= 20)
 SELECT query_id, doc_type, source_id, round(d, 6) AS vec_dist, hybrid_rank::INT AS hybrid_rank, round(e, 6) AS exact_dist,
  (row_number() OVER (PARTITION BY query_id ORDER BY e, doc_type, source_id))::INT AS rank FROM few""")
put("reranked", "SELECT query_id, doc_type, source_id, rk AS rank, used AS rerank_used FROM s_ranked")
put("retrieval_results", """SELECT query_id, doc_type, source_id, place AS rank, round(vec_dist, 6) AS vec_dist, keyword_bonus,
 CAST(removed AS BIGINT) AS dedup_removed_count FROM p_final""")
for _name, _p, _k in (("retrieval_stats", "p_", 10), ("retrieval_stats_reranked", "s_", 50)):
    put(_name, f"""SELECT q.query_id, q.detected_category, q.price_filter_value, q.price_filter_value IS NOT NULL AS price_filter_used,
 coalesce(c.n, 0) AS ann_candidates_count, {r('f.d', 4)} AS rag_confidence, {r('f.m', 4)} AS min_vec_distance,
 f.d > 0.6 AS low_confidence, CAST(f.removed AS BIGINT) AS dedup_removed_count, f.brands AS unique_brands_count,
 f.cats AS unique_categories_count, f.used AS rerank_used, f.d IS NULL AS rag_empty
 FROM search_queries q LEFT JOIN (SELECT query_id, count(*) AS n FROM cand WHERE hybrid_rank <= {_k} GROUP BY 1) c ON c.query_id = q.query_id
 LEFT JOIN (SELECT query_id, avg(vec_dist) AS d, min(vec_dist) AS m, max(removed) AS removed, bool_or(used) AS used,
   count(DISTINCT coalesce(brand, '~')) FILTER (WHERE doc_type = 'product') AS brands,
   count(DISTINCT coalesce(category, '~')) FILTER (WHERE doc_type = 'product') AS cats FROM {_p}final GROUP BY 1) f ON f.query_id = q.query_id""")
NOTE = ("Power Tools, Hand Tools, Outdoor & Garden, Plumbing, Electrical, Flooring, Paint & Supplies, Safety & Security,"
        " Storage & Organization, Heating & Cooling, Building Materials")
put("retrieval_contexts", f"""WITH c AS (SELECT query_id, string_agg(coalesce(content, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place)
 || CASE WHEN avg(vec_dist) > 0.6 THEN chr(10) || chr(10) || '[Note: Low confidence match. Available categories: {NOTE}]' ELSE '' END AS context,
 '[' || coalesce(string_agg(CASE WHEN doc_type = 'product' THEN '{{"id":"' || source_id || '","name":"' || coalesce(name, '') || '","price":'
  || CAST(CAST(coalesce(price, 0) AS DOUBLE) AS VARCHAR) || ',"category":"' || coalesce(category, '') || '"}}' END, ',' ORDER BY place), '') || ']' AS sources
 FROM p_final GROUP BY query_id)
 SELECT q.query_id, coalesce(c.context, '') AS context, coalesce(c.sources, '[]') AS sources FROM search_queries q LEFT JOIN c ON c.query_id = q.query_id""")

# --- commerce ----------------------------------------------------------------------
SEARCH = "FROM products WHERE price BETWEEN 900.5 AND 1500 AND category ILIKE '%o%' AND (name ILIKE '%ing%' OR description ILIKE '%ing%')"
put("product_search", f"SELECT * {SEARCH}")
put("product_page", f"SELECT * {SEARCH} ORDER BY sku LIMIT 20 OFFSET 5")
put("product_page_info", f'SELECT count(*) AS total, 20 AS "limit", 5 AS "offset", CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages {SEARCH}')
put("products_by_id", "SELECT id, sku FROM products WHERE id IN (SELECT l_partkey * 2 FROM lineitem)")
put("missing_product_ids", "SELECT DISTINCT l_partkey * 2 AS id FROM lineitem WHERE l_partkey * 2 NOT IN (SELECT id FROM products)")
register("change_feed", f"""
select l_partkey * 2 as id, case when l_returnflag = 'A' then 'create' when l_linenumber = 3 then 'delete' else 'update' end as op,
  'SKU-' || l_orderkey as sku, cast(l_extendedprice as decimal(10,2)) as price,
  row_number() over (partition by l_partkey order by {RO}) as pos from lineitem""")
put("apply_product_changes", """WITH RECURSIVE n AS (SELECT id, max(pos) AS last FROM change_feed GROUP BY id),
 st AS (SELECT coalesce(n.id, p.id) AS id, 0 AS pos, p.id IS NOT NULL AS there, p.sku, p.price FROM products p FULL OUTER JOIN n ON n.id = p.id
 UNION ALL SELECT st.id, f.pos, CASE f.op WHEN 'create' THEN true WHEN 'delete' THEN false ELSE st.there END,
  CASE WHEN f.op = 'create' OR (f.op = 'update' AND st.there) THEN f.sku ELSE st.sku END,
  CASE WHEN f.op = 'create' OR (f.op = 'update' AND st.there) THEN f.price ELSE st.price END
  FROM st JOIN change_feed f ON f.id = st.id AND f.pos = st.pos + 1)
 SELECT st.id, sku, price FROM st LEFT JOIN n ON n.id = st.id WHERE st.pos = coalesce(n.last, 0) AND there""")
put("product_bulk_load", f"""SELECT sku, author AS name, body FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY {RO}, body) AS n
 FROM raw_reviews) WHERE n = 1 AND sku NOT IN (SELECT 'SKU-' || (id * 3) FROM products)""")
put("product_image_fill", """SELECT p.sku, CASE WHEN p.is_featured THEN 'old' ELSE i.image_url END AS image_url FROM products p
 LEFT JOIN (SELECT sku, min('img/' || author) AS image_url FROM raw_reviews GROUP BY sku) i ON i.sku = p.sku""")
put("featured_products", "SELECT * FROM products WHERE is_featured ORDER BY sku LIMIT 8")
put("discounts", """SELECT sku, CASE WHEN original_price IS NULL OR original_price = 0 THEN 0 ELSE
 CAST(floor((1.0 - CAST(price AS DOUBLE) / CAST(original_price AS DOUBLE)) * 100 + 0.5) AS BIGINT) END AS discount_pct FROM products""")
_REST = "review_date ASC NULLS LAST, stars, title ASC NULLS LAST, author ASC NULLS LAST, body, verified"
for _sort, _key in (("recent", "review_date DESC NULLS LAST"), ("highest", "stars DESC"), ("lowest", "stars ASC")):
    put(f"reviews_{_sort}", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {_key}, {_REST}) AS position
 FROM product_reviews) WHERE position BETWEEN 3 AND 5""")
DIST = ", ".join(f"{cnt(f'stars = {s}')} AS stars_{s}" for s in range(1, 6))
put("star_distribution", f"""SELECT product_id, {DIST}, count(*) AS total, CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages
 FROM product_reviews GROUP BY product_id""")
BARS = ", ".join(f"CAST(floor({cnt(f'stars = {s}')} / count(*) * 100 + 0.5) AS BIGINT) AS pct_{s}" for s in range(1, 6))
put("rating_summary", f"SELECT product_id, {r('avg(stars)', 4)} AS avg_rating, {BARS} FROM product_reviews GROUP BY product_id")
SHIP = "CASE WHEN s >= 50 THEN 0.00 ELSE 9.99 END"
put("order_pricing", f"""WITH o AS (SELECT order_id, sum(CAST(CAST(price AS DECIMAL(28,10)) AS DECIMAL(10,2)) * quantity) AS s FROM order_items GROUP BY order_id)
 SELECT order_id, s AS subtotal, ROUND(s * 0.08, 2) AS tax, {SHIP} AS shipping, s + ROUND(s * 0.08, 2) + {SHIP} AS total FROM o""")
put("order_item_lists", f"""WITH o AS (SELECT *, CAST(CAST(l_extendedprice / l_quantity AS DECIMAL(28,10)) AS DECIMAL(10,2)) AS p, CAST(l_quantity AS INT) AS n FROM lineitem),
 c AS (SELECT *, CAST(p * n + 2.50 AS DECIMAL(18,2)) AS s FROM o)
 SELECT l_orderkey, l_linenumber, l_extendedprice, '[{{"product_id":"' || l_partkey || '","name":"P' || l_partkey || '","quantity":' || n || ',"price":' || p
 || '}},{{"product_id":"s' || l_suppkey || '","name":"S","quantity":1,"price":2.50}}]' AS items, s AS subtotal,
 s + ROUND(s * 0.08, 2) + {SHIP} AS total FROM c""")
register("stored_orders", """
select o_orderkey as id, o_custkey as user_id, 'pending' as status, cast(o_totalprice as decimal(12,2)) as total,
  o_orderdate as created_at from orders""")
put("newest_orders", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS position
 FROM stored_orders) WHERE position <= 5""")
register("status_updates", """
select l_orderkey as order_id, case l_linenumber when 1 then 'pending' when 2 then 'confirmed' when 3 then 'shipped' when 4 then 'delivered'
  when 5 then 'cancelled' when 6 then 'lost' end as status, l_shipdate, l_linenumber from lineitem""")
VALID = "('pending','confirmed','shipped','delivered','cancelled')"
put("order_status_updates", f"""SELECT o.id, o.user_id, coalesce(u.status, o.status) AS status, o.total, o.created_at FROM stored_orders o LEFT JOIN
 (SELECT order_id, status, row_number() OVER (PARTITION BY order_id ORDER BY l_shipdate DESC, l_linenumber DESC) AS n FROM status_updates
  WHERE status IN {VALID}) u ON u.order_id = o.id AND u.n = 1""")
put("rejected_status_updates", f"SELECT * FROM status_updates WHERE status IS NULL OR status NOT IN {VALID}")
register("cart_log", """
select l_suppkey as cart, l_partkey % 40 as item, case when l_linenumber = 7 and l_quantity = 50 then 'clear'
  when l_linenumber = 5 and l_quantity < 10 then 'remove' when l_returnflag = 'R' then 'update' else 'add' end as action,
  case when not (l_linenumber = 7 and l_quantity = 50) and not (l_linenumber = 5 and l_quantity < 10) and l_returnflag = 'R'
    then cast(l_quantity as int) % 7 - 1 else cast(l_quantity as int) end as quantity,
  cast(cast(l_extendedprice / l_quantity as decimal(28,10)) as decimal(10,2)) as price,
  (l_orderkey * 8 + l_linenumber) * 1000000 + cast(floor(l_extendedprice * 100) as bigint) % 1000000 as position from lineitem""")
# fold of the log in order: every slot meets its own events and the clears of its cart
register("cart_steps", """
select cart, item, action, quantity, price, row_number() over (partition by cart, item order by position) as n from (
  select cart, item, action, quantity, price, position from cart_log where action <> 'clear'
  union all select c.cart, i.item, 'clear', 0, null, c.position from (select * from cart_log where action = 'clear') c
    join (select distinct cart, item from cart_log where action <> 'clear') i on i.cart = c.cart)""")
CART = """WITH RECURSIVE st AS (SELECT DISTINCT cart, item, 0 AS n, CAST(NULL AS BIGINT) AS quantity, CAST(NULL AS DECIMAL(10,2)) AS price FROM cart_steps
 UNION ALL SELECT s.cart, s.item, e.n, CASE WHEN e.action = 'add' THEN coalesce(s.quantity, 0) + e.quantity
  WHEN e.action = 'update' AND s.quantity IS NOT NULL AND e.quantity > 0 THEN e.quantity ELSE NULL END,
  CASE WHEN e.action = 'add' THEN coalesce(s.price, e.price) WHEN e.action = 'update' AND s.quantity IS NOT NULL AND e.quantity > 0 THEN s.price END
  FROM st s JOIN cart_steps e ON e.cart = s.cart AND e.item = s.item AND e.n = s.n + 1),
 fin AS (SELECT cart, item, quantity, price FROM (SELECT *, row_number() OVER (PARTITION BY cart, item ORDER BY n DESC) AS z FROM st) WHERE z = 1 AND quantity IS NOT NULL)"""
put("cart_contents", f"{CART} SELECT cart, item, quantity, price FROM fin")
put("cart_totals", f"{CART} SELECT cart, count(*) AS items, CAST(sum(price * quantity) AS DECIMAL(18,2)) AS total FROM fin GROUP BY cart")
put("user_registration", """SELECT email, full_name, c_custkey FROM (SELECT 'u' || (c_custkey // 2 * 3) || '@example.com' AS email, c_name AS full_name,
 c_custkey, row_number() OVER (PARTITION BY c_custkey // 2 ORDER BY c_custkey) AS n FROM customer)
 WHERE n = 1 AND email NOT IN (SELECT email FROM users)""")

# --- sources -----------------------------------------------------------------------
put("feedback_rows", """SELECT message_id, session_id, timestamp, embed_ms % 4 - 1 AS rating, user_message, '' AS assistant_response,
 turn_number, detected_category FROM chat_logs WHERE embed_ms % 4 - 1 IN (1, -1)""")
put("feedback_rejected", "SELECT message_id, embed_ms % 4 - 1 AS rating FROM chat_logs WHERE embed_ms % 4 - 1 NOT IN (1, -1)")
put("event_rows", """SELECT event_type, session_id, timestamp, message_id, product_id, coalesce(product_name, '') AS product_name,
 product_price, product_category FROM chat_events""")
register("shifted_reviews", "select * exclude (stars), stars + turn_count % 3 - 1 as stars from session_reviews")
put("review_rows", "SELECT session_id, timestamp, stars, turn_count, unanswered_count FROM shifted_reviews WHERE stars BETWEEN 1 AND 5")
put("review_rejected", "SELECT session_id, stars FROM shifted_reviews WHERE stars NOT BETWEEN 1 AND 5")
put("chat_log_rows", "SELECT session_id, message_id, timestamp, sources_count, turn_number FROM chat_logs")

# --- monitoring --------------------------------------------------------------------
register("req", """
select event_type as session_id, event_id as request_id, ts as timestamp, epoch_us(ts) as us,
  row_number() over (partition by event_type order by ts, event_id) as n from events""")
LIMIT = """WITH RECURSIVE st AS (SELECT session_id, request_id, timestamp, n, [us] AS acc, true AS allowed FROM req WHERE n = 1
 UNION ALL SELECT r.session_id, r.request_id, r.timestamp, r.n,
  CASE WHEN len(list_filter(s.acc, lambda x: x > r.us - 7200000000)) < 5
   THEN list_append(list_filter(s.acc, lambda x: x > r.us - 7200000000), r.us) ELSE list_filter(s.acc, lambda x: x > r.us - 7200000000) END,
  len(list_filter(s.acc, lambda x: x > r.us - 7200000000)) < 5
  FROM st s JOIN req r ON r.session_id = s.session_id AND r.n = s.n + 1)"""
put("rate_limit", f"{LIMIT} SELECT session_id, request_id, timestamp, allowed FROM st")
FIVE = "time_bucket(INTERVAL 5 MINUTE, timestamp)"
put("request_floods", f"""{LIMIT} SELECT 'request_flood' AS policy, session_id AS series, {FIVE} AS window_start,
 CAST(count(*) AS DOUBLE) AS value FROM st WHERE NOT allowed GROUP BY session_id, {FIVE}""")
for _name, _policy, _flag, _over in (("injection_spikes", "injection_spike", "prompt_injection_flag", 0),
                                     ("rerank_error_spikes", "rerank_errors", "rerank_used = false", 1)):
    put(_name, f"""SELECT '{_policy}' AS policy, 'chat' AS series, {FIVE} AS window_start, CAST({cnt(_flag)} AS DOUBLE) AS value
 FROM chat_logs GROUP BY {FIVE} HAVING {cnt(_flag)} > {_over}""")
HOUR = "date_trunc('hour', timestamp)"


def _islands(value: str, test: str, hours: int) -> str:
    return f"""WITH w AS (SELECT {HOUR} AS h, CAST({value} AS DOUBLE) AS v FROM chat_logs GROUP BY 1),
 b AS (SELECT *, h - INTERVAL 1 HOUR * row_number() OVER (ORDER BY h) AS g FROM w WHERE v {test}),
 i AS (SELECT 'chat' AS series, min(h) AS started_at, max(h) + INTERVAL 1 HOUR AS ended_at, count(*) AS windows, {r('max(v)', 6)} AS peak
 FROM b GROUP BY g HAVING count(*) >= {hours})"""


P99 = "quantile_disc(latency_ms, 0.99)"
SER = "regexp_extract(session_id, '^s(\\d+)-', 1)"


def _mean_islands(value: str, test: str, hours: int) -> str:
    """Each series aligned by itself, then the mean of the series of a window."""
    return f"""WITH s AS (SELECT {HOUR} AS h, {SER} AS s, CAST({value} AS DOUBLE) AS v FROM chat_logs GROUP BY 1, 2),
 w AS (SELECT h, {r('avg(v)', 6)} AS v FROM s GROUP BY h),
 b AS (SELECT *, h - INTERVAL 1 HOUR * row_number() OVER (ORDER BY h) AS g FROM w WHERE v {test}),
 i AS (SELECT 'chat' AS series, min(h) AS started_at, max(h) + INTERVAL 1 HOUR AS ended_at, count(*) AS windows, max(v) AS peak
 FROM b GROUP BY g HAVING count(*) >= {hours})"""


put("server_error_alerts", _mean_islands(cnt("llm_error") + " / 3600", "> 0.00001", 2) + " SELECT * FROM i")
put("latency_alerts", _mean_islands(P99, "> 5000", 3) + " SELECT * FROM i")
put("insert_error_alerts", _islands(cnt("llm_error") + " / 3600", "> 0", 2) + " SELECT * FROM i")
put("connection_alerts", f"""WITH w AS (SELECT {SER} AS s, {HOUR} AS h, avg(latency_ms / 100) AS v FROM chat_logs GROUP BY 1, 2),
 b AS (SELECT *, h - INTERVAL 1 HOUR * row_number() OVER (PARTITION BY s ORDER BY h) AS g FROM w WHERE v > 80)
 SELECT s AS series, min(h) AS started_at, max(h) + INTERVAL 1 HOUR AS ended_at, count(*) AS windows, {r('max(v)', 6)} AS peak
 FROM b GROUP BY s, g""")
put("gauge_alerts", _islands("avg(latency_ms)", "> 5000", 2) + " SELECT * FROM i")
put("uptime_alerts", _islands(cnt("not llm_error"), "< 6", 2) + " SELECT * FROM i")
put("latency_incidents", _mean_islands(P99, "> 6000", 1) + """, m AS (SELECT *, sum(CASE WHEN started_at - prev <= INTERVAL 2 HOUR THEN 0 ELSE 1 END)
 OVER (ORDER BY started_at) AS g FROM (SELECT *, lag(ended_at) OVER (ORDER BY started_at) AS prev FROM i))
 SELECT 'chat' AS series, min(started_at) AS opened_at, max(ended_at) + INTERVAL 2 HOUR AS closes_at, count(*) AS islands, max(peak) AS peak
 FROM m GROUP BY g""")
put("latency_incident_windows", _mean_islands(P99, "> 6000", 1) + """, m AS (SELECT *, sum(CASE WHEN started_at - prev <= INTERVAL 2 HOUR THEN 0 ELSE 1 END)
 OVER (ORDER BY started_at) AS g FROM (SELECT *, lag(ended_at) OVER (ORDER BY started_at) AS prev FROM i))
 SELECT 'chat' AS series, min(started_at) AS opened_at, max(ended_at) + INTERVAL 2 HOUR AS closes_at, sum(windows)::BIGINT AS windows, max(peak) AS peak
 FROM m GROUP BY g""")
put("chart_request_rate", f"""SELECT {HOUR} AS window_start, CASE WHEN llm_error THEN '5xx' ELSE '2xx' END AS response_class,
 {r('count(*) / 3600', 6)} AS value FROM chat_logs GROUP BY 1, 2""")
for _name, _inner, _outer in (("chart_latency_p95", "quantile_disc(latency_ms, 0.95)", "avg(v)"), ("chart_instances", "max(latency_ms)", "sum(v)")):
    put(_name, f"""SELECT h AS window_start, {r(_outer, 6)} AS value FROM (SELECT {HOUR} AS h, {SER} AS s, {_inner} AS v FROM chat_logs GROUP BY 1, 2)
 GROUP BY h""")
put("chart_database_cpu", f"SELECT {SER} AS series, {HOUR} AS window_start, round(avg(latency_ms), 4) AS value FROM chat_logs GROUP BY 1, 2")
put("chart_memory_p95", f"""SELECT h AS window_start, {r('avg(v)', 6)} AS value FROM (SELECT {HOUR} AS h, {SER} AS s,
 quantile_disc(round(latency_ms / 20000, 6), 0.95) AS v FROM chat_logs GROUP BY 1, 2) GROUP BY h""")
put("chart_database_connections", f"SELECT {SER} AS series, {HOUR} AS window_start, round(avg(latency_ms), 4) AS value FROM chat_logs GROUP BY 1, 2")
put("chart_insert_errors", f"SELECT 'chat' AS series, {HOUR} AS window_start, round({cnt('llm_error')} / 3600, 6) AS value FROM chat_logs GROUP BY 2")
put("chart_database_memory", f"SELECT {SER} AS series, {HOUR} AS window_start, round(avg(latency_ms / 20000), 6) AS value FROM chat_logs GROUP BY 1, 2")
register("newest_turns", "select * from chat_logs where prompt_injection_flag is not true and vulgar_flag is not true order by timestamp desc, message_id desc limit 1000")


def _pick(c: str, p: int) -> str:
    n = f"len(list({c}) FILTER (WHERE {c} IS NOT NULL))"
    return (f"CAST(coalesce(list_sort(list({c}) FILTER (WHERE {c} IS NOT NULL))[least({n} * {p} // 100, {n} - 1) + 1], 0) AS BIGINT)")


def _p1(p: str) -> str:
    return r(f"{cnt(p)} / count(*) * 100", 1)


STEPS = ", ".join(f"CAST(coalesce(floor(avg(nullif({s}_ms, 0))), 0) AS BIGINT) AS {s}_avg_ms, {_pick(f'nullif({s}_ms, 0)', 95)} AS {s}_p95_ms"
                  for s in ("embed", "db", "rag", "llm", "ttft"))
LAT = ", ".join(f"{_pick('latency_ms', p)} AS latency_p{p}_ms" for p in (50, 95, 99))
put("rolling_summary", f"""SELECT count(*) AS requests_sampled, {r(f"(1 - {cnt('is_unanswered')} / count(*)) * 100", 1)} AS containment_rate_pct,
 {_p1('is_unanswered')} AS unanswered_rate_pct, {_p1('llm_error')} AS error_rate_pct, {LAT}, CAST(floor(avg(latency_ms)) AS BIGINT) AS latency_avg_ms,
 {STEPS}, {r('avg(nullif(rag_confidence, 0))', 4)} AS avg_confidence_score, {_p1('rag_empty')} AS empty_results_rate_pct,
 {_p1('price_filter_used')} AS price_filter_usage_rate_pct, CAST(floor(avg(nullif(tokens_in, 0))) AS BIGINT) AS avg_input_tokens,
 CAST(floor(avg(nullif(tokens_out, 0))) AS BIGINT) AS avg_output_tokens, {r('avg(nullif(estimated_cost_usd, 0))', 6)} AS avg_cost_per_request_usd,
 {r('sum(estimated_cost_usd)', 4)} AS total_estimated_cost_usd, {r('avg(turn_number)', 1)} AS avg_turn_number,
 {_p1('turn_number = 1')} AS turn_1_rate_pct, {_p1('turn_number >= 3')} AS turn_3plus_rate_pct, {_p1('wellbeing_triggered')} AS wellbeing_rate_pct,
 {_p1('hallucination_flag')} AS hallucination_flag_rate_pct, {r('avg(coalesce(dedup_removed_count, 0))', 2)} AS avg_dedup_removed,
 {r('avg(coalesce(unique_brands_count, 0))', 2)} AS avg_unique_brands, {r('avg(coalesce(unique_categories_count, 0))', 2)} AS avg_unique_categories,
 {r('avg(coalesce(context_pct, 0))', 1)} AS avg_context_pct, max(coalesce(context_pct, 0)) AS max_context_pct FROM newest_turns""")
put("rolling_errors", "SELECT llm_error_type AS error_type, count(*) AS count FROM newest_turns WHERE llm_error_type <> '' GROUP BY 1")
put("rolling_categories", f"""SELECT coalesce(nullif(detected_category, ''), 'General / Conversational') AS category, count(*) AS requests,
 {cnt('is_unanswered')} AS unanswered, {_p1('is_unanswered')} AS unanswered_rate_pct FROM newest_turns GROUP BY 1""")

_FLAGS = {"errors": "llm_error", "unanswered": "is_unanswered", "scope_rejections": "scope_rejected", "vulgar_blocks": "vulgar_flag",
          "injection_blocks": "prompt_injection_flag", "frustrated": "frustration_signal", "rec_gaps": "rec_gap"}
put("rollup_totals", f"""SELECT count(*) AS requests, {', '.join(f'{cnt(c)} AS {n}' for n, c in _FLAGS.items())},
 {', '.join(f'{pct(c)} AS {n}_rate_pct' for n, c in _FLAGS.items())}, CAST(floor(sum(coalesce(ttft_ms, 0)) / count(*) + 0.5) AS BIGINT)
 AS avg_ttft_ms, {r('sum(coalesce(estimated_cost_usd, 0))', 4)} AS total_cost_usd FROM chat_logs""")
put("rollup_days", f"""SELECT CAST(timestamp AS DATE) AS date, count(*) AS requests, {', '.join(f'{cnt(c)} AS {n}' for n, c in _FLAGS.items())},
 true AS sessions_within, true AS p95_within FROM chat_logs GROUP BY 1""")
put("rollup_period", f"SELECT *, true AS sessions_within, true AS p50_within, true AS p95_within FROM ({SQL['rollup_totals']})")


def _retyped(name: str, kind: str, *columns: str) -> None:
    casts = ", ".join(f"CAST({c} AS {kind}) AS {c}" for c in columns)
    SQL[name] = f"SELECT * REPLACE ({casts}) FROM ({SQL[name]})"


# decimals are compared as doubles, positions as 32-bit integers
for _name in ("product_search", "product_page", "featured_products"):
    _retyped(_name, "DOUBLE", "price", "original_price", "rating")
_retyped("order_pricing", "DOUBLE", "subtotal", "tax", "shipping", "total")
_retyped("order_item_lists", "DOUBLE", "subtotal", "total")
for _name in ("newest_orders", "order_status_updates", "cart_totals"):
    _retyped(_name, "DOUBLE", "total")
for _name in ("cart_contents", "apply_product_changes"):
    _retyped(_name, "DOUBLE", "price")
for _name in ("reviews_recent", "reviews_highest", "reviews_lowest", "newest_orders"):
    _retyped(_name, "INTEGER", "position")
for _name in ("hybrid_candidates", "hybrid_candidates_by_words"):
    _retyped(_name, "INTEGER", "hybrid_rank")
for _name in ("reranked", "retrieval_results"):
    _retyped(_name, "INTEGER", "rank")
# the same rows, out of tables that rewrite only what a change touches
for _name, _same in (("upsert_documents_in_buckets", "upsert_documents"), ("product_changes_in_buckets", "apply_product_changes"),
                     ("order_statuses_in_buckets", "order_status_updates")):
    SQL[_name] = SQL[_same]
