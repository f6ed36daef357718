"""Hybrid retrieval: cosine distance minus a keyword bonus, filters, rerank,
deduplication, and per-query quality figures.

The nearest-neighbour step is exact. Each task multiplies a block of queries
with the Arrow batches of its knowledge partition and keeps only the best
``k`` per query, so neither pairs nor whole groups are shuffled. A query set
under a checked size is sent to every task; a larger one is split into blocks
that meet blocks of the knowledge base.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley import schemas
from parley.functions import rules
from parley.functions.kernels import rounded
from parley.operators import detectors as d

# The functions that run in tasks travel whole, so executors do not need this
# package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BONUS = 0.15
CANDIDATES, RERANKED, RETURNED = 50, 16, 8
CANDIDATES_WITHOUT_RANKER = 10
LOW_CONFIDENCE = 0.6
SEPARATOR = "\n\n---\n\n"

MAX_BROADCAST_QUERIES = 2048
QUERY_BLOCK, DOC_BLOCK = 1024, 4096

_OUT = ("query_id string, doc_type string, source_id string, name string, price double, category string, "
        "brand string, vec_dist double, keyword_bonus double, hybrid_score double")
_NONE = pd.DataFrame(columns=[c.split()[0] for c in _OUT.split(", ")])
_ORDER = ["hybrid_score", "doc_type", "source_id"]


def prepare_queries(queries: DataFrame) -> DataFrame:
    """(query_id, query_text, embedding) plus filters and keywords of the text."""
    text = F.col("_low")
    return queries.withColumn("_low", F.lower("query_text")).select(
        F.col("query_id").cast("string").alias("query_id"), "query_text", "embedding",
        d.category(text).alias("detected_category"), d.price_limit(text).alias("price_filter_value"),
        d.keyword_list(text).alias("keywords"))


def metadata_filter(kb: DataFrame, category: str | None = None, price_limit: float | None = None) -> DataFrame:
    """Rows of one category (substring, any case) up to a price."""
    out = kb
    if category:
        out = out.where(F.col("metadata.category").ilike(f"%{category}%"))
    if price_limit is not None:
        out = out.where(F.col("metadata.price") <= F.lit(round(price_limit, 2)))
    return out


@dataclass
class _Block:
    """Queries of one task: unit vectors, filters and keyword lookup."""
    ids: np.ndarray
    vectors: np.ndarray
    categories: list
    limits: np.ndarray
    words: dict[str, list[int]]

    @classmethod
    def of(cls, ids, vectors, categories, limits, keywords) -> _Block:
        m = np.asarray([np.asarray(v, dtype=np.float64) for v in vectors])
        words: dict[str, list[int]] = {}
        for i, ws in enumerate(keywords):
            for w in set(ws if ws is not None else ()):
                words.setdefault(w, []).append(i)
        cats = [None if c is None or c != c else str(c).lower() for c in categories]
        lim = np.array([np.nan if x is None else float(x) for x in limits], dtype=np.float64)
        return cls(np.asarray(ids, dtype=object), _unit(m), cats, lim, words)

    def keyword_hits(self, texts: list) -> np.ndarray:
        hits = np.zeros((len(texts), len(self.ids)), dtype=bool)
        find = _finder(list(self.words))
        for row, text in enumerate(texts):
            if text:
                for w in find(text):
                    hits[row, self.words[w]] = True
        return hits

    def known_hits(self, found: list) -> np.ndarray:
        """Hits by the keywords that a word index found in each document."""
        hits = np.zeros((len(found), len(self.ids)), dtype=bool)
        for row, words in enumerate(found):
            for w in words if words is not None else ():
                hits[row, self.words.get(w, [])] = True
        return hits

    def allowed(self, docs: pd.DataFrame) -> np.ndarray:
        ok = np.ones((len(docs), len(self.ids)), dtype=bool)
        names = docs["category"].str.lower()
        for c in {c for c in self.categories if c is not None}:
            mine = [i for i, x in enumerate(self.categories) if x == c]
            ok[:, mine] &= names.str.contains(c, regex=False).fillna(False).to_numpy(dtype=bool)[:, None]
        limited = ~np.isnan(self.limits)
        price = docs["price"].to_numpy(dtype=np.float64, na_value=np.nan)[:, None]
        with np.errstate(invalid="ignore"):
            ok[:, limited] &= price <= np.round(self.limits[limited], 2)[None, :]
        return ok


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _finder(words: list[str]):
    """Function giving the words that occur in a text (any position)."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: [w for w in words if w in text]
    if not words:
        return lambda text: ()
    auto = ahocorasick.Automaton()
    for w in words:
        auto.add_word(w, w)
    auto.make_automaton()
    return lambda text: {w for _, w in auto.iter(text)}


def _best(block: _Block, docs: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best documents per query out of ``docs``."""
    if docs.empty or not len(block.ids):
        return _NONE
    vectors = np.stack(docs["embedding"].to_numpy()).astype(np.float64)
    dist = np.round(1.0 - _unit(vectors) @ block.vectors.T, 10)
    hits = block.known_hits(docs["found"].tolist()) if "found" in docs else block.keyword_hits(docs["low"].tolist())
    bonus = np.where(hits, BONUS, 0.0)
    score = np.where(block.allowed(docs), np.round(dist - bonus, 10), np.inf)
    ties = docs[["source_id", "doc_type"]].astype(str)
    rows, cols = [], []
    for j in range(len(block.ids)):
        s = score[:, j]
        picked = np.flatnonzero(np.isfinite(s))
        if len(picked) > k:
            picked = picked[s[picked] <= np.partition(s[picked], k - 1)[k - 1]]
        if len(picked) > k:
            keys = (ties["source_id"].to_numpy()[picked], ties["doc_type"].to_numpy()[picked], s[picked])
            picked = picked[np.lexsort(keys)[:k]]
        rows.append(picked)
        cols.append(np.full(len(picked), j))
    r, c = np.concatenate(rows), np.concatenate(cols)
    out = docs.iloc[r][["doc_type", "source_id", "name", "price", "category", "brand"]].reset_index(drop=True)
    out.insert(0, "query_id", block.ids[c])
    out["vec_dist"], out["keyword_bonus"], out["hybrid_score"] = dist[r, c], bonus[r, c], score[r, c]
    return out


def _merged(best: pd.DataFrame, more: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best per query out of two such sets."""
    if best.empty or more.empty:
        return more if best.empty else best
    both = pd.concat([best, more], ignore_index=True).sort_values(["query_id", *_ORDER], ignore_index=True)
    return both.groupby("query_id", sort=False).head(k)


def _doc_columns(kb: DataFrame) -> DataFrame:
    m = F.col("metadata")
    return kb.select("doc_type", "source_id", F.lower("content").alias("low"), m["name"].alias("name"),
                     m["price"].cast("double").alias("price"), m["category"].alias("category"),
                     m["brand"].alias("brand"), "embedding")


def _query_rows(prepared: DataFrame) -> DataFrame:
    return prepared.select("query_id", "embedding", "detected_category", "price_filter_value", "keywords")


def bounded_rows(prepared: DataFrame, most: int = MAX_BROADCAST_QUERIES) -> list | None:
    """The query rows if there are at most ``most`` of them, else None."""
    rows = _query_rows(prepared).limit(most + 1).collect()
    return rows if len(rows) <= most else None


def candidates(prepared: DataFrame, kb: DataFrame, *, k: int = CANDIDATES, max_broadcast: int = MAX_BROADCAST_QUERIES,
               found: DataFrame | None = None) -> DataFrame:
    """Best ``k`` documents per query by hybrid score, with ``hybrid_rank`` and
    the number of candidates of the query. ``found`` (doc_type, source_id and the
    array ``found`` of keywords, from a word index) spares reading the texts."""
    return _candidates(prepared, kb, k, bounded_rows(prepared, max_broadcast), found)


def _candidates(prepared: DataFrame, kb: DataFrame, k: int, rows: list | None, hits: DataFrame | None = None) -> DataFrame:
    asked, docs = _query_rows(prepared), _doc_columns(kb)
    if rows is None:
        n_queries, worded = asked.agg(F.count(F.lit(1)), F.count_if(F.size("keywords") > 0)).first()
    else:
        worded = any(r.keywords for r in rows)
    if hits is not None:
        docs = docs.drop("low").join(hits, ["doc_type", "source_id"], "left")
    elif not worded:  # no text can hold a keyword, so none is read
        docs = docs.drop("low").withColumn("found", F.array().cast("array<string>"))
    found = _by_blocks(asked, docs, k, n_queries) if rows is None else _by_broadcast(rows, docs, k)
    query = Window.partitionBy("query_id")
    ranked = found.withColumn("hybrid_rank", F.row_number().over(query.orderBy(*_ORDER))).where(F.col("hybrid_rank") <= k)
    return ranked.withColumn("ann_candidates_count", F.count(F.lit(1)).over(query))


def _by_broadcast(rows: list, docs: DataFrame, k: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = _Block.of(*zip(*shared.value)) if shared.value else None
        if block is None:
            return
        kept = _NONE
        for docs_ in batches:
            kept = _merged(kept, _best(block, docs_, k), k)
        yield kept

    return docs.mapInPandas(best, _OUT)


def _by_blocks(queries: DataFrame, docs: DataFrame, k: int, n_queries: int) -> DataFrame:
    qb, db = -(-n_queries // QUERY_BLOCK), max(1, -(-docs.count() // DOC_BLOCK))
    # columns of its own: queries out of the knowledge base would share them with the other side
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])
    left = (queries.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(qb)))
                   .withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(db - 1)))))
    right = (docs.withColumn("_d", F.pmod(F.xxhash64("doc_type", "source_id"), F.lit(db)).cast("int"))
                 .withColumn("_q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(qb - 1).cast("bigint")))))

    def best(q: pd.DataFrame, docs_: pd.DataFrame) -> pd.DataFrame:
        if q.empty or docs_.empty:
            return _NONE
        block = _Block.of(q["query_id"], q["embedding"], q["detected_category"],
                          q["price_filter_value"], q["keywords"])
        return _best(block, docs_.drop(columns=["_d", "_q"]), k)

    return left.groupBy("_q", "_d").cogroup(right.groupBy("_q", "_d")).applyInPandas(best, _OUT)


def rank(found: DataFrame, scores: DataFrame | None = None, *, rerank_k: int = RERANKED) -> DataFrame:
    """Adds ``rank`` and ``rerank_used``. With outside scores (query_id,
    doc_type, source_id, rerank_score) a query keeps its ``rerank_k`` best
    scored candidates; a query without scores keeps all in hybrid order."""
    if scores is None:
        return found.withColumn("rank", F.col("hybrid_rank")).withColumn("rerank_used", F.lit(False))
    joined = found.join(scores, ["query_id", "doc_type", "source_id"], "left")
    per_query = Window.partitionBy("query_id")
    used = F.count("rerank_score").over(per_query) > 0
    order = per_query.orderBy(F.col("rerank_score").desc_nulls_last(), "hybrid_rank")
    ranked = joined.withColumn("rerank_used", used).withColumn("rank", F.row_number().over(order))
    keep = ~F.col("rerank_used") | (F.col("rerank_score").isNotNull() & (F.col("rank") <= rerank_k))
    return ranked.where(keep).drop("rerank_score")


def dedup(ranked: DataFrame) -> DataFrame:
    """Keeps the best ranked product per name; other documents stay. Adds
    ``dedup_removed_count`` per query and renumbers ``rank``."""
    named = F.when(F.col("doc_type") == "product", F.coalesce(F.col("name"), F.lit("")))
    copy = F.row_number().over(Window.partitionBy("query_id", "doc_type", named).orderBy("rank"))
    per_query = Window.partitionBy("query_id")
    marked = ranked.withColumn("_drop", (F.col("doc_type") == "product") & (copy > 1))
    counted = marked.withColumn("dedup_removed_count", F.count_if("_drop").over(per_query)).where(~F.col("_drop"))
    return counted.withColumn("rank", F.row_number().over(per_query.orderBy("rank"))).drop("_drop")


@dataclass(frozen=True)
class Retrieval:
    results: DataFrame
    stats: DataFrame
    contexts: DataFrame


def retrieve(queries: DataFrame, kb: DataFrame, *, scores: DataFrame | None = None, k: int | None = None,
             rerank_k: int = RERANKED, final_k: int = RETURNED,
             max_broadcast: int = MAX_BROADCAST_QUERIES) -> Retrieval:
    """Full retrieval. Without outside scores fewer candidates are fetched."""
    k = k or (CANDIDATES if scores is not None else CANDIDATES_WITHOUT_RANKER)
    prepared = prepare_queries(queries)
    rows = bounded_rows(prepared, max_broadcast)
    found = _candidates(prepared, kb, k, rows)
    results = dedup(rank(found, scores, rerank_k=rerank_k)).where(F.col("rank") <= final_k)
    return Retrieval(results, quality(prepared, results), contexts(prepared, results, kb, bounded=rows is not None))


def quality(prepared: DataFrame, results: DataFrame) -> DataFrame:
    """One row per query, also for queries that found nothing."""
    product = F.col("doc_type") == "product"

    def variety(c: str) -> Column:
        return F.size(F.collect_set(F.when(product, F.coalesce(F.col(c), F.lit("\u0000"))))).cast("bigint")

    per_query = results.groupBy("query_id").agg(
        rounded(F.avg("vec_dist"), 4).alias("rag_confidence"), rounded(F.min("vec_dist"), 4).alias("min_vec_distance"),
        (F.avg("vec_dist") > LOW_CONFIDENCE).alias("low_confidence"),
        F.max("dedup_removed_count").alias("dedup_removed_count"),
        F.max("ann_candidates_count").alias("ann_candidates_count"), variety("brand").alias("unique_brands_count"),
        variety("category").alias("unique_categories_count"), F.bool_or("rerank_used").alias("rerank_used"))
    base = prepared.select("query_id", "detected_category", "price_filter_value",
                           F.col("price_filter_value").isNotNull().alias("price_filter_used"))
    return (base.join(per_query, "query_id", "left")
            .withColumn("ann_candidates_count", F.coalesce("ann_candidates_count", F.lit(0)))
            .withColumn("rag_empty", F.col("rag_confidence").isNull()))


def contexts(prepared: DataFrame, results: DataFrame, kb: DataFrame, *, bounded: bool = False) -> DataFrame:
    """Context text and product sources per query, in rank order. ``bounded``
    says that the number of queries was checked: the few result rows then go
    to the knowledge base instead of the texts being shuffled."""
    key = ["doc_type", "source_id"]
    wanted = F.broadcast(results) if bounded else results
    whole = wanted.join(kb.select(*key, "content"), key)
    part = F.struct(
        "rank", F.col("content"), (F.col("doc_type") == "product").alias("product"),
        F.struct(F.col("source_id").alias("id"), F.coalesce("name", F.lit("")).alias("name"),
                 F.coalesce("price", F.lit(0.0)).alias("price"),
                 F.coalesce("category", F.lit("")).alias("category")).alias("source"))
    parts = whole.groupBy("query_id").agg(F.array_sort(F.collect_list(part)).alias("_p"),
                                          (F.avg("vec_dist") > LOW_CONFIDENCE).alias("_low"))
    text = F.array_join(F.transform("_p", lambda p: F.coalesce(p["content"], F.lit(""))), SEPARATOR)
    note = f"\n\n[Note: Low confidence match. Available categories: {', '.join(rules.CATEGORY_KEYWORDS)}]"
    made = parts.select(
        "query_id", F.concat(text, F.when(F.col("_low"), F.lit(note)).otherwise(F.lit(""))).alias("context"),
        F.transform(F.filter("_p", lambda p: p["product"]), lambda p: p["source"]).alias("sources"))
    empty = F.array().cast(schemas.SOURCES)
    return prepared.select("query_id").join(made, "query_id", "left").select(
        "query_id", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("sources", empty).alias("sources"))
