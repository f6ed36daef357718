import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import retrieve
from parley.sources import inputs
from parley.sources.bridge import Bridge

KEY = ["query_id", "doc_type", "source_id", "hybrid_rank", "vec_dist", "keyword_bonus"]


@pytest.fixture(scope="module")
def kb(tables):
    return inputs.knowledge_base(tables)


@pytest.fixture(scope="module")
def prepared(tables):
    return retrieve.prepare_queries(inputs.search_queries(tables)).cache()


def as_rows(df):
    return sorted(tuple(r) for r in df.select(*KEY).collect())


def test_blocks_equal_broadcast(prepared, kb, monkeypatch):
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 6)
    monkeypatch.setattr(retrieve, "DOC_BLOCK", 60)
    assert as_rows(retrieve.candidates(prepared, kb, k=7)) == as_rows(
        retrieve.candidates(prepared, kb, k=7, max_broadcast=3))


def test_blocks_of_queries_out_of_the_knowledge_base(spark):
    rows = [("faq", f"{k}", f"text {k}", (f"n{k}", 1.0, None, "b"), [float(k % 7 + 1), float(k % 5), 1.0]) for k in range(60)]
    base = spark.createDataFrame(rows, "doc_type string, source_id string, content string, "
                                       "metadata struct<name:string,price:double,category:string,brand:string>, embedding array<float>")
    asked = base.where("source_id % 10 = 0").select(F.col("source_id").alias("query_id"), F.lit("").alias("query_text"), "embedding")
    asked = retrieve.prepare_queries(asked)
    blocks = as_rows(retrieve.candidates(asked, base, k=5, max_broadcast=3))
    assert blocks == as_rows(retrieve.candidates(asked, base, k=5)) and len(blocks) == 30


def test_blocks_without_documents(prepared, kb, monkeypatch):
    monkeypatch.setattr(retrieve, "DOC_BLOCK", 1)  # as many blocks as documents: some have none
    few = kb.where("source_id in ('d1', 'd2', 'd3', 'd6', 'd7', 'd8', 'd11', 'd12')")
    assert as_rows(retrieve.candidates(prepared, few, k=7, max_broadcast=3)) == as_rows(retrieve.candidates(prepared, few, k=7))


@pytest.mark.parametrize("max_broadcast", [3, 2048])
def test_queries_without_keywords_read_no_text(spark, prepared, kb, max_broadcast):
    plain = prepared.withColumn("keywords", F.array().cast("array<string>"))
    found = retrieve.candidates(plain, kb, k=7, max_broadcast=max_broadcast)
    text = re.compile(r"lower\((text|content)#")
    assert not text.search(found._jdf.queryExecution().optimizedPlan().toString())
    none = spark.createDataFrame([], "doc_type string, source_id string, found array<string>")
    assert as_rows(found) == as_rows(retrieve.candidates(plain, kb, k=7, found=none))
    one = retrieve.prepare_queries(prepared.limit(1).select(F.lit("q").alias("query_id"), F.lit("drill").alias("query_text"), "embedding"))
    some = retrieve.candidates(plain.unionByName(one), kb, k=7, max_broadcast=max_broadcast)  # one keyword: texts are read
    assert text.search(some._jdf.queryExecution().optimizedPlan().toString())


def test_knowledge_base_meets_few_products(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(v, [1.0], 0) for v in (-201, -7, 0, 7, 199, 250, None)], "vec_id bigint, embedding array<float>, label int") \
        .write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(7, "text")], "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    parts = [(k, f"n{k}", "b", "t", 1, 2.0) for k in (-150, -99, -7, -1, 0, 7, 7, 50, 99, 100, 150, 250, None)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double") \
        .write.parquet(f"{folder}/part.parquet")
    base = Bridge(spark, folder)["kb"]
    rows = sorted((str(r.vec_id), r.name or "", r.content or "") for r in base.collect())
    assert rows == sorted([("-201", "n-1", ""), ("-7", "n-7", ""), ("0", "n0", ""), ("7", "n7", "text"), ("7", "n7", "text"),
                           ("199", "n99", ""), ("250", "n50", ""), ("None", "", "")])
    plan = base._jdf.queryExecution().optimizedPlan().toString()
    assert "p_partkey" in plan and "<= 99" in plan and ">= -99" in plan


def test_topk_of_parts_merges_to_topk_of_whole(prepared, kb):
    whole = as_rows(retrieve.candidates(prepared, kb, k=5))
    left = kb.where(F.hash("source_id") % 2 == 0)
    right = kb.where(F.hash("source_id") % 2 != 0)
    both = left.unionByName(right).repartition(7)
    assert as_rows(retrieve.candidates(prepared, both, k=5)) == whole


def vectors(spark, rows):
    return spark.createDataFrame(
        [(d, s, c, (n, p, cat, b), [float(x) for x in v]) for d, s, c, n, p, cat, b, v in rows],
        "doc_type string, source_id string, content string, "
        "metadata struct<name:string,price:double,category:string,brand:string>, embedding array<float>")


def ask(spark, text, v):
    return spark.createDataFrame([("q", text, [float(x) for x in v])], "query_id string, query_text string, embedding array<double>")


def test_many_identical_copies_are_cut_by_key_order(spark):
    kb = vectors(spark, [("faq", f"{i:04d}", "same", None, None, None, None, [1, 0]) for i in range(500)])
    got = retrieve.candidates(retrieve.prepare_queries(ask(spark, "zz", [1, 0])), kb.repartition(8), k=4)
    assert sorted(r.source_id for r in got.collect()) == ["0000", "0001", "0002", "0003"]


def test_filters_bonus_and_low_confidence(spark):
    rows = [("product", "1", "strong DRILL bits", "Drill", 90.0, "power tools", "A", [1, 0]),
            ("product", "2", "drill again", "Drill", 95.0, "Power Tools", "B", [1, 0.1]),
            ("product", "3", "other", "Saw", 120.0, "Power Tools", None, [1, 0]),
            ("product", "4", "other", "Bit", None, "Power Tools", "C", [1, 0]),
            ("faq", "5", "about power", None, 1.0, None, None, [1, 0]),
            ("faq", "6", "far", None, 10.0, "Power Tools", None, [-1, 0.2])]
    out = retrieve.retrieve(ask(spark, "a drill under $100", [1, 0]), vectors(spark, rows))
    got = [(r.source_id, r["rank"], r.keyword_bonus) for r in out.results.orderBy("rank").collect()]
    assert got == [("1", 1, 0.15), ("6", 2, 0.0)]  # 2 repeats a name, 3 is too dear, 4 has no price, 5 no category
    stats = out.stats.first()
    assert (stats.ann_candidates_count, stats.dedup_removed_count, stats.unique_brands_count) == (3, 1, 1)
    assert stats.low_confidence and not stats.rag_empty and stats.price_filter_value == 100.0
    context = out.contexts.first()
    assert context.context.startswith("strong DRILL bits\n\n---\n\nfar\n\n[Note: Low confidence match.")
    assert [s.name for s in context.sources] == ["Drill"]


def test_no_candidates_gives_an_empty_row(spark):
    kb = vectors(spark, [("product", "1", "x", "X", 900.0, "Plumbing", "A", [1, 0])])
    out = retrieve.retrieve(ask(spark, "pipe under 5", [1, 0]), kb)
    s = out.stats.first()
    assert (s.rag_empty, s.rag_confidence, s.ann_candidates_count, s.rerank_used) == (True, None, 0, None)
    assert tuple(out.contexts.first()) == ("q", "", [])


def test_rerank_order_and_fallback(spark):
    kb = vectors(spark, [("faq", f"{i:02d}", "t", None, None, None, None, [1, i / 50]) for i in range(40)])
    q = ask(spark, "zz", [1, 0])
    scores = spark.createDataFrame([("q", "faq", f"{i:02d}", float(i)) for i in range(40)],
                                   "query_id string, doc_type string, source_id string, rerank_score double")
    ranked = retrieve.retrieve(q, kb, scores=scores)
    assert [r.source_id for r in ranked.results.orderBy("rank").collect()] == [f"{i:02d}" for i in range(39, 31, -1)]
    failed = retrieve.retrieve(q, kb, scores=scores.where("false"))
    assert [r.source_id for r in failed.results.orderBy("rank").collect()] == [f"{i:02d}" for i in range(8)]
    assert failed.stats.first().rerank_used is False


def test_distance_of_zero_vector_is_one():
    assert np.allclose(1 - retrieve._unit(np.zeros((1, 3))) @ np.ones((3, 1)), 1)


def test_finder_without_the_automaton(monkeypatch):
    import builtins
    real = builtins.__import__

    def no_aho(name, *a, **k):
        if name == "ahocorasick":
            raise ImportError
        return real(name, *a, **k)

    words = ["drill", "saw"]
    assert set(retrieve._finder(words)("a drill and a saw")) == set(words)
    monkeypatch.setattr(builtins, "__import__", no_aho)
    assert set(retrieve._finder(words)("a drill and a saw")) == set(words)
