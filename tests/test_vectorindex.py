"""Approximate search, half precision and the word index against the exact search and plain versions."""
import os
import random
import re

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from parley.operators import halves, retrieve, vectorindex, wordindex
from parley.plans import catalogue
from parley.sources import inputs

KEY = ["query_id", "doc_type", "source_id", "hybrid_rank", "vec_dist", "keyword_bonus"]
BASE = ("doc_type string, source_id string, content string, "
        "metadata struct<name:string,price:double,category:string,brand:string>, embedding array<float>")


def as_rows(df):
    return sorted(tuple(r) for r in df.select(*KEY).collect())


@pytest.fixture(scope="module")
def kb(spark):
    """Vectors around 12 directions, with a third of all rows alike, filters, words and rows without a vector."""
    rng, rnd = np.random.default_rng(3), random.Random(4)
    middles = rng.normal(size=(12, 16)) * 3
    rows = []
    for k in range(900):
        v = middles[0] if k % 3 == 0 else middles[k % 12] + rng.normal(size=16)
        text = None if k % 50 == 0 else " ".join(rnd.choice(["Drill", "hammer,", "pre-drilled", "saw", "漢字", "x"]) for _ in range(6))
        meta = (f"n{k}", float(k % 200), rnd.choice(["Power Tools", "Garden", None]), "b")
        rows.append((rnd.choice(["product", "faq"]), f"{k:04d}", text, meta, None if k == 7 else [float(x) for x in v]))
    return spark.createDataFrame(rows, BASE).repartition(6)


@pytest.fixture(scope="module")
def prepared(spark):
    rng = np.random.default_rng(8)
    texts = ["", "a drill under $100", "power tools hammer", "drilled garden", "saw 漢字"] * 6
    rows = [(f"q{k}", t, [float(x) for x in rng.normal(size=16)]) for k, t in enumerate(texts)]
    return retrieve.prepare_queries(spark.createDataFrame(rows, "query_id string, query_text string, embedding array<double>")).cache()


@pytest.fixture(scope="module")
def words(spark, kb, prepared, tmp_path_factory):
    index = wordindex.build_word_index(kb, str(tmp_path_factory.mktemp("words") / "w"))
    return index, wordindex.documents_with(wordindex.keywords_of(prepared), index).cache()


@pytest.fixture(scope="module")
def index(kb, tmp_path_factory):
    return vectorindex.build_index(kb, str(tmp_path_factory.mktemp("vectors") / "v"), cells=20)


def test_all_cells_give_the_exact_result(spark, kb, prepared, words, index, monkeypatch):
    whole = kb.where("embedding is not null")
    want = as_rows(retrieve.candidates(prepared, whole, k=9))
    assert as_rows(vectorindex.approximate_candidates(prepared, index, probes=20, k=9, found=words[1])) == want
    assert as_rows(retrieve.candidates(prepared, whole, k=9, found=words[1])) == want
    monkeypatch.setattr(retrieve, "DOC_BLOCK", 40)  # crowded cells and query sets in blocks
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 7)
    assert as_rows(vectorindex.approximate_candidates(prepared, index, probes=20, k=9, found=words[1])) == want


def test_every_row_is_in_one_cell(spark, kb, index):
    rows = index.rows(spark).groupBy("doc_type", "source_id").agg(F.count("*").alias("n")).collect()
    assert len(rows) == 899 and {r.n for r in rows} == {1} and index.sizes.sum() == 899
    again = vectorindex.open_index(spark, index.folder)
    assert np.allclose(again.centres, index.centres) and again.sizes.tolist() == index.sizes.tolist()


def test_a_cell_is_one_file_unless_crowded(spark, kb, prepared, index, tmp_path, monkeypatch):
    def files(built):
        return [len([f for f in os.listdir(f"{built.folder}/vectors/{c}") if f.endswith(".parquet")])
                for c in os.listdir(f"{built.folder}/vectors") if c.startswith("cell=")]

    assert set(files(index)) == {1}
    monkeypatch.setattr(vectorindex, "FILE_BYTES", 4 * 16 * 100)  # at most 100 vectors a file, about
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else few rows go to one task
    split = vectorindex.build_index(kb, str(tmp_path / "v"), cells=20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(files(split)) > 1 and split.sizes.sum() == 899
    assert as_rows(vectorindex.approximate_candidates(prepared, split, probes=20, k=9)) == as_rows(
        vectorindex.approximate_candidates(prepared, index, probes=20, k=9))


def test_few_cells_are_read_and_reach_the_recall(spark, kb, prepared, index):
    plain = prepared.withColumn("detected_category", F.lit(None).cast("string")).withColumn("price_filter_value", F.lit(None).cast("double")) \
        .withColumn("keywords", F.array().cast("array<string>"))
    whole = kb.where("embedding is not null")
    probes = vectorindex.probes_for(plain, whole, index, target=0.95, k=10)
    assert probes < 20
    found = vectorindex.approximate_candidates(plain, index, probes=probes, k=10)
    exact = retrieve.candidates(plain, whole, k=10)
    r = vectorindex.recall(found, exact).agg(F.sum("found"), F.sum("neighbours")).first()
    assert r[1] == 300 and r[0] >= 0.9 * r[1]
    one = plain.limit(1)
    plan = vectorindex.approximate_candidates(one, index, probes=1, k=10)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x and index.folder in x)
    assert re.search(r"PartitionFilters: \[[^]]*cell", scan) and "content" not in scan


def test_recall_of_more_queries_than_are_broadcast(spark, tables, monkeypatch):
    few = retrieve.bounded_rows
    monkeypatch.setattr(retrieve, "bounded_rows", lambda prepared, most=0: few(prepared, 0))  # all query sets go by blocks
    made = catalogue.queries()["approximate_recall"](spark, tables.folder).collect()
    rows, asked = tables["embeddings"].count(), tables["embeddings"].where("vec_id % 50 = 0").count()
    assert [tuple(r) for r in made] == [(asked, asked * min(50, rows), True)]


def test_index_of_nothing_and_of_one_row(spark, kb, tmp_path):
    with pytest.raises(ValueError):
        vectorindex.build_index(kb.limit(0), str(tmp_path / "a"))
    one = vectorindex.build_index(kb.where("source_id = '0001'"), str(tmp_path / "b"))
    assert one.sizes.tolist() == [1]


def test_halves_round_as_stored(spark):
    rng = np.random.default_rng(2)
    vectors = [[float(x) for x in rng.normal(size=8) * 10.0 ** rng.integers(-9, 4)] for _ in range(50)] + [[0.0, 65504.0, -1 / 3, 2.0 ** -24]]
    df = spark.createDataFrame([(v,) for v in [*vectors, None]], "v array<double>").withColumn("h", halves.packed("v"))
    rows = df.withColumn("u", halves.unpacked("h")).collect()
    for r in rows[:-1]:
        assert len(r.h) == 2 * len(r.v) and r.u == np.array(r.v).astype(np.float16).astype(float).tolist()
    assert rows[-1].h is None and rows[-1].u is None
    with pytest.raises(PythonException):
        spark.createDataFrame([([70000.0],)], "v array<double>").select(halves.packed("v")).collect()


def test_half_search_and_exact_scores(kb, prepared):
    whole = kb.where("embedding is not null")
    rounded = whole.withColumn("embedding", halves.unpacked(halves.packed("embedding")))
    found = halves.half_candidates(prepared, halves.half_base(whole), k=12)
    assert as_rows(found) == as_rows(retrieve.candidates(prepared, rounded, k=12))
    exact = {tuple(r[:3]): r.vec_dist for r in retrieve.candidates(prepared, whole, k=900).select(
        "query_id", "doc_type", "source_id", "vec_dist").collect()}
    rows = halves.rescored(found, prepared, whole).collect()
    assert rows and all(abs(exact[r.query_id, r.doc_type, r.source_id] - r.exact_dist) < 1e-9 for r in rows)
    for q in {r.query_id for r in rows}:
        order = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        score = [(round(r.exact_dist - r.keyword_bonus, 10), r.doc_type, r.source_id) for r in order]
        assert score == sorted(score)


def test_word_hits_equal_a_scan(spark, kb, prepared, words):
    asked = [r.keyword for r in wordindex.keywords_of(prepared).collect()]
    want = {(r.doc_type, r.source_id): sorted(w for w in asked if w in (r.content or "").lower()) for r in kb.collect()}
    got = {(r.doc_type, r.source_id): r.found for r in words[1].collect()}
    assert got == {k: v for k, v in want.items() if v} and any("drill" in v for v in got.values())


def test_words_of_any_length(spark, tmp_path):
    texts = ["one ab\tabc ABCD\nxaby", "a b", "漢字 ab漢c", "", None, "long" * 5000]
    base = spark.createDataFrame([("faq", str(k), t) for k, t in enumerate(texts)], "doc_type string, source_id string, content string")
    index = wordindex.build_word_index(base, str(tmp_path / "w"))
    asked = ["a", "ab", "abc", "abcd", "xab", "漢", "ngl", "none", "o"]
    keywords = spark.createDataFrame([(w,) for w in [*asked, "ab", ""]], "keyword string")
    got = {r.source_id: r.found for r in wordindex.documents_with(keywords, index).collect()}
    want = {str(k): sorted(w for w in asked if w in t.lower()) for k, t in enumerate(texts) if t}
    assert got == {k: v for k, v in want.items() if v}


def test_search_reads_no_text(spark, kb, prepared, words):
    plan = retrieve.candidates(prepared, kb.withColumn("content", F.lit(None).cast("string")), k=3, found=words[1])
    assert "lower(content" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert not [f for f in os.listdir(words[0].folder) if f not in ("words", "grams", "postings")]
