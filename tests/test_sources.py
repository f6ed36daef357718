import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from parley import schemas
from parley.functions.kernels import since
from parley.operators import documents
from parley.sources import tables as src

T0 = datetime(2024, 1, 5, 12)


def test_append_validates_and_partitions(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame(
        [("s1", T0, 5, 3, 1), ("s2", T0.replace(day=6), 6, 3, 1), ("s3", T0.replace(day=7), 1, None, None), (None, T0, 3, 1, 1)],
        "session_id string, timestamp timestamp_ntz, stars int, turn_count int, unanswered_count int")
    src.append_fact(src.review_rows(rows), root, "session_reviews")
    back = src.read_table(spark, root, "session_reviews")
    assert sorted(r.session_id for r in back.collect()) == ["s1", "s3"]
    assert {r["date"] for r in back.collect()} == {date(2024, 1, 5), date(2024, 1, 7)}
    assert spark.read.parquet(f"{root}/session_reviews_rejected").count() == 2
    plan = since(back, datetime(2024, 1, 8), days=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "(date#" in plan and "PushedFilters: [IsNotNull(timestamp)" in plan
    assert since(back, datetime(2024, 1, 8), days=2).count() == 1


def test_required_columns(spark):
    with pytest.raises(ValueError, match="session_id"):
        src.conform(spark.range(1), schemas.FEEDBACK)


def test_feedback_takes_fields_of_the_message(spark):
    votes = spark.createDataFrame([("m1", "s", T0, 1), ("m2", "s", T0, -1), ("m3", "s", T0, 0)],
                                  "message_id string, session_id string, timestamp timestamp_ntz, rating int")
    logs = spark.createDataFrame([("m1", 4, "Plumbing")], "message_id string, turn_number int, detected_category string")
    checked = src.feedback_rows(votes, logs)
    assert {(r.message_id, r.turn_number, r.detected_category, r.user_message) for r in checked.accepted.collect()} == {
        ("m1", 4, "Plumbing", ""), ("m2", None, None, "")}
    assert [r.message_id for r in checked.rejected.collect()] == ["m3"]


def test_missing_event_texts_are_empty(spark):
    events = spark.createDataFrame([("chip_click", "s", T0, None, None, None)],
                                   "event_type string, session_id string, timestamp timestamp_ntz, message_id string,"
                                   " product_id string, product_name string")
    row = src.event_rows(events).accepted.first()
    assert (row.message_id, row.product_id, row.product_name, row.product_price) == ("", "", "", None)


def test_snapshot_is_never_overwritten(spark, tmp_path):
    src.write_snapshot(spark.range(3), str(tmp_path), "t", "1")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        src.write_snapshot(spark.range(3), str(tmp_path), "t", "1")


def test_faq_file(spark, tmp_path):
    path = tmp_path / "faqs.json"
    path.write_text(json.dumps([{"question": "a", "answer": "b", "category": "Shipping"}, {"question": "c", "answer": "d"}], indent=1))
    docs = documents.faq_documents(src.read_faq_file(spark, str(path))).orderBy("source_id").collect()
    assert [(d.source_id, d.content, d.metadata.category) for d in docs] == [
        ("faq-0000", "Q: a\nA: b", "Shipping"), ("faq-0001", "Q: c\nA: d", "General")]


REVIEWS = [{"sku": "A", "name": "Drill", "category": "Power Tools", "brand": "X", "price": 9.5, "reviews": [
    {"stars": 5, "title": "t1", "body": "b" * 300, "author": "u", "date": "2024-01-02", "verified": True},
    {"stars": 4, "title": "t1", "body": "again", "author": "u", "date": "2024-01-02", "verified": True},
    {"title": None, "body": "no stars", "author": "v", "date": "2024-01"},
    {"title": None, "body": "no stars", "author": "v", "date": "2024-01"}]},
    {"sku": "Z", "name": "Gone", "reviews": [{"stars": 1}]}, {"sku": "B", "name": "Saw", "reviews": []}]


def test_review_file(spark, tmp_path):
    path = tmp_path / "reviews.json"
    path.write_text(json.dumps(REVIEWS, indent=1))
    entries, long = src.review_entries(src.read_review_file(spark, str(path)))
    products = spark.createDataFrame([(1, "A"), (2, "B")], "id int, sku string")
    empty = spark.createDataFrame([], "product_id int, author string, review_date date, title string")
    loaded = documents.load_reviews(empty, long, products, "position").collect()
    assert sorted((r.sku, r.stars, r.title or "", r.review_date, r.verified) for r in loaded) == [
        ("A", 3, "", None, False), ("A", 3, "", None, False), ("A", 5, "t1", date(2024, 1, 2), True)]
    again = spark.createDataFrame([r for r in loaded], spark.createDataFrame(loaded).schema)
    twice = documents.load_reviews(again, long, products, "position").collect()
    assert sorted(r.stars for r in twice) == [3, 3]  # keys with a missing part never collide
    summary = {d.source_id: d for d in documents.review_summaries(entries, long, "position").collect()}
    assert set(summary) == {"A", "Z"}
    text = summary["A"].content.split("\n")
    assert text[0] == "Customer reviews for Drill (A):" and text[1] == "Average rating: 3.8/5 based on 4 reviews."
    assert text[2] == f'- 5★ "t1" — {"b" * 200}' and text[4] == '- None★ "" — no stars'
    assert (summary["A"].metadata.avg_rating, summary["A"].metadata.review_count) == (3.75, 4)


def test_product_document_text(spark):
    rows = [(1, "S", "Drill", None, "Power Tools", "X", "9.50", '{"a":"1","b":2}'), (2, "T", "Saw", "d", "c", "b", "1.00", "not json"),
            (3, "U", "Saw", "d", "c", "b", "1.00", None)]
    df = spark.createDataFrame(rows, "id int, sku string, name string, description string, category string, brand string,"
                                     " price string, specifications string").withColumn("price", F.col("price").cast("decimal(10,2)"))
    got = {r.source_id: r.content for r in documents.product_documents(df).collect()}
    assert got["1"] == ("Product: Drill\nSKU: S\nCategory: Power Tools | Brand: X | Price: $9.50\nDescription: None\n"
                        "Specifications: a: 1 | b: 2")
    assert got["2"].endswith("Specifications: not json") and got["3"].endswith("Specifications: ")


def test_upsert_is_idempotent_and_keeps_creation_time(spark):
    old = spark.createDataFrame([("faq", "1", "a", T0), ("faq", "2", "b", T0)],
                                "doc_type string, source_id string, content string, created_at timestamp_ntz")
    new = spark.createDataFrame([("faq", "2", "c", 1), ("faq", "2", "d", 2), ("faq", "3", "e", 1)],
                                "doc_type string, source_id string, content string, v int")
    now = F.lit(datetime(2024, 2, 1)).cast("timestamp_ntz")
    once = documents.upsert_documents(old, new, "v", now=now)
    rows = {r.source_id: (r.content, r.created_at.day) for r in once.collect()}
    assert rows == {"1": ("a", 5), "2": ("d", 5), "3": ("e", 1)}
    twice = documents.upsert_documents(once, new, "v", now=F.lit(datetime(2025, 1, 1)).cast("timestamp_ntz"))
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))
