"""Knowledge documents: text and metadata out of products, FAQs and reviews."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley import schemas
from parley.functions.kernels import rounded

SUMMARY_REVIEWS = 5
SUMMARY_BODY_CHARS = 200


def shown(c: str | Column) -> Column:
    """Text of a value; a missing one prints as None."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col.cast("string"), F.lit("None"))


def metadata(**given: Column) -> Column:
    """The metadata struct; fields that are not given are NULL."""
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.METADATA.fields])


def spec_text(specifications: Column) -> Column:
    """``key: value | key: value`` of a JSON object; other text unchanged."""
    parsed = F.from_json(specifications, "map<string,string>")
    pairs = F.transform(F.map_entries(parsed), lambda e: F.concat(e["key"], F.lit(": "), shown(e["value"])))
    return F.coalesce(F.array_join(pairs, " | "), specifications, F.lit(""))


def product_documents(products: DataFrame) -> DataFrame:
    content = F.concat(
        F.lit("Product: "), shown("name"), F.lit("\nSKU: "), shown("sku"),
        F.lit("\nCategory: "), shown("category"), F.lit(" | Brand: "), shown("brand"),
        F.lit(" | Price: $"), F.col("price").cast("decimal(12,2)").cast("string"),
        F.lit("\nDescription: "), shown("description"), F.lit("\nSpecifications: "), spec_text(F.col("specifications")))
    meta = metadata(sku=F.col("sku"), name=F.col("name"), price=F.col("price"), category=F.col("category"),
                    brand=F.col("brand"))
    return products.select(F.lit("product").alias("doc_type"), F.col("id").cast("string").alias("source_id"),
                           content.alias("content"), meta.alias("metadata"))


def faq_documents(faqs: DataFrame) -> DataFrame:
    """``faqs`` has position, question, answer and category."""
    meta = metadata(category=F.coalesce(F.col("category"), F.lit("General")))
    return faqs.select(F.lit("faq").alias("doc_type"),
                       F.format_string("faq-%04d", F.col("position").cast("bigint")).alias("source_id"),
                       F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer").alias("content"),
                       meta.alias("metadata"))


def review_summaries(entries: DataFrame, reviews: DataFrame, *order: str) -> DataFrame:
    """One summary document per reviewed product.

    ``entries`` has one row per sku (name, price, category, brand); ``reviews``
    is in long form and ``order`` its input order. Counts combine before the
    shuffle and only the first reviews of a product travel, so a product with
    very many reviews is not gathered.
    """
    stars = F.coalesce(F.col("stars"), F.lit(3))
    counts = reviews.groupBy("sku").agg(F.avg(stars).alias("_avg"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("sku").orderBy(*order)
    line = F.concat(F.lit("- "), shown("stars"), F.lit('★ "'), F.coalesce(F.col("title"), F.lit("")), F.lit('" — '),
                    F.left(F.coalesce(F.col("body"), F.lit("")), F.lit(SUMMARY_BODY_CHARS)))
    first = (reviews.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= SUMMARY_REVIEWS)
             .select("sku", F.struct("_r", line.alias("line")).alias("_s")))
    lines = first.groupBy("sku").agg(
        F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["line"]).alias("_lines"))
    joined = entries.join(counts, "sku").join(lines, "sku")
    avg1 = F.round(F.col("_avg").cast("decimal(28,10)"), 1).cast("decimal(10,1)").cast("string")
    head = F.concat(F.lit("Customer reviews for "), shown("name"), F.lit(" ("), "sku", F.lit("):\nAverage rating: "),
                    avg1, F.lit("/5 based on "), F.col("_n").cast("string"), F.lit(" reviews.\n"))
    meta = metadata(sku=F.col("sku"), name=F.col("name"), price=F.coalesce(F.col("price"), F.lit(0)),
                    category=F.coalesce(F.col("category"), F.lit("")), brand=F.coalesce(F.col("brand"), F.lit("")),
                    avg_rating=rounded(F.col("_avg"), 2), review_count=F.col("_n"))
    return joined.select(F.lit("review_summary").alias("doc_type"), F.col("sku").alias("source_id"),
                         F.concat(head, F.array_join("_lines", "\n")).alias("content"), meta.alias("metadata"))


def not_yet_ingested(docs: DataFrame, existing: DataFrame) -> DataFrame:
    """Documents whose (doc_type, source_id) is not in the knowledge base."""
    return docs.join(existing.select("doc_type", "source_id"), ["doc_type", "source_id"], "left_anti")


def upsert_documents(existing: DataFrame, incoming: DataFrame, version: str, *, now: Column) -> DataFrame:
    """Last write wins per (doc_type, source_id); a replaced row keeps its
    creation time. ``version`` orders repeated keys within ``incoming``."""
    keys = ["doc_type", "source_id"]
    body = [c for c in existing.columns if c not in (*keys, "created_at")]
    latest = incoming.groupBy(*keys).agg(F.max_by(F.struct(*body), F.col(version)).alias("_new"))
    kept = existing.join(latest.select(*keys), keys, "left_anti")
    # only keys and times of the stored rows are needed to date the new versions
    dated = latest.join(existing.select(*keys, F.col("created_at").alias("_old"), F.lit(True).alias("_stored")), keys, "left")
    created = F.when(F.col("_stored"), F.col("_old")).otherwise(now).alias("created_at")
    written = dated.select(*keys, *[F.col(f"_new.{c}").alias(c) for c in body], created)
    return kept.select(*keys, *body, "created_at").unionByName(written)


def load_reviews(existing: DataFrame, incoming: DataFrame, products: DataFrame, *order: str) -> DataFrame:
    """Reviews to be inserted.

    A review is skipped when one with the same (product_id, author,
    review_date, title) exists or came earlier in ``order``; a key with a NULL
    part never collides. Unknown skus are dropped, missing stars count as 3,
    and dates that are not full ISO dates become NULL.
    """
    unique = ["product_id", "author", "review_date", "title"]
    iso = F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr("try_cast(date AS date)"))
    known = incoming.join(products.select(F.col("id").alias("product_id"), "sku"), "sku")
    shaped = known.select(
        "product_id", "sku", F.coalesce(F.col("stars"), F.lit(3)).cast("int").alias("stars"), "title", "body", "author",
        iso.alias("review_date"), F.coalesce(F.col("verified"), F.lit(False)).alias("verified"), *order)
    complete = (F.col("author").isNotNull() & F.col("review_date").isNotNull() & F.col("title").isNotNull()
                & F.col("product_id").isNotNull())
    first = (shaped.where(complete)
             .withColumn("_r", F.row_number().over(Window.partitionBy(*unique).orderBy(*order)))
             .where("_r = 1").drop("_r"))
    fresh = first.join(existing.select(*unique), unique, "left_anti")
    extra = [o for o in order if o not in schemas.PRODUCT_REVIEWS.fieldNames()]
    return fresh.unionByName(shaped.where(~complete)).drop(*extra)
