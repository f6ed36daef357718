"""Table reads, validated appends and snapshot rewrites.

Fact tables are Parquet partitioned by the UTC day of their timestamp, so that
a report over N days lists N folders.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley import schemas
from parley.functions.kernels import day

FACTS = {"chat_logs": schemas.CHAT_LOGS, "feedback": schemas.FEEDBACK, "chat_events": schemas.CHAT_EVENTS,
         "session_reviews": schemas.SESSION_REVIEWS}
OTHERS = {"products": schemas.PRODUCTS, "product_reviews": schemas.PRODUCT_REVIEWS, "users": schemas.USERS,
          "orders": schemas.ORDERS, "knowledge": schemas.KNOWLEDGE}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table by name with its declared schema; facts also have ``date``."""
    if name in FACTS:
        schema = T.StructType([*FACTS[name].fields, T.StructField("date", T.DateType())])
    else:
        schema = OTHERS[name]
    return spark.read.schema(schema).parquet(f"{root}/{name}")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in order; nullable ones that are absent become NULL."""
    missing = [f.name for f in schema.fields if not f.nullable and f.name not in df.columns]
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields]
    return df.select(*cols)


@dataclass(frozen=True)
class Checked:
    """Accepted rows and the rows that broke a rule."""
    accepted: DataFrame
    rejected: DataFrame


def required(schema: T.StructType):
    keep = F.lit(True)
    for f in schema.fields:
        if not f.nullable:
            keep = keep & F.col(f.name).isNotNull()
    return keep


def _split(rows: DataFrame, rule, schema: T.StructType) -> Checked:
    ok = F.coalesce(rule & required(schema), F.lit(False))
    return Checked(rows.where(ok), rows.where(~ok))


def chat_log_rows(rows: DataFrame) -> Checked:
    return _split(conform(rows, schemas.CHAT_LOGS), F.lit(True), schemas.CHAT_LOGS)


def feedback_rows(votes: DataFrame, chat_logs: DataFrame) -> Checked:
    """Votes of 1 or -1, with turn number and category of the voted message."""
    # a message id is logged once; the aggregate guards the join against repeats
    turns = chat_logs.groupBy("message_id").agg(F.min("turn_number").alias("turn_number"),
                                                F.min("detected_category").alias("detected_category"))
    rows = votes.drop("turn_number", "detected_category").join(turns, "message_id", "left")
    return checked_votes(rows)


def checked_votes(votes: DataFrame) -> Checked:
    """Votes of 1 or -1; missing texts are stored as empty strings."""
    texts = {c: F.coalesce(F.col(c), F.lit("")) if c in votes.columns else F.lit("")
             for c in ("user_message", "assistant_response")}
    return _split(conform(votes.withColumns(texts), schemas.FEEDBACK), F.col("rating").isin(1, -1), schemas.FEEDBACK)


def event_rows(events: DataFrame) -> Checked:
    """Click events; missing texts are stored as empty strings."""
    empty = {c: F.coalesce(F.col(c), F.lit("")) for c in ("message_id", "product_id", "product_name")}
    return _split(conform(events.withColumns(empty), schemas.CHAT_EVENTS), F.lit(True), schemas.CHAT_EVENTS)


def review_rows(reviews: DataFrame) -> Checked:
    """Session reviews of 1 to 5 stars."""
    return _split(conform(reviews, schemas.SESSION_REVIEWS), F.col("stars").between(1, 5), schemas.SESSION_REVIEWS)


def append_fact(checked: Checked, root: str, name: str) -> None:
    """Appends accepted rows by day; rejected rows go to ``<name>_rejected``.

    The rebalance hint gathers a day's rows into few files and splits a day
    that is too large for one task.
    """
    by_day = checked.accepted.withColumn("date", day()).hint("rebalance", "date")
    by_day.write.mode("append").partitionBy("date").parquet(f"{root}/{name}")
    checked.rejected.write.mode("append").parquet(f"{root}/{name}_rejected")


def write_snapshot(df: DataFrame, root: str, name: str, version: str) -> str:
    """Writes a new version of a table next to the old one, never over it, and
    returns the folder. Readers switch to it once the write has succeeded."""
    folder = f"{root}/{name}/version={version}"
    df.write.mode("errorifexists").parquet(folder)
    return folder


def read_faq_file(spark: SparkSession, path: str) -> DataFrame:
    """FAQ entries with their position in the file's array."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.posexplode(F.from_json("value", T.ArrayType(schemas.FAQ_FILE))).alias("position", "_e"))
    return parsed.select("position", "_e.*")


def read_review_file(spark: SparkSession, path: str) -> DataFrame:
    """One row per product of the reviews file, reviews as an array."""
    return spark.read.schema(schemas.REVIEW_FILE).json(path, multiLine=True)


def review_entries(file_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits the reviews file into product entries and long reviews with their
    ``position``."""
    entries = file_rows.select("sku", "name", "category", "brand", "price")
    long = file_rows.select("sku", F.posexplode("reviews").alias("position", "_r")).select("sku", "position", "_r.*")
    return entries, long
