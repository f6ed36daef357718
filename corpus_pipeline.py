"""Training data from raw documents in five stages, each an operator of ``parley.llm``.

Every stage's rows are written as Parquet to the shared folder and read again by
the next, so a lost executor costs no more than the stage it was in. All but the
last stage return the columns of documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import bpe, linededup, mixing, neardup, quality
from parley.llm.common import new_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of this corpus."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand in three or more and aren't the last of their kind."""
    own = {c: f"_own{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    rows = docs.withColumnsRenamed(own)  # under numbers, so that no column has a name of the result
    made = linededup.deduplicated(rows, ["doc_id", *own.values()]).withColumns(
        {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)})
    return made.drop("kept_text", "n_lines", "n_dropped").withColumnsRenamed({n: c for c, n in own.items()}).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with 80 % of its shingles of five words in common."""
    return neardup.survivors(docs, words=5)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    return mixing.mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, and digests of the ids and of the bytes that they decode to."""
    return bpe.digested(docs)


STAGES = [("quality classifier", quality_classifier), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup),
          ("source mix", source_mix), ("byte-level BPE", byte_bpe)]

#: Trees and pseudorandom draws can't be said in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
