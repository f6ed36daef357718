"""Keyword hits by postings instead of a scan of all texts.

A text is cut at white space into words. A keyword, which holds no white space,
stands somewhere in the text just if it stands inside one of its words. So the index
has three tables:

* ``words``: each distinct word of the knowledge base with a number,
* ``grams``: the parts of one, two and three characters of each word,
* ``postings``: the documents of each word.

All parts of three characters of a keyword (or the keyword itself, if shorter) give
candidate words by a join; these are verified on the word. Their postings are the
documents with a hit. Texts are read when the index is built and never by a search.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
_KEY = ["doc_type", "source_id"]
#: White space where a text is cut; what else counts as white space elsewhere stays inside words.
_SPACE = r"[ \t\n\x0B\f\r]+"


@dataclass(frozen=True)
class WordIndex:
    folder: str

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{name}")


def _grams(word: Column, size: int) -> Column:
    """The distinct parts of ``size`` characters."""
    n = F.char_length(word)
    places = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(word, i, F.lit(size))))


def build_word_index(kb: DataFrame, folder: str) -> WordIndex:
    """Writes the index of all texts of a knowledge base; a missing text has no words."""
    spark = kb.sparkSession
    cut = F.array_distinct(F.split(F.lower("content"), _SPACE))
    pairs = kb.select(*_KEY, F.explode(cut).alias("word")).where("word <> ''")
    pairs.select("word").distinct().withColumn("word_id", F.monotonically_increasing_id()).write.parquet(f"{folder}/words")
    words = spark.read.parquet(f"{folder}/words")
    sizes = F.concat(*[_grams(F.col("word"), s) for s in range(1, GRAM + 1)])
    # ordered by what is searched for, so that files and row groups outside are passed over; a frequent word spans several files
    grams = words.select(F.explode(sizes).alias("gram"), "word_id")
    grams.repartitionByRange("gram", "word_id").sortWithinPartitions("gram").write.parquet(f"{folder}/grams")
    postings = pairs.join(words, "word").select("word_id", *_KEY).distinct()
    postings.repartitionByRange("word_id", *_KEY).sortWithinPartitions("word_id").write.parquet(f"{folder}/postings")
    return WordIndex(folder)


def words_with(keywords: DataFrame, index: WordIndex) -> DataFrame:
    """(keyword, word_id): the words of the index that a keyword stands in."""
    spark, size = keywords.sparkSession, F.least(F.char_length("keyword"), F.lit(GRAM))
    asked = keywords.select("keyword").distinct().where("keyword <> ''")
    parts = F.when(size == GRAM, _grams(F.col("keyword"), GRAM)).otherwise(F.array("keyword"))
    asked = asked.select("keyword", F.size(parts).alias("wanted"), F.explode(parts).alias("gram"))
    near = asked.join(index.table(spark, "grams"), "gram").groupBy("keyword", "wanted", "word_id").agg(F.count(F.lit(1)).alias("n"))
    near = near.where("n = wanted").join(index.table(spark, "words"), "word_id")
    return near.where(F.contains("word", "keyword")).select("keyword", "word_id")


def documents_with(keywords: DataFrame, index: WordIndex) -> DataFrame:
    """(doc_type, source_id, found): the keywords that stand in each document that has one."""
    hits = words_with(keywords, index).join(index.table(keywords.sparkSession, "postings"), "word_id")
    return hits.groupBy(*_KEY).agg(F.array_sort(F.collect_set("keyword")).alias("found"))


def keywords_of(prepared: DataFrame) -> DataFrame:
    return prepared.select(F.explode("keywords").alias("keyword")).distinct()
