"""Quality rules over lines that many documents of a host share.

Lines are normalised (white space at the ends off, A-Z in lower case, runs of
digits as one 0) and hashed. A line that stands in more than ``MOST_DOCS``
distinct documents of its host (``source``) is boilerplate there and taken off. A
document is depleted, and rejected, if fewer than ``LEAST_WORDS`` words or less than
``LEAST_SHARE`` % of its words are left.

Documents are told apart by a hash of their whole raw text, so exact copies of one
document count once: being copied makes no line boilerplate. Texts that differ
anywhere, be it by a number that normalising erases, are documents of their own.

* Missing and empty texts have no words, fail the base rules and are rejected. An
  empty table gives no rows.
* Rows without a host form one host. Repeated rows each get their own result.
* Whole texts are read; a very long one needs memory in proportion to its length.
  Further columns of the documents, whatever their names, are not read.
* A third of all rows may share a host or a line: lines are counted after a
  partial count in each task, and rows meet the boilerplate lines in a join whose
  crowded parts Spark splits.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import SPACE, WORD, lower_ascii, slices, text_of

MOST_DOCS = 20
LEAST_WORDS, LEAST_SHARE = 20, 20
WINDOW = 8
SYMBOLS, BLANKS = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that stand twice or more in the text."""
    n = len(words)
    if n <= size:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    mixed = np.zeros(n - size + 1, np.uint64)
    for k in range(size):  # a first look: texts without equal hashes have no equal windows
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k:n - size + 1 + k]
    if len(np.unique(mixed)) == len(mixed):
        return 0
    ids, length = numbered(words), 1
    while length < size:  # equal numbers stand for equal windows, doubled in length each time
        ids = np.unique(ids[:-length] * (ids.max() + 1) + ids[length:], return_inverse=True)[1]
        length *= 2
    marked = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(np.bincount(ids)[ids] > 1)
    np.add.at(marked, at, 1)
    np.add.at(marked, at + size, -1)
    return int((marked.cumsum()[:n] > 0).sum())


def numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(BLANKS)]
    return (len(words), len(text) - (len(raw) - len(raw.translate(None, BLANKS))), len(raw) - len(raw.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated(words))


def with_base(rows: DataFrame) -> DataFrame:
    """Rows (text last) with the base counts in place of the text."""
    def count(batches):
        for b in slices(batches):
            got = [base_counts(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], *(pa.array(c, pa.int64()) for c in (zip(*got) if got else [[]] * 5))],
                names=[*b.schema.names[:-1], *COUNTS])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(count, ", ".join([kinds, *(f"{c} bigint" for c in COUNTS)]))


def normal(line: Column) -> Column:
    return F.regexp_replace(lower_ascii(F.btrim(line, F.lit(SPACE))), "[0-9]+", "0")


def normal_lines(text: Column) -> Column:
    """The distinct normalised lines that hold a word."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "\n", -1), normal), lambda x: x != ""))


def boilerplate(docs: DataFrame, most: int = MOST_DOCS) -> DataFrame:
    """(host, line): lines in more than ``most`` distinct documents of a host."""
    rows = docs.select(F.col("source").alias("host"), F.xxhash64(text_of()).alias("document"),
                       F.explode(F.transform(normal_lines(text_of()), lambda x: F.xxhash64(x))).alias("line"))
    return rows.distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > most).select("host", "line")


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, n_boilerplate (words on boilerplate lines), base_failed and kept of every row."""
    # one row for each line; the first carries the counts, so texts are read once here
    lines = F.transform(F.split(text_of(), "\n", -1), lambda x: F.struct(
        F.xxhash64(normal(x)).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words")))
    base = with_base(docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.col("source").alias("host"),
                                 lines.alias("lines"), text_of().alias("_text")))
    rows = base.select("row_id", "host", *(F.col(c).alias(f"_{c}") for c in COUNTS), "doc_id", F.posexplode("lines").alias("pos", "of"))
    rows = rows.where((F.col("pos") == 0) | (F.col("of.words") > 0)).select(
        "row_id", "host", "of.line", "of.words", *(F.when(F.col("pos") == 0, F.col(x)).alias(c) for c, x in
                                                   [("doc_id", "doc_id"), *((c, f"_{c}") for c in COUNTS)]))
    common = boilerplate(docs)
    found = rows.join(common, rows["host"].eqNullSafe(common["host"]) & (rows["line"] == common["line"]), "left").select(
        "row_id", "doc_id", *COUNTS, F.when(common["line"].isNotNull(), F.col("words")).otherwise(0).alias("off"))
    made = found.groupBy("row_id").agg(F.max("doc_id").alias("doc_id"), *(F.max(c).alias(c) for c in COUNTS),
                                       F.sum("off").alias("n_boilerplate")).drop("row_id")
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    left = F.col("n_words") - F.col("n_boilerplate")
    return made.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (left >= LEAST_WORDS) & (left * 100 >= F.col("n_words") * LEAST_SHARE))


def query(spark, sf_dir):
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
again AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM win) WHERE n > 1),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
line AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line
  FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)),
mine AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         regexp_replace(translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g') AS key
  FROM line),
dup AS (SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines FROM mine GROUP BY doc_id),
base AS (
  SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(w.text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
common AS (
  SELECT source, key FROM mine JOIN w USING (doc_id) WHERE key <> ''
  GROUP BY source, key HAVING count(DISTINCT w.text) > 20),
off AS (
  SELECT mine.doc_id, sum(n) AS n_boilerplate FROM mine JOIN common
  ON mine.source IS NOT DISTINCT FROM common.source AND mine.key = common.key GROUP BY mine.doc_id),
out AS (
  SELECT base.*, coalesce(n_boilerplate, 0)::BIGINT AS n_boilerplate,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM base LEFT JOIN off USING (doc_id))
SELECT *, NOT base_failed AND n_words - n_boilerplate >= 20
       AND 5 * (n_words - n_boilerplate) >= n_words AS kept
FROM out
"""
