"""Ranked lexical search by NRA: reads in order of impact, with score intervals, until nothing is open.

Texts are read once: of each document, the number of its terms and the occurrences
of the items' terms are kept. Document and term counts are summed from these. Then
every task builds, for runs of documents, a list for each term with the highest
impact first, and answers every item from them:

All lists of an item are read side by side, each read twice as far as before. A
document's score is at least what was read of it, and at most that plus the next
impact of every list in which it wasn't met. Reading goes on until at least k
documents can't be passed by any other, not even by one never met, and the
intervals of all that reach the k-th score are closed, so that membership, ties
and scores are final. The best k of each run are put together by one ranking, in
which each task first cuts to k.

* Items are taken in blocks of at most ITEMS items or TERMS terms, and the documents
  read once for each block; only the block at hand is held by the driver.
* Missing and empty texts have no terms: such documents never match, such items
  have no rows. An empty table gives no rows.
* Every row is a document or item of its own, also where ids are repeated or
  missing; missing ids come first among equal scores, as do smaller ones.
* A very long text needs memory in proportion to its own length. Further columns,
  whatever their names, are not read.
"""
from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import documents, slices, text_of, written

TOP = 10
ITEMS, TERMS = 1024, 1 << 20    # in one block
RUN_DOCS, RUN_POSTINGS = 1 << 14, 1 << 22  # in one run of documents
AHEAD = 64                      # postings of each list that are read at first
FLOOR, SLOPE = 25, 75           # of a document's length, in per cent
LETTERS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: str) -> list[bytes]:
    """Runs of ASCII letters, digits, and all characters beyond ASCII; A-Z in lower case."""
    return text.encode().translate(LETTERS).split()


def blocks_of(items: DataFrame):
    """(row, item_id, terms with their occurrences) of the items, in blocks."""
    block, n = [], 0
    for k, r in enumerate(items.select("item_id", text_of().alias("text")).toLocalIterator()):
        terms = Counter(terms_of(r.text))
        if block and (len(block) >= ITEMS or n + len(terms) > TERMS):
            yield block
            block, n = [], 0
        block.append((k, r.item_id, terms))
        n += len(terms)
    if block:
        yield block


def occurrences(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, n, and the numbers and occurrences of wanted terms (packed), of documents with a term."""
    def work(batches):
        for b in slices(batches):
            ids, n, terms, times = [], [], [], []
            for d, text in zip(b.column("doc_id").to_pylist(), b.column("_text").to_pylist()):
                words = terms_of(text)
                if not words:
                    continue
                found = Counter(filter(number.__contains__, words))
                ids.append(d), n.append(len(words))
                terms.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)).tobytes())
                times.append(np.fromiter(found.values(), np.int32, len(found)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(times, pa.binary())],
                                             names=["doc_id", "n", "terms", "times"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("_text"))
    return rows.mapInArrow(work, "doc_id bigint, n bigint, terms binary, times binary")


def frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """In how many documents each of the ``size`` terms stands; one sum for each term and task is shuffled."""
    def work(batches):
        df = np.zeros(size, np.int64)
        for b in batches:
            df += np.bincount(np.frombuffer(b"".join(b.column("terms").to_pylist()), np.int32), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in rows.select("terms").mapInArrow(work, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r.term] = r.df
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Lists:
    """The terms' lists of one run of documents, highest impact first."""

    def __init__(self, n: np.ndarray, terms: np.ndarray, docs: np.ndarray, times: np.ndarray, n_docs: int, all_terms: int, size: int):
        length = FLOOR + SLOPE * n * n_docs // all_terms
        impact = 1000000000 * times // (1000 * times + 8 * length[docs])
        order = np.lexsort((-impact, terms))
        self.n, self.docs, self.impact = len(n), docs[order], impact[order]
        self.bounds = np.searchsorted(terms[order], np.arange(size + 1))

    def best(self, lists: list[tuple[int, int]], top: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the ``top`` best for (term, factor) pairs, ties by ``ids``."""
        lists = [(int(self.bounds[t]), int(self.bounds[t + 1]), f) for t, f in lists if f > 0 and self.bounds[t] < self.bounds[t + 1]]
        least = np.zeros(self.n, np.int64)
        done, ahead = [s for s, _, _ in lists], AHEAD
        while lists:
            possible, met, unmet = 0, np.zeros(self.n, np.int64), False
            for k, (start, end, factor) in enumerate(lists):
                upto = min(start + ahead, end)
                least[self.docs[done[k]:upto]] += self.impact[done[k]:upto] * factor
                done[k] = upto
                if upto < end:  # a document not met in this list has this impact there at most
                    next_one = int(self.impact[upto]) * factor
                    met[self.docs[start:upto]] += next_one
                    possible, unmet = possible + next_one, True
            if not unmet:
                break
            limit = max(int(np.partition(least, -top)[-top]) if self.n >= top else 0, 1)
            still_open = (least + (possible - met) >= limit) & (met != possible)
            if not still_open.any():
                break
            ahead *= 2
        found = np.flatnonzero(least > 0)
        found = found[np.lexsort((ids[found], -least[found]))[:top]]
        return found, least[found]


def ranked_in_runs(rows: DataFrame, wanted: list[tuple[int, list[tuple[int, int]]]], n_docs: int, all_terms: int, size: int, top: int) -> DataFrame:
    """(row of the item, doc_id, score): the best of every run of documents."""
    def work(batches):
        def answers(parts: list[pa.RecordBatch]):
            t = pa.Table.from_batches(parts)
            sizes = np.array([len(x) // 4 for x in t.column("terms").to_pylist()], np.int64)
            terms = np.frombuffer(b"".join(t.column("terms").to_pylist()), np.int32)
            times = np.frombuffer(b"".join(t.column("times").to_pylist()), np.int32).astype(np.int64)
            ids = t.column("doc_id").to_pylist()
            order = np.array([-(1 << 63) if d is None else d for d in ids], np.int64)
            lists = Lists(t.column("n").to_numpy(), terms, np.repeat(np.arange(len(ids), dtype=np.int32), sizes), times, n_docs, all_terms, size)
            out = [[], [], []]
            for row, factors in wanted:
                found, scores = lists.best(factors, top, order)
                out[0] += [row] * len(found)
                out[1] += [ids[k] for k in found.tolist()]
                out[2] += scores.tolist()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["row", "doc_id", "score"])

        held, n, postings = [], 0, 0
        for b in slices(batches, 1024):
            held.append(b)
            n, postings = n + b.num_rows, postings + sum(map(len, b.column("terms").to_pylist())) // 4
            if n >= RUN_DOCS or postings >= RUN_POSTINGS:
                yield answers(held)
                held, n, postings = [], 0, 0
        if n:
            yield answers(held)

    return rows.mapInArrow(work, "row bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``top`` best documents."""
    spark, found = docs.sparkSession, []
    kind = items.schema["item_id"].dataType.simpleString()
    for block in blocks_of(items):
        number = {t: k for k, t in enumerate(dict.fromkeys(t for _, _, terms in block for t in terms))}
        rows = written(occurrences(docs, number))
        n_docs, all_terms = rows.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        df = frequencies(rows, len(number))
        weights = {t: weight(n_docs, int(df[k])) for t, k in number.items()}
        wanted = [(row, [(number[t], q * weights[t]) for t, q in terms.items()]) for row, _, terms in block]
        best = ranked_in_runs(rows, wanted, n_docs, all_terms, len(number), top)
        order = Window.partitionBy("row").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(row, item) for row, item, _ in block], f"row bigint, item_id {kind}")
        found.append(best.join(F.broadcast(names), "row").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def query(spark, sf_dir):
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH term AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM term GROUP BY ALL),
size AS (SELECT doc_id, count(*) AS n FROM term GROUP BY doc_id),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS all_terms FROM size),
item AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
w AS (
  SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY t, n_docs),
score AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // all_terms))))::BIGINT AS score
  FROM item JOIN tf USING (t) JOIN w USING (t) JOIN size USING (doc_id), total GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM score WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""
