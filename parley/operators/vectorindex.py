"""Approximate hybrid search by an inverted file of vectors.

Centres come from a distributed spherical k-means over a bounded sample. Every
vector is written to the folder of its nearest centre (its cell), without texts. A
query visits the cells of its nearest centres only: other cells aren't read at
all, as the cell is the partition column of the files. Inside the visited cells
scores are exact, by the same code as the exact search, so what is found is the
exact result less the neighbours that lie in other cells.

How many cells a query has to visit for a wanted recall is read off an exact search
for a bounded sample of queries (``probes_for``): the share of exact neighbours
whose cell is among the first p of its query is the recall of p visits.

Crowded cells are split by key and their queries by blocks, so that neither a cell
nor a query set has to fit one task.
"""
from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.operators import retrieve

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_ROWS = 1 << 18       # vectors that the centres are fitted on, about
SAMPLE_QUERIES = 256        # queries that the number of visits is fitted on
MOST_CELLS = 1 << 14        # so a task holds at most so many centres
CENTRE_BYTES = 64 << 20     # and so many bytes of them
FILE_BYTES = 64 << 20       # vectors of a cell that one task writes, about; a crowded cell has several files
ROUNDS = 10
_KEY = ["doc_type", "source_id"]


@dataclass(frozen=True)
class VectorIndex:
    """Folder of the files; unit vectors of the centres and number of rows by cell."""
    folder: str
    centres: np.ndarray
    sizes: np.ndarray

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/vectors")


def _nearest(centres: np.ndarray, vectors, n: int) -> np.ndarray:
    """The ``n`` nearest cells of each vector, nearest first; ties by number."""
    close = np.round(retrieve._unit(np.stack(vectors).astype(np.float64)) @ centres.T, 10)
    return np.argsort(-close, axis=1, kind="stable")[:, :n]


def _cell(centres: np.ndarray):
    @F.pandas_udf("int")
    def cell(vectors: pd.Series) -> pd.Series:
        return pd.Series(_nearest(centres, vectors, 1)[:, 0] if len(vectors) else [], dtype="int32")

    return cell


def _fitted(sample: DataFrame, centres: np.ndarray, rounds: int) -> np.ndarray:
    """Centres moved to the mean direction of their vectors, round by round; a cell without vectors stays."""
    dim = centres.shape[1]
    sums = ", ".join(f"s{i} double" for i in range(dim))

    for _ in range(rounds):
        now = centres

        def partial(batches):
            total = np.zeros((len(now), dim))
            for b in batches:
                if len(b):
                    np.add.at(total, _nearest(now, b["embedding"], 1)[:, 0], retrieve._unit(np.stack(b["embedding"]).astype(np.float64)))
            seen = np.flatnonzero(np.abs(total).sum(1))
            yield pd.DataFrame(total[seen], columns=[f"s{i}" for i in range(dim)]).assign(cell=seen)

        moved = sample.mapInPandas(partial, f"{sums}, cell int").groupBy("cell").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(dim)])
        centres = centres.copy()
        for r in moved.toLocalIterator():  # a row for each cell
            centres[r.cell] = np.array(r[1:])
        centres = retrieve._unit(centres)
        if np.abs(centres - now).max() < 1e-6:
            break
    return centres


def _by_files(dealt: DataFrame, sample: DataFrame, centres: np.ndarray, n: int, most: int) -> DataFrame:
    """Rows of a cell in one task, those of a cell with more than ``most`` of the ``n`` rows, by the sample, in several."""
    seen = sample.select(_cell(centres)("embedding").alias("cell")).groupBy("cell").count().collect()  # a row for each cell
    each = n / max(1, sum(r["count"] for r in seen))
    crowded = [(r.cell, -(-int(r["count"] * each) // most)) for r in seen if r["count"] * each > most]
    if not crowded:
        return dealt.repartition("cell")
    files = F.broadcast(dealt.sparkSession.createDataFrame(crowded, "cell int, files int"))
    return dealt.join(files, "cell", "left").repartition("cell", F.pmod(F.xxhash64(*_KEY), F.coalesce("files", F.lit(1)))).drop("files")


def build_index(kb: DataFrame, folder: str, *, cells: int | None = None, rounds: int = ROUNDS) -> VectorIndex:
    """Writes the index of a knowledge base; rows without a vector are left out. About sqrt(rows) cells by default."""
    spark, rows = kb.sparkSession, retrieve._doc_columns(kb).drop("low").where("embedding is not null")
    place = F.pmod(F.xxhash64(*_KEY), F.lit(1 << 30))
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not n:
        raise ValueError("there are no vectors to index")
    cells = min(cells or max(1, round(n ** 0.5)), n, MOST_CELLS, max(1, CENTRE_BYTES // (8 * dim)))
    share = max(SAMPLE_ROWS, 4 * cells) / n
    picked = rows if share >= 1 else rows.where(place < int(share * (1 << 30)))
    picked.select(place.alias("place"), *_KEY, "embedding").write.parquet(f"{folder}/sample")
    sample = spark.read.parquet(f"{folder}/sample")
    first = sample.orderBy("place", *_KEY).limit(cells).collect()
    centres = _fitted(sample, retrieve._unit(np.array([r.embedding for r in first], np.float64)), rounds)
    dealt = _by_files(rows.withColumn("cell", _cell(centres)("embedding")), sample, centres, n, max(1, FILE_BYTES // (4 * dim)))
    dealt.sortWithinPartitions("cell").write.partitionBy("cell").parquet(f"{folder}/vectors")
    sizes = np.zeros(len(centres), np.int64)
    for r in spark.read.parquet(f"{folder}/vectors").groupBy("cell").count().collect():
        sizes[r.cell] = r["count"]
    table = [(k, c.tolist(), int(m)) for k, (c, m) in enumerate(zip(centres, sizes))]
    spark.createDataFrame(table, "cell int, centre array<double>, n bigint").coalesce(1).write.parquet(f"{folder}/centres")
    return VectorIndex(folder, centres, sizes)


def open_index(spark: SparkSession, folder: str) -> VectorIndex:
    rows = spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()  # at most MOST_CELLS
    return VectorIndex(folder, np.array([r.centre for r in rows]), np.array([r.n for r in rows]))


def _visits(prepared: DataFrame, index: VectorIndex, probes: int) -> DataFrame:
    """The query rows, once for each cell that they visit, with the cell's place in their order."""
    centres = index.centres

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(_nearest(centres, vectors, probes).astype(np.int32)) if len(vectors) else [])

    return retrieve._query_rows(prepared).select("*", F.posexplode(nearest("embedding")).alias("visit", "cell"))


def approximate_candidates(prepared: DataFrame, index: VectorIndex, *, probes: int, k: int = retrieve.CANDIDATES,
                           found: DataFrame | None = None) -> DataFrame:
    """Best ``k`` documents per query among ``probes`` cells, as the exact ``candidates``.

    ``found`` (doc_type, source_id, found: array of keywords) gives the keyword hits, as
    made by the word index; without it no document has a bonus.
    """
    spark = prepared.sparkSession
    visits = _visits(prepared, index, probes)
    asked = {r.cell: r["count"] for r in visits.groupBy("cell").count().collect()}  # at most a row for each cell
    parts = [(c, -(-int(index.sizes[c]) // retrieve.DOC_BLOCK), -(-n // retrieve.QUERY_BLOCK)) for c, n in asked.items() if index.sizes[c]]
    tables = [F.broadcast(spark.createDataFrame(parts, "cell int, n_docs int, n_queries int")) for _ in range(2)]  # a row for each cell at most
    rows = index.rows(spark).where(F.col("cell").isin([c for c, _, _ in parts]))
    rows = rows.withColumn("found", F.array().cast("array<string>")) if found is None else rows.join(found, _KEY, "left")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    block = lambda key, n: F.pmod(F.xxhash64(*key), F.col(n)).cast("int")
    left = visits.join(tables[0], "cell").withColumn("_q", block(["query_id"], "n_queries")).withColumn("_d", upto("n_docs"))
    right = rows.join(tables[1], "cell").withColumn("_d", block(_KEY, "n_docs")).withColumn("_q", upto("n_queries"))

    def best(q: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        if q.empty or docs.empty:
            return retrieve._NONE
        asked_here = retrieve._Block.of(q["query_id"], q["embedding"], q["detected_category"], q["price_filter_value"], q["keywords"])
        return retrieve._best(asked_here, docs.drop(columns=["cell", "_d", "_q", "n_docs", "n_queries"]), k)

    group = ["cell", "_q", "_d"]
    made = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(best, retrieve._OUT)
    query = Window.partitionBy("query_id")
    ranked = made.withColumn("hybrid_rank", F.row_number().over(query.orderBy(*retrieve._ORDER))).where(F.col("hybrid_rank") <= k)
    return ranked.withColumn("ann_candidates_count", F.count(F.lit(1)).over(query))


def probes_for(prepared: DataFrame, kb: DataFrame, index: VectorIndex, *, target: float = 0.9, k: int = retrieve.CANDIDATES) -> int:
    """The least number of visits with the wanted mean recall for a sample of the queries."""
    sample = prepared.orderBy(F.xxhash64("query_id"), "query_id").limit(SAMPLE_QUERIES)
    exact = retrieve.candidates(sample, kb, k=k).select("query_id", *_KEY)
    order = _visits(sample, index, len(index.centres)).select("query_id", "cell", "visit")
    cells = index.rows(prepared.sparkSession).select(*_KEY, "cell")
    met = exact.join(cells, _KEY).join(order, ["query_id", "cell"]).groupBy("visit").count().orderBy("visit").collect()  # a row for each cell
    total, seen = sum(r["count"] for r in met), 0
    for r in met:
        seen += r["count"]
        if seen >= target * total:
            return r.visit + 1
    return 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, the number of exact neighbours and how many of them were found."""
    key = ["query_id", *_KEY]
    hit = found.select(*key, F.lit(1).alias("hit"))
    return exact.select(*key).join(hit, key, "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("found"))
