"""Vectors stored in half precision: a quarter of the bytes of doubles, distances as stored, exact order for the first.

A vector is packed into 16-bit floats (little-endian), each rounded to the nearest,
ties to even. A first search reads packed vectors only and gives the distances that
belong to them; its best are scored once more with the whole vectors.
"""
from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators import retrieve

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LARGEST = 65504.0  # beyond it a number has no half
_KEY = ["doc_type", "source_id"]


def packed(vector: str | Column) -> Column:
    """A vector as 16-bit floats; an error for numbers beyond their range, null for a missing vector."""
    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            x = np.asarray(v, np.float64)
            if np.abs(x).max(initial=0) > LARGEST:
                raise ValueError(f"a number beyond {LARGEST} can't be stored in half precision")
            return x.astype("<f2").tobytes()

        return vectors.map(one)

    return pack(vector)


def unpacked(halves: str | Column) -> Column:
    """The numbers of a packed vector."""
    @F.pandas_udf("array<double>")
    def unpack(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else np.frombuffer(b, "<f2").astype(np.float64))

    return unpack(halves)


def half_base(kb: DataFrame) -> DataFrame:
    """A knowledge base with packed vectors instead of whole ones."""
    return kb.withColumn("halves", packed("embedding")).drop("embedding")


def half_candidates(prepared: DataFrame, base: DataFrame, *, k: int = retrieve.CANDIDATES) -> DataFrame:
    """Best ``k`` per query by the distances of packed vectors, as ``retrieve.candidates``.

    Each task decodes its Arrow batches; whole vectors are neither read nor shuffled.
    """
    return retrieve.candidates(prepared, base.withColumn("embedding", unpacked("halves")), k=k)


def rescored(found: DataFrame, prepared: DataFrame, kb: DataFrame) -> DataFrame:
    """Candidates with ``exact_dist``, the distance of whole vectors, and ``rank`` by it and the keyword bonus.

    Only the candidates' keys meet the whole vectors.
    """
    query = prepared.select("query_id", F.col("embedding").alias("_asked"))
    whole = kb.select(*_KEY, F.col("embedding").alias("_own"))

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        x, y = (retrieve._unit(np.stack(s).astype(np.float64)) for s in (a, b))
        return pd.Series(np.round(1.0 - (x * y).sum(1), 10))

    made = found.join(whole, _KEY).join(query, "query_id").withColumn("exact_dist", distance("_own", "_asked"))
    order = Window.partitionBy("query_id").orderBy(F.round(F.col("exact_dist") - F.col("keyword_bonus"), 10), *_KEY)
    return made.withColumn("rank", F.row_number().over(order)).drop("_own", "_asked")
