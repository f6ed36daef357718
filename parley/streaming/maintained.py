"""A maintained table of daily roll-ups: every batch adds its days, late ones too.

A batch writes the roll-up of its own turns into a folder of its own, by its number;
written again after a failure it replaces itself, so nothing counts twice and no day
is ever rewritten in place. Counts and sums add up and sketches merge, whatever the
order of the batches. Each ``BLOCK`` batches are merged into one folder, so a reader
meets at most ``BLOCK`` single batches and one row per day and block.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.functions.kernels import day
from parley.streaming.rollups import COUNTS, daily_rollup, rollup_columns

BLOCK = 32


def merged_days(rollup: DataFrame) -> DataFrame:
    """One row per date of roll-ups that hold parts of days."""
    sums = ["requests", *COUNTS, "ttft_sum", "cost_sum"]
    return rollup.groupBy("date").agg(
        *[F.sum(c).alias(c) for c in sums], F.hll_union_agg("sessions_sketch").alias("sessions_sketch"),
        F.expr("kll_merge_agg_bigint(latency_sketch)").alias("latency_sketch"))


def rollup_step(folder: str, block: int = BLOCK) -> Callable[[DataFrame, int], None]:
    """What a trigger does with its batch of turns; batches are numbered from 0 without gaps."""
    def step(turns: DataFrame, batch: int) -> None:
        daily_rollup(turns).write.mode("overwrite").parquet(f"{folder}/batches/batch={batch}")
        if (batch + 1) % block == 0:
            own = turns.sparkSession.read.parquet(f"{folder}/batches").where(F.col("batch").between(batch + 1 - block, batch))
            merged_days(own).write.mode("overwrite").parquet(f"{folder}/blocks/block={batch // block}")

    return step


def maintain(chat_logs: DataFrame, folder: str, checkpoint: str, block: int = BLOCK, **trigger) -> StreamingQuery:
    """Keeps the roll-up table of a stream of turns below ``folder``."""
    return (chat_logs.writeStream.foreachBatch(rollup_step(folder, block)).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def rollup_days(spark: SparkSession, folder: str, block: int = BLOCK) -> DataFrame:
    """The maintained table, one row per date, as ``rollups.daily_rollup`` has them.

    A block is read once a later batch exists, as it was complete before that began.
    """
    batches = spark.read.parquet(f"{folder}/batches")
    whole = (batches.agg(F.max("batch")).first()[0] or 0) // block
    parts = batches.where(F.col("batch") >= whole * block).drop("batch")
    if whole:
        parts = spark.read.parquet(f"{folder}/blocks").where(F.col("block") < whole).drop("block").unionByName(parts)
    return merged_days(parts)


def checked_days(chat_logs: DataFrame, *, pieces: int = 8, sessions_error: float = 0.05, rank_error: float = 0.02) -> DataFrame:
    """Days merged from ``pieces`` partial roll-ups each, with every sketch replaced by whether it holds its bound
    (as in ``rollups.checked_period``; a rank may miss by one row on top)."""
    piece = F.pmod(F.xxhash64("message_id"), F.lit(pieces))
    parts = chat_logs.groupBy(day().alias("date"), piece.alias("_piece")).agg(*rollup_columns()).drop("_piece")
    days = merged_days(parts).select(
        "date", "requests", *COUNTS, F.hll_sketch_estimate("sessions_sketch").alias("_about"),
        F.expr("kll_sketch_get_quantile_bigint(latency_sketch, 0.95D)").alias("_p95"))
    turns = chat_logs.select(day().alias("date"), "session_id", "latency_ms").join(days.select("date", "_p95"), "date")
    exact = turns.groupBy("date").agg(
        F.count_distinct("session_id").alias("_sessions"), F.count("latency_ms").alias("_n"),
        F.count_if(F.col("latency_ms") < F.col("_p95")).alias("_below"), F.count_if(F.col("latency_ms") <= F.col("_p95")).alias("_upto"))
    sessions = F.abs(F.col("_about") - F.col("_sessions")) <= F.col("_sessions") * sessions_error
    rank = ((F.col("_below") <= F.col("_n") * (0.95 + rank_error) + 1) & (F.col("_upto") >= F.col("_n") * (0.95 - rank_error) - 1))
    return days.join(exact, "date").select("date", "requests", *COUNTS, sessions.alias("sessions_within"), rank.alias("p95_within"))
