"""The live summary: reports over the newest turns, written anew by every trigger.

The ring of the newest turns is a table of at most ``n`` rows in the shared folder.
A trigger merges it with its own newest rows (each partition gives at most ``n``) and
writes the next ring into the other of two slots, so a batch that is repeated after a
failure reads the ring it read before and gives the same result. Turns may arrive in
any order: the newest of all are the newest of the ring and of the batch.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.streaming.alerts import ROLLING, newest, rolling_categories, rolling_errors, rolling_summary

REPORTS = {"summary": rolling_summary, "errors": rolling_errors, "categories": rolling_categories}


def ring_step(folder: str, n: int = ROLLING) -> Callable[[DataFrame, int], None]:
    """What a trigger does with its batch of turns; batches are numbered from 0 without gaps."""
    slots = [f"{folder}/ring/{k}" for k in (0, 1)]

    def step(turns: DataFrame, batch: int) -> None:
        read = turns.sparkSession.read.schema(turns.schema)
        if batch:
            turns = read.parquet(slots[(batch - 1) % 2]).unionByName(turns)
        newest(turns, n).write.mode("overwrite").parquet(slots[batch % 2])
        ring = read.parquet(slots[batch % 2])
        for name, report in REPORTS.items():
            report(ring, n).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")

    return step


def live_summary(chat_logs: DataFrame, folder: str, checkpoint: str, n: int = ROLLING, **trigger) -> StreamingQuery:
    """Keeps the reports over the newest ``n`` turns of a stream below ``folder``."""
    return (chat_logs.writeStream.foreachBatch(ring_step(folder, n)).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def latest(spark: SparkSession, folder: str, name: str = "summary") -> DataFrame:
    """A report as the last trigger left it. The summary has a row for each trigger, the others may have none."""
    last = spark.read.parquet(f"{folder}/summary").agg(F.max("batch")).first()[0]
    return spark.read.parquet(f"{folder}/{name}").where(F.col("batch") == last).drop("batch")
