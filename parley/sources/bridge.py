"""Gives the test tables (events, part, lineitem, ...) the shapes the operators
expect: chat_logs, chat_events, feedback, session_reviews, products and so on.

Row-wise shaping is SQL text; the turn number needs the order of a session and
goes through the segmented state helper. Its join can't be pruned, so queries
that read no turn number leave it out.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.segments import TotalBefore, minute_segment, with_state
from parley.sources import bridge_sql as sql

AS_OF = datetime(2024, 1, 31)
# What the join of a view can meet of an input: remainders of 100, of either sign.
MET = {("kb", "products"): "id between -99 and 99"}


class Bridge(Mapping):
    """Lazy mapping of table name to DataFrame over one data folder; ``turn_numbers``
    says whether chat_logs has turn numbers."""

    def __init__(self, spark: SparkSession, folder: str, turn_numbers: bool = True):
        self.spark, self.folder, self.turn_numbers = spark, folder, turn_numbers
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def __iter__(self):
        return iter([*sql.VIEWS, "chat_logs"])

    def __len__(self):
        return len(sql.VIEWS) + 1

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _make(self, name: str) -> DataFrame:
        if name == "chat_logs":
            return self._chat_logs()
        if name not in sql.VIEWS:
            return self.raw(name)
        inputs, text = sql.VIEWS[name]
        return self.spark.sql(text, **{i: self[i].where(MET.get((name, i), "true")) for i in inputs})

    def _chat_logs(self) -> DataFrame:
        plain = self.spark.sql(sql.CHAT_LOGS, chat_turns_raw=self["chat_turns_raw"])
        if not self.turn_numbers:
            return plain.drop("event_id")
        numbered = with_state(plain, "session_id", ["timestamp", "event_id"], minute_segment(),
                              {"_before": TotalBefore(F.lit(1))})
        turn = (F.col("_before") + 1).cast("bigint")
        return numbered.withColumn("turn_number", turn).drop("_before", "event_id")


def bridge(make: Callable[..., DataFrame], *, turn_numbers: bool = True) -> Callable[[SparkSession, str], DataFrame]:
    """Turns ``make(tables)`` into the ``(spark, folder)`` form of the driver."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return make(Bridge(spark, folder, turn_numbers))
    return run
