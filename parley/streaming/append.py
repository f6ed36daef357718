"""Continuous append of chat turns to the chat_logs table."""
from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from parley import schemas
from parley.functions.kernels import day, event_time
from parley.operators import enrich
from parley.streaming.ordered import in_order

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TURN = T.StructType([
    *schemas.struct_of("session_id:s message_id:s timestamp:t user_message:s assistant_response:s").fields,
    T.StructField("retrieved_sources", schemas.SOURCES), T.StructField("history", schemas.HISTORY),
    *schemas.struct_of("latency_ms:i embed_ms:i db_ms:i rag_ms:i llm_ms:i ttft_ms:i embed_model:s llm_error_type:s"
                     " intent_text:s target_text:s intent_tokens_in:i intent_tokens_out:i").fields])


def read_turns(spark: SparkSession, folder: str, *, files_per_trigger: int = 100) -> DataFrame:
    """Turns as JSON files arriving in a folder."""
    return (spark.readStream.schema(TURN).option("maxFilesPerTrigger", files_per_trigger).json(folder))


def unique_turns(turns: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drops repeated deliveries of a message within the lateness bound."""
    return event_time(turns, delay).dropDuplicatesWithinWatermark(["message_id"])


def write_fact(rows: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends rows as Parquet by day. ``checkpoint`` belongs in the shared
    folder of the cluster."""
    by_day = rows.withColumn("date", day())
    return (by_day.writeStream.format("parquet").outputMode("append").partitionBy("date")
            .option("path", folder).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


#: A session that was quiet for so long starts anew: its last message is no longer remembered.
QUIET_MS = 7 * 24 * 3600 * 1000
_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "true"}


def with_stream_frustration(logged: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """Frustration signal and reason for a stream of logged turns, as ``enrich.with_frustration`` for a table.

    Each session's state holds its previous message and whether its last turn that
    reached an answer was left unanswered; turns are taken in the order of events once
    the watermark has passed them. The other columns travel as one text.
    """
    reached = ~F.col("route").isin(enrich.INJECTION, enrich.VULGAR)
    rows = logged.select("session_id", "message_id", "timestamp", "user_message",
                         F.when(reached, F.col("is_unanswered")).alias("unanswered"),
                         F.to_json(F.struct(*[c for c in logged.columns if c != "timestamp"]), _TIMES).alias("whole"))

    def step(key, turns: pd.DataFrame, carried) -> tuple[pd.DataFrame, tuple]:
        message, unanswered = carried or (None, None)
        messages, answers = [], []
        for text, known in zip(turns["user_message"], turns["unanswered"]):
            messages.append(message), answers.append(unanswered)
            message = text
            if known is not None and known == known:
                unanswered = bool(known)
        made = turns[["timestamp", "whole"]].assign(previous=messages, previous_unanswered=pd.Series(answers, dtype="object"))
        return made, (message, unanswered)

    made = in_order(rows, "session_id", "message_id",
                    "timestamp timestamp, whole string, previous string, previous_unanswered boolean", step, quiet_ms)
    fields = T.StructType([f for f in logged.schema.fields if f.name != "timestamp"])
    made = made.withColumn("_r", F.from_json("whole", fields, {"timestampNTZFormat": _TIMES["timestampNTZFormat"]}))
    made = made.select("timestamp", "_r.*", F.lower("previous").alias("_low_previous"), "previous_unanswered")
    reason = enrich.d.frustration_reason(F.lower("user_message"), F.col("_low_previous"), F.col("previous_unanswered"))
    return made.withColumn("frustration_reason", reason).drop("_low_previous", "previous_unanswered").withColumn(
        "frustration_signal", F.col("frustration_reason").isNotNull())


def stream_turns(turns: DataFrame) -> DataFrame:
    """The enrichment of a stream of turns that carry their history; turns come out once the watermark has passed them."""
    routed = enrich.with_route(enrich.with_history(enrich.with_optional(unique_turns(turns))))
    made = enrich.with_quality(routed.where(F.col("route") != enrich.ENDING))
    return enrich.shape_logs(with_stream_frustration(made))
