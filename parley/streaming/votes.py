"""Votes that meet the turns they are about, both as streams."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley import schemas
from parley.functions.kernels import event_time
from parley.sources.tables import Checked, checked_votes

TURN_COLUMNS = ("turn_number", "detected_category")


def feedback_stream(votes: DataFrame, turns: DataFrame, *, delay: str = "10 minutes", before: str = "1 day",
                    after: str = "1 hour") -> Checked:
    """``tables.feedback_rows`` for streams: votes of 1 or -1 with turn number and category of the voted message.

    A turn is found if it was logged up to ``before`` earlier or ``after`` later than its
    vote. A vote goes out as soon as it meets its turn, or without turn columns once the
    watermarks of both streams tell that none can come. State holds turns for ``before``
    and votes for ``after``; a turn that is delivered again counts once. Rejected votes
    don't wait and have no turn columns.
    """
    checked = checked_votes(votes.drop(*TURN_COLUMNS))
    waiting = event_time(checked.accepted.drop(*TURN_COLUMNS), delay)
    known = event_time(turns.select("message_id", "timestamp", *TURN_COLUMNS), delay).dropDuplicatesWithinWatermark(["message_id"])
    known = known.withColumnsRenamed({"message_id": "_message", "timestamp": "_logged"})
    meets = ((F.col("message_id") == F.col("_message")) & (F.col("_logged") >= F.col("timestamp") - F.expr(f"interval {before}"))
             & (F.col("_logged") <= F.col("timestamp") + F.expr(f"interval {after}")))
    rows = waiting.join(known, meets, "leftOuter")
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.FEEDBACK.fields]
    return Checked(rows.select(*columns), checked.rejected)
