"""Streams that keep tables: the live summary, votes that meet turns, the roll-up table."""
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parley.sources import tables as sources
from parley.streaming import alerts, append, live, maintained, rollups, votes

T = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def logs(spark, tables, tmp_path_factory):
    """Chat logs in four parts whose times overlap."""
    folder = str(tmp_path_factory.mktemp("logs") / "rows")
    tables["chat_logs"].withColumn("_part", F.pmod(F.xxhash64("message_id"), F.lit(4))).write.parquet(folder)
    return spark.read.parquet(folder)


def part(logs, *ks):
    return logs.where(F.col("_part").isin(*ks)).drop("_part")


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_live_summary_equals_batch_after_every_trigger(spark, logs, tmp_path):
    for k in range(4):
        part(logs, k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema(part(logs, 0).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.live_summary(stream, str(tmp_path / "live"), str(tmp_path / "cp"), n=40).awaitTermination()
    for name, report in live.REPORTS.items():
        kept = spark.read.parquet(str(tmp_path / "live" / name))
        for k in range(4):
            assert rows(kept.where(F.col("batch") == k).drop("batch")) == rows(report(part(logs, *range(k + 1)), 40)), (name, k)
    assert rows(live.latest(spark, str(tmp_path / "live"))) == rows(alerts.rolling_summary(logs, 40))


def test_a_repeated_trigger_leaves_the_ring_as_it_was(spark, logs, tmp_path):
    step = live.ring_step(str(tmp_path), n=40)
    for k in (0, 1, 1, 2, 2):
        step(part(logs, k), k)
    assert rows(live.latest(spark, str(tmp_path))) == rows(alerts.rolling_summary(part(logs, 0, 1, 2), 40))
    step(part(logs, 3).limit(0), 3)  # a batch without turns keeps the ring
    assert rows(live.latest(spark, str(tmp_path), "categories")) == rows(alerts.rolling_categories(part(logs, 0, 1, 2), 40))


def vote(k, minute, rating=1):
    return (f"m{k}", "s", T + timedelta(minutes=minute), rating, None, "fine")


def turn(k, minute, number):
    return (f"m{k}", T + timedelta(minutes=minute), number, "Paint")


def test_votes_meet_turns_of_a_stream(spark, tmp_path):
    """Turns before and after their votes, one delivered twice, one missing, two votes on one turn, votes out of range."""
    voted = [[vote(1, 5), vote(2, 6, -1), vote(3, 7)], [vote(1, 8, -1), vote(4, 9, 5), vote(None, 9)], [vote("end", 4000), vote("end", 8000)]]
    logged = [[turn(1, 1, 3)], [turn(1, 1, 3), turn(2, 11, 4), turn(4, 8, 2)], [turn("end", 4000, 1), turn("end2", 8000, 1)]]
    kinds = {"votes": "message_id string, session_id string, timestamp timestamp_ntz, rating int, user_message string, assistant_response string",
             "turns": "message_id string, timestamp timestamp_ntz, turn_number int, detected_category string"}
    streams, whole = {}, {}
    for name, batches in (("votes", voted), ("turns", logged)):
        for batch in batches:
            if name == "votes":
                batch = [(None if r[0] == "mNone" else r[0], *r[1:]) for r in batch]
            spark.createDataFrame(batch, kinds[name]).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            time.sleep(0.05)
        whole[name] = spark.read.parquet(str(tmp_path / name))
        streams[name] = spark.readStream.schema(kinds[name]).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    made = votes.feedback_stream(streams["votes"], streams["turns"])
    got = {}
    for name, df in (("accepted", made.accepted), ("rejected", made.rejected)):
        df.writeStream.format("memory").queryName(f"votes_{name}").option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(
            availableNow=True).start().awaitTermination()
        got[name] = spark.table(f"votes_{name}").where("coalesce(message_id, '') not like 'mend%'")
    want = sources.feedback_rows(whole["votes"], whole["turns"])
    assert rows(got["accepted"]) == rows(want.accepted.where("message_id not like 'mend%'"))
    assert {(r.message_id, r.turn_number) for r in got["accepted"].collect()} == {("m1", 3), ("m2", 4), ("m3", None)}
    assert sorted(str(r.message_id) for r in got["rejected"].collect()) == ["None", "m4"]


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (2, 2, 0, 3, 3, 1)])
def test_maintained_rollup_of_replayed_and_reordered_batches(spark, logs, tmp_path, order):
    step, batch, seen = maintained.rollup_step(str(tmp_path), block=2), -1, None
    for k in order:
        batch += k != seen  # the same part again is the same batch, repeated after a failure
        seen = k
        step(part(logs, k), batch)
    got = maintained.rollup_days(spark, str(tmp_path), block=2)
    whole = rollups.daily_rollup(logs)
    exact = ["date", "requests", *rollups.COUNTS, "ttft_sum"]
    assert rows(got.select(exact)) == rows(whole.select(exact)) and got.count() > 5
    period, want = rollups.period_from_rollup(got).first(), rollups.period_from_rollup(whole).first()
    assert (period.requests, period.approx_sessions, period.avg_ttft_ms) == (want.requests, want.approx_sessions, want.avg_ttft_ms)
    assert period.total_cost_usd == pytest.approx(want.total_cost_usd)


def test_maintained_rollup_of_a_stream(spark, logs, tmp_path):
    for k in range(3):
        part(logs, k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema(part(logs, 0).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    maintained.maintain(stream, str(tmp_path / "days"), str(tmp_path / "cp"), block=2).awaitTermination()
    got = maintained.rollup_days(spark, str(tmp_path / "days"), block=2)
    want = rollups.daily_rollup(part(logs, 0, 1, 2))
    assert rows(got.select("date", "requests", "errors")) == rows(want.select("date", "requests", "errors"))


def test_events_and_reviews_arrive_as_streams(spark, tmp_path):
    """The row rules are the same on a stream; accepted rows land by day, rejected ones are kept."""
    kinds = {"events": "event_type string, session_id string, timestamp timestamp_ntz, message_id string, product_id string, product_name string",
             "reviews": "session_id string, timestamp timestamp_ntz, stars int"}
    batches = {"events": [[("click", "s", T, "m", None, None), (None, "s", T, "m", "1", "x")], [("click", "r", T + timedelta(days=1), None, "2", "y")]],
               "reviews": [[("s", T, 5), ("s", T, 0)], [("r", T + timedelta(days=1), 1), ("r", T, None)]]}
    rules = {"events": sources.event_rows, "reviews": sources.review_rows}
    for name, rule in rules.items():
        folder = str(tmp_path / name)
        for chunk in batches[name]:
            spark.createDataFrame(chunk, kinds[name]).coalesce(1).write.mode("append").parquet(folder)
        made = rule(spark.readStream.schema(kinds[name]).option("maxFilesPerTrigger", 1).parquet(folder))
        want = rule(spark.read.parquet(folder))
        for part_name in ("accepted", "rejected"):
            out = str(tmp_path / f"{name}-{part_name}")
            append.write_fact(getattr(made, part_name), out, out + "-cp").awaitTermination()
            got = spark.read.parquet(out)
            assert rows(got.drop("date")) == rows(getattr(want, part_name)), (name, part_name)
            assert got.where("date <> to_date(timestamp)").isEmpty()
