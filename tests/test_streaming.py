import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parley import schemas
from parley.operators import enrich
from parley.sources.bridge import AS_OF
from parley.sources import inputs
from parley.streaming import alerts, append, rollups


def replay(spark, df, folder, parts=3):
    """Writes ``df`` as files in time order and opens them as a stream."""
    cut = df.withColumn("_p", (F.ntile(parts).over(__import__("pyspark").sql.Window.orderBy("timestamp"))))
    cut = cut.cache()
    for p in range(1, parts + 1):
        cut.where(F.col("_p") == p).drop("_p").coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drain(stream, name, tmp_path, mode="append"):
    query = (stream.writeStream.format("memory").queryName(name).outputMode(mode)
             .option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.table(name)


def test_spike_windows_of_a_stream_equal_batch(spark, tables, tmp_path):
    metrics = inputs.flag_metrics(tables, F.col("rec_gap"))
    policy = alerts.POLICIES["injection_spike"]
    stream = alerts.with_lateness(replay(spark, metrics, tmp_path / "in"))
    out = drain(alerts.spikes(stream, policy, threshold=0), "spikes", tmp_path)
    got = {r.window_start: r.value for r in out.collect()}
    want = {r.window_start: r.value for r in alerts.spikes(metrics, policy, threshold=0).collect()}
    last = max(want)
    closed = {k: v for k, v in want.items() if k < last - timedelta(minutes=15)}
    assert closed and {k: got.get(k) for k in closed} == closed
    assert set(got) <= set(want)


def test_a_row_beyond_the_lateness_is_dropped_and_counted(spark, tmp_path):
    schema = "timestamp timestamp_ntz, series string, value int"
    t0 = datetime(2024, 1, 1)
    batches = [[(t0, "a", 1), (t0 + timedelta(hours=2), "a", 1)], [(t0 + timedelta(hours=3), "a", 1)], [(t0, "a", 50)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    series = alerts.align(alerts.with_lateness(stream), 300, "sum")
    query = (series.writeStream.format("memory").queryName("late").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    assert dropped == 1
    assert {r.value for r in spark.table("late").collect()} == {1.0}


def test_daily_rollup_of_a_stream_equals_batch(spark, tables, tmp_path):
    logs = tables["chat_logs"].drop("turn_number")
    stream = rollups.daily_rollup_stream(replay(spark, logs, tmp_path / "in"))
    out = drain(stream, "rollup", tmp_path)
    cols = ["date", "requests", "errors", "unanswered", "ttft_sum"]
    want = {r.date: tuple(r) for r in rollups.daily_rollup(logs).select(*cols).collect()}
    got = {r.date: tuple(r) for r in out.select(*cols).collect()}
    assert len(got) >= len(want) - 1 and all(want[d] == v for d, v in got.items())


def test_rollup_estimates_are_close(spark, tables):
    logs = tables["chat_logs"]
    row = rollups.period_from_rollup(rollups.daily_rollup(logs)).first()
    true = logs.agg(F.count(F.lit(1)), F.count_distinct("session_id"), F.expr(
        "percentile_disc(0.95) within group (order by latency_ms)"), F.count_if("llm_error")).first()
    assert row.requests == true[0] and row.errors == true[3]
    assert abs(row.approx_sessions - true[1]) <= 0.05 * true[1] + 1
    rank = logs.agg(F.avg((F.col("latency_ms") <= row.approx_p95_latency_ms).cast("int"))).first()[0]
    assert abs(rank - 0.95) < 0.02


def test_turns_arrive_once_and_land_by_day(spark, tmp_path):
    t0 = datetime(2024, 1, 1, 23, 50)
    turns = [{"session_id": "s", "message_id": f"m{i}", "timestamp": (t0 + timedelta(minutes=i)).isoformat(),
              "user_message": "a drill under $50", "assistant_response": "The Red Drill.",
              "retrieved_sources": [{"id": "1", "name": "Red Drill", "price": 5.0, "category": "Power Tools"}],
              "history": [{"role": "user", "content": "x"}, {"role": "assistant", "content": "y"}], "latency_ms": 5}
             for i in range(20)]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps(x) for x in turns[:12]))
    (folder / "b.json").write_text("\n".join(json.dumps(x) for x in turns[10:]))  # two deliveries repeat
    for k in (1, 2):  # turns come out once later ones have moved the watermark past them
        time.sleep(0.05)
        later = turns[0] | {"session_id": "later", "message_id": f"l{k}", "timestamp": (t0 + timedelta(days=k)).isoformat()}
        (folder / f"{'bcd'[k]}.json").write_text(json.dumps(later))
    rows = append.stream_turns(append.read_turns(spark, str(folder), files_per_trigger=1))
    append.write_fact(rows, str(tmp_path / "chat_logs"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "chat_logs")).where("session_id = 's'")
    assert out.count() == 20 and out.select("message_id").distinct().count() == 20
    assert sorted(str(r[0]) for r in out.select("date").distinct().collect()) == ["2024-01-01", "2024-01-02"]
    first = out.where("message_id = 'm0'").first()
    assert (first.turn_number, first.detected_category, first.price_filter_value) == (2, "Power Tools", 50.0)
    assert [f.name for f in out.schema.fields][:-1] == schemas.CHAT_LOGS.fieldNames()


T = datetime(2024, 1, 1)


def minutes(spark, bad, series="a"):
    rows = [(T + timedelta(minutes=m), series, 9.0 if m in bad else 0.0) for m in range(120)]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, series string, value double")


@pytest.mark.parametrize("length,fires", [(4, False), (5, True), (6, True)])
def test_a_condition_must_hold_for_its_duration(spark, length, fires):
    policy = alerts.Policy("p", 60, "mean", 1, 300)
    aligned = alerts.align(minutes(spark, set(range(10, 10 + length))), 60, "mean")
    got = alerts.sustained(aligned, policy).collect()
    assert bool(got) == fires
    if fires:
        assert (got[0].started_at, got[0].windows, got[0].peak) == (T + timedelta(minutes=10), length, 9.0)
        assert got[0].ended_at == T + timedelta(minutes=10 + length)


@pytest.mark.parametrize("gap,count", [(29, 1), (30, 1), (31, 2)])
def test_incidents_close_after_quiet_time(spark, gap, count):
    policy = alerts.Policy("p", 60, "mean", 1, 300)
    bad = set(range(0, 5)) | set(range(5 + gap, 10 + gap))
    islands = alerts.sustained(alerts.align(minutes(spark, bad), 60, "mean"), policy)
    got = alerts.incidents(islands, 1800).orderBy("opened_at").collect()
    assert len(got) == count
    assert got[-1].closes_at == T + timedelta(minutes=10 + gap + 30)


def metrics_with_runs(spark, seed=5):
    """Breaches in runs of many lengths, with windows that are missing, two series and values that are fine."""
    rng, rows = random.Random(seed), []
    for series in "ab":
        m = 0
        while m < 600:
            for k in range(rng.choice([1, 3, 5, 5, 6, 9])):
                rows.append((T + timedelta(minutes=m + k, seconds=rng.randrange(60)), series, 5.0 + rng.randrange(9)))
            m += 9 + rng.choice([1, 20, 30, 31, 40])
            rows.append((T + timedelta(minutes=m - 1), series, 0.0))
        rows += [(T + timedelta(minutes=k), series, 0.0) for k in range(m, m + 200, 2)]
    return rows, spark.createDataFrame(rows, "timestamp timestamp_ntz, series string, value double")


POLICY = alerts.Policy("p", 60, "mean", 1, 300, 1800)


def test_incidents_as_session_windows(spark):
    _, metrics = metrics_with_runs(spark)
    aligned = alerts.align(metrics, 60, "mean")
    want = alerts.incidents(alerts.sustained(aligned, POLICY), 1800).select("series", "opened_at", "closes_at", "peak").collect()
    got = alerts.incident_windows(alerts.sustained_windows(aligned, POLICY), 60, 1800).select("series", "opened_at", "closes_at", "peak").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 6


def arriving(spark, rows, folder):
    """The rows shuffled by less than the delay, in files, and later ones that move the watermark."""
    rng, schema = random.Random(1), "timestamp timestamp_ntz, series string, value double"
    rows = sorted(rows, key=lambda r: r[0] + timedelta(seconds=rng.uniform(0, 300)))
    end = max(r[0] for r in rows) + timedelta(days=1)
    for chunk in [*(rows[k:k + 300] for k in range(0, len(rows), 300)), *([(end + timedelta(days=k), "end", 0.0)] for k in range(5))]:
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return alerts.aligned_stream(alerts.with_lateness(stream), 60, "mean")


def test_held_conditions_of_a_stream_equal_batch(spark, tmp_path):
    rows, metrics = metrics_with_runs(spark)
    islands = alerts.sustained(alerts.align(metrics, 60, "mean"), POLICY).collect()
    out = drain(alerts.held(arriving(spark, rows, tmp_path / "in"), POLICY), "held", tmp_path).collect()
    over = sorted((r.series, r.started_at, r.window_start + timedelta(minutes=1), r.windows) for r in out if r.state == alerts.OVER)
    assert over == sorted((r.series, r.started_at, r.ended_at, r.windows) for r in islands) and len(over) > 10
    firing = sorted((r.series, r.window_start, r.value) for r in out if r.state == alerts.FIRING)
    want = alerts.sustained_windows(alerts.align(metrics, 60, "mean"), POLICY).collect()
    assert firing == sorted(map(tuple, want))


def test_incidents_of_a_stream_equal_batch(spark, tmp_path):
    rows, metrics = metrics_with_runs(spark)
    want = alerts.incidents(alerts.sustained(alerts.align(metrics, 60, "mean"), POLICY), 1800).collect()
    out = drain(alerts.held_incidents(arriving(spark, rows, tmp_path / "in"), POLICY), "incidents", tmp_path).collect()
    assert sorted((r.series, r.opened_at, r.closes_at, r.peak) for r in out) == sorted((r.series, r.opened_at, r.closes_at, r.peak) for r in want)


def test_missing_windows_break_an_island(spark):
    policy = alerts.Policy("p", 60, "mean", 1, 300)
    metrics = minutes(spark, set(range(10, 16))).where(F.col("timestamp") != F.lit(T + timedelta(minutes=12)).cast("timestamp_ntz"))
    assert alerts.sustained(alerts.align(metrics, 60, "mean"), policy).count() == 0


def test_frustration_of_a_stream_equals_batch(spark, tables, tmp_path):
    """Turns arrive shuffled by less than the delay; later turns of other sessions move the watermark past them."""
    rng = random.Random(4)
    logged = enrich.with_quality(enrich.with_route(enrich.with_history(enrich.with_optional(inputs.raw_turns(tables)))))
    logged = logged.where(F.col("route") != enrich.ENDING).cache()
    want = {r.message_id: (r.frustration_signal, r.frustration_reason) for r in enrich.with_frustration(logged).collect()}
    assert sum(signal for signal, _ in want.values()) > 10 and len(want) == logged.count()
    rows = sorted(logged.collect(), key=lambda r: r.timestamp + timedelta(seconds=rng.uniform(0, 300)))
    end = max(r.timestamp for r in rows) + timedelta(days=1)
    last = [rows[0].asDict() | {"session_id": "end", "message_id": f"end{k}", "timestamp": end + timedelta(days=k)} for k in range(3)]
    chunks = [rows[k:k + 200] for k in range(0, len(rows), 200)] + [[tuple(r.values())] for r in last]
    for chunk in chunks:
        spark.createDataFrame(chunk, logged.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema(logged.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = drain(append.with_stream_frustration(append.event_time(stream, "10 minutes")), "frustration", tmp_path)
    rows = out.where("session_id <> 'end'").collect()
    assert {r.message_id: (r.frustration_signal, r.frustration_reason) for r in rows} == want and len(rows) == len(want)
    kept = {r.message_id: (r.timestamp, r.retrieved_sources, r.tokens_in, r.intent) for r in rows}
    assert kept == {r.message_id: (r.timestamp, r.retrieved_sources, r.tokens_in, r.intent) for r in logged.collect()}


def test_percentiles_of_fractions_keep_their_decimals(spark):
    rows = [(datetime(2024, 1, 1, 0, 0, k), "s", (400 + k) / 1000) for k in range(50)]
    got = alerts.chart(spark.createDataFrame(rows, "timestamp timestamp_ntz, series string, value double"), "memory_p95").collect()
    assert [r.value for r in got] == [0.447]


def test_blocked_turns_are_not_in_the_rolling_cut(spark, tables):
    newest = alerts.newest(tables["chat_logs"]).collect()
    assert newest and not any(r.prompt_injection_flag or r.vulgar_flag for r in newest)
