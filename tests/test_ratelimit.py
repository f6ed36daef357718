import random
import time
from datetime import datetime, timedelta

import pytest

from parley.streaming.ratelimit import rate_limit, rate_limit_stream

T0 = datetime(2024, 1, 1)
SCHEMA = "session_id string, request_id bigint, timestamp timestamp_ntz"


def brute(rows, most, window):
    kept, out = {}, {}
    for s, i, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        live = [x for x in kept.get(s, []) if x > t - timedelta(seconds=window)]
        out[i] = len(live) < most
        kept[s] = live + [t] if out[i] else live
    return out


def flood(seed, n=900):
    rng = random.Random(seed)
    rows, at = [], {"a": 0.0, "b": 0.0, "c": 0.0}
    for i in range(n):
        s = rng.choice("aaaabc")
        at[s] += rng.choice([0, 0.2, 1, 5, 40, 700])
        rows.append((s, i, T0 + timedelta(seconds=at[s])))
    return rows


@pytest.mark.parametrize("seed,most,window", [(1, 30, 600), (2, 3, 60), (3, 1, 600), (4, 5, 10)])
def test_batch_equals_brute_force(spark, seed, most, window):
    rows = flood(seed)
    got = rate_limit(spark.createDataFrame(rows, SCHEMA), max_requests=most, window_seconds=window).collect()
    assert {r.request_id: r.allowed for r in got} == brute(rows, most, window)


def test_equal_times_and_ids_decide_by_id(spark):
    rows = [("s", i, T0) for i in range(50)] + [(None, 100 + i, T0) for i in range(3)]
    got = rate_limit(spark.createDataFrame(rows, SCHEMA), max_requests=2, window_seconds=60).collect()
    assert sorted(r.request_id for r in got if r.allowed) == [0, 1, 100, 101] and len(got) == 53


def test_limit_bounds(spark):
    rows = [("s", i, T0 + timedelta(seconds=i)) for i in range(31)] + [("s", 99, T0 + timedelta(seconds=600))]
    got = {r.request_id: r.allowed for r in rate_limit(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] for i in range(30)) and not got[30] and got[99]  # exactly one window later is free again


def test_stream_equals_batch_with_late_rows(spark, tmp_path):
    """Rows come shuffled by less than the delay; far later rows move the watermark past them."""
    rng = random.Random(6)
    rows = flood(6, 400)
    arrival = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rng.uniform(0, 300)))
    end = max(r[2] for r in rows) + timedelta(days=1)
    chunks = [arrival[k * 100:(k + 1) * 100] for k in range(4)]
    chunks += [[("end", 10 ** 6 + k, end + timedelta(days=k))] for k in range(3)]
    source = tmp_path / "in"
    for k, chunk in enumerate(chunks):
        spark.createDataFrame(chunk, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(0.05)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = (rate_limit_stream(stream, max_requests=5, window_seconds=60, delay="10 minutes").writeStream.format("memory")
             .queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    got = {r.request_id: r.allowed for r in spark.table("limited").collect() if r.session_id != "end"}
    assert got == brute(rows, 5, 60)
