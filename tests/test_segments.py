import random

import pytest
from pyspark.sql import functions as F

from parley.functions.segments import LastKnown, Previous, TotalBefore, block_segment, with_state


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [("hot", i, rng.choice([None, *range(5)])) for i in range(300)]
    out += [(f"s{j}", i, rng.choice([None, *range(5)])) for j in range(20) for i in range(rng.randint(1, 6))]
    return out


def expected(rows):
    out, last, known, total = {}, {}, {}, {}
    for key, at, v in sorted(rows, key=lambda r: r[:2]):
        out[key, at] = (last.get(key), known.get(key), total.get(key, 0))
        last[key] = v
        known[key] = v if v is not None else known.get(key)
        total[key] = total.get(key, 0) + (v or 0)
    return out


@pytest.mark.parametrize("size,coarser", [(1, ()), (7, (3,)), (2, (4, 5)), (1000, (2,))])
def test_state_equals_plain_fold(spark, rows, size, coarser):
    df = spark.createDataFrame(rows, "key string, at int, v int")
    v = F.col("v")
    got = with_state(df, "key", ["at"], block_segment("at", size), {
        "p": Previous(v), "k": LastKnown(v), "t": TotalBefore(v)}, coarser).collect()
    assert {(r.key, r["at"]): (r.p, r.k, r.t) for r in got} == expected(rows)


def test_rows_without_a_key_form_one_key(spark):
    df = spark.createDataFrame([(None, k, k) for k in range(9)], "key string, at int, v int")
    got = with_state(df, "key", ["at"], block_segment("at", 2), {"t": TotalBefore(F.col("v"))}, (2,)).collect()
    assert {r["at"]: r.t for r in got} == {k: sum(range(k)) for k in range(9)}


def test_no_window_orders_a_whole_key_of_rows(spark, rows):
    df = spark.createDataFrame(rows, "key string, at int, v int")
    out = with_state(df, "key", ["at"], block_segment("at", 7), {"t": TotalBefore(F.col("v"))})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window " in x or "Window[" in x]
    assert windows and all("at#" not in x.split("], [")[-1] or "_seg" in x for x in windows if "[key#" in x)
