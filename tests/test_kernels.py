from datetime import date, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.functions import kernels as k

AT = datetime(2024, 1, 31)


def frame(spark, times):
    return spark.createDataFrame([(t, i) for i, t in enumerate(times)], "timestamp timestamp_ntz, i int")


def test_since_is_inclusive_and_has_no_upper_bound(spark):
    df = frame(spark, [AT - timedelta(days=7), AT - timedelta(days=7, seconds=1), AT + timedelta(days=3)])
    assert sorted(r.i for r in k.since(df, AT, days=7).collect()) == [0, 2]
    assert k.since(df, AT, hours=24 * 7).count() == 2
    assert k.since(df, AT, weeks=1).count() == 2


@pytest.mark.parametrize("bad", [0, -1, 1.5, True, "7"])
def test_spans_must_be_positive_integers(spark, bad):
    with pytest.raises(ValueError):
        k.since(frame(spark, [AT]), AT, days=bad)


def test_since_on_instants_with_zone(spark):
    df = frame(spark, [AT, AT - timedelta(days=8)]).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    assert k.since(df, AT, days=7).count() == 1


def test_weeks_start_on_sunday(spark):
    df = frame(spark, [datetime(2024, 1, 6), datetime(2024, 1, 7), datetime(2024, 1, 13, 23)])
    got = [r[0] for r in df.orderBy("i").select(k.week_sunday()).collect()]
    assert got == [date(2023, 12, 31), date(2024, 1, 7), date(2024, 1, 7)]


def test_flags_ignore_null_and_rates_survive_empty_input(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    assert df.agg(k.countif("f"), k.rate_pct("f")).first() == (1, 33.33)
    assert df.where("false").agg(k.countif("f"), k.rate_pct("f")).first() == (0, None)


def test_rounding_is_half_up(spark):
    df = spark.createDataFrame([(1.005,), (2.5,), (-2.5,)], "x double")
    assert [r[0] for r in df.select(k.rounded(F.col("x"), 2)).collect()][0] == 1.01
    assert df.where("x = 2.5").agg(k.int_avg(F.col("x"))).first()[0] == 3
    assert df.where("x = -2.5").agg(k.int_avg(F.col("x"))).first()[0] == -3


def nearest_rank(values, pct):
    ordered = sorted(values)
    return ordered[max(1, -(-len(ordered) * pct // 100)) - 1]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.none(), st.integers(0, 40))), min_size=1, max_size=60))
def test_ranks_are_exact(spark, rows):
    df = spark.createDataFrame(rows, "g string, v bigint")
    out = k.summarise(df, {"g": F.col("g")}, {
        "n": k.rows(), "lo": k.Rank("v", 10), "mid": k.Rank("v", 50), "hi": k.Rank("v", 95), "z": k.Rank(k.zero("v"), 50)})
    for r in out.collect():
        mine = [v for g, v in rows if g == r.g]
        known = [v for v in mine if v is not None]
        assert r.n == len(mine)
        want = [nearest_rank(known, p) if known else None for p in (10, 50, 95)]
        assert [r.lo, r.mid, r.hi] == want
        assert r.z == nearest_rank([v or 0 for v in mine], 50)


def test_ungrouped_summary_of_nothing_is_one_row(spark):
    df = spark.createDataFrame([], "v bigint, s string")
    out = k.summarise(df, {}, {"n": k.rows(), "s": k.Distinct("s"), "p": k.Rank("v", 95)}).collect()
    assert [tuple(r) for r in out] == [(0, 0, None)]


def test_rank_places_round_the_value(spark):
    df = spark.createDataFrame([(i / 7,) for i in range(1, 30)], "v double")
    got = k.summarise(df, {}, {"p": k.Rank("v", 90, places=3)}).first()[0]
    assert got == round(nearest_rank([i / 7 for i in range(1, 30)], 90), 3)


def test_group_key_may_carry_the_name_of_an_input(spark):
    df = spark.createDataFrame([(None,), ("unknown",), ("a",)], "intent string")
    out = k.summarise(df, {"intent": k.label("intent", "unknown")}, {"count": k.rows()})
    assert {tuple(r) for r in out.collect()} == {("unknown", 2), ("a", 1)}


def test_shares_sum_to_hundred(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, n bigint")
    shares = [r.pct for r in k.with_share(df, "n", "pct").collect()]
    assert abs(sum(shares) - 100) < 0.05
    assert k.with_share(df.where("false"), "n", "pct").count() == 0


def test_dominant_counts_null_and_breaks_ties_downwards(spark):
    rows = [("s", "b"), ("s", "a"), ("t", None), ("t", None), ("t", "a"), ("u", None), ("u", "z")]
    got = dict(map(tuple, k.dominant(spark.createDataFrame(rows, "s string, v string"), "s", "v", "d").collect()))
    assert got == {"s": "a", "t": None, "u": "z"}


def test_first_values_keep_order_and_limit(spark):
    rows = [("g", i, f"v{i}" if i % 2 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, at int, v string")
    assert k.first_n_values(df, "g", "v", 3, "out", "at").first().out == ["v1", "v3", "v5"]
