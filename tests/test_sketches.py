"""Reports made with sketches: one pass, within their bounds, and exact where the sketch holds every value."""
import random
import re

import pytest
from pyspark.sql import functions as F

from parley.functions import kernels as k
from parley.operators import sketches
from parley.plans.registry import ALL, NAMED, VARIANTS

RANKS = {"p10": 10, "p50": 50, "p95": 95, "p99": 99}


@pytest.fixture(scope="module")
def values(spark):
    """Two groups of 20,000 and 3 rows, with ties and missing values."""
    rng = random.Random(4)
    rows = [("a", f"s{rng.randrange(5000)}", rng.choice([None, 7, 7, 7, rng.randrange(10 ** 6)])) for _ in range(20000)]
    return spark.createDataFrame([*rows, ("b", "x", 1), ("b", "y", 5), ("b", "x", 9), ("c", None, None)], "g string, s string, v long")


def summary(df, by=True):
    return k.summarise(df, {"g": F.col("g")} if by else {}, {
        "n": k.rows(), "sessions": k.Distinct("s"), **{n: k.Rank("v", p) for n, p in RANKS.items()}, "twice": k.Derived(F.col("n") * 2)})


def test_estimates_are_within_their_bounds(values):
    with k.sketched():
        found = summary(values)
    assert found.columns == summary(values).columns
    made = {r.g: r for r in found.collect()}
    exact = {r.g: r for r in summary(values).collect()}
    assert made["b"] == exact["b"] and made["c"] == exact["c"]  # few values are kept whole
    assert (made["a"].n, made["a"].twice) == (20000, 40000)
    assert abs(made["a"].sessions - exact["a"].sessions) < 0.03 * exact["a"].sessions
    within = sketches.ranks_within(values, found, "g", "v", RANKS).collect()
    assert {r.g for r in within} == {"a", "b"} and all(all(r[1:]) for r in within)


def test_a_wrong_estimate_is_out_of_bounds(values):
    wrong = summary(values).withColumn("p50", F.col("p95"))
    row = sketches.ranks_within(values, wrong, "g", "v", RANKS).where("g = 'a'").first()
    assert not row.p50_within and row.p95_within


def test_no_rows(values):
    with k.sketched():
        row = summary(values.limit(0), by=False).first()
    assert (row.n, row.sessions, row.p50) == (0, 0, None)


def test_one_pass(spark, values, tmp_path):
    values.write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    with k.sketched():
        plan = summary(stored)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan", plan)) == 1 and len(re.findall(r"Exchange ", plan)) == 1
    assert len(re.findall(r"Aggregate\(", plan)) == 2  # before and after the one shuffle


def test_dominant_values(spark):
    rows = [("a", "y")] * 3 + [("a", "x")] * 3 + [("a", None)] * 3 + [("b", None)] * 2 + [("b", "z")] + [("c", "q")]
    df = spark.createDataFrame(rows, "key string, v string")
    want = {r.key: r.top for r in k.dominant(df, "key", "v", "top").collect()}
    with k.sketched():
        made = k.dominant(df, "key", "v", "top")
    assert len(re.findall(r"Exchange ", made._jdf.queryExecution().executedPlan().toString())) == 1
    assert {r.key: r.top for r in made.collect()} == want == {"a": "x", "b": None, "c": "q"}


def test_the_option_ends_with_its_block(values):
    with k.sketched():
        pass
    assert "kll" not in summary(values)._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("name", [*NAMED, *VARIANTS])
def test_every_report_takes_the_option(tables, as_of, name):
    """The same columns of the same types."""
    assert ALL[name](tables, as_of=as_of, approximate=True).dtypes == ALL[name](tables, as_of=as_of).dtypes
