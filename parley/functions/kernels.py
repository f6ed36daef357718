"""Shared building blocks of the report operators."""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HUNDRED = 100.0


# --- time ------------------------------------------------------------------

def positive(name: str, value: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ValueError(f"{name} must be a positive integer, got {value!r}")
    return value


def moment(df: DataFrame, at: datetime, ts: str = "timestamp") -> Column:
    """A literal of the same timestamp type as column ``ts``, so that the
    comparison reaches the file scan without a cast on the column."""
    text = at.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return F.expr(f"TIMESTAMP_NTZ '{text}'")
    return F.expr(f"TIMESTAMP '{text}+00:00'")


def since(df: DataFrame, as_of: datetime, *, days: int | None = None, hours: int | None = None,
          weeks: int | None = None, ts: str = "timestamp") -> DataFrame:
    """Rows with ``ts >= as_of - span`` (inclusive, no upper bound).

    A ``date`` partition column, where the table has one, gets the matching
    bound as well: the optimizer does not derive it from the timestamp.
    """
    if days is not None:
        span = timedelta(days=positive("days", days))
    elif hours is not None:
        span = timedelta(hours=positive("hours", hours))
    else:
        span = timedelta(days=7 * positive("weeks", weeks))
    start = as_of - span
    out = df.where(F.col(ts) >= moment(df, start, ts))
    if "date" in df.columns and isinstance(df.schema["date"].dataType, T.DateType):
        out = out.where(F.col("date") >= F.lit(start.date()))
    return out


def day(ts: str = "timestamp") -> Column:
    return F.to_date(F.col(ts))


def week_sunday(ts: str = "timestamp") -> Column:
    """First day of the week, weeks starting on Sunday."""
    return F.expr(f"date_sub(to_date({ts}), dayofweek(to_date({ts})) - 1)")


def event_time(df: DataFrame, delay: str, ts: str = "timestamp") -> DataFrame:
    """A stream with a watermark; watermarks need an instant, and times without
    a zone are UTC here."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


# --- numbers ----------------------------------------------------------------

def rounded(c: Column, places: int) -> Column:
    """Half-up rounding on the decimal value, so that summation noise in the
    last bits of a double cannot flip a digit."""
    return F.round(c.cast("decimal(28,10)"), places).cast("double")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def holds(p: str | Column) -> Column:
    return F.col(p) if isinstance(p, str) else p


def rows() -> Column:
    return F.count(F.lit(1))


def countif(p: str | Column) -> Column:
    return F.count_if(holds(p))


def rate_pct(p: str | Column, places: int = 2) -> Column:
    return rounded(ratio(F.count_if(holds(p)) * F.lit(HUNDRED), rows()), places)


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def avg0(c: str, places: int) -> Column:
    """Average with NULL counted as zero."""
    return rounded(F.avg(zero(c)), places)


def int_avg(c: Column) -> Column:
    return F.round(F.avg(c)).cast("bigint")


def int_avg0(c: str) -> Column:
    return int_avg(zero(c))


def total0(c: str) -> Column:
    return F.sum(zero(c))


def label(c: str, default: str) -> Column:
    return F.coalesce(F.col(c), F.lit(default))


def with_share(grouped: DataFrame, count: str, out: str, places: int = 2) -> DataFrame:
    """``grouped`` with each group's share of the total count. The total is a sum
    over the groups, of which a report has a handful, so the fact is read once."""
    total = F.sum(count).over(Window.partitionBy())
    return grouped.withColumn(out, rounded(ratio(F.col(count) * F.lit(HUNDRED), total), places))


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(positive("limit", n))


# --- sketches as an option ----------------------------------------------------

@dataclass(frozen=True)
class Sketches:
    """Sizes of the sketches that stand in for exact ranks and distinct counts."""
    hll_bits: int = 14    # distinct values: a standard error of 0.8 %
    kll_k: int = 400      # ranks: within 1 % of the rank asked for
    tracked: int = 1000   # most frequent values: exact for up to this many per key
    tied: int = 16        # values that are compared when the largest counts are equal


_SKETCHES: ContextVar[Sketches | None] = ContextVar("sketches", default=None)


@contextmanager
def sketched(sizes: Sketches = Sketches()) -> Iterator[None]:
    """Plans made inside the block read their rows once, with mergeable sketches in
    place of exact ranks, distinct counts and dominant values."""
    token = _SKETCHES.set(sizes)
    try:
        yield
    finally:
        _SKETCHES.reset(token)


def _rank_from_sketch(r: Rank, sizes: Sketches) -> Column:
    """The percentile of ``r`` from a KLL sketch; NULL where no row has a value.
    Several ranks of one value share one sketch, as equal aggregates are computed once."""
    value = holds(r.value).cast("double") if r.places is None else rounded(holds(r.value), r.places)
    found = F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(value, sizes.kll_k), F.lit(r.pct / 100))
    found = F.when(F.count(value) > 0, found)
    return found if r.places is not None else F.round(found).cast("bigint")


def _sketched_summary(src: DataFrame, keys: list[str], metrics: dict[str, object], sizes: Sketches) -> DataFrame:
    """Every metric in one aggregation."""
    made = []
    for name, m in metrics.items():
        if isinstance(m, Distinct):
            sketch = F.hll_sketch_agg(F.col(m.column).cast("string"), F.lit(sizes.hll_bits))
            made.append(F.hll_sketch_estimate(sketch).alias(name))
        elif isinstance(m, Rank):
            made.append(_rank_from_sketch(m, sizes).alias(name))
        elif isinstance(m, Column):
            made.append(m.alias(name))
    return src.groupBy(*keys).agg(*made)


# --- one pass summaries with exact ranks --------------------------------------

@dataclass(frozen=True)
class Distinct:
    """Number of distinct non-null values of a column."""
    column: str


@dataclass(frozen=True)
class Rank:
    """Nearest-rank percentile of a column or expression.

    Values are counted per distinct value before they are ordered, so the work
    after the first shuffle grows with the number of distinct values: whole
    milliseconds, or doubles at ``places`` decimals. Rounding keeps the order
    of values, hence the percentile of the rounded values is the rounded
    percentile.
    """
    value: str | Column
    pct: int
    places: int | None = None


@dataclass(frozen=True)
class Derived:
    """Expression over the other output columns (names with a leading
    underscore are helpers and are dropped)."""
    value: Column


def _ranks(src: DataFrame, keys: list[str], ranks: dict[str, Rank]) -> DataFrame:
    sources: dict[str, tuple[Column, int | None]] = {}
    tags: dict[str, str] = {}
    for name, r in ranks.items():
        tag = f"{r.value}|{r.places}"
        sources.setdefault(tag, (holds(r.value), r.places))
        tags[name] = tag
    numbered = {tag: i for i, tag in enumerate(sources)}
    pairs = []
    for tag, (value, places) in sources.items():
        value = value.cast("double") if places is None else rounded(value, places)
        pairs.append(F.struct(F.lit(numbered[tag]).alias("_m"), value.alias("_v")))
    values = src.select(*keys, F.inline(F.array(*pairs))).where(F.col("_v").isNotNull())
    hist = values.groupBy(*keys, "_m", "_v").agg(F.count(F.lit(1)).alias("_c"))
    if keys:  # one exchange of the value counts serves the windows and the last aggregate
        hist = hist.repartition(*keys)
    group = Window.partitionBy(*keys, "_m")
    upto = group.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.select(*keys, "_m", "_v", "_c", F.sum("_c").over(upto).alias("_upto"),
                      F.sum("_c").over(group).alias("_n"))
    picks = []
    for name, r in ranks.items():
        place = F.expr(f"greatest((_n * {r.pct} + 99) div 100, 1)")
        hit = (F.col("_m") == numbered[tags[name]]) & (F.col("_upto") >= place) \
            & (F.col("_upto") - F.col("_c") < place)
        value = F.max(F.when(hit, F.col("_v")))
        picks.append((value if r.places is not None else F.round(value).cast("bigint")).alias(name))
    return cum.groupBy(*keys).agg(*picks)


def summarise(df: DataFrame, by: dict[str, Column], metrics: dict[str, object]) -> DataFrame:
    """Group ``df`` by the named expressions and compute ``metrics`` in order.

    Plain and distinct metrics share one aggregation. Rank metrics are computed
    from value counts and merged by union and a tiny second aggregation, which
    keeps the single row of an ungrouped report on empty input. Inside a
    ``sketched`` block there is one aggregation for all metrics.
    """
    keys = [f"_k_{name}" for name in by]
    src = df.withColumns(dict(zip(keys, by.values()))) if by else df
    ranks = {n: m for n, m in metrics.items() if isinstance(m, Rank)}
    derived = {n: m for n, m in metrics.items() if isinstance(m, Derived)}
    plain = []
    for name, metric in metrics.items():
        if isinstance(metric, Distinct):
            plain.append(F.count_distinct(F.col(metric.column)).alias(name))
        elif isinstance(metric, Column):
            plain.append(metric.alias(name))
    sizes = _SKETCHES.get()
    if sizes is not None:
        out = _sketched_summary(src, keys, metrics, sizes)
    elif not ranks:
        out = src.groupBy(*keys).agg(*plain)
    elif not plain:
        out = _ranks(src, keys, ranks)
    else:
        base = src.groupBy(*keys).agg(*plain)
        both = base.unionByName(_ranks(src, keys, ranks), allowMissingColumns=True)
        merged = [F.max(n).alias(n) for n in metrics if n not in derived]
        out = both.groupBy(*keys).agg(*merged)
    for name, metric in derived.items():
        out = out.withColumn(name, metric.value)
    renamed = [F.col(k).alias(n) for k, n in zip(keys, by)]
    return out.select(*renamed, *[n for n in metrics if not n.startswith("_")])


# --- dominant values and samples ---------------------------------------------

def dominant(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Most frequent value per key; NULL is a value; ties go to the smaller
    value, NULL last. Both steps combine before they shuffle. Inside a
    ``sketched`` block one sketch per key counts the values."""
    sizes = _SKETCHES.get()
    if sizes is not None:
        top = df.groupBy(key).agg(F.expr(f"approx_top_k(`{value}`, {sizes.tied}, {sizes.tracked})").alias("_top"))
        order = F.array_sort(F.transform("_top", lambda x: F.struct(
            (-x["count"]).alias("o"), x["item"].isNull().alias("z"), x["item"].alias("v"))))
        return top.select(key, order[0]["v"].alias(out))
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("o"), F.col(value).isNull().alias("z"),
                          F.col(value).alias("v")))
    return counts.groupBy(key).agg(best.alias("_b")).select(key, F.col("_b.v").alias(out))


def null_if_empty(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, arr)


def first_n_values(df: DataFrame, by: str, value: str, n: int, out: str, *order: str) -> DataFrame:
    """The first ``n`` non-null values per group in ``order``. The rank filter
    is applied map-side before the shuffle, so no group is gathered."""
    w = Window.partitionBy(by).orderBy(*order)
    ranked = (df.where(F.col(value).isNotNull())
                .select(by, F.row_number().over(w).alias("_r"), value, *[o for o in order if o != value])
                .where(F.col("_r") <= n))
    packed = F.array_sort(F.collect_list(F.struct("_r", F.col(value).alias("v"))))
    return ranked.groupBy(by).agg(F.transform(packed, lambda s: s["v"]).alias(out))
