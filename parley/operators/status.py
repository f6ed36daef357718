"""Traffic-light status of KPIs, trend rules and display names."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.kernels import avg0, rounded, since, summarise, week_sunday
from parley.operators import builders
from parley.operators.business import get_business_session_outcomes
from parley.operators.tech import get_tech_context_window_pct

# Fixed values: (kpi, direction, amber limit, red limit). "above" turns amber
# past the first limit and red past the second; "below" the other way round.
# A None limit means that the colour does not occur.
DASHBOARD_RULES = [
    ("error_rate_pct", "above", 0.5, 2.0),
    ("p95_latency_ms", "above", 4000.0, 8000.0),
    ("unanswered_rate_pct", "above", 10.0, 20.0),
    ("scope_rejected_rate_pct", "above", 5.0, 15.0),
    ("avg_rag_confidence", "above", 0.4, 0.6),
    ("rag_empty_rate_pct", "above", 3.0, 10.0),
    ("avg_unique_brands", "below", 2.0, None),
    ("citation_gap_rate_pct", "above", None, 5.0),
    ("rec_gap_rate_pct", "above", 5.0, 10.0),
    ("frustration_rate_pct", "above", 8.0, 15.0),
    ("avg_turn_number", "below", 3.0, None),
    ("avg_stars", "below", 4.0, 3.0),
    ("positive_rate_pct", "below", 70.0, 50.0),
    ("thumbs_up_rate_pct", "below", 75.0, 60.0),
    ("conversion_rate_pct", "below", None, 10.0),
    ("cost_per_session_usd", "above", 0.005, 0.01),
]

# Limits of the written reports where they differ or add a KPI.
REPORT_RULES = [
    ("error_rate_pct", "above", 0.5, 2.0),
    ("p95_latency_ms", "above", 4000.0, 8000.0),
    ("unanswered_rate_pct", "above", 10.0, 25.0),
    ("avg_ttft_ms", "above", 3000.0, None),
    ("injection_blocks", "above", None, 0.0),
    ("vulgar_blocks", "above", None, 0.0),
    ("avg_rag_confidence", "above", 0.4, 0.6),
    ("rerank_used_pct", "below", None, 80.0),
    ("cost_per_session_usd", "above", None, 0.01),
    ("frustration_rate_pct", "above", 8.0, 15.0),
    ("citation_gap_rate_pct", "above", None, 5.0),
    ("rec_gap_rate_pct", "above", None, 10.0),
    ("p95_context_pct", "above", None, 0.85),
    ("avg_stars", "below", 4.0, 3.0),
    ("failure_rate_pct", "above", None, 30.0),
    ("positive_rate_pct", "below", None, 50.0),
    ("thumbs_up_rate_pct", "below", None, 60.0),
    ("conversion_rate_pct", "below", None, 10.0),
]

# Display names of intents.
INTENT_NAMES = {
    "product_search": "Product Search",
    "DIY_advice": "DIY Advice",
    "price_comparison": "Price Comparison",
    "how_to_use": "How-To / Install",
    "complaint": "Complaint",
    "general_info": "General Info",
    "availability_check": "Availability Check",
    "troubleshooting": "Troubleshooting",
    "general_chat": "General Chat",
    "unknown": "Unknown",
}

RULE_SCHEMA = "kpi string, direction string, amber double, red double"


def long_form(summary: DataFrame) -> DataFrame:
    """A one-row summary as (kpi, value)."""
    wide = summary.select(*[F.col(c).cast("double").alias(c) for c in summary.columns])
    return wide.unpivot([], wide.columns, "kpi", "value")


def kpi_status(summary: DataFrame, rules: list[tuple] = DASHBOARD_RULES) -> DataFrame:
    """(kpi, value, status) for the KPIs of ``summary`` that have a rule. A
    missing value counts as zero, as on the dashboard."""
    table = summary.sparkSession.createDataFrame(rules, RULE_SCHEMA)
    joined = long_form(summary).join(F.broadcast(table), "kpi")
    v = F.coalesce(F.col("value"), F.lit(0.0))

    def past(limit: str) -> Column:
        return F.when(F.col("direction") == "above", v > F.col(limit)).otherwise(v < F.col(limit))

    status = F.when(past("red"), "red").when(past("amber"), "amber").otherwise("green")
    return joined.select("kpi", v.alias("value"), status.alias("status"))


def mean_conversion(t, *, as_of, days=30) -> DataFrame:
    """Unweighted mean of the daily conversion rates."""
    daily = builders.biz_conversion(t, as_of=as_of, days=days)
    return daily.agg(rounded(F.avg("conversion_rate_pct"), 4).alias("mean_conversion_rate_pct"))


def dashboard_status(t, *, as_of, days=30) -> DataFrame:
    """Status of every KPI tile over all three dashboard pages."""
    conversion = mean_conversion(t, as_of=as_of, days=days).withColumnRenamed(
        "mean_conversion_rate_pct", "conversion_rate_pct")
    pages = [builders.devops_summary(t, as_of=as_of, days=days), builders.tech_summary(t, as_of=as_of, days=days),
             builders.biz_sat_summary(t, as_of=as_of, days=days), builders.biz_feedback(t, as_of=as_of, days=days),
             conversion]
    out = kpi_status(pages[0])
    for page in pages[1:]:
        out = out.unionByName(kpi_status(page))
    return out


def report_status(t, *, as_of, days=30) -> DataFrame:
    """Status under the limits of the written reports, all audiences."""
    outcomes = get_business_session_outcomes(t, as_of=as_of, days=days)
    failing = outcomes.agg(F.max(F.when(F.col("outcome") == "failure", F.col("pct"))).alias("failure_rate_pct"))
    conversion = mean_conversion(t, as_of=as_of, days=days).withColumnRenamed(
        "mean_conversion_rate_pct", "conversion_rate_pct")
    devops = builders.agent_devops_summary(t, as_of=as_of, days=days).withColumnsRenamed(
        {"total_injection_blocks": "injection_blocks", "total_vulgar_blocks": "vulgar_blocks"})
    pages = [devops, builders.agent_tech_summary(t, as_of=as_of, days=days),
             get_tech_context_window_pct(t, as_of=as_of, days=days),
             builders.agent_satisfaction_summary(t, as_of=as_of, days=days),
             builders.agent_feedback(t, as_of=as_of, days=days), failing, conversion]
    out = kpi_status(pages[0], REPORT_RULES)
    for page in pages[1:]:
        out = out.unionByName(kpi_status(page, REPORT_RULES))
    return out


def with_week_trend(weekly: DataFrame, value: str, week: str = "week_start", run: int = 2,
                    rising: bool = False) -> DataFrame:
    """Marks weeks that end a run of ``run`` week-on-week moves in the bad
    direction. The input has one row per week, so one ordered window is enough."""
    w = Window.orderBy(week)
    before = F.lag(value).over(w)
    move = F.col(value) > before if rising else F.col(value) < before
    moved = weekly.withColumn("_moved", F.coalesce(move, F.lit(False)).cast("int"))
    recent = F.sum("_moved").over(w.rowsBetween(-(run - 1), 0))
    return moved.withColumn("flagged", recent >= run).drop("_moved")


def distance_trend(t, *, as_of, weeks=8) -> DataFrame:
    """Weekly mean of the smallest vector distance; flags a week-on-week rise."""
    logs = since(t["chat_logs"], as_of, weeks=weeks)
    weekly = summarise(logs, {"week_start": week_sunday()}, {"avg_min_vec_distance": avg0("min_vec_distance", 4)})
    return with_week_trend(weekly, "avg_min_vec_distance", run=1, rising=True)


def conversion_trend(t, *, as_of, days=30) -> DataFrame:
    """Weekly mean of daily conversion; flags two declines in a row."""
    daily = builders.biz_conversion(t, as_of=as_of, days=days)
    weekly = daily.groupBy(week_sunday("date").alias("week_start")).agg(
        rounded(F.avg("conversion_rate_pct"), 4).alias("conversion_rate_pct"))
    return with_week_trend(weekly, "conversion_rate_pct", run=2)


def with_intent_name(df: DataFrame, column: str = "intent", out: str = "label",
                     names: dict[str, str] | None = None) -> DataFrame:
    names = INTENT_NAMES if names is None else names
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return df.withColumn(out, F.coalesce(F.try_element_at(table, F.col(column)), F.col(column)))


def named_intents(t, *, as_of, days=30) -> DataFrame:
    return with_intent_name(builders.tech_intents(t, as_of=as_of, days=days))
