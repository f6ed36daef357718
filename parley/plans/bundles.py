"""Report bundles: several reports over the same period.

The facts are cut to the period once; ``cached`` keeps that cut in memory for
all reports of the bundle and releases it at the end of the block.
"""
from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from parley.functions.kernels import since
from parley.plans.registry import ALL

# Reports per bundle, by the name of their section.
BUNDLES: dict[str, dict[str, str]] = {
    "infra": {"summary": "devops_infra_summary", "daily": "devops_infra_daily"},
    "model": {"summary": "tech_model_summary", "daily": "tech_model_daily", "catalog_gaps": "tech_gaps",
              "category_performance": "tech_category_performance"},
    "business_page": {"satisfaction_summary": "biz_sat_full_summary", "feedback_summary": "biz_feedback_full",
                      "satisfaction_trend": "biz_sat_daily", "conversion_trend": "biz_conversion_raw",
                      "top_clicked_products": "biz_top_products"},
    "devops": {"summary": "agent_devops_summary", "daily": "agent_devops_daily"},
    "tech": {"summary": "agent_tech_summary", "daily": "agent_tech_daily",
             "intent_distribution": "agent_intents", "catalog_gaps": "agent_gaps"},
    "business": {"satisfaction_summary": "agent_satisfaction_summary", "feedback_summary": "agent_feedback",
                 "satisfaction_trend": "agent_satisfaction_daily", "conversion_trend": "agent_conversion",
                 "top_products": "agent_top_products", "session_outcomes": "agent_outcomes"},
}
DEFAULT_DAYS = {"infra": 14, "model": 14, "business_page": 30, "devops": 7, "tech": 7, "business": 30}


def bundle(name: str, tables: Mapping[str, DataFrame], *, as_of: datetime,
           days: int | None = None) -> dict[str, DataFrame]:
    days = DEFAULT_DAYS[name] if days is None else days
    return {section: ALL[report](tables, as_of=as_of, days=days) for section, report in BUNDLES[name].items()}


@contextmanager
def cached(tables: Mapping[str, DataFrame], *, as_of: datetime, days: int) -> Iterator[dict[str, DataFrame]]:
    """Tables with chat_logs cut to the period and kept for the block.

    Only ``chat_logs`` is cut: session outcomes and review joins read their
    tables whole. Use it with bundles that do not need session outcomes over
    older turns.
    """
    logs = since(tables["chat_logs"], as_of, days=days).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield {**{n: tables[n] for n in tables if n != "chat_logs"}, "chat_logs": logs}
    finally:
        logs.unpersist()


def weekly_run(tables: Mapping[str, DataFrame], *, as_of: datetime, days: int = 7) -> dict[str, dict[str, DataFrame]]:
    """All audiences over one week; meant to be started by an outside scheduler."""
    return {name: bundle(name, tables, as_of=as_of, days=days) for name in ("devops", "tech", "business")}
