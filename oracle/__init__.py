"""Independent SQL for the checking engine."""


def all_sql() -> dict[str, str]:
    from oracle import enrichment, others, reports
    return {**reports.SQL, **enrichment.SQL, **others.SQL}
