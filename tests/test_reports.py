import itertools
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parley.operators import builders, business, devops, sessions, status, tech
from parley.plans import bundles
from parley.plans.registry import ALL, NAMED, run

T0 = datetime(2024, 1, 20, 9)


def outcome_tables(spark):
    """Sessions with 0..2 events, 0..2 feedback rows, 0..2 frustrated turns."""
    reviews, events, feedback, logs = [], [], [], []
    for stars, e, f, fr, turns in itertools.product([2, 3, 5], range(3), range(3), range(3), [0, 3]):
        s = f"{stars}-{e}-{f}-{fr}-{turns}"
        reviews.append((s, T0, stars, turns, 2))
        events += [(s, "chip_click" if i else "chip_hover") for i in range(e)]
        feedback += [(s, f"{s}m{i % 1}", i * 2 - 1) for i in range(f)]
        logs += [(s, True, i == 0) for i in range(fr)]
    reviews.append(reviews[7])
    return {
        "session_reviews": spark.createDataFrame(
            reviews, "session_id string, timestamp timestamp_ntz, stars int, turn_count int, unanswered_count int"),
        "chat_events": spark.createDataFrame(events, "session_id string, event_type string"),
        "feedback": spark.createDataFrame(feedback, "session_id string, message_id string, rating int"),
        "chat_logs": spark.createDataFrame(logs, "session_id string, frustration_signal boolean, rec_gap boolean")}


LITERAL = """select s.session_id, count_if(e.event_type='chip_click') > 0 as had_chip_click,
 count(distinct f.message_id) as feedback_count, round(avg(f.rating), 2) as avg_message_feedback,
 count_if(l.frustration_signal) as frustrated_turns, count_if(l.rec_gap) as rec_gap_turns,
 case when s.stars >= 4 then 'success' when count_if(e.event_type='chip_click') > 0 and (s.stars is null or s.stars >= 3) then 'success'
  when s.stars <= 2 then 'failure' when try_divide(s.unanswered_count, s.turn_count) > 0.5 then 'failure'
  when count_if(l.frustration_signal) >= 2 then 'failure' else 'inconclusive' end as outcome
 from {r} s left join {e} e on e.session_id = s.session_id left join {f} f on f.session_id = s.session_id
 left join {l} l on l.session_id = s.session_id group by s.session_id, s.timestamp, s.stars, s.turn_count, s.unanswered_count"""


def test_outcomes_equal_the_plain_four_way_join(spark):
    t = outcome_tables(spark)
    want = spark.sql(LITERAL, r=t["session_reviews"], e=t["chat_events"], f=t["feedback"], l=t["chat_logs"])
    got = sessions.session_outcomes(t).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    true = {r.session_id: r.frustrated_turns for r in sessions.session_outcomes(t, dedup=True).collect()}
    assert true["3-2-2-2-0"] == 2


def test_there_are_45_named_reports(tables, as_of):
    assert len(NAMED) == 45
    assert len(ALL) == 45 + 40 + 2
    with pytest.raises(KeyError):
        run("nothing", tables)
    with pytest.raises(TypeError, match="days"):
        run("get_devops_daily", tables, as_of=as_of, days="7")
    with pytest.raises(TypeError, match="no parameter"):
        run("get_devops_daily", tables, as_of=as_of, hours=7)
    with pytest.raises(TypeError, match="needs"):
        run("session_detail", tables)
    with pytest.raises(ValueError):
        run("get_tech_catalog_gaps", tables, as_of=as_of, days=7, limit=0)


def empty(tables):
    return {n: tables[n].where("false") for n in ("chat_logs", "chat_events", "feedback", "session_reviews")}


@pytest.mark.parametrize("name", sorted(NAMED))
def test_reports_on_empty_tables(tables, as_of, name):
    params = {"as_of": as_of} if "as_of" in NAMED[name].parameters else {}
    assert NAMED[name](empty(tables), **params).count() <= 1


def test_identities(spark, tables, as_of):
    funnel = business.get_business_conversion_funnel(tables, as_of=as_of).first()
    assert 0 <= funnel.sessions_with_click <= funnel.total_sessions
    depth = business.get_business_session_length_dist(tables, as_of=as_of).collect()
    assert sum(r.sessions for r in depth) == funnel.total_sessions
    assert abs(sum(r.pct for r in depth) - 100) < 0.05
    daily = devops.get_devops_daily(tables, as_of=as_of, days=30).collect()
    total = devops.get_devops_summary(tables, as_of=as_of, days=30).first()
    assert sum(r.requests for r in daily) == total.total_requests
    assert [r["date"] for r in daily] == sorted(r["date"] for r in daily)


def test_windows_differ(tables, as_of):
    counts = [builders.overview(tables, as_of=as_of, days=d).first()[0] for d in (1, 7, 30)]
    assert counts[0] < counts[1] < counts[2]


def test_unanswered_flag_variants(tables, as_of):
    narrow = devops.get_devops_summary(tables, as_of=as_of, days=30).first().unanswered_rate_pct
    wide = builders.agent_devops_summary(tables, as_of=as_of, days=30).first().unanswered_rate_pct
    assert wide > narrow


def test_single_session_and_all_null_metrics(spark, tables, as_of):
    one = tables["chat_logs"].limit(1).withColumns({c: F.lit(None).cast("bigint") for c in ("ttft_ms", "latency_ms")})
    row = devops.get_devops_summary({"chat_logs": one}, as_of=as_of, days=31).first()
    assert (row.total_sessions, row.p95_latency_ms, row.avg_latency_ms, row.avg_ttft_ms, row.p95_ttft_ms) == (1, None, None, 0, 0)
    assert tech.get_tech_rec_gap_analysis({"chat_logs": one}, as_of=as_of, days=31).count() == 1


def test_midnight_belongs_to_the_new_day(spark, tables):
    logs = tables["chat_logs"].limit(1).withColumn("timestamp", F.lit(datetime(2024, 1, 10)).cast("timestamp_ntz"))
    assert str(builders.daily_volume({"chat_logs": logs}, as_of=datetime(2024, 1, 31)).first()["date"]) == "2024-01-10"


def test_report_reads_only_its_columns(tables, as_of):
    raw = tables.raw("events").withColumnsRenamed({"ts": "timestamp", "event_type": "llm_error_type"}).withColumn(
        "llm_error", F.lit(True))
    plan = devops.error_types({"chat_logs": raw}, as_of=as_of, days=3)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in plan
    assert "GreaterThanOrEqual(ts," in plan


def test_no_session_is_joined_before_it_is_reduced(tables, as_of):
    plan = business.get_business_engagement_score(tables, as_of=as_of)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Cross" not in plan


def test_kpi_colours(spark):
    rows = spark.createDataFrame([(0.5, 4000.1, 2.0, 3.9, 5.1, None)], "error_rate_pct double, p95_latency_ms double,"
                                 " avg_unique_brands double, avg_stars double, citation_gap_rate_pct double, rec_gap_rate_pct double")
    got = {r.kpi: r.status for r in status.kpi_status(rows).collect()}
    assert got == {"error_rate_pct": "green", "p95_latency_ms": "amber", "avg_unique_brands": "green", "avg_stars": "amber",
                   "citation_gap_rate_pct": "red", "rec_gap_rate_pct": "green"}


def test_trend_needs_two_drops_in_a_row(spark):
    weeks = [(T0.date() + timedelta(days=7 * i), v) for i, v in enumerate([5.0, 4.0, 4.5, 4.0, 3.0, 3.5])]
    df = spark.createDataFrame(weeks, "week_start date, v double")
    assert [r.flagged for r in status.with_week_trend(df, "v").orderBy("week_start").collect()] == [False] * 4 + [True, False]


def test_intent_names_keep_unknown_labels(spark):
    df = spark.createDataFrame([("complaint",), ("custom",), (None,)], "intent string")
    assert [r.label for r in status.with_intent_name(df).collect()] == ["Complaint", "custom", None]


def test_bundles(tables, as_of):
    assert set(bundles.weekly_run(tables, as_of=as_of)) == {"devops", "tech", "business"}
    with bundles.cached({n: tables[n] for n in ("chat_logs", "chat_events", "feedback", "session_reviews")},
                        as_of=as_of, days=14) as kept:
        got = {n: df.collect() for n, df in bundles.bundle("infra", kept, as_of=as_of).items()}
    want = {n: df.collect() for n, df in bundles.bundle("infra", tables, as_of=as_of).items()}
    assert got == want
    for name in bundles.BUNDLES:
        assert bundles.bundle(name, tables, as_of=as_of)
