import json

import pytest


def _write(path, text):
    path.write_text(text, encoding="utf-8")


def test_csv_tables_typed_and_audited(spark, tmp_path):
    from shiftscope.sources.files import load_audit, load_csv_tables
    _write(tmp_path / "customers.csv",
           "customer_id,signup_date,country,city,age_group,device_type,acquisition_channel,customer_segment\n"
           "c1,2025-01-02,India,Pune,25-34,Android,Email,New\nc2,2025-02-03,Germany,Berlin,35-44,iOS,Direct,Loyal\n")
    _write(tmp_path / "sessions.csv",
           "session_id,customer_id,timestamp,device,country,traffic_source,campaign_id,landing_page,"
           "session_duration_seconds,pages_viewed\n"
           "s1,c1,2026-07-20 10:00:00,Android,India,Email,,/,30,2\n"
           "s2,c2,2026-07-21 11:30:00,iOS,Germany,Direct,cmp_1,/sale,45,3\n")
    t = load_csv_tables(spark, str(tmp_path), ["customers", "sessions"])
    rows = {r.session_id: r for r in t.sessions.collect()}
    assert rows["s1"].campaign_id is None  # empty field is NULL
    assert rows["s2"].timestamp.hour == 11 and rows["s2"].pages_viewed == 3
    counts = {r.table_name: r.row_count for r in load_audit(spark, str(tmp_path), ["customers", "sessions"]).collect()}
    assert counts == {"customers": 2, "sessions": 2}
    with pytest.raises(FileNotFoundError):
        load_csv_tables(spark, str(tmp_path), ["customers", "conversions"])
    with pytest.raises(FileNotFoundError):
        load_csv_tables(spark, str(tmp_path / "missing"), ["customers"])


def test_benchmark_cases_and_recorded_plans(spark, tmp_path):
    from shiftscope.sources.files import benchmark_cases, recorded_plans
    cases = [{"case_id": "a", "question": "Why did revenue decline?", "current_start": "2026-07-20",
              "current_end": "2026-07-27", "previous_start": "2026-07-13", "previous_end": "2026-07-20",
              "expected_question_type": "root_cause_analysis",
              "expected_primary_driver": {"dimension": "device", "segment": "Android"},
              "expected_top_drivers": [{"dimension": "device", "segment": "Android"}],
              "expected_funnel_transition": None, "expected_root_cause_contains": "SDK"}]
    _write(tmp_path / "cases.json", json.dumps(cases, indent=2))
    r = benchmark_cases(spark, str(tmp_path / "cases.json")).head()
    assert r.expected_primary_driver.segment == "Android" and str(r.current_end) == "2026-07-27"
    plans = {"Why did revenue decline?": {"question_type": "root_cause_analysis", "primary_metric": "revenue",
                                          "scope": {"country": "India"}}}
    _write(tmp_path / "plans.json", json.dumps(plans))
    p = recorded_plans(spark, str(tmp_path / "plans.json")).head()
    assert (p.question_type, p.country, p.device) == ("root_cause_analysis", "India", None)


def test_write_tables(spark, tmp_path):
    from shiftscope.sources.files import write_tables
    df = spark.createDataFrame([("kpi_1", 1.0)], "evidence_id string, value double")
    write_tables({"kpis": df}, str(tmp_path / "out"), "json")
    back = spark.read.json(str(tmp_path / "out" / "kpis")).collect()
    assert back[0].evidence_id == "kpi_1"


def test_materialised_tables_prune_partitions(spark, tmp_path):
    from shiftscope.operators.decompose import decompose, segment_period_totals
    from shiftscope.queries import ORDERS_PERIODS
    from shiftscope.sources import tpch_adapter as A
    from shiftscope.sources.files import load_parquet_tables, write_logical_tables
    t = A.orders_tables(spark, "/root/testdata/sf0.001")
    write_logical_tables(t, str(tmp_path / "logical"))
    m = load_parquet_tables(spark, str(tmp_path / "logical"))
    assert "day" in m.sessions.columns
    direct = sorted(decompose(t, ORDERS_PERIODS, ["device"]).collect(), key=lambda r: r.segment)
    stored = decompose(m, ORDERS_PERIODS, ["device"])
    plan = segment_period_totals(m, ORDERS_PERIODS, ["device"])._jdf.queryExecution().executedPlan().toString()
    scans = [x.split("PartitionFilters: [")[1].split("]")[0] for x in plan.splitlines() if "FileScan parquet" in x]
    assert sum("day" in x for x in scans) == 2, scans  # sessions and conversions
    assert sorted(stored.collect(), key=lambda r: r.segment) == direct


def test_recorded_plans_reject_unknown_fields(spark, tmp_path):
    from shiftscope.sources.files import recorded_plans
    for k, decision in enumerate(({"question_type": "x", "confidence": 1}, {"question_type": "x", "scope": {"planet": "Mars"}})):
        _write(tmp_path / f"p{k}.json", json.dumps({"Why?": decision}))
        with pytest.raises(Exception, match="unknown fields in the recorded plan of Why"):
            recorded_plans(spark, str(tmp_path / f"p{k}.json")).collect()
