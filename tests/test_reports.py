"""Whole reports: titles, limitations, scope of candidates, bounded arrays, JSON sink; audit with offenders."""

import datetime as dt
import json

from pyspark.sql import functions as F

from shiftscope.operators.audit import constraint_audit, constraint_offenders
from shiftscope.periods import Periods
from shiftscope.plans.reports import candidate_evidence, report_documents, scope_map, write_reports
from shiftscope.sources import tpch_adapter as A
from shiftscope.tables import MarketingTables

P = Periods.of("2024-01-08", "2024-01-15", "2024-01-01", "2024-01-08")
KPI = "evidence_id string, metric string, current double, previous double, absolute_change double, percent_change double"


def traffic(spark, n, incidents=3):
    kpis = spark.createDataFrame([("trk_1", "sessions", 8.0, 10.0, -2.0, -0.2), ("trk_2", "users", 0.0, 0.0, 0.0, None)], KPI)
    cands = spark.range(n).select(F.concat(F.lit("trf_"), "id").alias("evidence_id"), F.lit("dimension_driver").alias("candidate_type"),
                                  F.when(F.col("id") % 2 == 0, "device").otherwise("channel").alias("dimension"),
                                  F.when(F.col("id") == 4, F.lit(None)).otherwise(F.concat(F.lit("s"), "id")).alias("segment"), F.lit(0.5).alias("score"),
                                  (F.col("id") + 1).cast("int").alias("rank_within_dimension"), F.lit("sessions").alias("metric"), F.lit(1).alias("current"),
                                  F.lit(2).alias("previous"), F.lit(-1).alias("absolute_change"), F.lit(-0.5).alias("percent_change")).repartition(5)
    incs = spark.range(incidents).select(F.concat(F.lit("gt_"), "id").alias("evidence_id"), F.concat(F.lit("x"), "id").alias("incident_id"),
                                         F.date_sub(F.lit("2024-01-09").cast("date"), F.col("id").cast("int")).alias("incident_date"), F.lit("t").alias("title"),
                                         F.concat(F.lit("cause "), "id").alias("root_cause"), F.lit("r").alias("resolution"), F.lit("High").alias("impact"))
    return {"question_type": "traffic_analysis", "metric": "sessions", "kpis": kpis, "ranked_candidates": cands, "related_incidents": incs}


def test_document_holds_the_first_rows_and_counts_all(spark):
    row = report_documents(traffic(spark, 70_000, 40), P, {"device": "iOS", "country": None}, rows=5).collect()
    assert len(row) == 1
    d = row[0].asDict(recursive=True)
    assert d["title"] == "Traffic investigation (device=iOS)" and d["limitations"][1] == "Applied traffic scope: device=iOS."
    assert d["applied_scope"] == {"device": "iOS"} and (d["current_start"], d["previous_end"]) == (dt.date(2024, 1, 8), dt.date(2024, 1, 8))
    assert [c["position"] for c in d["ranked_candidates"]] == [1, 2, 3, 4, 5] and d["n_candidates"] == 70_000
    assert [i["incident_id"] for i in d["related_incidents"]] == [f"x{k}" for k in range(39, 34, -1)] and d["n_incidents"] == 40
    # a candidate's own segment takes the place of the scope's value; a candidate without one keeps the scope
    assert [c["evidence"]["applied_scope"] for c in d["ranked_candidates"]] == [
        {"device": "s0"}, {"device": "iOS", "channel": "s1"}, {"device": "s2"}, {"device": "iOS", "channel": "s3"}, {"device": "iOS"}]
    assert d["primary_driver"]["text"] == "The leading traffic driver was device=s0." and d["contributing_factors"] == []
    assert [c["claim_id"] for c in d["recommendations"]] == ["traffic_incident", "traffic_recommendation"]
    assert [k["metric"] for k in d["kpis"]] == ["sessions", "users"] and d["kpis"][1]["percent_change"] is None


def test_report_without_candidates_and_incidents(spark):
    d = report_documents(traffic(spark, 0, 0), P).first().asDict(recursive=True)
    assert d["title"] == "Traffic investigation (all traffic)" and d["primary_driver"] is None
    assert (d["ranked_candidates"], d["related_incidents"], d["n_candidates"], d["n_incidents"]) == ([], [], 0, 0)
    assert [c["claim_id"] for c in d["summary"]] == ["traffic_metric_change"]


def test_json_sink_writes_one_object_a_report(spark, tmp_path):
    write_reports(report_documents(traffic(spark, 3), P, {"channel": "Ads"}), str(tmp_path / "reports"))
    lines = [json.loads(x) for f in (tmp_path / "reports").glob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) == 1
    assert lines[0]["applied_scope"] == {"channel": "Ads"} and lines[0]["ranked_candidates"][1]["evidence"]["applied_scope"] == {"channel": "s1"}
    assert lines[0]["kpis"][1]["percent_change"] is None


def test_scope_columns(spark):
    one = spark.range(1)
    assert one.select(scope_map({"device": "a", "country": None}).alias("m")).first()["m"] == {"device": "a"}
    assert one.select(scope_map(None).alias("m")).first()["m"] == {}
    topic = spark.createDataFrame([("topic", "refund")], "dimension string, segment string")
    assert candidate_evidence(topic, {"device": "a"}).first()["applied_scope"] == {"device": "a"}


def test_offenders_of_every_kind(spark):
    c = "customer_id string, country string, customer_segment string"
    customers = spark.createDataFrame([("a", "x", "s"), ("b", None, "s"), ("b", "x", None), ("b", None, "s")], c)
    sessions = spark.createDataFrame([(f"s{i:04d}", "gone" if i % 3 == 0 else f"c{i % 7}" if i % 3 == 1 else "a", None if i < 9 else "iOS") for i in range(3000)],
                                     "session_id string, customer_id string, device string")
    t = MarketingTables(customers=customers, sessions=sessions)
    got = {(r["table_name"], r["check_name"], r["column_name"]): (r["violations"], r["offending_keys"], r["examples"]) for r in constraint_offenders(t).collect()}
    assert got["customers", "primary_key", "customer_id"] == (3, 1, "b")
    assert got["customers", "not_null", "country"] == (2, 1, "b") and got["customers", "not_null", "customer_segment"] == (1, 1, "b")
    assert got["sessions", "foreign_key:customers.customer_id", "customer_id"] == (2000, 8, "c0, c1, c2")
    assert got["sessions", "not_null", "device"] == (9, 9, "s0000, s0001, s0002") and got["sessions", "primary_key", "session_id"] == (0, 0, "")
    # the counts are those of the plain audit
    assert {k: v[0] for k, v in got.items()} == {(r["table_name"], r["check_name"], r["column_name"]): r["violations"] for r in constraint_audit(t).collect()}


def test_offenders_cover_all_eleven_tables(spark):
    t = A.damaged_tables(spark, "/root/testdata/sf0.001")
    rows = constraint_offenders(t).collect()
    assert len({r["table_name"] for r in rows}) == 11 and len(t.present()) == 11
    assert sum(r["violations"] > 0 for r in rows) >= 6
    assert all((r["violations"] > 0) == (r["examples"] != "") for r in rows if r["table_name"] not in ("funnel_events", "experiments") or r["check_name"] != "not_null")


def test_offenders_of_empty_tables(spark):
    t = MarketingTables(customers=spark.createDataFrame([], "customer_id string, country string, customer_segment string"))
    assert [r["violations"] for r in constraint_offenders(t).collect()] == [0] * 4


def test_investigations_share_the_facts_of_their_periods(spark, small_tables, small_periods):
    from pyspark.sql import functions as F

    from shiftscope.investigations import investigate_attribution_quality, investigate_traffic_change, with_stored_facts
    from shiftscope.tables import MarketingTables
    read = spark.sparkContext.accumulator(0)

    def noted(v):
        read.add(1)
        return v
    rows = small_tables.sessions.withColumn("device", F.udf(noted, "string")("device"))
    none = spark.createDataFrame([], "scenario_id string, start_date date, end_date date, affected_dimension string, affected_metric string, root_cause string, severity string")
    t = MarketingTables(customers=small_tables.customers, campaigns=small_tables.campaigns, sessions=rows, anomaly_ground_truth=none)
    plain = MarketingTables(customers=small_tables.customers, campaigns=small_tables.campaigns, sessions=small_tables.sessions, anomaly_ground_truth=none)
    shared = with_stored_facts(t, small_periods)
    assert read.value == 0 and set(shared.present()) == set(t.present())
    for scope in (None, {"device": "Android"}):
        for run in (lambda t: investigate_traffic_change(t, small_periods, "sessions", scope), lambda t: investigate_attribution_quality(t, small_periods, scope)):
            got, want = run(shared), run(plain)
            for part in ("kpis", "ranked_candidates"):
                assert sorted(map(repr, got[part].collect())) == sorted(map(repr, want[part].collect()))
    assert 0 < read.value <= small_tables.sessions.count()
