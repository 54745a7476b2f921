import datetime as dt

import pytest

from shiftscope.periods import Periods
from shiftscope.tables import MarketingTables
from tests.conftest import ts


@pytest.fixture(scope="module")
def funnel_tables(spark):
    """funnel_gaps: a missing step, an unknown event, a later step larger than an earlier one."""
    cust = spark.createDataFrame([("c", "X", "New")], "customer_id string, country string, customer_segment string")
    S = "session_id string, customer_id string, timestamp timestamp_ntz, device string, country string, " \
        "traffic_source string, campaign_id string, landing_page string"
    sess = [(f"p{i}", "c", ts("2024-01-02 00:00:00"), "A", "X", "t", None, "/") for i in range(4)] + \
           [(f"q{i}", "c", ts("2024-01-09 00:00:00"), "A" if i < 2 else "B", "X", "t", None, "/") for i in range(4)]
    ev = []
    for i in range(4):                      # previous: view 4, click 2, buy 3 (more than click)
        ev.append(("c", f"p{i}", ts("2024-01-02 00:00:00"), "view"))
        ev.append(("c", f"p{i}", ts("2024-01-02 00:00:00"), "error"))
        if i < 2:
            ev.append(("c", f"p{i}", ts("2024-01-02 00:00:00"), "click"))
        if i < 3:
            ev.append(("c", f"p{i}", ts("2024-01-02 00:00:00"), "buy"))
    for i in range(4):                      # current: view 4, click 0, buy 1
        ev.append(("c", f"q{i}", ts("2024-01-09 00:00:00"), "view"))
        ev.append(("c", f"q{i}", ts("2024-01-09 00:00:00"), "view"))
    ev.append(("c", "q0", ts("2024-01-09 00:00:00"), "buy"))
    return MarketingTables(
        customers=cust, sessions=spark.createDataFrame(sess, S),
        funnel_events=spark.createDataFrame(ev, "customer_id string, session_id string, timestamp timestamp_ntz, "
                                                "event_name string"))


P = Periods.of("2024-01-08", "2024-01-15", "2024-01-01", "2024-01-08")


def test_funnel_gaps(funnel_tables):
    from shiftscope.operators.funnel import compare_funnels
    rows = {r.from_step: r for r in compare_funnels(funnel_tables, P, steps=("view", "click", "buy")).collect()}
    vc, cb = rows["view"], rows["click"]
    assert (vc.current_from_sessions, vc.current_to_sessions, vc.previous_to_sessions) == (4, 0, 2)
    assert vc.current_rate == 0.0 and vc.previous_rate == 0.5
    assert cb.current_rate == 0.0  # from-count 0 gives rate 0
    assert cb.previous_rate == 1.5 and cb.p_value is None  # rate above 1: invalid variance
    assert cb.evidence_id.startswith("fun_") and cb.filter_dimension is None


def test_segment_funnel_and_filter(funnel_tables, spark):
    from shiftscope.operators.funnel import compare_funnels, segment_funnels
    seg = spark.createDataFrame([("B",), ("Z",)], "segment string")
    rows = segment_funnels(funnel_tables, P, seg, "device", steps=("view", "buy")).collect()
    by = {r.filter_value: r for r in rows}
    assert by["B"].current_from_sessions == 2 and by["Z"].current_from_sessions == 0
    direct = compare_funnels(funnel_tables, P, filter_dimension="device", filter_value="B",
                             steps=("view", "buy")).head()
    assert direct.evidence_id == by["B"].evidence_id  # same key for the same drill-down
    with pytest.raises(ValueError):
        compare_funnels(funnel_tables, P, filter_dimension="device")


QUESTIONS = [
    ("q1", "Why did revenue decline from July 20 to July 26?", "root_cause_analysis", "revenue", {}),
    ("q2", "Why did Google Ads CPC increase in the first half of June?", "campaign_performance_analysis", "cpc",
     {"channel": "Google Ads"}),
    ("q3", "Why did organic sessions decline in the second half of June?", "traffic_analysis", "sessions",
     {"channel": "Organic Search"}),
    ("q4", "Why did campaign attribution completeness decline from May 10 to May 16?", "data_quality_analysis",
     "attribution_completeness", {}),
    ("q5", "Why did negative app reviews increase after July 20?", "sentiment_analysis", "negative_review_rate", {}),
    ("q6", "Did the Meta Summer Lift campaign improve conversion rate in July?", "campaign_performance_analysis",
     "conversion_rate", {"campaign": "Meta_Summer_Lift"}),
    ("q7", "Why did revenue decline in India from July 20 to July 26?", "root_cause_analysis", "revenue",
     {"country": "India"}),
    ("q8", "How is the weather?", "unsupported", None, {}),
    ("q9", "Is the Checkout-reassurance copy working?", "experiment_analysis", "conversion_rate",
     {"experiment": "Checkout reassurance copy"}),
]


def test_question_rules(spark):
    from shiftscope.plans.questions import SCOPE_FIELDS, question_scope, question_type
    qs = spark.createDataFrame([(a, b) for a, b, *_ in QUESTIONS], "request_id string, question string")
    got = {r.request_id: r for r in question_type(qs, question_scope(qs)).collect()}
    for rid, _, qtype, metric, scope in QUESTIONS:
        r = got[rid]
        assert (r.question_type, r.primary_metric) == (qtype, metric), rid
        assert {f: getattr(r, f) for f in SCOPE_FIELDS if getattr(r, f)} == scope, rid


def test_scope_check(spark):
    from shiftscope.plans.questions import scope_check
    qs = spark.createDataFrame([("r1", "Why did organic sessions fall in india?")], "request_id string, question string")
    props = spark.createDataFrame([("r1", "channel", "organic"), ("r1", "country", "INDIA"), ("r1", "device", "all"),
                                   ("r1", "device", "Android")], "request_id string, dimension string, value string")
    got = {(r.dimension, r.value): r for r in scope_check(props, qs).collect()}
    assert got[("channel", "organic")].canonical_value == "Organic Search" and got[("channel", "organic")].stated
    assert got[("country", "INDIA")].canonical_value == "India" and got[("country", "INDIA")].stated
    assert got[("device", "all")].dropped
    assert got[("device", "Android")].error == "not_stated"


def test_request_errors(spark):
    from shiftscope.plans.questions import request_errors
    d = dt.date.fromisoformat
    rows = [("ok", "Why did revenue fall?", d("2024-01-08"), d("2024-01-15"), d("2024-01-01"), d("2024-01-08")),
            ("overlap", "Why did revenue fall?", d("2024-01-05"), d("2024-01-12"), d("2024-01-01"), d("2024-01-08")),
            ("unequal", "Why did revenue fall?", d("2024-01-08"), d("2024-01-16"), d("2024-01-01"), d("2024-01-08")),
            ("reversed", "Why did revenue fall?", d("2024-01-15"), d("2024-01-08"), d("2024-01-01"), d("2024-01-08")),
            ("short", "Why", d("2024-01-08"), d("2024-01-15"), d("2024-01-01"), d("2024-01-08"))]
    req = spark.createDataFrame(rows, "request_id string, question string, current_start date, current_end date, "
                                      "previous_start date, previous_end date")
    got = {r.request_id: r for r in request_errors(req).collect()}
    assert got["ok"].valid and got["ok"].errors == []
    assert got["overlap"].first_error == "periods_overlap"
    assert got["unequal"].errors == ["unequal_durations"]
    assert got["reversed"].first_error == "current_start_not_before_end"
    assert got["short"].first_error == "question_too_short"


def test_claim_audit(spark):
    from shiftscope.plans.claims import audit_claims
    claims = spark.createDataFrame([("r", "good", ["kpi_a"]), ("r", "fake", ["kpi_a", "dim_zzz"]), ("r", "empty", [])],
                                   "report string, claim_id string, evidence_ids array<string>")
    valid = spark.createDataFrame([("kpi_a",)], "evidence_id string")
    got = {r.claim_id: r for r in audit_claims(claims, valid).collect()}
    assert got["good"].approved and got["good"].n_evidence == 1
    assert not got["fake"].approved and got["fake"].unknown_ids == ["dim_zzz"]
    assert got["empty"].missing_evidence and not got["empty"].approved


def test_incident_overlap_edges(spark):
    from shiftscope.operators.incidents import incidents_for_metric, incidents_scoped
    d = dt.date.fromisoformat
    an = spark.createDataFrame([
        ("ends_on_start", d("2024-01-01"), d("2024-01-08"), "sessions", "device=A", "x", "rc", "high"),
        ("starts_on_end", d("2024-01-15"), d("2024-01-20"), "sessions", "device=A", "x", "rc", "high"),
        ("other_dim", d("2024-01-09"), d("2024-01-10"), "sessions", "device=B", "x", "rc", "medium")],
        "scenario_id string, start_date date, end_date date, affected_metric string, affected_dimension string, "
        "expected_direction string, root_cause string, severity string")
    got = [r.incident_id for r in incidents_scoped(an, P, {"device": "A"}).collect()]
    assert got == ["ends_on_start"]
    assert incidents_scoped(an, P, None).count() == 0
    rows = incidents_for_metric(an, P, "sessions").collect()
    assert sorted(r.incident_id for r in rows) == ["ends_on_start", "other_dim"]
    assert {r.impact for r in rows} == {"High", "Medium"}
