"""Each investigation family end to end on the smallest driver data, with its claims
audited against its own evidence (every claim must cite known evidence)."""

import pytest

from shiftscope import investigations as I
from shiftscope.plans.claims import audit_claims
from shiftscope.queries import EVENT_STEPS, EVENTS_PERIODS, ORDERS_PERIODS, REVIEW_PERIODS, REVIEW_TERMS
from shiftscope.sources import tpch_adapter as A

SF = "/root/testdata/sf0.001"


def _check(result):
    claims = I.report_claims(result)
    audit = audit_claims(claims, I.report_evidence_ids(result)).collect()
    assert audit, result["question_type"]
    assert all(r.approved for r in audit), [r for r in audit if not r.approved]


def test_revenue_campaign_traffic(spark):
    ev = A.events_tables(spark, SF)
    _check(I.investigate_revenue(ev, EVENTS_PERIODS, steps=EVENT_STEPS))
    orders = A.orders_tables(spark, SF)
    _check(I.investigate_campaign_performance(orders, ORDERS_PERIODS, "cpc", {"channel": "ASIA"}))
    _check(I.investigate_traffic_change(orders, ORDERS_PERIODS, "sessions", {"device": "F"}))


def test_attribution_reviews_experiment(spark):
    orders = A.orders_tables(spark, SF)
    _check(I.investigate_attribution_quality(orders, ORDERS_PERIODS))
    _check(I.investigate_review_sentiment(orders, REVIEW_PERIODS, terms=REVIEW_TERMS))
    p = ORDERS_PERIODS
    r = I.investigate_experiment(orders, p.current_start, p.current_end, "BUILDING")
    assert r["experiment"] == "BUILDING"
    _check(r)
    with pytest.raises(ValueError):
        I.investigate_experiment(orders, p.current_start, p.current_end)  # five experiments, no name


def test_metric_registry(spark):
    df = spark.createDataFrame([("roas", "d", "f", "c", "a", "b", "o"), ("cpc", "d", "f", "c", "a", "b", "o")],
                               "metric_name string, definition string, formula string, required_columns string, "
                               "allowed_dimensions string, business_context string, owner string")
    assert [r.metric_name for r in I.metric_registry(df).collect()] == ["cpc", "roas"]


def test_materialized_investigation_matches_lazy(spark):
    from shiftscope.operators.root_cause import investigate_revenue_change
    ev = A.events_tables(spark, SF)
    lazy = investigate_revenue_change(ev, EVENTS_PERIODS, steps=EVENT_STEPS)["ranked_candidates"]
    mat = investigate_revenue_change(ev, EVENTS_PERIODS, steps=EVENT_STEPS, materialize=True)["ranked_candidates"]
    key = lambda r: r.position
    assert sorted(lazy.collect(), key=key) == sorted(mat.collect(), key=key)
