"""Hand-made facts_small fixture (conftest): expected values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from shiftscope.operators.attribution import attribution_compare, period_attribution_metrics
from shiftscope.operators.decompose import decompose
from shiftscope.operators.facts import session_facts
from shiftscope.operators.kpi import compare_periods, period_kpis
from shiftscope.operators.traffic import period_traffic_kpis, traffic_candidates


def _by(rows, key):
    return {getattr(r, key): r for r in rows}


def test_session_facts_fans_out(small_tables):
    rows = session_facts(small_tables).collect()
    assert len(rows) == 13  # 12 sessions, s6 has two conversions
    s6 = [r for r in rows if r.session_id == "s6"]
    assert sorted(r.revenue for r in s6) == [20.0, 40.0] and all(r.converted == 1 for r in s6)
    s3 = [r for r in rows if r.session_id == "s3"][0]
    assert s3.revenue == 0.0 and s3.converted == 0 and s3.conversion_id is None


def test_period_kpis_bounds_and_fanout(small_tables, small_periods):
    p = small_periods
    cur = period_kpis(small_tables, p.current_start, p.current_end).head()
    assert (cur.sessions, cur.conversions, cur.users) == (5, 3, 4)
    assert cur.revenue == pytest.approx(70.0)
    assert cur.conversion_rate == pytest.approx(0.6)
    assert cur.average_order_value == pytest.approx(70 / 3)
    assert cur.revenue_per_session == pytest.approx(14.0)
    prev = period_kpis(small_tables, p.previous_start, p.previous_end).head()
    assert (prev.sessions, prev.conversions, prev.users) == (5, 3, 4) and prev.revenue == pytest.approx(180.0)
    empty = period_kpis(small_tables, p.current_end.replace(year=2030), p.current_end.replace(year=2031)).head()
    assert empty.sessions == 0 and empty.average_order_value == 0.0


def test_compare_periods(small_tables, small_periods):
    rows = _by(compare_periods(small_tables, small_periods).collect(), "metric")
    assert rows["revenue"].absolute_change == pytest.approx(-110.0)
    assert rows["revenue"].percent_change == pytest.approx(-110 / 180)
    assert rows["sessions"].percent_change == 0.0
    assert all(r.evidence_id.startswith("kpi_") and len(r.evidence_id) == 16 for r in rows.values())


def test_scope_filters_and_rejects_unknown(small_tables, small_periods):
    p = small_periods
    r = period_kpis(small_tables, p.current_start, p.current_end, {"device": "Android"}).head()
    assert (r.sessions, r.conversions) == (2, 2) and r.revenue == pytest.approx(60.0)
    r = period_kpis(small_tables, p.current_start, p.current_end, {"campaign": "Unattributed"}).head()
    assert r.sessions == 2  # NULL campaign and a campaign id without a campaign row
    with pytest.raises(ValueError):
        period_kpis(small_tables, p.current_start, p.current_end, {"planet": "Mars"})


def test_device_decomposition(small_tables, small_periods):
    rows = _by(decompose(small_tables, small_periods, ["device"]).collect(), "segment")
    a, dsk, ios = rows["Android"], rows["Desktop"], rows["iOS"]
    assert (a.current_sessions, a.previous_sessions, a.current_conversions, a.previous_conversions) == (2, 2, 2, 2)
    assert a.revenue_change == pytest.approx(-90.0) and dsk.revenue_change == pytest.approx(-20.0)
    assert a.contribution_share == pytest.approx(90 / 110) and dsk.contribution_share == pytest.approx(20 / 110)
    assert ios.revenue_percent_change is None  # previous revenue 0
    # total fell: ascending change, ties by segment
    assert (a.rank_in_dimension, dsk.rank_in_dimension, ios.rank_in_dimension) == (1, 2, 3)
    assert sum(r.revenue_change for r in rows.values()) == pytest.approx(-110.0)
    assert a.evidence_id.startswith("dim_")


def test_campaign_and_product_segments(small_tables, small_periods):
    rows = {(r.dimension, r.segment): r for r in
            decompose(small_tables, small_periods, ["campaign", "product"]).collect()}
    un = rows[("campaign", "Unattributed")]
    assert (un.current_sessions, un.previous_sessions) == (2, 1)
    nop = rows[("product", "No purchase")]
    assert (nop.current_sessions, nop.previous_sessions) == (3, 2)
    p1, p2 = rows[("product", "p1")], rows[("product", "p2")]
    assert (p1.current_sessions, p1.current_conversions) == (2, 2) and p1.current_revenue == pytest.approx(30.0)
    assert (p2.current_sessions, p2.current_revenue) == (1, 40.0)


def test_one_sided_and_zero_total(spark, small_periods):
    from shiftscope.tables import MarketingTables
    from tests.conftest import ts
    cust = spark.createDataFrame([("c", "X", "New")], "customer_id string, country string, customer_segment string")
    S = "session_id string, customer_id string, timestamp timestamp_ntz, device string, country string, " \
        "traffic_source string, campaign_id string, landing_page string"
    sessions = spark.createDataFrame([
        ("a", "c", ts("2024-01-09 00:00:00"), "only_cur", "X", "t", None, "/"),
        ("b", "c", ts("2024-01-02 00:00:00"), "only_prev", "X", "t", None, "/")], S)
    conv = spark.createDataFrame([("1", "a", "p", 10.0, 0.0), ("2", "b", "p", 10.0, 0.0)],
                                 "conversion_id string, session_id string, product_id string, revenue double, discount double")
    t = MarketingTables(customers=cust, sessions=sessions, conversions=conv)
    rows = _by(decompose(t, small_periods, ["device"]).collect(), "segment")
    assert rows["only_cur"].previous_sessions == 0 and rows["only_prev"].current_sessions == 0
    assert rows["only_cur"].contribution_share is None  # gains and losses cancel
    assert rows["only_cur"].revenue_percent_change is None
    # total is 0 (>= 0): descending change
    assert rows["only_cur"].rank_in_dimension == 1


def test_attribution_and_traffic(small_tables, small_periods):
    p = small_periods
    a = period_attribution_metrics(small_tables, p.current_start, p.current_end).head()
    assert (a.sessions, a.attributed_sessions, a.unattributed_sessions) == (5, 4, 1)
    assert a.attribution_completeness == pytest.approx(0.8)
    rows = _by(attribution_compare(small_tables, p).collect(), "metric")
    assert rows["unattributed_sessions"].previous == 1.0
    t = period_traffic_kpis(small_tables, p.current_start, p.current_end).head()
    assert (t.sessions, t.users) == (5.0, 4.0)
    cands = traffic_candidates(small_tables, p, {"device": "iOS"}).collect()
    assert all(c.absolute_change < 0 for c in cands)
    assert sorted(c.rank_within_dimension for c in cands) == list(range(1, len(cands) + 1))


def test_kpi_invariants_on_driver_data(spark):
    """Reconciliation on sf0.001: segment sums equal the KPI totals."""
    from shiftscope.queries import ORDERS_PERIODS
    from shiftscope.sources import tpch_adapter as A
    t = A.orders_tables(spark, "/root/testdata/sf0.001")
    k = _by(compare_periods(t, ORDERS_PERIODS).collect(), "metric")
    d = decompose(t, ORDERS_PERIODS, ["device", "channel"]).groupBy("dimension").agg(
        F.sum("current_revenue").alias("r"), F.sum("current_sessions").alias("s")).collect()
    for r in d:
        assert r.r == pytest.approx(k["revenue"].current, rel=1e-9)
        assert r.s == k["sessions"].current
