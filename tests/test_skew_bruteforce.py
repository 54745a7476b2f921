"""Hot keys: one customer owns a third of all sessions and one session a third of all funnel
events.  Results are compared with a brute-force pandas computation of the same semantics
(distinct counts over the fanned-out join, as the original SQL states them)."""

import datetime as dt
import random

import pandas as pd
import pytest

from shiftscope.periods import Periods
from shiftscope.tables import MarketingTables

P = Periods.of("2024-02-15", "2024-03-01", "2024-02-01", "2024-02-15")
STEPS = ("view", "click", "buy")


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    n = 600
    cust = [(f"c{i}", rnd.choice(["A", "B"]), rnd.choice(["s1", "s2"])) for i in range(20)]
    sessions, conversions, events = [], [], []
    for i in range(n):
        c = "c0" if i % 3 == 0 else f"c{rnd.randrange(1, 20)}"  # hot customer
        ts = dt.datetime(2024, 2, 1) + dt.timedelta(minutes=rnd.randrange(0, 29 * 24 * 60))
        sessions.append((f"s{i}", c, ts, rnd.choice(["Android", "iOS", "Desktop"]), rnd.choice(["A", "B"]),
                         rnd.choice(["Ads", "Email"]), rnd.choice([None, "k1", "k2"]), "/"))
        for j in range(rnd.choice([0, 0, 1, 2])):
            conversions.append((f"v{i}_{j}", f"s{i}", rnd.choice(["p1", "p2"]), float(rnd.randrange(1, 9999)) / 100, 0.0))
        for step in STEPS + ("noise",):
            if rnd.random() < 0.5:
                events.append((c, f"s{i}", ts, step))
    hot = [("c0", "s0", dt.datetime(2024, 2, 20), rnd.choice(STEPS)) for _ in range(len(events) // 2)]
    events += hot                                                      # hot session: a third of events
    S = ("session_id string, customer_id string, timestamp timestamp_ntz, device string, country string, "
         "traffic_source string, campaign_id string, landing_page string")
    t = MarketingTables(
        customers=spark.createDataFrame(cust, "customer_id string, country string, customer_segment string"),
        campaigns=spark.createDataFrame([("k1", "K1", "x"), ("k2", "K2", "y")],
                                        "campaign_id string, campaign_name string, channel string"),
        sessions=spark.createDataFrame(sessions, S),
        conversions=spark.createDataFrame(conversions, "conversion_id string, session_id string, product_id string, "
                                                       "revenue double, discount double"),
        funnel_events=spark.createDataFrame(events, "customer_id string, session_id string, "
                                                    "timestamp timestamp_ntz, event_name string"))
    pdf = {k: pd.DataFrame(v, columns=c) for k, v, c in (
        ("s", sessions, ["session_id", "customer_id", "timestamp", "device", "country", "traffic_source",
                         "campaign_id", "landing_page"]),
        ("v", conversions, ["conversion_id", "session_id", "product_id", "revenue", "discount"]),
        ("e", events, ["customer_id", "session_id", "timestamp", "event_name"]))}
    return t, pdf


def _period(ts):
    if dt.datetime(2024, 2, 15) <= ts < dt.datetime(2024, 3, 1):
        return "current"
    if dt.datetime(2024, 2, 1) <= ts < dt.datetime(2024, 2, 15):
        return "previous"
    return None


def test_device_decomposition_matches_bruteforce(skewed):
    from shiftscope.operators.decompose import decompose
    t, pdf = skewed
    facts = pdf["s"].merge(pdf["v"], on="session_id", how="left")
    facts["period"] = facts["timestamp"].map(_period)
    facts = facts[facts["period"].notna()]
    exp = facts.groupby(["device", "period"]).agg(sessions=("session_id", "nunique"),
                                                   conversions=("conversion_id", "nunique"),
                                                   revenue=("revenue", "sum")).reset_index()
    got = {r.segment: r for r in decompose(t, P, ["device"]).collect()}
    for _, e in exp.iterrows():
        r = got[e.device]
        pre = "current" if e.period == "current" else "previous"
        assert getattr(r, f"{pre}_sessions") == e.sessions
        assert getattr(r, f"{pre}_conversions") == e.conversions
        assert getattr(r, f"{pre}_revenue") == pytest.approx(e.revenue, abs=1e-6)


def test_funnel_counts_match_bruteforce(skewed):
    from shiftscope.operators.funnel import compare_funnels
    t, pdf = skewed
    j = pdf["e"].merge(pdf["s"][["session_id", "timestamp"]].rename(columns={"timestamp": "sts"}), on="session_id")
    j["period"] = j["sts"].map(_period)
    counts = j[j["period"].notna()].groupby(["period", "event_name"])["session_id"].nunique().to_dict()
    rows = {r.from_step: r for r in compare_funnels(t, P, steps=STEPS).collect()}
    for a, b in zip(STEPS, STEPS[1:]):
        r = rows[a]
        assert r.current_from_sessions == counts.get(("current", a), 0)
        assert r.current_to_sessions == counts.get(("current", b), 0)
        assert r.previous_from_sessions == counts.get(("previous", a), 0)
        assert r.previous_to_sessions == counts.get(("previous", b), 0)


def test_kpis_match_bruteforce(skewed):
    from shiftscope.operators.kpi import period_kpis
    t, pdf = skewed
    facts = pdf["s"].merge(pdf["v"], on="session_id", how="left")
    cur = facts[facts["timestamp"].map(_period) == "current"]
    r = period_kpis(t, P.current_start, P.current_end).head()
    assert r.sessions == cur["session_id"].nunique()
    assert r.conversions == cur["conversion_id"].nunique()
    assert r.users == cur["customer_id"].nunique()
    assert r.revenue == pytest.approx(cur["revenue"].sum(), abs=1e-6)
