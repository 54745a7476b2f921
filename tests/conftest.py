import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from shiftscope.session import local_session, ensure_checkpoint_dir
    s = local_session("*", 8, app="shiftscope-tests")
    ensure_checkpoint_dir(s)
    yield s


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


@pytest.fixture(scope="session")
def small_tables(spark):
    """facts_small: 12 sessions, 4 customers, 2 campaigns, one NULL campaign, a session
    with two conversions, rows exactly on both period bounds."""
    from shiftscope.tables import MarketingTables
    customers = spark.createDataFrame(
        [("c1", "India", "New"), ("c2", "India", "Loyal"), ("c3", "Germany", "New"), ("c4", "Germany", "Loyal")],
        "customer_id string, country string, customer_segment string")
    campaigns = spark.createDataFrame([("k1", "Brand", "Search"), ("k2", "Promo", "Social")],
                                      "campaign_id string, campaign_name string, channel string")
    # previous = [2024-01-01, 2024-01-08), current = [2024-01-08, 2024-01-15)
    S = "session_id string, customer_id string, timestamp timestamp_ntz, device string, country string, " \
        "traffic_source string, campaign_id string, landing_page string"
    sessions = spark.createDataFrame([
        ("s1", "c1", ts("2024-01-01 00:00:00"), "Android", "India", "Ads", "k1", "/"),   # previous lower bound
        ("s2", "c1", ts("2024-01-03 10:00:00"), "Android", "India", "Ads", "k1", "/"),
        ("s3", "c2", ts("2024-01-04 10:00:00"), "iOS", "India", "Email", None, "/"),
        ("s4", "c3", ts("2024-01-05 10:00:00"), "Desktop", "Germany", "Ads", "k2", "/"),
        ("s5", "c4", ts("2024-01-07 23:59:59"), "iOS", "Germany", "Email", "k2", "/"),
        ("s6", "c1", ts("2024-01-08 00:00:00"), "Android", "India", "Ads", "k1", "/"),   # current lower bound
        ("s7", "c2", ts("2024-01-09 10:00:00"), "Android", "India", "Email", None, "/"),
        ("s8", "c3", ts("2024-01-10 10:00:00"), "Desktop", "Germany", "Ads", "k2", "/"),
        ("s9", "c4", ts("2024-01-11 10:00:00"), "iOS", "Germany", "Email", "k2", "/"),
        ("s10", "c4", ts("2024-01-12 10:00:00"), "iOS", "Germany", "Email", "k9", "/"),  # unknown campaign
        ("s11", "c1", ts("2024-01-15 00:00:00"), "Android", "India", "Ads", "k1", "/"),  # current upper bound: out
        ("s12", "cX", ts("2024-01-09 12:00:00"), "Android", "India", "Ads", "k1", "/"),  # no customer: dropped
    ], S)
    conversions = spark.createDataFrame([
        ("v1", "s1", "p1", 100.0, 0.0), ("v2", "s2", "p2", 50.0, 0.0), ("v3", "s4", "p1", 30.0, 0.0),
        ("v4", "s6", "p1", 20.0, 0.0), ("v5", "s6", "p2", 40.0, 0.0),  # two conversions in one session
        ("v6", "s8", "p1", 10.0, 0.0), ("v7", "s11", "p1", 999.0, 0.0), ("v8", "s12", "p1", 999.0, 0.0),
    ], "conversion_id string, session_id string, product_id string, revenue double, discount double")
    return MarketingTables(customers=customers, campaigns=campaigns, sessions=sessions, conversions=conversions)


@pytest.fixture(scope="session")
def small_periods():
    from shiftscope.periods import Periods
    return Periods.of("2024-01-08", "2024-01-15", "2024-01-01", "2024-01-08")
