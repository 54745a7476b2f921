"""Bucketed storage by session and day, funnels of many steps, decompositions of many segments, top segments."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from shiftscope.operators.campaign import campaign_candidates
from shiftscope.operators.decompose import decompose
from shiftscope.operators.funnel import compare_funnels, funnel_counts, step_totals
from shiftscope.operators.kpi import compare_periods, kpis_per_period
from shiftscope.operators.root_cause import dimension_candidates, leading_segment
from shiftscope.operators.traffic import traffic_candidates
from shiftscope.periods import Periods
from shiftscope.queries import EVENT_STEPS, EVENTS_PERIODS
from shiftscope.sources import tpch_adapter as A
from shiftscope.sources.files import load_bucketed_tables, load_parquet_tables, write_bucketed_tables, write_logical_tables
from shiftscope.tables import MarketingTables


def rows(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def events(spark):
    return A.events_tables(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def bucketed(spark, events, tmp_path_factory):
    prefix = f"t{uuid.uuid4().hex[:8]}"
    write_bucketed_tables(events, prefix, 4)
    yield load_bucketed_tables(spark, prefix)
    for name in spark.catalog.listTables():
        if name.name.startswith(prefix):
            spark.sql(f"DROP TABLE {name.name}")


def test_bucketed_facts_are_joined_without_an_exchange(spark, events, bucketed):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    kpis = kpis_per_period(bucketed, EVENTS_PERIODS)
    assert rows(kpis) == rows(kpis_per_period(events, EVENTS_PERIODS))
    steps = step_totals(bucketed, EVENTS_PERIODS, None, EVENT_STEPS)
    assert rows(steps) == rows(step_totals(events, EVENTS_PERIODS, None, EVENT_STEPS))
    assert rows(funnel_counts(bucketed, EVENTS_PERIODS)) == rows(funnel_counts(events, EVENTS_PERIODS))
    try:
        # customers are small, the facts are not
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        facts = bucketed.sessions.select("session_id").join(
            bucketed.conversions.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")), "session_id", "left")
        assert "Exchange" not in plan_of(facts)
        funnel = bucketed.sessions.join(bucketed.funnel_events.groupBy("session_id").agg(F.max("event_name")), "session_id")
        assert "Exchange" not in plan_of(funnel)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    for df in (kpis, steps):
        assert "hashpartitioning(session_id" not in plan_of(df)
        # sessions and their facts; an executed plan shows its first form too
        scans = {x.split("PartitionFilters: [")[1].split("]")[0] for x in plan_of(df).splitlines() if "FileScan parquet" in x and "PartitionFilters: [" in x}
        assert sum("day" in x for x in scans) == 2, scans


def test_stored_facts_keep_their_sessions_day(spark, tmp_path):
    s = "session_id string, customer_id string, timestamp timestamp_ntz, device string, country string, traffic_source string, campaign_id string, landing_page string"
    t = MarketingTables(
        customers=spark.createDataFrame([("c", "India", "New")], "customer_id string, country string, customer_segment string"),
        campaigns=spark.createDataFrame([], "campaign_id string, campaign_name string, channel string"),
        sessions=spark.createDataFrame([("s", "c", dt.datetime(2024, 1, 1, 23, 59), "iOS", "India", "Ads", None, "/")], s),
        # the conversion falls on the next day, and one has no session
        conversions=spark.createDataFrame([("v", "s", "p", 5.0, 0.0, dt.datetime(2024, 1, 2, 0, 5)), ("w", "gone", "p", 7.0, 0.0, dt.datetime(2024, 1, 1))],
                                          "conversion_id string, session_id string, product_id string, revenue double, discount double, timestamp timestamp_ntz"))
    write_logical_tables(t, str(tmp_path / "once"))
    stored = load_parquet_tables(spark, str(tmp_path / "once"))
    p = Periods.of("2024-01-01", "2024-01-02", "2023-12-31", "2024-01-01")
    assert rows(compare_periods(stored, p)) == rows(compare_periods(t, p))
    assert {r["metric"]: r["current"] for r in compare_periods(stored, p).collect()}["revenue"] == 5.0
    # writing stored tables again changes nothing
    write_logical_tables(stored, str(tmp_path / "twice"))
    assert rows(load_parquet_tables(spark, str(tmp_path / "twice")).conversions) == rows(stored.conversions)


def test_funnel_of_more_steps_than_a_mask_holds(spark):
    n = 130
    sessions = spark.range(40).select(F.concat(F.lit("s"), "id").alias("session_id"), F.lit("c").alias("customer_id"),
                                      F.lit("2024-01-10 10:00:00").cast("timestamp_ntz").alias("timestamp"), F.lit("iOS").alias("device"), F.lit("x").alias("country"),
                                      F.lit("Ads").alias("traffic_source"), F.lit(None).cast("string").alias("campaign_id"), F.lit("/").alias("landing_page"))
    # session k has the steps up to 3k
    events = spark.range(40).select(F.concat(F.lit("s"), "id").alias("session_id"), F.explode(F.sequence(F.lit(0), F.least(F.col("id") * 3, F.lit(n - 1)))).alias("k")) \
        .select("session_id", F.concat(F.lit("step"), "k").alias("event_name"))
    t = MarketingTables(customers=spark.createDataFrame([("c", "x", "New")], "customer_id string, country string, customer_segment string"),
                        campaigns=spark.createDataFrame([], "campaign_id string, campaign_name string, channel string"), sessions=sessions,
                        funnel_events=events.unionAll(events))
    got = compare_funnels(t, Periods.of("2024-01-08", "2024-01-15", "2024-01-01", "2024-01-08"), steps=[f"step{k}" for k in range(n)])
    counts = {r["step_pos"]: (r["current_from_sessions"], r["current_to_sessions"]) for r in got.collect()}
    reach = lambda k: sum(3 * i >= k for i in range(40))
    assert counts == {k + 1: (reach(k), reach(k + 1)) for k in range(n - 1)}
    with pytest.raises(ValueError):
        compare_funnels(t, EVENTS_PERIODS, steps=["a", "a"])


@pytest.fixture(scope="module")
def many(spark):
    """100,000 landing pages and campaigns, one session each and period."""
    n = 100_000
    base = spark.range(2 * n).select("id", (F.col("id") % n).alias("k"), (F.col("id") < n).alias("cur"))
    sessions = base.select(F.concat(F.lit("s"), "id").alias("session_id"), F.lit("c").alias("customer_id"),
                           F.when(F.col("cur"), F.lit("2024-01-10 10:00:00")).otherwise(F.lit("2024-01-03 10:00:00")).cast("timestamp_ntz").alias("timestamp"),
                           F.lit("iOS").alias("device"), F.concat(F.lit("n"), "k").alias("country"), F.lit("Ads").alias("traffic_source"),
                           F.lit(None).cast("string").alias("campaign_id"), F.lit("/").alias("landing_page"))
    conversions = base.select(F.concat(F.lit("v"), "id").alias("conversion_id"), F.concat(F.lit("s"), "id").alias("session_id"), F.lit("p").alias("product_id"),
                              F.when(F.col("cur"), (F.col("k") * 7919 % 1000).cast("double")).otherwise(500.0).alias("revenue"), F.lit(0.0).alias("discount"))
    t = MarketingTables(customers=spark.createDataFrame([("c", "x", "New")], "customer_id string, country string, customer_segment string"),
                        campaigns=spark.createDataFrame([], "campaign_id string, campaign_name string, channel string"), sessions=sessions, conversions=conversions)
    return t, Periods.of("2024-01-08", "2024-01-15", "2024-01-01", "2024-01-08"), n


def test_decomposition_of_many_segments(many):
    t, p, n = many
    df = decompose(t, p, ["country", "device"])
    for line in plan_of(df).splitlines():
        assert "windowspecdefinition(" not in line or "__part" in line or "__share" in line, line
    got = df.filter("dimension = 'country'").select("segment", "revenue_change", "contribution_share", "rank_in_dimension").collect()
    changes = {f"n{k}": k * 7919 % 1000 - 500.0 for k in range(n)}
    total = sum(changes.values())
    order = sorted(changes, key=lambda s: (-changes[s] if total >= 0 else changes[s], s))
    assert {r["segment"]: r["rank_in_dimension"] for r in got} == {s: i for i, s in enumerate(order, 1)}
    assert all(abs(r["contribution_share"] - changes[r["segment"]] / total) < 1e-9 for r in got)


def test_top_segments_without_ranking_the_rest(many):
    t, p, _ = many
    full, few = decompose(t, p, ["country", "device"]), decompose(t, p, ["country", "device"], top=3)
    assert plan_of(few).count("WindowGroupLimit") == 2
    assert rows(few) == rows(full.filter("rank_in_dimension <= 3"))
    assert rows(dimension_candidates(few, None, ["device", "country"])) == rows(dimension_candidates(full, None, ["device", "country"]))
    assert rows(leading_segment(few, "country")) == rows(leading_segment(full, "country"))


def test_candidates_are_ranked_without_a_global_window(spark):
    t = A.orders_tables(spark, "/root/testdata/sf0.001")
    from shiftscope.queries import ORDERS_PERIODS
    for df in (traffic_candidates(t, ORDERS_PERIODS), campaign_candidates(t, ORDERS_PERIODS, "cpc")):
        got = df.select("rank_within_dimension", "score").orderBy("rank_within_dimension").collect()
        assert [r[0] for r in got] == list(range(1, len(got) + 1)) and len(got) > 3
        assert [r[1] for r in got] == sorted((r[1] for r in got), reverse=True)
        assert all("windowspecdefinition(" not in x or "__part" in x or "__share" in x for x in plan_of(df).splitlines())
