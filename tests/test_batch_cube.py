"""Day cube and batch form, interval join, ranks and top-k: against single requests and brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shiftscope.operators.batch import batch_decompose, batch_incidents, batch_kpi_compare
from shiftscope.operators.day_cube import build_day_cube, read_day_cube
from shiftscope.operators.decompose import DIMENSIONS, decompose
from shiftscope.operators.incidents import incidents_scoped
from shiftscope.operators.intervals import overlap_join
from shiftscope.operators.kpi import compare_periods
from shiftscope.operators.ranking import ranked, top_k, with_group_total
from shiftscope.periods import Periods
from shiftscope.tables import MarketingTables

DAY0 = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def market(spark):
    """Random facts: a third of the sessions on one day and from one customer, NULL dimensions, several conversions a session."""
    rng = random.Random(4)
    customers = [(f"c{i}", rng.choice(["India", "Peru", None]), rng.choice(["New", "Loyal;x=y", None])) for i in range(30)]
    campaigns = [(f"k{i}", f"Camp {i}", "Search") for i in range(3)] + [("k9", None, "Mail")]
    sessions, conversions = [], []
    for i in range(700):
        hot = i % 3 == 0
        day = 20 if hot else rng.randrange(45)
        at = dt.datetime(2024, 1, 1) + dt.timedelta(days=day, seconds=rng.choice([0, 1, 43210, 86399]))
        cust = "c0" if hot else f"c{rng.randrange(32)}"
        sessions.append((f"s{i}", cust, at, rng.choice(["iOS", "Android", None]), rng.choice(["India", "Peru"]), rng.choice(["Ads", "Mail"]),
                         rng.choice(["k0", "k1", "k2", "k9", "kX", None]), "/"))
        for j in range(rng.choice([0, 0, 0, 1, 1, 3])):
            conversions.append((f"v{i}-{j}", f"s{i}", rng.choice(["p1", "p2", "p3", None]), rng.choice([10.0, 0.1, 99.99, None]), 0.0))
    return MarketingTables(
        customers=spark.createDataFrame(customers, "customer_id string, country string, customer_segment string"),
        campaigns=spark.createDataFrame(campaigns, "campaign_id string, campaign_name string, channel string"),
        sessions=spark.createDataFrame(sessions, "session_id string, customer_id string, timestamp timestamp_ntz, device string, country string, "
                                                 "traffic_source string, campaign_id string, landing_page string"),
        conversions=spark.createDataFrame(conversions, "conversion_id string, session_id string, product_id string, revenue double, discount double"))


CASES = [("a", (14, 28, 0, 14), None), ("b", (14, 28, 0, 14), {"device": "iOS"}), ("c", (10, 30, 5, 20), {"country": "Peru", "channel": "Ads"}),
         ("d", (14, 28, 0, 14), {"device": "iOS"}), ("e", (100, 110, 90, 100), {}), ("f", (20, 21, 0, 45), {"customer_segment": "Loyal;x=y"}),
         ("g", (20, 34, 6, 20), {"campaign": "Camp 1"}), ("h", (20, 34, 6, 20), {"campaign": "Unattributed", "device": "Android"})]


def periods(bounds):
    return Periods.of(*[DAY0 + dt.timedelta(days=x) for x in bounds])


@pytest.fixture(scope="module")
def requests(spark):
    rows = [(c, *[DAY0 + dt.timedelta(days=x) for x in b], s) for c, b, s in CASES]
    return spark.createDataFrame(rows, "case_id string, current_start date, current_end date, previous_start date, previous_end date, scope map<string,string>")


def table(df, *drop):
    def norm(v):
        return round(v, 6) + 0.0 if isinstance(v, float) else v
    cols = sorted(c for c in df.columns if c not in drop)
    return sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def test_batch_kpis_equal_single_requests(market, requests):
    got = batch_kpi_compare(market, requests).cache()
    for case, bounds, scope in CASES:
        want = table(compare_periods(market, periods(bounds), scope))
        assert table(got.filter(F.col("case_id") == case), "case_id") == want, case


def test_batch_decomposition_equals_single_requests(market, requests):
    got = batch_decompose(market, requests).cache()
    for case, bounds, scope in CASES:
        want = table(decompose(market, periods(bounds), DIMENSIONS, scope), "metric")
        assert table(got.filter(F.col("case_id") == case), "case_id") == want, case


def test_batch_reads_a_stored_cube_and_prunes_its_days(spark, market, requests, tmp_path):
    build_day_cube(market).write(str(tmp_path))
    cube = read_day_cube(spark, str(tmp_path))
    few = requests.filter("case_id IN ('b', 'c')")
    assert table(batch_kpi_compare(market, few, cube)) == table(batch_kpi_compare(market, few))
    df = batch_decompose(market, few, cube=cube)
    assert table(df) == table(batch_decompose(market, few))
    plan = batch_kpi_compare(market, few, cube)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("dynamicpruning") >= 2 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_batch_never_multiplies_sessions_by_requests(spark, market, requests):
    many = requests.crossJoin(spark.range(50).withColumnRenamed("id", "k")).select(
        F.concat_ws("-", "case_id", "k").alias("case_id"), "current_start", "current_end", "previous_start", "previous_end",
        "scope")
    got = batch_kpi_compare(market, many)
    assert got.count() == 50 * len(CASES) * 7


def test_batch_of_nothing(market, requests):
    assert batch_kpi_compare(market, requests.filter("false")).count() == 0
    assert batch_decompose(market, requests.filter("false")).count() == 0
    with pytest.raises(ValueError):
        batch_decompose(market, requests, ["planet"])


@pytest.fixture(scope="module")
def anomalies(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        start = DAY0 + dt.timedelta(days=rng.randint(-400, 60))
        length = rng.choice([0, 0, 1, 2, 7, 30, 400, 5000, -3])
        rows.append((f"x{i}", start, start + dt.timedelta(days=length), rng.choice(["device=iOS", "country=Peru", "channel=Ads", "campaign=Camp 1", "other=1"]),
                     "revenue", "cause", "high"))
    rows += [("open", DAY0, dt.date(9999, 12, 31), "device=iOS", "revenue", "c", "low"), ("old", dt.date(1, 1, 1), DAY0, "device=iOS", "revenue", "c", "low"),
             ("nul", None, DAY0, "device=iOS", "revenue", "c", "low"), ("nul2", DAY0, None, "device=iOS", "revenue", "c", "low")]
    return spark.createDataFrame(rows, "scenario_id string, start_date date, end_date date, affected_dimension string, affected_metric string, "
                                       "root_cause string, severity string")


def test_batch_incidents_equal_single_requests(anomalies, requests):
    got = batch_incidents(anomalies, requests).cache()
    for case, bounds, scope in CASES:
        want = table(incidents_scoped(anomalies, periods(bounds), scope))
        assert table(got.filter(F.col("case_id") == case), "case_id") == want, case
    plan = batch_incidents(anomalies, requests)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("seed", [1, 2])
def test_overlap_join_gives_every_pair_once(spark, seed):
    rng = random.Random(seed)

    def intervals(n, name):
        rows = []
        for i in range(n):
            lo = rng.choice([rng.randint(-40, 40), rng.randint(-100000, 100000)])
            rows.append((f"{name}{i}", rng.choice("ab"), lo, lo + rng.choice([0, 1, 2, 3, 4, 7, 8, 9, 63, 64, 65, 1000, 90000])))
        return rows
    left, right = intervals(120, "l"), intervals(150, "r")
    as_df = lambda rows, n: spark.createDataFrame(rows, f"{n} string, g string, {n}_lo int, {n}_hi int").select(
        n, "g", F.date_from_unix_date(f"{n}_lo").alias(f"{n}_lo"), F.date_from_unix_date(f"{n}_hi").alias(f"{n}_hi"))
    for on in ([], ["g"]):
        lhs, rhs = as_df(left, "l"), as_df(right, "r")
        if not on:
            rhs = rhs.withColumnRenamed("g", "h")
        got = [(r["l"], r["r"]) for r in overlap_join(lhs, rhs, ("l_lo", "l_hi"), ("r_lo", "r_hi"), on).collect()]
        want = sorted((a[0], b[0]) for a in left for b in right if a[2] <= b[3] and b[2] <= a[3] and (not on or a[1] == b[1]))
        assert sorted(got) == want and want
    with pytest.raises(ValueError):
        overlap_join(as_df(left, "l"), as_df(right, "r"), ("l_lo", "l_hi"), ("r_lo", "r_hi"))


def test_ranks_of_a_large_group(spark):
    rows = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.when(F.col("id") % 3 == 1, "a").otherwise("b")).alias("g"),
                                       (F.col("id") % 7).alias("v"), F.col("id").alias("k"))
    out = ranked(rows, ["g"], [F.desc("v"), F.asc("k")], "place")
    plan = out._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in out.collect():
        got.setdefault(r["g"], []).append((r["place"], -r["v"], r["k"]))
    assert set(got) == {None, "a", "b"}
    for places in got.values():
        places.sort()
        assert [p for p, _, _ in places] == list(range(1, len(places) + 1))
        assert [x[1:] for x in places] == sorted(x[1:] for x in places)
    # windows: over shares (a row per group and partition) and over one partition's part of a group
    windows = [line for line in plan.split("\n") if "windowspecdefinition(" in line and "row_number" in line]
    assert windows and all("__part" in w for w in windows)
    assert ranked(rows.filter("false"), ["g"], [F.asc("k")], "place").count() == 0
    alone = ranked(rows, [], [F.desc("v"), F.asc("k")], "place").agg(F.min("place"), F.max("place"), F.count_distinct("place")).first()
    assert tuple(alone) == (1, 100_000, 100_000)


def test_group_total_keeps_null_groups(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 5)], "g string, v int")
    assert sorted((r["g"] or "", r["v"], r["t"]) for r in with_group_total(rows, ["g"], F.sum("v"), "t").collect()) == [("", 1, 3), ("", 2, 3), ("a", 5, 5)]


def test_top_k_is_limited_before_the_shuffle(spark):
    rows = spark.range(10_000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    out = top_k(rows, ["g"], [F.desc("v")], 3, "place")
    assert out._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
    assert sorted((r["g"], r["place"], r["v"]) for r in out.collect()) == [
        (g, p, v) for g in range(3) for p, v in enumerate(sorted((x for x in range(10_000) if x % 3 == g), reverse=True)[:3], 1)]


def test_a_cube_reads_its_sources_once(spark, market, tmp_path):
    names = ("customers", "campaigns", "sessions", "conversions")
    for n in names:
        getattr(market, n).write.parquet(str(tmp_path / n))
    cube = build_day_cube(MarketingTables(**{n: spark.read.parquet(str(tmp_path / n)) for n in names}), with_users=False)
    s = {r["session_id"]: r for r in market.sessions.collect()}
    known = {r["customer_id"] for r in market.customers.collect()}
    sold = [r for r in market.conversions.collect() if s[r["session_id"]]["customer_id"] in known]
    at = cube.products.filter("product <> 'No purchase'").agg(F.sum("conversions"), F.sum("sessions")).first()
    assert tuple(at) == (len(sold) - sum(r["product_id"] is None for r in sold), len({(r["session_id"], r["product_id"]) for r in sold if r["product_id"]}))
    assert cube.cells.agg(F.sum("sessions"), F.sum("conversions")).first() == (sum(r["customer_id"] in known for r in s.values()), len(sold))
    # every part of the cube comes from the stored sessions and conversions
    assert not [f for part in (cube.cells, cube.products) for f in part.inputFiles() if str(tmp_path) in f]
