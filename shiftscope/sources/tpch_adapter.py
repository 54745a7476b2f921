"""Adapter from the driver's TPC-H-like parquet tables to the logical marketing tables.

It only renames, casts and groups rows into the logical schemas; it does none of an
analysis's work.  Two session mappings share one schema, so operators cannot tell
which one they read:

* the **orders mapping** (sessions from ``orders``, conversions from returned
  ``lineitem`` rows) serves KPI, decomposition, traffic and attribution jobs;
* the **events mapping** (sessions, conversions and funnel events all from ``events``)
  is self-consistent and serves the funnel and root-cause jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftscope.session import sf_path
from shiftscope.tables import MarketingTables

# Fixed values of the stand-in inputs (used only to give rows the logical schema).
EVENT_DEVICES = ("Android", "iOS", "Desktop")          # by user_id % 3
REVIEW_EPOCH = "2024-01-01"                             # review day = epoch + doc_id % 28
REGISTRY_EPOCH = "2000-01-01"                           # incident/anomaly day = epoch + doc_id % 366
EXPOSURE_EPOCH = "2000-07-01"                           # exposure day = epoch + custkey % 181
EXPERIMENT_ORDERS_FROM = "2000-01-01"                   # orders counted as experiment outcomes
REGISTRY_METRICS = ("revenue", "sessions", "cpc", "attribution_completeness",
                    "negative_review_rate", "conversion_rate", "checkout_completion_rate")
REGISTRY_DIMENSIONS = ("device=F", "channel=1-URGENT", "channel=ASIA", "country=GERMANY",
                       "device=O", "device=de")
REGISTRY_SEVERITIES = ("high", "medium", "low", "positive")


class Raw:
    """Readers of the driver's parquet tables, one DataFrame per table (footers read once)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        # one reader per table and session: file listing and footers are read once
        self.spark, self.sf_dir = spark, sf_dir
        self._cache = spark.__dict__.setdefault("_shiftscope_readers", {}).setdefault(sf_dir, {})

    def __getattr__(self, table: str) -> DataFrame:
        if table.startswith("_"):
            raise AttributeError(table)
        if table not in self._cache:
            self._cache[table] = self.spark.read.parquet(sf_path(self.sf_dir, table))
        return self._cache[table]


def _s(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _pick(values: tuple[str, ...], index: F.Column) -> F.Column:
    return F.try_element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def customers(raw: Raw) -> DataFrame:
    c, n = raw.customer, raw.nation
    return (c.join(n, c.c_nationkey == n.n_nationkey, "left")
            .select(_s("c_custkey").alias("customer_id"),
                    F.col("n_name").alias("country"),
                    F.col("c_mktsegment").alias("customer_segment")))


def campaigns(raw: Raw) -> DataFrame:
    s, n, r = raw.supplier, raw.nation, raw.region
    return (s.join(n, s.s_nationkey == n.n_nationkey, "left")
            .join(r, F.col("n_regionkey") == r.r_regionkey, "left")
            .select(_s("s_suppkey").alias("campaign_id"),
                    F.col("s_name").alias("campaign_name"),
                    F.col("r_name").alias("channel")))


def _customer_country(raw: Raw) -> DataFrame:
    """Country per customer key.  Keyed by an aggregate (``c_custkey`` is the customer
    key, so ``min`` is the lookup) so that Catalyst can drop the join from every plan
    that prunes ``country``."""
    c, n = raw.customer, raw.nation
    return (c.join(n, c.c_nationkey == n.n_nationkey, "left")
            .groupBy(F.col("c_custkey").alias("_ck")).agg(F.min("n_name").alias("country")))


# --- orders mapping ----------------------------------------------------------------
def orders_sessions(raw: Raw) -> DataFrame:
    first_line = (raw.lineitem.filter(F.col("l_linenumber") == 1)
                  .groupBy("l_orderkey").agg(F.min("l_suppkey").alias("_supp")))
    o = raw.orders
    return (o.join(first_line, o.o_orderkey == first_line.l_orderkey, "left")
            .join(_customer_country(raw), o.o_custkey == F.col("_ck"), "left")
            .select(_s("o_orderkey").alias("session_id"),
                    _s("o_custkey").alias("customer_id"),
                    F.col("o_orderdate").alias("timestamp"),
                    F.col("o_orderstatus").alias("device"),
                    F.col("country"),
                    F.col("o_orderpriority").alias("traffic_source"),
                    _s("_supp").alias("campaign_id"),
                    F.concat(F.lit("/lp"), _s(F.col("o_orderkey") % 4)).alias("landing_page")))


def orders_conversions(raw: Raw) -> DataFrame:
    li, p = raw.lineitem, raw.part
    returned = (li.filter(F.col("l_returnflag") == "R")
                .join(p, li.l_partkey == p.p_partkey, "left"))
    return (returned.groupBy("l_orderkey", "l_linenumber")
            .agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
                 F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("discount"),
                 F.min("p_type").alias("product_id"),
                 F.min("l_shipdate").alias("timestamp"))
            .select(_s(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("conversion_id"),
                    _s("l_orderkey").alias("session_id"),
                    "timestamp", "product_id", "revenue", "discount"))


def daily_campaign_metrics(raw: Raw) -> DataFrame:
    li = raw.lineitem
    return (li.groupBy(F.to_date("l_shipdate").alias("date"), F.col("l_suppkey"))
            .agg(F.sum("l_quantity").cast("bigint").alias("impressions"),
                 F.count(F.lit(1)).alias("clicks"),
                 F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("spend"),
                 F.count_if(F.col("l_returnflag") == "R").alias("conversions"),
                 F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
            .select("date", _s("l_suppkey").alias("campaign_id"), "impressions", "clicks",
                    "spend", "conversions", "revenue"))


def app_reviews(raw: Raw) -> DataFrame:
    d, lab = raw.documents, raw.labels
    rating = (F.when((F.col("quality") == 0) & (F.col("toxic") == 1), 1)
              .when(F.col("quality") == 0, 2).when(F.col("toxic") == 1, 4).otherwise(5))
    day = F.date_add(F.lit(REVIEW_EPOCH).cast("date"), (F.col("d_id") % 28).cast("int"))
    return (d.withColumnRenamed("doc_id", "d_id")
            .join(lab, F.col("d_id") == lab.doc_id, "inner")
            .select(_s("d_id").alias("review_id"),
                    day.cast("timestamp_ntz").alias("timestamp"),
                    rating.cast("int").alias("rating"),
                    F.col("text").alias("review_text"),
                    F.col("lang").alias("device"),
                    F.col("source").alias("country")))


def experiments(raw: Raw) -> DataFrame:
    c, o = raw.customer, raw.orders
    outcome = (o.filter((F.col("o_orderstatus") == "F")
                        & (F.col("o_orderdate") >= F.lit(EXPERIMENT_ORDERS_FROM).cast("timestamp_ntz")))
               .groupBy("o_custkey").agg(F.count(F.lit(1)).alias("_n"),
                                         F.sum("o_totalprice").alias("_rev")))
    return (c.join(outcome, c.c_custkey == outcome.o_custkey, "left")
            .select(F.concat(F.lit("exp_"), F.lower("c_mktsegment")).alias("experiment_id"),
                    F.col("c_mktsegment").alias("experiment_name"),
                    F.when(F.col("c_custkey") % 2 == 0, F.lit("treatment"))
                    .otherwise(F.lit("control")).alias("variant"),
                    _s("c_custkey").alias("customer_id"),
                    F.date_add(F.lit(EXPOSURE_EPOCH).cast("date"),
                               (F.col("c_custkey") % 181).cast("int")).alias("exposure_date"),
                    F.when(F.coalesce(F.col("_n"), F.lit(0)) > 0, 1).otherwise(0)
                    .cast("int").alias("conversion"),
                    F.coalesce(F.col("_rev"), F.lit(0.0)).alias("revenue")))


def marketing_incidents(raw: Raw) -> DataFrame:
    d, lab = raw.documents, raw.labels
    return (d.join(lab.filter(F.col("toxic") == 1).select(F.col("doc_id").alias("l_id"), "quality"),
                   F.col("doc_id") == F.col("l_id"), "inner")
            .select(F.concat(F.lit("d"), _s("doc_id")).alias("incident_id"),
                    F.date_add(F.lit(REGISTRY_EPOCH).cast("date"),
                               (F.col("doc_id") % 366).cast("int")).alias("incident_date"),
                    F.concat(F.lit("Incident in "), F.col("source")).alias("title"),
                    F.col("text").alias("description"),
                    _pick(REGISTRY_METRICS, F.col("doc_id") % len(REGISTRY_METRICS)).alias("affected_metric"),
                    F.col("source").alias("affected_channel"),
                    F.concat(F.col("lang"), F.lit(" "), F.col("source"), F.lit(" regression")).alias("root_cause"),
                    F.concat(F.lit("Roll back "), F.col("source")).alias("resolution"),
                    F.when(F.col("quality") == 0, F.lit("High")).otherwise(F.lit("Medium")).alias("impact")))


def anomaly_ground_truth(raw: Raw) -> DataFrame:
    d = raw.documents
    start = F.date_add(F.lit(REGISTRY_EPOCH).cast("date"), (F.col("doc_id") % 366).cast("int"))
    return d.select(
        F.concat(F.lit("scn_"), _s("doc_id")).alias("scenario_id"),
        start.alias("start_date"),
        F.date_add(start, (F.col("doc_id") % 15).cast("int")).alias("end_date"),
        _pick(REGISTRY_METRICS, F.col("doc_id") % len(REGISTRY_METRICS)).alias("affected_metric"),
        _pick(REGISTRY_DIMENSIONS, F.col("doc_id") % len(REGISTRY_DIMENSIONS)).alias("affected_dimension"),
        F.when(F.col("n_chars") % 2 == 0, F.lit("decrease")).otherwise(F.lit("increase")).alias("expected_direction"),
        F.concat(F.col("source"), F.lit(" "), F.col("lang"), F.lit(" anomaly")).alias("root_cause"),
        _pick(REGISTRY_SEVERITIES, F.col("doc_id") % len(REGISTRY_SEVERITIES)).alias("severity"))


def orders_tables(spark: SparkSession, sf_dir: str) -> MarketingTables:
    raw = Raw(spark, sf_dir)
    return MarketingTables(
        customers=lambda: customers(raw), campaigns=lambda: campaigns(raw),
        sessions=lambda: orders_sessions(raw), conversions=lambda: orders_conversions(raw),
        daily_campaign_metrics=lambda: daily_campaign_metrics(raw),
        app_reviews=lambda: app_reviews(raw), experiments=lambda: experiments(raw),
        marketing_incidents=lambda: marketing_incidents(raw),
        anomaly_ground_truth=lambda: anomaly_ground_truth(raw))


# --- events mapping ----------------------------------------------------------------
def _event_base(raw: Raw) -> DataFrame:
    e = raw.events
    return e.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.concat(_s("user_id"), F.lit("-"), _s(F.to_date("ts"))).alias("session_id"))


def events_sessions(raw: Raw) -> DataFrame:
    ev = _event_base(raw)
    first = (ev.groupBy("session_id", "user_id")
             .agg(F.min("ts").alias("timestamp"),
                  F.min("event_id").alias("_first"),
                  F.min_by("event_type", "event_id").alias("traffic_source"),
                  F.min_by("k", "event_id").alias("_k")))
    camp = F.col("_k") % 7
    return (first.join(_customer_country(raw), F.col("user_id") == F.col("_ck"), "left")
            .select("session_id", _s("user_id").alias("customer_id"), "timestamp",
                    _pick(EVENT_DEVICES, F.col("user_id") % 3).alias("device"),
                    "country", "traffic_source",
                    F.when(camp == 6, F.lit(None).cast("string")).otherwise(_s(camp)).alias("campaign_id"),
                    F.concat(F.lit("/lp"), _s(F.col("_first") % 4)).alias("landing_page")))


def events_conversions(raw: Raw) -> DataFrame:
    ev = _event_base(raw)
    return (ev.filter(F.col("event_type") == "purchase")
            .select(_s("event_id").alias("conversion_id"), "session_id",
                    _s("user_id").alias("customer_id"), F.col("ts").alias("timestamp"),
                    F.concat(F.lit("k"), _s(F.col("k") % 5)).alias("product_id"),
                    F.col("value").alias("revenue"), F.lit(0.0).alias("discount")))


def events_funnel(raw: Raw) -> DataFrame:
    ev = _event_base(raw)
    return ev.select(_s("user_id").alias("customer_id"), "session_id",
                     F.col("ts").alias("timestamp"), F.col("event_type").alias("event_name"))


def events_tables(spark: SparkSession, sf_dir: str) -> MarketingTables:
    raw = Raw(spark, sf_dir)
    return MarketingTables(
        customers=lambda: customers(raw), campaigns=lambda: campaigns(raw),
        sessions=lambda: events_sessions(raw), conversions=lambda: events_conversions(raw),
        funnel_events=lambda: events_funnel(raw), marketing_incidents=lambda: marketing_incidents(raw),
        anomaly_ground_truth=lambda: anomaly_ground_truth(raw))


def metric_definitions(raw: Raw) -> DataFrame:
    """Stand-in registry: the benchmark's items as metrics, their texts as definitions."""
    b = raw.benchmark
    return b.select(F.concat(F.lit("metric_"), _s("item_id")).alias("metric_name"), F.col("text").alias("definition"),
                    F.lit("count").alias("formula"), F.lit("session_id").alias("required_columns"), F.lit("device").alias("allowed_dimensions"),
                    F.lit("stand-in").alias("business_context"), F.concat(F.lit("team "), _s(F.col("item_id") % 3)).alias("owner"))


def all_tables(spark: SparkSession, sf_dir: str) -> MarketingTables:
    """All eleven logical tables: sessions and their facts of the events mapping, the others of the orders mapping."""
    raw = Raw(spark, sf_dir)
    return MarketingTables(
        customers=lambda: customers(raw), campaigns=lambda: campaigns(raw),
        sessions=lambda: events_sessions(raw), conversions=lambda: events_conversions(raw),
        funnel_events=lambda: events_funnel(raw), daily_campaign_metrics=lambda: daily_campaign_metrics(raw),
        app_reviews=lambda: app_reviews(raw), experiments=lambda: experiments(raw),
        marketing_incidents=lambda: marketing_incidents(raw), metric_definitions=lambda: metric_definitions(raw),
        anomaly_ground_truth=lambda: anomaly_ground_truth(raw))


def damaged_tables(spark: SparkSession, sf_dir: str) -> MarketingTables:
    """The eleven tables with violations of every kind: customers and campaigns that are missing, conversions and
    metrics that come twice, values that are NULL."""
    t = all_tables(spark, sf_dir)
    number = lambda c: F.regexp_extract(c, "([0-9]+)$", 1).cast("long")
    lost = lambda c, when: F.when(when, F.lit(None)).otherwise(F.col(c))
    repeated = lambda df, when: df.withColumn("_n", F.explode(F.when(when, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_n")
    changed = {
        "customers": lambda: t.customers.filter(number("customer_id") % 50 != 7).withColumn("customer_segment", lost("customer_segment", number("customer_id") % 30 == 0)),
        "campaigns": lambda: t.campaigns.filter(number("campaign_id") % 25 != 3),
        "conversions": lambda: repeated(t.conversions, number("conversion_id") % 40 == 1),
        "app_reviews": lambda: t.app_reviews.withColumn("rating", lost("rating", number("review_id") % 20 == 0)),
        "metric_definitions": lambda: repeated(t.metric_definitions, number("metric_name") % 9 == 0).withColumn("owner", lost("owner", number("metric_name") % 10 == 0)),
    }
    return MarketingTables(**{n: changed.get(n, lambda n=n: getattr(t, n)) for n in t.present()})


# --- requests and planner replies (table jobs) -------------------------------------
REQUEST_EPOCH = "2000-07-01"     # current_start = epoch + conv_id % 5
PERIOD_DAYS = 181


# Sentences that the stand-in requests and replies end with, so that they mention metrics and scope values.
ASKED = (
    "Why did revenue decline for Android in United States?", "Why did the conversion rate of the Brand_Search campaign fall?",
    "Why did organic sessions drop for Loyal customers?", "Did attribution completeness change on Google Ads?",
    "What changed in review sentiment on iOS?", "Did the Checkout reassurance copy experiment help High-Value customers?",
    "Why did CPC rise on Meta Ads?", "How was the weather?", "Why did revenue fall in India and Canada?", "Why did traffic of new customers fall?")


def _asked(number: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in ASKED]), (number % len(ASKED) + 1).cast("int"))


def requests(raw: Raw) -> DataFrame:
    """One investigation request per user turn of ``conversations``: the turn's whole text and a
    sentence of ``ASKED`` are the question; period bounds vary with the ids so that some requests are invalid."""
    c = raw.conversations.filter(F.col("role") == "user")
    cs = F.date_add(F.lit(REQUEST_EPOCH).cast("date"), (F.col("conv_id") % 5).cast("int"))
    pe = F.date_add(F.lit(REQUEST_EPOCH).cast("date"), (F.col("conv_id") % 7 - 3).cast("int"))
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("request_id"),
                    F.concat_ws(" ", "text", _asked(F.col("conv_id"))).alias("question"),
                    cs.alias("current_start"),
                    F.date_add(cs, (F.lit(PERIOD_DAYS) - F.col("turn") % 2).cast("int")).alias("current_end"),
                    F.date_add(pe, -PERIOD_DAYS).alias("previous_start"),
                    pe.alias("previous_end"))


def planner_replies(raw: Raw) -> DataFrame:
    """The assistant turn that follows each user turn (the second planner's text)."""
    c = raw.conversations
    users = c.filter(F.col("role") == "user").select("conv_id", "turn")
    replies = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return (users.join(replies, ["conv_id", "turn"], "left")
            .select(F.concat_ws("-", "conv_id", "turn").alias("request_id"),
                    F.concat_ws(" ", "reply", _asked(F.col("conv_id") + (F.col("conv_id") % 3 == 0).cast("int"))).alias("reply")))


def recorded_plans(plans: DataFrame) -> DataFrame:
    """Stand-in for recorded plans of a second planner: some change a date, name another tool or metric,
    use a placeholder or spell a value differently."""
    conv = F.split("request_id", "-")[0].cast("long")
    return plans.withColumns({
        "current_end": F.when(conv % 11 == 3, F.date_add("current_end", 1)).otherwise(F.col("current_end")),
        "tool": F.when(conv % 13 == 5, F.lit("run_traffic_investigation")).otherwise(F.col("tool")),
        "primary_metric": F.when(conv % 17 == 7, F.lit("ctr")).otherwise(F.col("primary_metric")),
        "country": F.when(conv % 7 == 1, F.coalesce("country", F.lit("any"))).otherwise(F.col("country")),
        "device": F.when(conv % 4 == 2, F.upper("device")).otherwise(F.col("device"))})


# Question type expected for an anomaly's affected metric.
EXPECTED_TYPE = {"revenue": "root_cause_analysis", "checkout_completion_rate": "root_cause_analysis",
                 "sessions": "traffic_analysis", "cpc": "campaign_performance_analysis",
                 "conversion_rate": "campaign_performance_analysis",
                 "attribution_completeness": "data_quality_analysis",
                 "negative_review_rate": "sentiment_analysis"}


def benchmark_cases(anomalies: DataFrame, investigations: dict[str, str]) -> DataFrame:
    """Benchmark cases whose expectations come from anomaly rows: the ``name=value``
    dimension is the expected driver, the root cause the expected incident text.  Each
    case is routed to the investigation that answers its expected question type
    (``investigations``: question type -> investigation id); other cases have none."""
    kv = F.split("affected_dimension", "=", 2)
    exp_type = F.try_element_at(F.create_map(*[x for k, v in EXPECTED_TYPE.items()
                                               for x in (F.lit(k), F.lit(v))]), F.col("affected_metric"))
    dim, seg = F.try_element_at(kv, F.lit(1)), F.try_element_at(kv, F.lit(2))
    return anomalies.select(
        F.col("scenario_id").alias("case_id"),
        F.try_element_at(F.create_map(*[x for k, v in investigations.items() for x in (F.lit(k), F.lit(v))]),
                         exp_type).alias("investigation_id"),
        exp_type.alias("expected_question_type"), dim.alias("expected_dimension"), seg.alias("expected_segment"),
        F.array(F.struct(dim.alias("dimension"), seg.alias("segment"))).alias("expected_top_drivers"),
        F.lit(None).cast("string").alias("expected_funnel_transition"),
        F.col("root_cause").alias("expected_root_cause_contains"))


def evaluation_tables(spark: SparkSession, sf_dir: str) -> MarketingTables:
    """The orders mapping with the events mapping's funnel events (whose sessions it does not have)."""
    t, raw = orders_tables(spark, sf_dir), Raw(spark, sf_dir)
    return MarketingTables(**{n: (lambda n=n: getattr(t, n)) for n in t.present()}, funnel_events=lambda: events_funnel(raw))


def family_cases(anomalies: DataFrame, investigations: dict[str, str]) -> DataFrame:
    """Cases that expect two drivers, the anomaly's own and another one, and a part of the root cause: its first words,
    two of its letters, or for every seventh a text that no cause has."""
    number = F.regexp_extract("scenario_id", "([0-9]+)$", 1).cast("long")
    other = _pick(REGISTRY_DIMENSIONS, F.floor(number / len(REGISTRY_DIMENSIONS)).cast("long") % len(REGISTRY_DIMENSIONS))
    driver = lambda c: F.struct(F.split(c, "=", 2)[0].alias("dimension"), F.split(c, "=", 2)[1].alias("segment"))
    part = (F.when(number % 7 == 3, F.lit("no such cause")).when(number % 5 == 1, F.substring("root_cause", 4, 2))
            .otherwise(F.upper(F.regexp_replace("root_cause", " anomaly$", ""))))
    cases = benchmark_cases(anomalies, investigations).drop("expected_top_drivers", "expected_root_cause_contains")
    more = anomalies.select(F.col("scenario_id").alias("case_id"), F.array_distinct(F.array(driver(F.col("affected_dimension")), driver(other))).alias("expected_top_drivers"),
                            part.alias("expected_root_cause_contains"))
    return cases.join(more, "case_id")
