"""Session facts (S4, J1-J3) and the scoped, period-labelled session frame.

The reference counts ``DISTINCT`` sessions, conversions and users over sessions left
joined to conversions (a fan-out).  At scale we pre-aggregate conversions to one row
per session (or per session and product), join 1:1, and then count rows and sum
conversion counts.  This equals the distinct counts because ``session_id`` and
``conversion_id`` are keys (audited by ``constraint_audit``) and avoids the ``Expand``
that several distinct aggregates produce.  Only ``users`` stays a distinct count.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftscope.functions.expr import money_sum
from shiftscope.functions.scope import SESSION_SCOPE, scope_predicate
from shiftscope.periods import Periods
from shiftscope.tables import MarketingTables

UNATTRIBUTED = "Unattributed"
NO_PURCHASE = "No purchase"


def session_facts(t: MarketingTables) -> DataFrame:
    """Sessions left-joined to conversions, revenue/discount defaulted, ``converted`` flag."""
    conv = t.conversions.select("session_id", "conversion_id", "product_id",
                                F.col("revenue").alias("_rev"), F.col("discount").alias("_disc"))
    return (t.sessions.join(conv, "session_id", "left")
            .withColumn("revenue", F.coalesce("_rev", F.lit(0.0)))
            .withColumn("discount", F.coalesce("_disc", F.lit(0.0)))
            .withColumn("converted", F.when(F.col("conversion_id").isNull(), 0).otherwise(1))
            .drop("_rev", "_disc"))


def scoped_sessions(t: MarketingTables, periods: Periods, scope: Mapping[str, str] | None,
                    *, label: str = "first", need_campaign: bool = False,
                    extra_dims: Mapping[str, str] | None = None) -> DataFrame:
    """Sessions of either period, joined to customers (inner) and campaigns (left, only
    when a campaign column is used), filtered by the session scope, with a ``period``.

    ``label="first"`` gives each row its first matching period (P7); ``label="all"``
    emits one row per matching period (a row in overlapping periods counts in both).
    Output dimension columns: country, device, channel, campaign (if joined),
    customer_segment, landing_page.
    """
    scope = dict(scope or {})
    scope_predicate(scope, SESSION_SCOPE, "Session analysis")  # validates keys
    need_campaign = need_campaign or scope.get("campaign") is not None
    sessions = t.sessions
    if "day" in sessions.columns:
        # day-partitioned storage: the same half-open bounds on the date prune partitions
        sessions = sessions.filter(periods.in_either("day", as_date=True))
    s = (sessions.filter(periods.in_either("timestamp"))
         .select("session_id", "customer_id", "timestamp", "device", "country",
                 F.col("traffic_source").alias("channel"), "campaign_id", "landing_page"))
    s = s.join(t.customers.select("customer_id", "customer_segment"), "customer_id", "inner")
    if need_campaign:
        camp = t.campaigns.select("campaign_id", "campaign_name")
        s = (s.join(camp, "campaign_id", "left")
             .withColumn("campaign", F.coalesce("campaign_name", F.lit(UNATTRIBUTED)))
             .drop("campaign_name"))
    s = s.filter(scope_predicate(scope, SESSION_SCOPE))
    if label == "first":
        return s.withColumn("period", periods.first_match_label("timestamp"))
    return s.withColumn("period", F.explode(periods.all_labels("timestamp")))


def of_session_days(facts: DataFrame, periods: Periods | None) -> DataFrame:
    """Facts of sessions in either period, where they are stored with their session's day (``session_day``):
    the bounds prune partitions.  Other facts are returned whole; the join with the sessions decides."""
    if periods is None or "session_day" not in facts.columns:
        return facts
    return facts.filter(periods.in_either("session_day", as_date=True))


def conversions_per_session(t: MarketingTables, by_product: bool = False, periods: Periods | None = None) -> DataFrame:
    keys = ["session_id"] + (["product_id"] if by_product else [])
    return (of_session_days(t.conversions, periods).groupBy(*keys)
            .agg(F.count("conversion_id").alias("n_conv"), money_sum("revenue").alias("conv_revenue")))


def with_conversions(sessions: DataFrame, t: MarketingTables, by_product: bool = False,
                     periods: Periods | None = None) -> DataFrame:
    """Attach per-session (or per session-and-product) conversion counts and revenue.

    ``periods`` are those the sessions were chosen by."""
    joined = sessions.join(conversions_per_session(t, by_product, periods), "session_id", "left")
    joined = (joined.withColumn("n_conv", F.coalesce("n_conv", F.lit(0)).cast("bigint"))
              .withColumn("conv_revenue", F.coalesce("conv_revenue", F.lit(0.0))))
    if by_product:
        joined = joined.withColumn("product", F.coalesce("product_id", F.lit(NO_PURCHASE)))
    return joined
