"""Campaign-attribution completeness."""

from __future__ import annotations

import datetime as dt
from typing import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftscope.functions.expr import clamp, evidence_id, pct_change, safe_ratio
from shiftscope.functions.scope import scope_identity
from shiftscope.operators.compare import compare_long, single_period, widen
from shiftscope.operators.facts import UNATTRIBUTED, scoped_sessions
from shiftscope.periods import Periods
from shiftscope.tables import MarketingTables

ATTRIBUTION_METRICS = ("sessions", "attributed_sessions", "unattributed_sessions",
                       "attribution_completeness")


def attribution_per_period(t: MarketingTables, periods: Periods,
                           scope: Mapping[str, str] | None = None) -> DataFrame:
    """Attribution is about a NULL session ``campaign_id``, not a missing campaign row."""
    s = scoped_sessions(t, periods, scope, label="all")
    agg = s.groupBy("period").agg(
        F.count(F.lit(1)).cast("double").alias("sessions"),
        F.count_if(F.col("campaign_id").isNotNull()).cast("double").alias("attributed_sessions"),
        F.count_if(F.col("campaign_id").isNull()).cast("double").alias("unattributed_sessions"))
    return agg.withColumn("attribution_completeness",
                          safe_ratio("attributed_sessions", "sessions"))


def period_attribution_metrics(t: MarketingTables, start: dt.date, end: dt.date,
                               scope: Mapping[str, str] | None = None) -> DataFrame:
    p = Periods.of(start, end, start, end)
    return single_period(attribution_per_period(t, p, scope), ATTRIBUTION_METRICS)


def attribution_compare(t: MarketingTables, periods: Periods,
                        scope: Mapping[str, str] | None = None) -> DataFrame:
    wide = widen(attribution_per_period(t, periods, scope), ATTRIBUTION_METRICS)
    return compare_long(wide, ATTRIBUTION_METRICS, "att_", "attribution_kpi", periods,
                        scope_identity(scope))


def attribution_driver(t: MarketingTables, periods: Periods,
                       scope: Mapping[str, str] | None = None) -> DataFrame:
    """The single driver row (campaign=Unattributed); present even when things improved."""
    wide = widen(attribution_per_period(t, periods, scope), ATTRIBUTION_METRICS)
    cur, prev = F.col("cur_unattributed_sessions"), F.col("prev_unattributed_sessions")
    pct = pct_change(cur, prev)
    return wide.select(
        evidence_id("atd_", "attribution_driver", "campaign", UNATTRIBUTED,
                    *periods.key_parts(), scope_identity(scope)).alias("evidence_id"),
        F.lit("dimension_driver").alias("candidate_type"),
        F.lit("campaign").alias("dimension"), F.lit(UNATTRIBUTED).alias("segment"),
        clamp(F.abs(F.coalesce(pct, F.lit(0.0))), 0.0, 1.0).alias("score"),
        F.lit(1).alias("rank_within_dimension"),
        F.lit("unattributed_sessions").alias("metric"),
        cur.alias("current"), prev.alias("previous"),
        (cur - prev).alias("absolute_change"), pct.alias("percent_change"))
