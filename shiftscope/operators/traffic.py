"""Traffic analysis: sessions and users (G2, C8) and declining segments."""

from __future__ import annotations

import datetime as dt
from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftscope.functions.expr import clamp, evidence_id, pct_change, text_or_none
from shiftscope.functions.scope import scope_identity
from shiftscope.operators.compare import compare_long, single_period, widen
from shiftscope.operators.facts import scoped_sessions
from shiftscope.operators.ranking import ranked
from shiftscope.periods import Periods
from shiftscope.tables import MarketingTables

# Traffic dimensions in their ranking (insertion) order.
TRAFFIC_DIMENSIONS = ("channel", "device", "country", "landing_page")
TRAFFIC_METRICS = ("sessions", "users")


def traffic_per_period(t: MarketingTables, periods: Periods,
                       scope: Mapping[str, str] | None = None) -> DataFrame:
    s = scoped_sessions(t, periods, scope, label="all")
    return s.groupBy("period").agg(F.count(F.lit(1)).cast("double").alias("sessions"),
                                   F.count_distinct("customer_id").cast("double").alias("users"))


def period_traffic_kpis(t: MarketingTables, start: dt.date, end: dt.date,
                        scope: Mapping[str, str] | None = None) -> DataFrame:
    """Distinct sessions and users of one period."""
    p = Periods.of(start, end, start, end)
    return single_period(traffic_per_period(t, p, scope), TRAFFIC_METRICS)


def traffic_compare(t: MarketingTables, periods: Periods,
                    scope: Mapping[str, str] | None = None) -> DataFrame:
    wide = widen(traffic_per_period(t, periods, scope), TRAFFIC_METRICS)
    return compare_long(wide, TRAFFIC_METRICS, "trk_", "traffic_kpi", periods, scope_identity(scope))


def traffic_dimension_rows(t: MarketingTables, periods: Periods,
                           scope: Mapping[str, str] | None = None,
                           dimensions: Sequence[str] = TRAFFIC_DIMENSIONS) -> DataFrame:
    """G8 for all dimensions in one aggregation: per segment sessions in each period."""
    s = scoped_sessions(t, periods, scope, label="first")
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("segment"))
                      for d in dimensions])
    g = (s.select("period", F.inline(pairs))
         .groupBy("dimension", "segment")
         .agg(F.count_if(F.col("period") == "current").cast("bigint").alias("current"),
              F.count_if(F.col("period") == "previous").cast("bigint").alias("previous")))
    return g.select(
        evidence_id("trf_", "traffic_driver", F.col("dimension"), text_or_none("segment"),
                    *periods.key_parts(), scope_identity(scope)).alias("evidence_id"),
        "dimension", "segment", "current", "previous",
        (F.col("current") - F.col("previous")).alias("absolute_change"),
        pct_change("current", "previous").alias("percent_change"))


def traffic_candidates(t: MarketingTables, periods: Periods,
                       scope: Mapping[str, str] | None = None) -> DataFrame:
    """Declining segments across all four dimensions, one global rank by score."""
    scope = dict(scope or {})
    rows = traffic_dimension_rows(t, periods, scope).filter(F.col("absolute_change") < 0)
    score = clamp(F.abs(F.coalesce(F.col("percent_change"), F.lit(0.0))), 0.0, 1.0)
    for dim, value in scope.items():
        if dim in TRAFFIC_DIMENSIONS:
            score = F.when((F.col("dimension") == dim) & (F.col("segment") == value),
                           F.lit(1.0)).otherwise(score)
    dim_order = F.array_position(F.array(*[F.lit(d) for d in TRAFFIC_DIMENSIONS]), F.col("dimension"))
    order = [F.col("score").desc(), dim_order, F.col("segment").asc_nulls_first()]
    return (ranked(rows.withColumn("score", score), [], order, "rank_within_dimension")
            .select("evidence_id", F.lit("dimension_driver").alias("candidate_type"),
                    "dimension", "segment", "score", "rank_within_dimension",
                    F.lit("sessions").alias("metric"), "current", "previous",
                    "absolute_change", "percent_change"))
