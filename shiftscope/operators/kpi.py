"""Revenue and conversion KPIs per period (G1) and their comparison."""

from __future__ import annotations

import datetime as dt
from typing import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftscope.functions.expr import money_sum, safe_ratio
from shiftscope.functions.scope import scope_identity
from shiftscope.operators.compare import compare_long, single_period, widen
from shiftscope.operators.facts import scoped_sessions, with_conversions
from shiftscope.periods import Periods
from shiftscope.tables import MarketingTables

KPI_METRICS = ("sessions", "conversions", "revenue", "users", "conversion_rate",
               "average_order_value", "revenue_per_session")


def kpis_per_period(t: MarketingTables, periods: Periods,
                    scope: Mapping[str, str] | None = None) -> DataFrame:
    """G1 for both periods at once: one row per period that has sessions.

    A session in both (overlapping) periods counts in both, as two separate period
    queries would.  ``users`` is the only distinct count left (see ``facts``).
    """
    g = with_conversions(scoped_sessions(t, periods, scope, label="all"), t, periods=periods)
    agg = g.groupBy("period").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.coalesce(F.sum("n_conv"), F.lit(0)).cast("bigint").alias("conversions"),
        F.coalesce(money_sum("conv_revenue"), F.lit(0.0)).alias("revenue"),
        F.count_distinct("customer_id").alias("users"))
    return agg.select(
        "period", "sessions", "conversions", "revenue", "users",
        safe_ratio("conversions", "sessions").alias("conversion_rate"),
        safe_ratio("revenue", "conversions").alias("average_order_value"),
        safe_ratio("revenue", "sessions").alias("revenue_per_session"))


def period_kpis(t: MarketingTables, start: dt.date, end: dt.date,
                scope: Mapping[str, str] | None = None) -> DataFrame:
    """G1 for one half-open period: one row, zeros when the period is empty."""
    p = Periods.of(start, end, start, end)
    return single_period(kpis_per_period(t, p, scope), KPI_METRICS)


def compare_periods(t: MarketingTables, periods: Periods,
                    scope: Mapping[str, str] | None = None) -> DataFrame:
    """Current, previous, absolute and percent change per KPI, with ``kpi_`` ids."""
    wide = widen(kpis_per_period(t, periods, scope), KPI_METRICS)
    return compare_long(wide, KPI_METRICS, "kpi_", "kpi", periods, scope_identity(scope))
