"""Campaign performance: KPIs from daily campaign metrics.

Driver segments of all dimensions come from one scan: a grouped aggregate with conditional sums per
period, in which a segment is listed if it has a row in the span of both periods.
"""

from __future__ import annotations

import datetime as dt
from typing import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftscope.functions.expr import clamp, evidence_id, money_sum_sql, pct_change, safe_ratio
from shiftscope.functions.scope import CAMPAIGN_SCOPE, check_scope, scope_identity, scope_predicate
from shiftscope.operators.ranking import ranked
from shiftscope.operators.compare import compare_long, single_period, widen
from shiftscope.periods import Periods
from shiftscope.tables import MarketingTables

BASE_MEASURES = ("impressions", "clicks", "spend", "conversions", "revenue")
CAMPAIGN_METRICS = BASE_MEASURES + ("ctr", "cpc", "cpa", "roas", "conversion_rate")
SEGMENT_COLUMN = {"channel": "channel", "campaign": "campaign_name"}
MONEY_MEASURES = ("spend", "revenue")


def _sum(expr: str, measure: str | None = None) -> str:
    """Counts sum exactly; money is summed as a decimal (see ``expr.money_sum``)."""
    measure = measure or expr
    return money_sum_sql(expr) if measure in MONEY_MEASURES else f"sum({expr})"


def _ratios(prefix: str = "") -> dict:
    c = lambda m: F.col(prefix + m)
    return {
        "ctr": safe_ratio(c("clicks"), c("impressions")),
        "cpc": safe_ratio(c("spend"), c("clicks")),
        "cpa": safe_ratio(c("spend"), c("conversions")),
        "roas": safe_ratio(c("revenue"), c("spend")),
        "conversion_rate": safe_ratio(c("conversions"), c("clicks")),
    }


def daily_with_campaign(t: MarketingTables) -> DataFrame:
    """Daily metrics joined to their campaign's channel and name."""
    camp = t.campaigns.select("campaign_id", "channel", "campaign_name")
    return t.daily_campaign_metrics.join(camp, "campaign_id", "inner")


def _campaign_columns():
    return {"channel": F.col("channel"), "campaign": F.col("campaign_name")}


def campaign_per_period(t: MarketingTables, periods: Periods,
                        scope: Mapping[str, str] | None = None) -> DataFrame:
    """G5 for both periods: sums of the base measures, ratios as ratio of sums."""
    pred = scope_predicate(scope, CAMPAIGN_SCOPE, "Campaign analysis", _campaign_columns())
    d = (daily_with_campaign(t).filter(periods.in_either("date", as_date=True) & pred)
         .withColumn("period", F.explode(periods.all_labels("date", as_date=True))))
    agg = d.groupBy("period").agg(*[F.expr(f"CAST(coalesce({_sum(m)}, 0) AS DOUBLE)").alias(m)
                                    for m in BASE_MEASURES])
    return agg.select("period", *BASE_MEASURES, *[v.alias(k) for k, v in _ratios().items()])


def period_campaign_kpis(t: MarketingTables, start: dt.date, end: dt.date,
                         scope: Mapping[str, str] | None = None) -> DataFrame:
    p = Periods.of(start, end, start, end)
    return single_period(campaign_per_period(t, p, scope), CAMPAIGN_METRICS)


def campaign_compare(t: MarketingTables, periods: Periods,
                     scope: Mapping[str, str] | None = None) -> DataFrame:
    wide = widen(campaign_per_period(t, periods, scope), CAMPAIGN_METRICS)
    return compare_long(wide, CAMPAIGN_METRICS, "cmp_", "campaign_kpi", periods, scope_identity(scope))


def campaign_segments(t: MarketingTables, periods: Periods, dimension: str) -> DataFrame:
    """Distinct segments over ``[previous_start, current_end)`` (gap included, scope ignored)."""
    span = Periods.in_range("date", periods.previous_start, periods.current_end, as_date=True)
    return (daily_with_campaign(t).filter(span)
            .select(F.col(SEGMENT_COLUMN[dimension]).alias("segment")).distinct())


def campaign_candidates(t: MarketingTables, periods: Periods, metric: str,
                        scope: Mapping[str, str] | None = None) -> DataFrame:
    """C7 drivers: each segment *replaces* the scope value of its dimension (other filters
    stay); rises and falls are both kept; one global rank by score."""
    scope = check_scope(scope, CAMPAIGN_SCOPE, "Campaign analysis")
    if metric not in CAMPAIGN_METRICS:
        raise ValueError(f"unknown campaign metric {metric!r}")
    dimensions = [next(iter(scope))] if scope else ["channel", "campaign"]
    sid = scope_identity(scope)
    # only a single dimension has other filters, so one scan serves every dimension
    others = {k: v for k, v in scope.items() if k not in dimensions}
    pred = scope_predicate(others, CAMPAIGN_SCOPE, "Campaign analysis", _campaign_columns())
    span = Periods.in_range("date", periods.previous_start, periods.current_end, as_date=True)
    d = (daily_with_campaign(t).filter(periods.in_either("date", as_date=True) | span)
         .select("*", span.alias("_span"), (periods.in_current("date", as_date=True) & pred).alias("_cur"),
                 (periods.in_previous("date", as_date=True) & pred).alias("_prev")))
    pairs = F.array(*[F.struct(F.lit(x).alias("dimension"), F.col(SEGMENT_COLUMN[x]).alias("segment")) for x in dimensions])
    sums = [F.expr(f"CAST(coalesce({_sum(f'CASE WHEN {side} THEN {m} END', m)}, 0) AS DOUBLE)").alias(pre + m)
            for m in BASE_MEASURES for side, pre in (("_cur", "c_"), ("_prev", "p_"))]
    # a segment counts if it has a row in the span, whatever the scope
    per_seg = (d.select("_span", "_cur", "_prev", *BASE_MEASURES, F.inline(pairs)).groupBy("dimension", "segment")
               .agg(F.bool_or("_span").alias("_in_span"), *sums).filter("_in_span"))

    def value(prefix):
        return _ratios(prefix)[metric] if metric in _ratios() else F.col(prefix + metric)
    cur_v, prev_v = value("c_"), value("p_")
    pct = pct_change(cur_v, prev_v)
    score = clamp(F.abs(F.coalesce(pct, F.lit(0.0))), 0.0, 1.0)
    for dim in dimensions:
        if scope.get(dim) is not None:
            score = F.when(F.col("segment") == F.lit(scope[dim]), F.lit(1.0)).otherwise(score)
    out = per_seg.select(
        evidence_id("drv_", "campaign_driver", metric, F.col("dimension"), F.col("segment"),
                    *periods.key_parts(), sid).alias("evidence_id"),
        F.lit("dimension_driver").alias("candidate_type"), "dimension", "segment", score.alias("score"),
        F.lit(metric).alias("metric"), cur_v.alias("current"), prev_v.alias("previous"),
        (cur_v - prev_v).alias("absolute_change"), pct.alias("percent_change"))
    place = F.array_position(F.array(*[F.lit(x) for x in dimensions]), F.col("dimension"))
    return ranked(out, [], [F.col("score").desc(), place, F.col("segment").asc_nulls_first()], "rank_within_dimension")
