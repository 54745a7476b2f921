"""Dimension decomposition of a revenue change (C2: G7, G13, T1, F4, W1).

All requested dimensions are answered by **one** aggregation: each session row is
``stack``-ed into one (dimension, segment) row per dimension, then grouped once with
per-period conditional sums.  Partial aggregation runs map-side, so a hot segment is
combined before the shuffle.  ``product`` needs the (session, product) grain and is
unioned in from its own pre-aggregate.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftscope.functions.expr import MONEY_TYPE, C, evidence_id, money_sum_sql
from shiftscope.functions.scope import scope_identity
from shiftscope.functions.stats import with_two_proportion_test
from shiftscope.operators.facts import scoped_sessions, with_conversions
from shiftscope.operators.ranking import ranked, top_k, with_group_total
from shiftscope.periods import Periods
from shiftscope.session import cut_lineage
from shiftscope.tables import MarketingTables

# Approved decomposition dimensions.
DIMENSIONS = ("device", "country", "channel", "campaign", "customer_segment", "product")


def segment_period_totals(t: MarketingTables, periods: Periods, dimensions: Sequence[str],
                          scope: Mapping[str, str] | None = None) -> DataFrame:
    """Per (dimension, segment) sessions, conversions and revenue of both periods,
    0 where a segment is missing from one side."""
    unknown = [d for d in dimensions if d not in DIMENSIONS]
    if unknown:
        raise ValueError(f"cannot decompose by {', '.join(unknown)}: the dimensions are {', '.join(DIMENSIONS)}")
    facts = scoped_sessions(t, periods, scope, label="first",
                            need_campaign="campaign" in dimensions)
    pieces = []
    plain = [d for d in dimensions if d != "product"]
    if plain:
        g = with_conversions(facts, t, periods=periods)
        pairs = ", ".join(f"named_struct('dimension', '{d}', 'segment', CAST(`{d}` AS STRING))"
                          for d in plain)
        pieces.append(g.selectExpr("period", "n_conv", "conv_revenue", f"inline(array({pairs}))"))
    if "product" in dimensions:
        g = with_conversions(facts, t, by_product=True, periods=periods)
        pieces.append(g.selectExpr("period", "n_conv", "conv_revenue", "'product' AS dimension",
                                   "product AS segment"))
    rows = pieces[0]
    for p in pieces[1:]:
        rows = rows.unionByName(p)
    aggs = {
        "current_sessions": "CAST(count_if(period = 'current') AS BIGINT)",
        "previous_sessions": "CAST(count_if(period = 'previous') AS BIGINT)",
        "current_conversions": "CAST(coalesce(sum(CASE WHEN period = 'current' THEN n_conv END), 0) AS BIGINT)",
        "previous_conversions": "CAST(coalesce(sum(CASE WHEN period = 'previous' THEN n_conv END), 0) AS BIGINT)",
        "current_revenue": f"coalesce({money_sum_sql("CASE WHEN period = 'current' THEN conv_revenue END")}, 0.0)",
        "previous_revenue": f"coalesce({money_sum_sql("CASE WHEN period = 'previous' THEN conv_revenue END")}, 0.0)",
    }
    return rows.groupBy("dimension", "segment").agg(*[F.expr(v).alias(k) for k, v in aggs.items()])


def decompose(t: MarketingTables, periods: Periods, dimensions: Sequence[str] = DIMENSIONS,
              scope: Mapping[str, str] | None = None, top: int | None = None) -> DataFrame:
    """C2 for several dimensions at once: DimensionEvidence rows plus ``rank_in_dimension``
    (1 = first in the direction-aware order W1: ascending change when the dimension's
    total fell, else descending; ties by segment).

    The aggregated segments are stored once, so the facts are read once whatever is asked of the result.
    A dimension may have any number of segments: its total is a grouped sum and its ranks come from range
    partitions.  With ``top`` only so many segments of each dimension are kept, without ranking the others."""
    g = cut_lineage(segment_period_totals(t, periods, dimensions, scope))
    g = g.withColumns({
        "revenue_change": F.expr("current_revenue - previous_revenue"),
        "current_conversion_rate": F.expr(
            "CASE WHEN current_sessions > 0 THEN current_conversions / current_sessions ELSE 0.0 END"),
        "previous_conversion_rate": F.expr(
            "CASE WHEN previous_sessions > 0 THEN previous_conversions / previous_sessions ELSE 0.0 END"),
        "_seg_key": F.expr("coalesce(segment, 'None')"),
    })
    g = with_group_total(g, ["dimension"], F.sum(F.col("revenue_change").cast(MONEY_TYPE)).cast("double"), "_total")
    order = [F.expr("CASE WHEN _total >= 0 THEN -revenue_change ELSE revenue_change END"), F.col("segment").asc_nulls_first()]
    g = top_k(g, ["dimension"], order, top, "rank_in_dimension") if top else ranked(g, ["dimension"], order, "rank_in_dimension")
    g = with_two_proportion_test(g, "current_conversions", "current_sessions",
                                 "previous_conversions", "previous_sessions",
                                 p="conversion_rate_p_value", z="_z")
    return g.select(
        evidence_id("dim_", "dimension", C("dimension"), C("_seg_key"),
                    *periods.key_parts(), scope_identity(scope)).alias("evidence_id"),
        F.lit("revenue").alias("metric"),
        "dimension", "segment",
        "current_sessions", "previous_sessions", "current_conversions", "previous_conversions",
        "current_revenue", "previous_revenue", "revenue_change",
        F.expr("CASE WHEN previous_revenue <> 0 THEN revenue_change / previous_revenue END")
        .alias("revenue_percent_change"),
        F.expr("CASE WHEN _total <> 0 THEN revenue_change / _total END").alias("contribution_share"),
        "current_conversion_rate", "previous_conversion_rate",
        F.expr("current_conversion_rate - previous_conversion_rate").alias("conversion_rate_change"),
        "conversion_rate_p_value", "statistically_significant",
        "rank_in_dimension",
    )


def decompose_metric(t: MarketingTables, dimension: str, periods: Periods,
                     scope: Mapping[str, str] | None = None) -> DataFrame:
    """The reference's single-dimension call."""
    return decompose(t, periods, [dimension], scope)
