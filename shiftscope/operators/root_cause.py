"""Revenue-change investigation: ranked root-cause candidates."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftscope.functions.expr import clamp
from shiftscope.operators.decompose import decompose
from shiftscope.operators.funnel import FUNNEL_STEPS, segment_funnels
from shiftscope.periods import Periods
from shiftscope.session import cut_lineage
from shiftscope.tables import MarketingTables

# Dimensions scored as drivers and how much each is trusted.
DEFAULT_DIMENSIONS = ("device", "country", "channel", "campaign", "customer_segment")
DIMENSION_RELIABILITY = {"device": 1.00, "country": 0.85, "channel": 0.75, "campaign": 0.65,
                         "customer_segment": 0.40}
# Score weights.
SHARE_WEIGHT, SIGNIFICANCE_WEIGHT, RATE_WEIGHT, RATE_CAP = 0.65, 0.20, 2.0, 0.15
FUNNEL_SHARE_WEIGHT, FUNNEL_SIGNIFICANCE_WEIGHT = 0.65, 0.25
TOP_SEGMENTS = 3
LEAD_DIMENSION = "device"


def _dim_order(dimensions: Sequence[str]):
    return F.array_position(F.array(*[F.lit(d) for d in dimensions]), F.col("dimension"))


def dimension_candidates(decomposition: DataFrame, scope: Mapping[str, str] | None,
                         dimensions: Sequence[str] = DEFAULT_DIMENSIONS) -> DataFrame:
    """C5 + W2: top 3 segments per dimension (rank kept), falling ones scored."""
    scope = dict(scope or {})
    rel = F.try_element_at(F.create_map(*[x for d in dimensions for x in (F.lit(d), F.lit(DIMENSION_RELIABILITY[d]))]),
                       F.col("dimension"))
    share = F.coalesce(F.col("contribution_share"), F.lit(0.0))
    raw = (F.least(F.abs(share), F.lit(1.0)) * F.lit(SHARE_WEIGHT)
           + F.when(F.col("statistically_significant"), F.lit(SIGNIFICANCE_WEIGHT)).otherwise(F.lit(0.0))
           + clamp(-F.col("conversion_rate_change") * F.lit(RATE_WEIGHT), 0.0, RATE_CAP)) * rel
    for dim, value in scope.items():
        raw = F.when((F.col("dimension") == dim) & (F.col("segment") == value), F.lit(1.0)).otherwise(raw)
    return (decomposition
            .filter((F.col("rank_in_dimension") <= TOP_SEGMENTS) & (F.col("revenue_change") < 0))
            .select("evidence_id", F.lit("dimension_driver").alias("candidate_type"),
                    "dimension", "segment", F.round(raw, 4).alias("score"),
                    F.col("rank_in_dimension").alias("rank_within_dimension"),
                    F.lit(None).cast("string").alias("transition"),
                    _dim_order(dimensions).alias("_group"),
                    F.col("rank_in_dimension").alias("_sub")))


def leading_segment(decomposition: DataFrame, dimension: str = LEAD_DIMENSION) -> DataFrame:
    """The first segment of ``dimension`` in the direction-aware order (0 or 1 row)."""
    return (decomposition.filter((F.col("dimension") == dimension) & (F.col("rank_in_dimension") == 1)
                                 & F.col("segment").isNotNull() & (F.col("segment") != ""))
            .select("segment"))


def funnel_candidates(lead_funnel: DataFrame, n_dimensions: int) -> DataFrame:
    """Falling transitions of the leading segment's funnel (no reliability factor)."""
    pct = F.coalesce(F.col("percent_change"), F.lit(0.0))
    score = (F.least(F.abs(pct), F.lit(1.0)) * F.lit(FUNNEL_SHARE_WEIGHT)
             + F.when(F.col("statistically_significant"), F.lit(FUNNEL_SIGNIFICANCE_WEIGHT)).otherwise(F.lit(0.0)))
    return (lead_funnel.filter(F.col("absolute_change") < 0)
            .select("evidence_id", F.lit("funnel_driver").alias("candidate_type"),
                    F.col("filter_dimension").alias("dimension"), F.col("filter_value").alias("segment"),
                    F.round(score, 4).alias("score"),
                    F.lit(None).cast("int").alias("rank_within_dimension"),
                    F.concat(F.col("from_step"), F.lit(" -> "), F.col("to_step")).alias("transition"),
                    F.lit(n_dimensions + 1).alias("_group"), F.col("step_pos").alias("_sub")))


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Score descending; ties keep insertion order (dimension order, rank, step).

    The candidate list holds at most 3 rows per dimension plus one per funnel step, so
    the single ordered window is bounded by the number of dimensions and steps.
    """
    order = Window.orderBy(F.col("score").desc(), F.col("_group"), F.col("_sub"))
    return candidates.withColumn("position", F.row_number().over(order)).drop("_group", "_sub")


def _ranked(t: MarketingTables, periods: Periods, scope: dict, steps: Sequence[str],
            dimensions: Sequence[str], top: int | None = None):
    decomposition = decompose(t, periods, list(dimensions), scope, top)
    lead = leading_segment(decomposition)
    lead_funnel = segment_funnels(t, periods, lead, LEAD_DIMENSION, scope, steps)
    candidates = rank_candidates(dimension_candidates(decomposition, scope, dimensions)
                                 .unionByName(funnel_candidates(lead_funnel, len(dimensions))))
    return decomposition, lead_funnel, candidates


def investigate_revenue_change(t: MarketingTables, periods: Periods,
                               scope: Mapping[str, str] | None = None,
                               steps: Sequence[str] = FUNNEL_STEPS,
                               dimensions: Sequence[str] = DEFAULT_DIMENSIONS,
                               materialize: bool = False) -> dict[str, DataFrame]:
    """C4: KPIs, decompositions, overall and leading-device funnels, ranked candidates.

    The decomposition, the candidates and the leading segment share the stored segment totals; the
    other values are lazy DataFrames.  With ``materialize=True`` every section is stored in the
    cluster's checkpoint folder, so evidence written by separate actions does not read the facts again.
    """
    from shiftscope.operators.funnel import compare_funnels
    from shiftscope.operators.incidents import related_incidents
    from shiftscope.operators.kpi import compare_periods
    scope = dict(scope or {})
    decomposition, lead_funnel, candidates = _ranked(t, periods, scope, steps, dimensions)
    found = {
        "kpis": compare_periods(t, periods, scope),
        "decompositions": decomposition,
        "overall_funnel": compare_funnels(t, periods, scope=scope, steps=steps),
        "leading_device_funnel": lead_funnel,
        "ranked_candidates": candidates,
        "related_incidents": related_incidents(t.marketing_incidents, t.anomaly_ground_truth, periods, scope),
    }
    return {k: cut_lineage(v) for k, v in found.items()} if materialize else found


def root_cause_candidates(t: MarketingTables, periods: Periods, scope: Mapping[str, str] | None = None,
                          steps: Sequence[str] = FUNNEL_STEPS) -> DataFrame:
    """C4's ranked candidates alone: of each dimension only the first segments are looked for."""
    return _ranked(t, periods, dict(scope or {}), steps, DEFAULT_DIMENSIONS, TOP_SEGMENTS)[2]
