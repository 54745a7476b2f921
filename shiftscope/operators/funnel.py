"""Conversion funnel comparison (G6, W5, C3) and the leading-segment funnel.

Step counts are distinct sessions **having** an event of the step in the period (the
period test uses the session's timestamp; order in time is not enforced).  At scale
each session's steps are folded into a bitmask with ``bit_or`` (map-side combined, so a
hot session shrinks to one row per task before the shuffle), joined 1:1 to the scoped
sessions, and every step is counted by one conditional sum in a single aggregate.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftscope.functions.expr import C, evidence_id
from shiftscope.functions.scope import SESSION_SCOPE, scope_identity, scope_identity_col
from shiftscope.functions.stats import with_two_proportion_test
from shiftscope.operators.facts import of_session_days, scoped_sessions
from shiftscope.periods import Periods
from shiftscope.tables import MarketingTables

# The default funnel step order.
FUNNEL_STEPS = ("landing_page", "product_view", "add_to_cart", "checkout_started",
                "payment_started", "purchase_completed")
#: steps per mask
WORD = 62


def _check_steps(steps: Sequence[str]) -> tuple[str, ...]:
    steps = tuple(steps)
    if len(steps) < 2 or len(set(steps)) != len(steps):
        raise ValueError("a funnel needs two or more distinct steps")
    return steps


def funnel_counts(t: MarketingTables, periods: Periods, scope: Mapping[str, str] | None = None) -> DataFrame:
    """Distinct sessions per event name and period (every event name, known or not)."""
    s = scoped_sessions(t, periods, scope, label="all").select("session_id", "period")
    ev = of_session_days(t.funnel_events, periods).select("session_id", "event_name").distinct()
    return (ev.join(s, "session_id").groupBy("period", "event_name")
            .agg(F.count(F.lit(1)).alias("sessions")))


def step_masks(t: MarketingTables, steps: Sequence[str], periods: Periods | None = None) -> DataFrame:
    """One row per session: bit i of the masks set when the session has an event of step i.

    A mask holds ``WORD`` steps; longer funnels have several."""
    pos = F.array_position(F.array(*[F.lit(s) for s in steps]), F.col("event_name"))
    masks = [F.bit_or(F.expr(f"CASE WHEN (pos - 1) DIV {WORD} = {k} THEN shiftleft(CAST(1 AS BIGINT), CAST((pos - 1) % {WORD} AS INT)) ELSE CAST(0 AS BIGINT) END"))
             .alias(f"mask_{k}") for k in range(-(-len(steps) // WORD))]
    return (of_session_days(t.funnel_events, periods).select("session_id", pos.alias("pos")).filter(F.col("pos") > 0)
            .groupBy("session_id").agg(*masks))


def _bit(i: int) -> Column:
    return F.shiftright(F.col(f"mask_{i // WORD}"), i % WORD).bitwiseAND(F.lit(1))


def step_totals(t: MarketingTables, periods: Periods, scope: Mapping[str, str] | None,
                steps: Sequence[str], by: str | None = None) -> DataFrame:
    """``cur_<i>`` / ``prev_<i>`` session counts per step, optionally per segment of ``by``."""
    s = scoped_sessions(t, periods, scope, label="all", need_campaign=(by == "campaign"))
    j = s.join(step_masks(t, steps, periods), "session_id")
    aggs = []
    for i in range(len(steps)):
        for label, pre in (("current", "cur_"), ("previous", "prev_")):
            aggs.append(F.coalesce(F.sum(F.when(F.col("period") == label, _bit(i))), F.lit(0))
                        .cast("bigint").alias(f"{pre}{i}"))
    return j.groupBy(by).agg(*aggs) if by else j.agg(*aggs)


def transitions(wide: DataFrame, steps: Sequence[str], periods: Periods,
                filter_dimension: str | None, filter_value, scope_id) -> DataFrame:
    """W5 + T1: one FunnelEvidence row per adjacent step pair of each ``wide`` row.

    ``filter_value`` and ``scope_id`` are literals or columns of ``wide``.
    """
    pairs = F.array(*[F.struct(
        F.lit(i + 1).alias("step_pos"), F.lit(steps[i]).alias("from_step"), F.lit(steps[i + 1]).alias("to_step"),
        F.col(f"cur_{i}").alias("current_from_sessions"), F.col(f"cur_{i + 1}").alias("current_to_sessions"),
        F.col(f"prev_{i}").alias("previous_from_sessions"), F.col(f"prev_{i + 1}").alias("previous_to_sessions"))
        for i in range(len(steps) - 1)])
    fv = filter_value if isinstance(filter_value, Column) else F.lit(filter_value).cast("string")
    sid = scope_id if isinstance(scope_id, Column) else F.lit(scope_id)
    rows = wide.select(fv.alias("filter_value"), sid.alias("_scope_id"), F.inline(pairs))
    rows = rows.withColumns({
        "current_rate": F.expr("CASE WHEN current_from_sessions > 0 "
                               "THEN current_to_sessions / current_from_sessions ELSE 0.0 END"),
        "previous_rate": F.expr("CASE WHEN previous_from_sessions > 0 "
                                "THEN previous_to_sessions / previous_from_sessions ELSE 0.0 END"),
        "_fv_key": F.expr("coalesce(filter_value, 'all')"),
    })
    rows = with_two_proportion_test(rows, "current_to_sessions", "current_from_sessions",
                                    "previous_to_sessions", "previous_from_sessions", z="_z")
    return rows.select(
        evidence_id("fun_", "funnel", C("from_step"), C("to_step"), filter_dimension or "all",
                    C("_fv_key"), *periods.key_parts(), C("_scope_id")).alias("evidence_id"),
        "from_step", "to_step", "step_pos",
        "current_from_sessions", "current_to_sessions", "previous_from_sessions", "previous_to_sessions",
        "current_rate", "previous_rate",
        F.expr("current_rate - previous_rate").alias("absolute_change"),
        F.expr("CASE WHEN previous_rate <> 0 THEN (current_rate - previous_rate) / previous_rate END")
        .alias("percent_change"),
        "p_value", "statistically_significant",
        F.lit(filter_dimension).cast("string").alias("filter_dimension"), "filter_value")


def compare_funnels(t: MarketingTables, periods: Periods, *, filter_dimension: str | None = None,
                    filter_value: str | None = None, scope: Mapping[str, str] | None = None,
                    steps: Sequence[str] = FUNNEL_STEPS) -> DataFrame:
    """Transition rates of adjacent steps, current vs previous, with a p-value."""
    steps = _check_steps(steps)
    effective = dict(scope or {})
    if filter_dimension is not None:
        if filter_value is None:
            raise ValueError(f"a value of {filter_dimension!r} must be given to filter the funnel by it")
        effective[filter_dimension] = filter_value
    wide = step_totals(t, periods, effective, steps)
    return transitions(wide, steps, periods, filter_dimension, filter_value,
                       scope_identity(effective))


def segment_funnels(t: MarketingTables, periods: Periods, segments: DataFrame, dimension: str,
                    scope: Mapping[str, str] | None = None,
                    steps: Sequence[str] = FUNNEL_STEPS) -> DataFrame:
    """C3 drilled down to each segment listed in ``segments`` (column ``segment``).

    Counts for all segments of ``dimension`` come from one aggregation; ``segments`` is
    joined to that small result, so a segment chosen at run time (W4) needs no driver
    round trip.  Segments without events get zero counts.
    """
    steps = _check_steps(steps)
    if dimension not in SESSION_SCOPE:
        raise ValueError(f"cannot drill a funnel down by {dimension!r}")
    base = {k: v for k, v in (scope or {}).items() if k != dimension}
    per_seg = step_totals(t, periods, base, steps, by=dimension).withColumnRenamed(dimension, "_seg")
    wide = segments.select(F.col("segment")).join(per_seg, F.col("segment") == F.col("_seg"), "left")
    counts = [F.coalesce(F.col(f"{pre}{i}"), F.lit(0)).cast("bigint").alias(f"{pre}{i}")
              for i in range(len(steps)) for pre in ("cur_", "prev_")]
    wide = wide.select("segment", *counts)
    sid = scope_identity_col(base, dimension, F.col("segment"))
    return transitions(wide, steps, periods, dimension, F.col("segment"), sid)
