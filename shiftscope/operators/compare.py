"""Period-to-period comparison helpers shared by the KPI families."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftscope.functions.expr import evidence_id, pct_change
from shiftscope.periods import Periods


def widen(per_period: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row with ``cur_<m>`` and ``prev_<m>`` from a frame keyed by ``period``.

    A period without rows gets 0 for every metric (counts, sums and safe ratios of
    nothing are 0).  Input has at most two rows, so this global aggregate is tiny.
    """
    cols = []
    for m in metrics:
        for label, pre in (("current", "cur_"), ("previous", "prev_")):
            cols.append(F.coalesce(F.max(F.when(F.col("period") == label, F.col(m))),
                                   F.lit(0)).alias(pre + m))
    return per_period.agg(*cols)


def compare_long(wide: DataFrame, metrics: Sequence[str], prefix: str, key_name: str,
                 periods: Periods, scope_id: str) -> DataFrame:
    """MetricComparison rows: metric, current, previous, absolute and percent change."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"),
                               F.col("cur_" + m).cast("double").alias("current"),
                               F.col("prev_" + m).cast("double").alias("previous"))
                      for m in metrics])
    long = wide.select(F.inline(pairs))
    return long.select(
        evidence_id(prefix, key_name, F.col("metric"), *periods.key_parts(), scope_id).alias("evidence_id"),
        "metric", "current", "previous",
        (F.col("current") - F.col("previous")).alias("absolute_change"),
        pct_change("current", "previous").alias("percent_change"))


def single_period(per_period: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """The ``current`` row of a per-period frame, zeros when the period is empty."""
    w = widen(per_period, metrics)
    return w.select(*[F.col("cur_" + m).alias(m) for m in metrics])
