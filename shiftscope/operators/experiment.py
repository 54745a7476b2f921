"""Control-versus-treatment experiments.

The batch form analyses every experiment with exposures in the window in one pass:
variants are grouped case-folded (two spellings of a variant are merged — a stated
deviation from keeping the last row read), then control and treatment are placed side
by side with conditional aggregates over the small per-variant result.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftscope.functions.expr import C, evidence_id, money_sum
from shiftscope.functions.stats import ALPHA, with_experiment_test
from shiftscope.periods import Periods

POWER_TARGET = 0.8


def _window(experiments: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    return experiments.filter(Periods.in_range("exposure_date", start, end, as_date=True))


def experiment_names(experiments: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Experiments with exposures in ``[start, end)``."""
    return _window(experiments, start, end).select("experiment_name").distinct()


def choose_experiment(experiments: DataFrame, start: dt.date, end: dt.date,
                      experiment_name: str | None = None) -> str:
    """Resolve the experiment of a single request.

    This is the one driver-side read in the library: it fetches at most two names.
    Without a name, exactly one experiment must have exposures in the window.
    """
    names = experiment_names(experiments, start, end)
    if experiment_name is None:
        found = [r[0] for r in names.orderBy("experiment_name").limit(2).collect()]
        if len(found) != 1:
            raise ValueError(f"an experiment must be named: [{start}, {end}) holds {'none' if not found else 'several, among them ' + ', '.join(found)}")
        return found[0]
    if names.filter(F.col("experiment_name") == experiment_name).limit(1).count() == 0:
        raise ValueError(f"no exposure of {experiment_name!r} in [{start}, {end})")
    return experiment_name


def experiment_variants(experiments: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Participants, conversions, revenue and revenue per user per experiment and variant."""
    return (_window(experiments, start, end)
            .groupBy("experiment_name", F.lower("variant").alias("variant"))
            .agg(F.count(F.lit(1)).alias("participants"),
                 F.sum("conversion").cast("bigint").alias("conversions"),
                 money_sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("_n"))
            .withColumn("revenue_per_user", F.expr("revenue / _n")).drop("_n"))


def incomplete_experiments(experiments: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Experiments of the window that cannot be compared, one row each with the missing variants."""
    v = experiment_variants(experiments, start, end).groupBy("experiment_name").agg(
        *[F.max(F.col("variant") == side).alias(side) for side in ("control", "treatment")])
    missing = F.array_compact(F.array(*[F.when(~F.col(side), F.lit(side)) for side in ("control", "treatment")]))
    return v.select("experiment_name", missing.alias("missing_variants")).filter(F.size("missing_variants") > 0)


def experiment_lift(experiments: DataFrame, start: dt.date, end: dt.date,
                    experiment_name: str | None = None) -> DataFrame:
    """C11 + T2 for every experiment in the window that has both a control and a treatment
    variant; the others are listed by :func:`incomplete_experiments`.  One named experiment
    without either variant is an error."""
    v = experiment_variants(experiments, start, end)
    if experiment_name is not None:
        named = experiments.filter(F.col("experiment_name") == experiment_name)
        lacking = incomplete_experiments(named, start, end).first()  # at most one row
        if lacking:
            raise ValueError(f"experiment {experiment_name!r} has no {' and no '.join(lacking.missing_variants)} in [{start}, {end})")
        v = v.filter(F.col("experiment_name") == experiment_name)

    def pick(variant, col):
        return F.max(F.when(F.col("variant") == variant, F.col(col)))
    side = v.groupBy("experiment_name").agg(
        *[pick(var, c).alias(f"{pre}_{c}") for var, pre in (("control", "c"), ("treatment", "t"))
          for c in ("participants", "conversions", "revenue", "revenue_per_user")])
    side = side.filter(F.col("c_participants").isNotNull() & F.col("t_participants").isNotNull())
    side = with_experiment_test(side, "c_conversions", "c_participants", "t_conversions", "t_participants")
    side = side.withColumn("relative_conversion_lift", F.expr(
        "CASE WHEN control_rate <> 0 THEN (treatment_rate - control_rate) / control_rate END"))
    keys = (C("experiment_name"), start.isoformat(), end.isoformat())
    return side.select(
        "experiment_name",
        evidence_id("exp_", "conversion", *keys).alias("conversion_evidence_id"),
        evidence_id("exp_", "revenue", *keys).alias("revenue_evidence_id"),
        evidence_id("exd_", "treatment", *keys).alias("evidence_id"),
        F.col("c_participants").alias("control_participants"),
        F.col("t_participants").alias("treatment_participants"),
        F.col("c_conversions").alias("control_conversions"),
        F.col("t_conversions").alias("treatment_conversions"),
        "control_rate", "treatment_rate",
        F.col("absolute_lift").alias("absolute_conversion_lift"),
        "relative_conversion_lift", "p_value", "ci_low", "ci_high",
        F.expr(f"coalesce(p_value < {ALPHA}, false)").alias("statistically_significant"),
        "observed_power",
        F.expr(f"observed_power < {POWER_TARGET}").alias("low_power_warning"),
        F.col("c_revenue").alias("control_revenue"), F.col("t_revenue").alias("treatment_revenue"),
        F.expr("t_revenue - c_revenue").alias("absolute_revenue_lift"),
        F.col("c_revenue_per_user").alias("control_revenue_per_user"),
        F.col("t_revenue_per_user").alias("treatment_revenue_per_user"),
        F.expr("t_revenue_per_user - c_revenue_per_user").alias("revenue_per_user_lift"),
        F.expr("CASE WHEN c_revenue_per_user <> 0 THEN (t_revenue_per_user - c_revenue_per_user) "
               "/ c_revenue_per_user END").alias("revenue_per_user_percent_change"),
        F.expr("least(greatest(abs(coalesce(relative_conversion_lift, 0.0)), 0.0), 1.0)").alias("score"))
