"""Known incidents and anomalies linked to an investigation."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftscope.functions.expr import sha_prefix
from shiftscope.functions.scope import scope_identity
from shiftscope.periods import Periods

# Texts of anomaly-derived incident rows.
NO_RESOLUTION = "No resolution recorded in anomaly ground truth"
TITLE_PREFIX = {"scoped": "Scoped anomaly for ", "attribution_completeness": "Attribution anomaly for ",
                "negative_review_rate": "Review anomaly for "}

INCIDENT_COLUMNS = ("evidence_id", "incident_id", "incident_date", "title", "root_cause",
                    "resolution", "impact")


def incident_registry(incidents: DataFrame) -> DataFrame:
    """Every incident with its ``inc_`` evidence id (ordered by date when sorted)."""
    return incidents.select(F.concat(F.lit("inc_"), F.col("incident_id")).alias("evidence_id"),
                            "incident_id", "incident_date", "title", "root_cause", "resolution", "impact")


def incidents_in_period(incidents: DataFrame, periods: Periods) -> DataFrame:
    """Incidents dated inside the current period (unscoped investigations)."""
    return incident_registry(incidents).filter(
        periods.in_current("incident_date", as_date=True))


def _overlapping(anomalies: DataFrame, periods: Periods) -> DataFrame:
    """P10: stored end date is inclusive while periods are half-open."""
    cs = F.lit(periods.current_start.isoformat()).cast("date")
    ce = F.lit(periods.current_end.isoformat()).cast("date")
    return anomalies.filter((F.col("start_date") < ce) & (F.col("end_date") >= cs))


def _as_incidents(anomalies: DataFrame, title_prefix: str, scope: Mapping[str, str] | None) -> DataFrame:
    suffix = sha_prefix(F.lit(scope_identity(scope)), 8)
    return anomalies.select(
        F.concat(F.lit("gt_"), F.col("scenario_id"), F.lit("_"), suffix).alias("evidence_id"),
        F.col("scenario_id").alias("incident_id"), F.col("start_date").alias("incident_date"),
        F.concat(F.lit(title_prefix), F.col("affected_dimension")).alias("title"),
        "root_cause", F.lit(NO_RESOLUTION).alias("resolution"),
        F.initcap("severity").alias("impact"))


def incidents_scoped(anomalies: DataFrame, periods: Periods, scope: Mapping[str, str] | None) -> DataFrame:
    """C13 + J6: overlapping anomalies whose ``affected_dimension`` is one of the scope's
    ``name=value`` pairs; empty without a scope."""
    pairs = [f"{k}={v}" for k, v in (scope or {}).items()]
    rows = _overlapping(anomalies, periods)
    rows = rows.filter(F.col("affected_dimension").isin(*pairs)) if pairs else rows.filter(F.lit(False))
    return _as_incidents(rows, TITLE_PREFIX["scoped"], scope)


def incidents_for_metric(anomalies: DataFrame, periods: Periods, metric: str,
                         scope: Mapping[str, str] | None = None) -> DataFrame:
    """C14: overlapping anomalies of one affected metric; scope only enters the id."""
    rows = _overlapping(anomalies, periods).filter(F.col("affected_metric") == metric)
    return _as_incidents(rows, TITLE_PREFIX.get(metric, "Anomaly for "), scope)


def related_incidents(incidents: DataFrame, anomalies: DataFrame, periods: Periods,
                      scope: Mapping[str, str] | None) -> DataFrame:
    """Revenue investigations: registry incidents when unscoped, scoped anomalies otherwise."""
    if scope:
        return incidents_scoped(anomalies, periods, scope)
    return incidents_in_period(incidents, periods)
