"""One call per investigation family, as a user of the original API would make.

Each returns a dict of lazy DataFrames (the evidence sections of a report) plus the
question type and metric.  ``report_claims`` turns a result into its claims table and
``report_evidence_ids`` lists the ids the claims may cite.
"""

from __future__ import annotations

import datetime as dt
from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftscope.periods import Periods
from shiftscope.tables import TABLE_NAMES, MarketingTables


def investigate_revenue(t: MarketingTables, periods: Periods, scope: Mapping[str, str] | None = None,
                        steps: Sequence[str] | None = None) -> dict:
    from shiftscope.operators.funnel import FUNNEL_STEPS
    from shiftscope.operators.root_cause import investigate_revenue_change
    out = investigate_revenue_change(t, periods, scope, steps or FUNNEL_STEPS)
    return {"question_type": "root_cause_analysis", "metric": "revenue", **out}


def investigate_campaign_performance(t: MarketingTables, periods: Periods, metric: str,
                                     scope: Mapping[str, str] | None = None) -> dict:
    from shiftscope.operators.campaign import campaign_candidates, campaign_compare
    from shiftscope.operators.incidents import incidents_scoped
    return {"question_type": "campaign_performance_analysis", "metric": metric,
            "kpis": campaign_compare(t, periods, scope),
            "ranked_candidates": campaign_candidates(t, periods, metric, scope),
            "related_incidents": incidents_scoped(t.anomaly_ground_truth, periods, scope)}


def investigate_traffic_change(t: MarketingTables, periods: Periods, metric: str = "sessions",
                               scope: Mapping[str, str] | None = None) -> dict:
    from shiftscope.operators.incidents import incidents_scoped
    from shiftscope.operators.traffic import traffic_candidates, traffic_compare
    return {"question_type": "traffic_analysis", "metric": metric,
            "kpis": traffic_compare(t, periods, scope),
            "ranked_candidates": traffic_candidates(t, periods, scope),
            "related_incidents": incidents_scoped(t.anomaly_ground_truth, periods, scope)}


def investigate_attribution_quality(t: MarketingTables, periods: Periods,
                                    scope: Mapping[str, str] | None = None) -> dict:
    from shiftscope.operators.attribution import attribution_compare, attribution_driver
    from shiftscope.operators.incidents import incidents_for_metric
    return {"question_type": "data_quality_analysis", "metric": "attribution_completeness",
            "kpis": attribution_compare(t, periods, scope),
            "ranked_candidates": attribution_driver(t, periods, scope),
            "related_incidents": incidents_for_metric(t.anomaly_ground_truth, periods,
                                                      "attribution_completeness", scope)}


def investigate_review_sentiment(t: MarketingTables, periods: Periods, scope: Mapping[str, str] | None = None,
                                 terms: Sequence[str] | None = None) -> dict:
    from shiftscope.operators.incidents import incidents_for_metric
    from shiftscope.operators.reviews import NEGATIVE_TERMS, review_compare, review_topic
    return {"question_type": "sentiment_analysis", "metric": "negative_review_rate",
            "kpis": review_compare(t, periods, scope),
            "ranked_candidates": review_topic(t, periods, scope, terms or NEGATIVE_TERMS),
            "related_incidents": incidents_for_metric(t.anomaly_ground_truth, periods,
                                                      "negative_review_rate", scope)}


def investigate_experiment(t: MarketingTables, start: dt.date, end: dt.date,
                           experiment_name: str | None = None) -> dict:
    """Without a name, exactly one experiment must have exposures in the window."""
    from shiftscope.operators.experiment import choose_experiment, experiment_lift
    name = choose_experiment(t.experiments, start, end, experiment_name)
    lift = experiment_lift(t.experiments, start, end, name)
    kpis = lift.select(F.inline(F.array(
        F.struct(F.col("conversion_evidence_id").alias("evidence_id"), F.lit("conversion_rate").alias("metric"),
                 F.col("treatment_rate").alias("current"), F.col("control_rate").alias("previous"),
                 F.col("absolute_conversion_lift").alias("absolute_change"),
                 F.col("relative_conversion_lift").alias("percent_change")),
        F.struct(F.col("revenue_evidence_id").alias("evidence_id"), F.lit("revenue_per_user").alias("metric"),
                 F.col("treatment_revenue_per_user").alias("current"),
                 F.col("control_revenue_per_user").alias("previous"),
                 F.col("revenue_per_user_lift").alias("absolute_change"),
                 F.col("revenue_per_user_percent_change").alias("percent_change")))))
    return {"question_type": "experiment_analysis", "metric": "conversion_rate", "experiment": name,
            "kpis": kpis, "ranked_candidates": lift}


def stored(result: dict) -> dict:
    """The result with its evidence frames stored, so that claims, audits and documents built on them do not
    read the facts again (``spark.checkpoint.dir``)."""
    from shiftscope.session import cut_lineage
    return {k: cut_lineage(v) if isinstance(v, DataFrame) else v for k, v in result.items()}


def with_stored_facts(t: MarketingTables, periods: Periods) -> MarketingTables:
    """The tables, with the sessions and daily campaign metrics of either period (and the days between) stored on first use.

    For investigations of the same ``periods``: every section reads these rows, and building them from
    their sources joins and groups whole tables each time."""
    from shiftscope.session import stored_table
    # campaigns are listed from the days between the periods too
    days = periods.in_either("date", as_date=True) | Periods.in_range("date", periods.previous_start, periods.current_end, as_date=True)
    cut = {"sessions": lambda: stored_table(t.sessions.filter(periods.in_either("timestamp")), "sessions"),
           "daily_campaign_metrics": lambda: stored_table(t.daily_campaign_metrics.filter(days), "daily_campaign_metrics")}
    return MarketingTables(**{n: cut.get(n, lambda n=n: getattr(t, n)) for n in TABLE_NAMES if t.has(n)})


def report_claims(result: dict) -> DataFrame:
    """R8 dispatch by question type."""
    from shiftscope.plans import claims as C
    qt = result["question_type"]
    k, c, i = result.get("kpis"), result.get("ranked_candidates"), result.get("related_incidents")
    if qt == "root_cause_analysis":
        return C.revenue_claims(k, c, i)
    if qt == "campaign_performance_analysis":
        return C.campaign_claims(k, c, i, result["metric"])
    if qt == "traffic_analysis":
        return C.traffic_claims(k, c, i, result["metric"])
    if qt == "data_quality_analysis":
        return C.attribution_claims(k, c, i)
    if qt == "sentiment_analysis":
        return C.sentiment_claims(k, c, i)
    if qt == "experiment_analysis":
        return C.experiment_claims(c)
    raise ValueError(f"unknown question type {qt!r}")


def report_evidence_ids(result: dict) -> DataFrame:
    """Ids of every evidence section of a result."""
    from shiftscope.plans.claims import evidence_ids
    frames = [result[k] for k in ("kpis", "decompositions", "overall_funnel", "leading_device_funnel",
                                  "related_incidents", "ranked_candidates") if result.get(k) is not None]
    if result["question_type"] == "experiment_analysis":
        frames = [result["kpis"], result["ranked_candidates"].select("evidence_id")]
    return evidence_ids(*frames)


def metric_registry(metric_definitions: DataFrame) -> DataFrame:
    """The metric registry ordered by name."""
    return metric_definitions.select("*").orderBy("metric_name")
