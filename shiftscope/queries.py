"""Registered query keys: each callable takes ``(spark, sf_dir)`` and returns a DataFrame.

The parameters below (periods, scopes) are fixed choices for the driver's test data;
the operators themselves take them as arguments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftscope.periods import Periods
from shiftscope.sources import tpch_adapter as A

# Fixed parameters of the registered queries.
ORDERS_PERIODS = Periods.of("2000-07-01", "2000-12-29", "2000-01-02", "2000-07-01")
EVENTS_PERIODS = Periods.of("2024-01-16", "2024-01-30", "2024-01-02", "2024-01-16")
REVIEW_PERIODS = Periods.of("2024-01-15", "2024-01-29", "2024-01-01", "2024-01-15")
KPI_SCOPE = {"device": "F", "channel": "1-URGENT"}
CAMPAIGN_SCOPE = {"channel": "ASIA"}
REVIEW_SCOPE = {"device": "de"}
FUNNEL_SCOPE = {"device": "Android"}
EVENT_STEPS = ("view", "click", "signup", "purchase")
REVIEW_TERMS = ("license", "tion", "der")

MONEY_WORDS = ("revenue", "spend", "discount", "change_value")


MONEY_PLACES, RATIO_PLACES = 4, 6


def fix(c, places: int):
    """Deterministic half-up rounding ``floor(x * 10^n + 0.5) / 10^n``.

    Bit-identical in any IEEE engine, unlike ``round`` whose tie rules differ.  Money
    inputs are multiples of 1e-4, so 4 places removes summation-order noise without
    ever meeting a tie.
    """
    scale = float(10 ** places)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def fix_sql(c: str, places: int) -> str:
    scale = float(10 ** places)
    return f"(floor({c} * {scale}D + 0.5D) / {scale}D)"


def finish(df: DataFrame, money: tuple[str, ...] = ()) -> DataFrame:
    """Presentation rounding shared with the oracle: money columns to 4 places, every
    other double to 6 (summation order differs between engines)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            places = MONEY_PLACES if f.name in money else RATIO_PLACES
            out.append(f"{fix_sql(f'`{f.name}`', places)} AS `{f.name}`")
        else:
            out.append(f"`{f.name}`")
    return df.selectExpr(*out)


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


# --- decompositions -------------------------------------------------------------
DIM_MONEY = ("current_revenue", "previous_revenue", "revenue_change")


def _decompose_query(dimension: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from shiftscope.operators.decompose import decompose
        t = A.orders_tables(spark, sf_dir)
        return finish(decompose(t, ORDERS_PERIODS, [dimension]), DIM_MONEY)
    run.__name__ = f"decompose_{dimension}"
    run.__doc__ = f"C2: revenue change decomposed by {dimension} (orders mapping)."
    return run


for _dim, _key in (("device", "decompose_device"), ("country", "decompose_country"),
                   ("channel", "decompose_channel"), ("campaign", "decompose_campaign"),
                   ("customer_segment", "decompose_segment"), ("product", "decompose_product")):
    register(_key)(_decompose_query(_dim))


def finish_long(df: DataFrame, money_metrics: tuple[str, ...] = ()) -> DataFrame:
    """Rounding for MetricComparison rows: money metrics to 4 places, others to 6."""
    money_in = ", ".join("'" + m + "'" for m in money_metrics) or "''"
    out = []
    for f in df.schema.fields:
        c = f"`{f.name}`"
        if f.name in ("current", "previous", "absolute_change"):
            out.append(f"CASE WHEN metric IN ({money_in}) THEN {fix_sql(c, MONEY_PLACES)} "
                       f"ELSE {fix_sql(c, RATIO_PLACES)} END AS {c}")
        elif isinstance(f.dataType, T.DoubleType):
            out.append(f"{fix_sql(c, RATIO_PLACES)} AS {c}")
        else:
            out.append(c)
    return df.selectExpr(*out)


KPI_MONEY = ("revenue",)


# --- session facts and KPIs ---------------------------------------------------------
@register("session_facts")
def q_session_facts(spark, sf_dir):
    """Sessions left-joined to conversions (orders mapping)."""
    from shiftscope.operators.facts import session_facts
    return finish(session_facts(A.orders_tables(spark, sf_dir)), ("revenue", "discount"))


@register("kpi_period")
def q_kpi_period(spark, sf_dir):
    """G1: KPIs of the current orders period, unscoped."""
    from shiftscope.operators.kpi import period_kpis
    p = ORDERS_PERIODS
    return finish(period_kpis(A.orders_tables(spark, sf_dir), p.current_start, p.current_end), KPI_MONEY)


@register("kpi_period_scoped")
def q_kpi_period_scoped(spark, sf_dir):
    """G1 with a device and channel scope."""
    from shiftscope.operators.kpi import period_kpis
    p = ORDERS_PERIODS
    return finish(period_kpis(A.orders_tables(spark, sf_dir), p.current_start, p.current_end,
                              KPI_SCOPE), KPI_MONEY)


@register("kpi_compare")
def q_kpi_compare(spark, sf_dir):
    """KPI comparison of the two orders periods."""
    from shiftscope.operators.kpi import compare_periods
    return finish_long(compare_periods(A.orders_tables(spark, sf_dir), ORDERS_PERIODS), KPI_MONEY)


# --- traffic ------------------------------------------------------------------------
@register("traffic_kpis")
def q_traffic_kpis(spark, sf_dir):
    """Distinct sessions and users of the current period."""
    from shiftscope.operators.traffic import period_traffic_kpis
    p = ORDERS_PERIODS
    return finish(period_traffic_kpis(A.orders_tables(spark, sf_dir), p.current_start, p.current_end))


@register("traffic_compare")
def q_traffic_compare(spark, sf_dir):
    """Session and user comparison."""
    from shiftscope.operators.traffic import traffic_compare
    return finish_long(traffic_compare(A.orders_tables(spark, sf_dir), ORDERS_PERIODS))


@register("traffic_dimension_rows")
def q_traffic_dimension_rows(spark, sf_dir):
    """Per-segment sessions of both periods over four dimensions in one pass."""
    from shiftscope.operators.traffic import traffic_dimension_rows
    return finish(traffic_dimension_rows(A.orders_tables(spark, sf_dir), ORDERS_PERIODS))


@register("traffic_candidates")
def q_traffic_candidates(spark, sf_dir):
    """C8 drivers: declining segments, scoped to channel=1-URGENT, ranked globally."""
    from shiftscope.operators.traffic import traffic_candidates
    return finish(traffic_candidates(A.orders_tables(spark, sf_dir), ORDERS_PERIODS,
                                     {"channel": "1-URGENT"}))


# --- attribution --------------------------------------------------------------------
@register("attribution_kpis")
def q_attribution_kpis(spark, sf_dir):
    """Attributed and unattributed sessions of the current period."""
    from shiftscope.operators.attribution import period_attribution_metrics
    p = ORDERS_PERIODS
    return finish(period_attribution_metrics(A.orders_tables(spark, sf_dir), p.current_start,
                                             p.current_end))


@register("attribution_compare")
def q_attribution_compare(spark, sf_dir):
    """Attribution KPI comparison."""
    from shiftscope.operators.attribution import attribution_compare
    return finish_long(attribution_compare(A.orders_tables(spark, sf_dir), ORDERS_PERIODS))


@register("attribution_driver")
def q_attribution_driver(spark, sf_dir):
    """C9 driver: change of unattributed sessions, scoped to device=F."""
    from shiftscope.operators.attribution import attribution_driver
    return finish(attribution_driver(A.orders_tables(spark, sf_dir), ORDERS_PERIODS, {"device": "F"}))


@register("two_proportion_test")
def q_two_proportion_test(spark, sf_dir):
    """T1 on conversion rates per device, channel and country segment, current vs previous."""
    from shiftscope.operators.decompose import segment_period_totals
    from shiftscope.functions.stats import with_two_proportion_test
    g = segment_period_totals(A.events_tables(spark, sf_dir), EVENTS_PERIODS, ["device", "channel", "country"])
    args = ("current_conversions", "current_sessions", "previous_conversions", "previous_sessions")
    return finish(with_two_proportion_test(g, *args).select(
        "dimension", "segment", *args, "z_score", "p_value", "statistically_significant"))


# --- funnels and root cause (events mapping) ------------------------------------------
FUNNEL_MONEY: tuple[str, ...] = ()


@register("funnel_counts")
def q_funnel_counts(spark, sf_dir):
    """Distinct sessions per event name and period."""
    from shiftscope.operators.funnel import funnel_counts
    return funnel_counts(A.events_tables(spark, sf_dir), EVENTS_PERIODS)


@register("funnel_compare")
def q_funnel_compare(spark, sf_dir):
    """Adjacent-step transition rates, current vs previous, unscoped."""
    from shiftscope.operators.funnel import compare_funnels
    return finish(compare_funnels(A.events_tables(spark, sf_dir), EVENTS_PERIODS, steps=EVENT_STEPS))


@register("funnel_compare_scoped")
def q_funnel_compare_scoped(spark, sf_dir):
    """C3 drilled down with filter device=Android."""
    from shiftscope.operators.funnel import compare_funnels
    return finish(compare_funnels(A.events_tables(spark, sf_dir), EVENTS_PERIODS,
                                  filter_dimension="device", filter_value=FUNNEL_SCOPE["device"],
                                  steps=EVENT_STEPS))


@register("leading_segment_funnel")
def q_leading_segment_funnel(spark, sf_dir):
    """W4 + C3: funnel of the device that leads the revenue decomposition."""
    from shiftscope.operators.decompose import decompose
    from shiftscope.operators.funnel import segment_funnels
    from shiftscope.operators.root_cause import leading_segment
    t = A.events_tables(spark, sf_dir)
    lead = leading_segment(decompose(t, EVENTS_PERIODS, ["device"]))
    return finish(segment_funnels(t, EVENTS_PERIODS, lead, "device", steps=EVENT_STEPS))


@register("root_cause_candidates")
def q_root_cause_candidates(spark, sf_dir):
    """C4: ranked dimension and funnel drivers of the revenue change (events mapping)."""
    from shiftscope.operators.root_cause import root_cause_candidates
    return finish(root_cause_candidates(A.events_tables(spark, sf_dir), EVENTS_PERIODS, steps=EVENT_STEPS))


# --- campaigns ------------------------------------------------------------------------
CAMPAIGN_MONEY = ("spend", "revenue")
CANDIDATE_METRIC = "cpc"


@register("campaign_kpis")
def q_campaign_kpis(spark, sf_dir):
    """Campaign KPIs of the current period (ratios of sums)."""
    from shiftscope.operators.campaign import period_campaign_kpis
    p = ORDERS_PERIODS
    return finish(period_campaign_kpis(A.orders_tables(spark, sf_dir), p.current_start, p.current_end),
                  CAMPAIGN_MONEY)


@register("campaign_kpis_scoped")
def q_campaign_kpis_scoped(spark, sf_dir):
    """G5 with a channel scope."""
    from shiftscope.operators.campaign import period_campaign_kpis
    p = ORDERS_PERIODS
    return finish(period_campaign_kpis(A.orders_tables(spark, sf_dir), p.current_start, p.current_end,
                                       CAMPAIGN_SCOPE), CAMPAIGN_MONEY)


@register("campaign_compare")
def q_campaign_compare(spark, sf_dir):
    """The ten campaign KPIs compared."""
    from shiftscope.operators.campaign import campaign_compare
    return finish_long(campaign_compare(A.orders_tables(spark, sf_dir), ORDERS_PERIODS), CAMPAIGN_MONEY)


@register("campaign_segments")
def q_campaign_segments(spark, sf_dir):
    """Campaigns active over [previous_start, current_end)."""
    from shiftscope.operators.campaign import campaign_segments
    return campaign_segments(A.orders_tables(spark, sf_dir), ORDERS_PERIODS, "campaign")


@register("campaign_candidates")
def q_campaign_candidates(spark, sf_dir):
    """C7 drivers over channel then campaign, unscoped, for CPC."""
    from shiftscope.operators.campaign import campaign_candidates
    return finish(campaign_candidates(A.orders_tables(spark, sf_dir), ORDERS_PERIODS, CANDIDATE_METRIC))


@register("campaign_candidates_scoped")
def q_campaign_candidates_scoped(spark, sf_dir):
    """C7 drivers with channel=ASIA: each channel replaces the scoped one."""
    from shiftscope.operators.campaign import campaign_candidates
    return finish(campaign_candidates(A.orders_tables(spark, sf_dir), ORDERS_PERIODS, CANDIDATE_METRIC,
                                      CAMPAIGN_SCOPE))


# --- reviews --------------------------------------------------------------------------
@register("review_kpis")
def q_review_kpis(spark, sf_dir):
    """Review counts, negative rate and average rating of the current period."""
    from shiftscope.operators.reviews import period_review_metrics
    p = REVIEW_PERIODS
    return finish(period_review_metrics(A.orders_tables(spark, sf_dir), p.current_start, p.current_end))


@register("review_kpis_scoped")
def q_review_kpis_scoped(spark, sf_dir):
    """G4 with a device scope (P5)."""
    from shiftscope.operators.reviews import period_review_metrics
    p = REVIEW_PERIODS
    return finish(period_review_metrics(A.orders_tables(spark, sf_dir), p.current_start, p.current_end,
                                        REVIEW_SCOPE))


@register("review_compare")
def q_review_compare(spark, sf_dir):
    """Review KPI comparison."""
    from shiftscope.operators.reviews import review_compare
    return finish_long(review_compare(A.orders_tables(spark, sf_dir), REVIEW_PERIODS))


@register("review_topic")
def q_review_topic(spark, sf_dir):
    """G12 + topic driver: negative reviews mentioning any topic term (whole texts)."""
    from shiftscope.operators.reviews import review_topic
    return finish(review_topic(A.orders_tables(spark, sf_dir), REVIEW_PERIODS, terms=REVIEW_TERMS))


# --- experiments ----------------------------------------------------------------------
EXPERIMENT_MONEY = ("control_revenue", "treatment_revenue", "absolute_revenue_lift", "revenue")


@register("experiment_names")
def q_experiment_names(spark, sf_dir):
    """Experiments with exposures in the current period."""
    from shiftscope.operators.experiment import experiment_names
    p = ORDERS_PERIODS
    return experiment_names(A.orders_tables(spark, sf_dir).experiments, p.current_start, p.current_end)


@register("experiment_variants")
def q_experiment_variants(spark, sf_dir):
    """Per-variant aggregates of every experiment in the window."""
    from shiftscope.operators.experiment import experiment_variants
    p = ORDERS_PERIODS
    return finish(experiment_variants(A.orders_tables(spark, sf_dir).experiments, p.current_start,
                                      p.current_end), EXPERIMENT_MONEY)


@register("experiment_lift")
def q_experiment_lift(spark, sf_dir):
    """C11 + T2: lift, p-value, interval and power for every experiment in the window."""
    from shiftscope.operators.experiment import experiment_lift
    p = ORDERS_PERIODS
    return finish(experiment_lift(A.orders_tables(spark, sf_dir).experiments, p.current_start,
                                  p.current_end), EXPERIMENT_MONEY)


# --- incidents ------------------------------------------------------------------------
@register("incident_registry")
def q_incident_registry(spark, sf_dir):
    """The incident registry with ``inc_`` ids."""
    from shiftscope.operators.incidents import incident_registry
    return incident_registry(A.orders_tables(spark, sf_dir).marketing_incidents)


@register("incidents_period")
def q_incidents_period(spark, sf_dir):
    """Incidents dated in the current period."""
    from shiftscope.operators.incidents import incidents_in_period
    return incidents_in_period(A.orders_tables(spark, sf_dir).marketing_incidents, ORDERS_PERIODS)


@register("incidents_scoped")
def q_incidents_scoped(spark, sf_dir):
    """Anomalies overlapping the current period on a scoped dimension."""
    from shiftscope.operators.incidents import incidents_scoped
    return incidents_scoped(A.orders_tables(spark, sf_dir).anomaly_ground_truth, ORDERS_PERIODS, KPI_SCOPE)


@register("incidents_overlap")
def q_incidents_overlap(spark, sf_dir):
    """C14: anomalies of the attribution metric overlapping the current period."""
    from shiftscope.operators.incidents import incidents_for_metric
    return incidents_for_metric(A.orders_tables(spark, sf_dir).anomaly_ground_truth, ORDERS_PERIODS,
                                "attribution_completeness")


# --- evidence, claims and the claim audit -----------------------------------------------
def _revenue_report(spark, sf_dir):
    from shiftscope.investigations import stored
    from shiftscope.operators.root_cause import investigate_revenue_change
    return stored(investigate_revenue_change(A.events_tables(spark, sf_dir), EVENTS_PERIODS, steps=EVENT_STEPS))


def _report_evidence_ids(report):
    from shiftscope.plans.claims import evidence_ids
    return evidence_ids(report["kpis"], report["decompositions"], report["overall_funnel"],
                        report["leading_device_funnel"], report["related_incidents"],
                        report["ranked_candidates"])


def _claims_text(df: DataFrame) -> DataFrame:
    return df.withColumn("evidence_ids", F.array_join("evidence_ids", ","))


@register("evidence_ids")
def q_evidence_ids(spark, sf_dir):
    """Every evidence id of the revenue investigation (events mapping)."""
    return _report_evidence_ids(_revenue_report(spark, sf_dir))


@register("report_claims")
def q_report_claims(spark, sf_dir):
    """Executive claims of the revenue investigation, each citing evidence ids."""
    from shiftscope.plans.claims import revenue_claims
    r = _revenue_report(spark, sf_dir)
    return _claims_text(revenue_claims(r["kpis"], r["ranked_candidates"], r["related_incidents"]))


@register("claims_unsupported")
def q_claims_unsupported(spark, sf_dir):
    """Audit of report claims plus claims cited in assistant turns (whole texts)
    against the revenue investigation's evidence ids."""
    from shiftscope.plans.claims import audit_claims, claims_from_text, revenue_claims
    r = _revenue_report(spark, sf_dir)
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter(F.col("role") == "assistant")
    conv = conv.select(F.concat_ws("-", "conv_id", "turn").alias("claim_key"), "text")
    claims = revenue_claims(r["kpis"], r["ranked_candidates"], r["related_incidents"]).unionByName(
        claims_from_text(conv, "claim_key", "text", "conversation"))
    return audit_claims(claims, _report_evidence_ids(r)).withColumn(
        "unknown_ids", F.array_join("unknown_ids", ","))


# --- requests, questions and plans (conversations) --------------------------------------
def _requests(spark, sf_dir):
    raw = A.Raw(spark, sf_dir)
    return A.requests(raw), A.planner_replies(raw)


def _plans(spark, sf_dir):
    from shiftscope.plans.planning import rule_plans
    req, rep = _requests(spark, sf_dir)
    baseline = rule_plans(req, req, "question")
    candidate = A.recorded_plans(rule_plans(req, rep, "reply"))
    return req, baseline, candidate


@register("request_errors")
def q_request_errors(spark, sf_dir):
    """Validation errors of every request (question length, period rules)."""
    from shiftscope.plans.questions import request_errors
    req, _ = _requests(spark, sf_dir)
    return request_errors(req).withColumn("errors", F.array_join("errors", ","))


@register("question_scope")
def q_question_scope(spark, sf_dir):
    """R2: dictionary scope values stated as whole words in each (whole) question."""
    from shiftscope.plans.questions import question_scope
    req, _ = _requests(spark, sf_dir)
    return question_scope(req)


@register("question_type")
def q_question_type(spark, sf_dir):
    """Ordered-rule question type, metric and tool of each request."""
    from shiftscope.plans.questions import question_scope, question_type
    req, _ = _requests(spark, sf_dir)
    return question_type(req, question_scope(req))


@register("scope_check")
def q_scope_check(spark, sf_dir):
    """Scope proposed by the reply planner, canonicalised and checked against the question."""
    from shiftscope.plans.questions import SCOPE_FIELDS, scope_check
    req, _, tags = _plans(spark, sf_dir)
    pairs = F.array(*[F.struct(F.lit(f).alias("dimension"), F.col(f).alias("value")) for f in SCOPE_FIELDS])
    proposals = tags.select("request_id", F.inline(pairs)).filter(F.col("value").isNotNull())
    return scope_check(proposals, req)


@register("plan_audit")
def q_plan_audit(spark, sf_dir):
    """The reply planner's plans audited against their requests."""
    from shiftscope.plans.planning import plan_audit
    req, _, candidate = _plans(spark, sf_dir)
    return plan_audit(candidate, req)


@register("plan_agreement")
def q_plan_agreement(spark, sf_dir):
    """Agreement of the reply planner with the question planner, per request."""
    from shiftscope.plans.planning import plan_agreement
    req, baseline, candidate = _plans(spark, sf_dir)
    return plan_agreement(baseline, candidate, req)


@register("plan_agreement_rates")
def q_plan_agreement_rates(spark, sf_dir):
    """Agreement rates over all requests."""
    from shiftscope.plans.planning import plan_agreement, plan_agreement_rates
    req, baseline, candidate = _plans(spark, sf_dir)
    return finish(plan_agreement_rates(plan_agreement(baseline, candidate, req)))


@register("plan_consensus")
def q_plan_consensus(spark, sf_dir):
    """Consensus plan per request (candidate only when it agrees and is valid)."""
    from shiftscope.plans.planning import plan_consensus
    req, baseline, candidate = _plans(spark, sf_dir)
    return plan_consensus(baseline, candidate, req)


# --- audits ------------------------------------------------------------------------------
@register("table_row_counts")
def q_table_row_counts(spark, sf_dir):
    """Row count of every logical table of the orders mapping."""
    from shiftscope.operators.audit import table_row_counts
    return table_row_counts(A.orders_tables(spark, sf_dir))


@register("constraint_audit")
def q_constraint_audit(spark, sf_dir):
    """S3: declared primary-key, NOT NULL and foreign-key checks of the orders mapping."""
    from shiftscope.operators.audit import constraint_audit
    return constraint_audit(A.orders_tables(spark, sf_dir))


@register("table_row_counts_all")
def q_table_row_counts_all(spark, sf_dir):
    """Row count of all eleven logical tables."""
    from shiftscope.operators.audit import table_row_counts
    return table_row_counts(A.all_tables(spark, sf_dir))


@register("constraint_offenders")
def q_constraint_offenders(spark, sf_dir):
    """S3 over all eleven tables with violations planted: counts, distinct offending keys and the first of them."""
    from shiftscope.operators.audit import constraint_offenders
    return constraint_offenders(A.damaged_tables(spark, sf_dir))


# --- benchmark scoring ---------------------------------------------------------------------
def _case_scores(spark, sf_dir):
    from shiftscope.plans.claims import audit_claims, revenue_claims
    from shiftscope.plans.evaluation import investigation_causes, investigation_summary, score_cases
    r = _revenue_report(spark, sf_dir)
    audit = audit_claims(revenue_claims(r["kpis"], r["ranked_candidates"], r["related_incidents"]),
                         _report_evidence_ids(r))
    summary = investigation_summary("revenue", "root_cause_analysis", r["ranked_candidates"], audit)
    cases = A.benchmark_cases(A.orders_tables(spark, sf_dir).anomaly_ground_truth,
                              {"root_cause_analysis": "revenue"})
    return score_cases(cases, summary, investigation_causes("revenue", r["related_incidents"]))


#: the investigation that answers each question type
FAMILIES = {"root_cause_analysis": "revenue", "campaign_performance_analysis": "campaign", "traffic_analysis": "traffic",
            "data_quality_analysis": "attribution", "sentiment_analysis": "sentiment"}


def _family_scores(spark, sf_dir):
    """Every anomaly's case against the investigation of its own family (orders mapping), each run once."""
    from shiftscope import investigations as I
    from shiftscope.plans.evaluation import evaluate
    t, p = A.evaluation_tables(spark, sf_dir), ORDERS_PERIODS
    results = {"revenue": I.investigate_revenue(t, p, steps=EVENT_STEPS),
               "campaign": I.investigate_campaign_performance(t, p, CANDIDATE_METRIC, CAMPAIGN_SCOPE),
               "traffic": I.investigate_traffic_change(t, p, "sessions", {"channel": "1-URGENT"}),
               "attribution": I.investigate_attribution_quality(t, p),
               "sentiment": I.investigate_review_sentiment(t, REVIEW_PERIODS, terms=REVIEW_TERMS)}
    return evaluate(A.family_cases(t.anomaly_ground_truth, FAMILIES), results)


@register("benchmark_cases_all")
def q_benchmark_cases_all(spark, sf_dir):
    """R10 over all families that anomalies ask for: no case is without a result."""
    return finish(_family_scores(spark, sf_dir))


@register("benchmark_aggregate_all")
def q_benchmark_aggregate_all(spark, sf_dir):
    """G14 over all families."""
    from shiftscope.plans.evaluation import benchmark_aggregate
    return finish(benchmark_aggregate(_family_scores(spark, sf_dir)))


@register("benchmark_cases")
def q_benchmark_cases(spark, sf_dir):
    """Anomaly-derived cases scored against the investigation of their question type
    (the revenue investigation here; cases of other types have no result: failed)."""
    return finish(_case_scores(spark, sf_dir))


@register("driver_recall")
def q_driver_recall(spark, sf_dir):
    """Primary-driver match and top-3 recall per case."""
    from shiftscope.plans.evaluation import driver_recall
    return finish(driver_recall(_case_scores(spark, sf_dir)))


@register("benchmark_aggregate")
def q_benchmark_aggregate(spark, sf_dir):
    """Benchmark rates over all cases and over completed cases."""
    from shiftscope.plans.evaluation import benchmark_aggregate
    return finish(benchmark_aggregate(_case_scores(spark, sf_dir)))


# --- batch form ----------------------------------------------------------------------------
def _batch_cases(spark, sf_dir):
    """Every valid request of the conversations table, with the scope tagged from its own question."""
    from shiftscope.plans.questions import question_scope, request_errors
    from shiftscope.functions.scope import SESSION_SCOPE
    req, _ = _requests(spark, sf_dir)
    valid = request_errors(req).filter("valid").select("request_id")
    tags = question_scope(req)
    entries = F.array_compact(F.array(*[F.when(F.col(d).isNotNull(), F.struct(F.lit(d).alias("key"),
                                                                               F.col(d).alias("value")))
                                        for d in SESSION_SCOPE]))
    return (req.join(valid, "request_id").join(tags.select("request_id", entries.alias("_e")), "request_id")
            .select(F.col("request_id").alias("case_id"), "current_start", "current_end", "previous_start",
                    "previous_end", F.map_from_entries("_e").alias("scope")))


@register("batch_kpi_compare")
def q_batch_kpi_compare(spark, sf_dir):
    """C1 for every valid request in one job over the day cube (orders mapping)."""
    from shiftscope.operators.batch import batch_kpi_compare
    return finish_long(batch_kpi_compare(A.orders_tables(spark, sf_dir), _batch_cases(spark, sf_dir)), KPI_MONEY)


@register("batch_decompose")
def q_batch_decompose(spark, sf_dir):
    """C2 by all six dimensions for every valid request in one job over the day cube (orders mapping)."""
    from shiftscope.operators.batch import batch_decompose
    return batch_decompose(A.orders_tables(spark, sf_dir), _batch_cases(spark, sf_dir), finish=lambda df: finish(df, DIM_MONEY))


#: the scope of a request, by its conversation's number, where anomalies of the orders mapping are looked for
INCIDENT_SCOPES = ({}, {"device": "F"}, {"channel": "1-URGENT", "device": "O"}, {"country": "GERMANY"}, {"channel": "ASIA"})


@register("batch_incidents")
def q_batch_incidents(spark, sf_dir):
    """C13 for every valid request: scoped anomalies by an interval-overlap join (orders mapping)."""
    from shiftscope.operators.batch import batch_incidents
    scopes = F.array(*[F.create_map(*[F.lit(x) for kv in s.items() for x in kv]).cast("map<string,string>") for s in INCIDENT_SCOPES])
    conv = F.split("case_id", "-")[0].cast("long")
    cases = _batch_cases(spark, sf_dir).withColumn("scope", F.element_at(scopes, (conv % len(INCIDENT_SCOPES) + 1).cast("int")))
    return batch_incidents(A.orders_tables(spark, sf_dir).anomaly_ground_truth, cases)


#: the events mapping covers four weeks: requests keep their distances in days, from this day on
EVENTS_EPOCH, EVENTS_DAYS = "2024-01-15", 12


def _event_cases(spark, sf_dir):
    """The valid requests with periods of twelve or eleven days in the time of the events."""
    first = F.lit(EVENTS_EPOCH).cast("date")
    moved = lambda c: F.date_add(first, F.datediff(c, F.lit(A.REQUEST_EPOCH).cast("date")))
    length = F.datediff("current_end", "current_start") - A.PERIOD_DAYS + EVENTS_DAYS
    return _batch_cases(spark, sf_dir).select(
        "case_id", "scope", moved("current_start").alias("current_start"), F.date_add(moved("current_start"), length).alias("current_end"),
        F.date_sub(moved("previous_end"), EVENTS_DAYS).alias("previous_start"), moved("previous_end").alias("previous_end"))


@register("batch_kpi_compare_events")
def q_batch_kpi_compare_events(spark, sf_dir):
    """C1 for every valid request over the day cube of the events mapping."""
    from shiftscope.operators.batch import batch_kpi_compare
    return finish_long(batch_kpi_compare(A.events_tables(spark, sf_dir), _event_cases(spark, sf_dir)), KPI_MONEY)


@register("batch_decompose_events")
def q_batch_decompose_events(spark, sf_dir):
    """C2 by six dimensions for every valid request over the day cube of the events mapping (rates below 1: p-values)."""
    from shiftscope.operators.batch import batch_decompose
    return batch_decompose(A.events_tables(spark, sf_dir), _event_cases(spark, sf_dir), finish=lambda df: finish(df, DIM_MONEY))


# --- claims of the other five report types ------------------------------------------------
def _claims_of(result) -> DataFrame:
    from shiftscope.investigations import report_claims
    return _claims_text(report_claims(result))


@register("report_claims_campaign")
def q_report_claims_campaign(spark, sf_dir):
    """R8 campaign template: claims of the CPC investigation over channels and campaigns."""
    from shiftscope.investigations import investigate_campaign_performance
    return _claims_of(investigate_campaign_performance(A.orders_tables(spark, sf_dir), ORDERS_PERIODS,
                                                       CANDIDATE_METRIC))


@register("report_claims_traffic")
def q_report_claims_traffic(spark, sf_dir):
    """R8 traffic template: claims of the session investigation scoped to channel=1-URGENT."""
    from shiftscope.investigations import investigate_traffic_change
    return _claims_of(investigate_traffic_change(A.orders_tables(spark, sf_dir), ORDERS_PERIODS, "sessions",
                                                 {"channel": "1-URGENT"}))


@register("report_claims_attribution")
def q_report_claims_attribution(spark, sf_dir):
    """R8 attribution template."""
    from shiftscope.investigations import investigate_attribution_quality
    return _claims_of(investigate_attribution_quality(A.orders_tables(spark, sf_dir), ORDERS_PERIODS))


@register("report_claims_sentiment")
def q_report_claims_sentiment(spark, sf_dir):
    """R8 sentiment template (whole review texts)."""
    from shiftscope.investigations import investigate_review_sentiment
    return _claims_of(investigate_review_sentiment(A.orders_tables(spark, sf_dir), REVIEW_PERIODS,
                                                   terms=REVIEW_TERMS))


@register("report_claims_experiment")
def q_report_claims_experiment(spark, sf_dir):
    """R8 experiment template, one claim set per experiment in the window."""
    from shiftscope.operators.experiment import experiment_lift
    from shiftscope.plans.claims import experiment_claims
    p = ORDERS_PERIODS
    lift = experiment_lift(A.orders_tables(spark, sf_dir).experiments, p.current_start, p.current_end)
    return _claims_text(experiment_claims(lift))


# --- whole reports -----------------------------------------------------------------------
TRAFFIC_SCOPE = {"channel": "1-URGENT"}


def _documents(spark, sf_dir) -> DataFrame:
    """The reports of all six families, nested."""
    from shiftscope import investigations as I
    from shiftscope.operators.experiment import experiment_lift
    from shiftscope.plans.reports import report_documents
    p = ORDERS_PERIODS
    t, events = I.with_stored_facts(A.orders_tables(spark, sf_dir), p), I.with_stored_facts(A.events_tables(spark, sf_dir), EVENTS_PERIODS)
    experiments = {"question_type": "experiment_analysis", "metric": "conversion_rate",
                   "ranked_candidates": experiment_lift(t.experiments, p.current_start, p.current_end)}
    made = [report_documents(I.stored(result), periods, scope) for result, periods, scope in (
        (I.investigate_revenue(events, EVENTS_PERIODS, steps=EVENT_STEPS), EVENTS_PERIODS, None),
        (I.investigate_campaign_performance(t, p, CANDIDATE_METRIC), p, None),
        (I.investigate_traffic_change(t, p, "sessions", TRAFFIC_SCOPE), p, TRAFFIC_SCOPE),
        (I.investigate_attribution_quality(t, p), p, None),
        (I.investigate_review_sentiment(t, REVIEW_PERIODS, terms=REVIEW_TERMS), REVIEW_PERIODS, None),
        (experiments, p, None))]
    out = made[0]
    for df in made[1:]:
        out = out.unionByName(df)
    return out


@register("report_documents")
def q_report_documents(spark, sf_dir):
    """S9 + R8 + F11: whole reports of all six families; nested parts are spelled out as text."""
    line = lambda c: F.concat_ws(" ", c["claim_id"], c["text"], F.array_join(c["evidence_ids"], ","))
    claims = F.concat("summary", F.array_compact(F.array("primary_driver")), "contributing_factors", "recommendations")
    scope = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return _documents(spark, sf_dir).select(
        "report", "question_type", "metric", "title", F.array_join("limitations", " | ").alias("limitations"), scope(F.col("applied_scope")).alias("applied_scope"),
        "current_start", "current_end", "previous_start", "previous_end", F.array_join(F.array_sort(F.transform(claims, line)), "\n").alias("claims"),
        F.array_join(F.transform("kpis", lambda k: F.concat_ws(" ", k["metric"], k["evidence_id"])), ",").alias("kpis"),
        F.array_join(F.transform("ranked_candidates", lambda c: F.concat_ws(" ", c["position"], c["evidence_id"], scope(c["evidence"]["applied_scope"]))), ",")
        .alias("candidates"),
        F.array_join(F.transform("related_incidents", lambda i: i["evidence_id"]), ",").alias("incidents"), "n_candidates", "n_incidents")
