"""Whole reports: title, scope, claims by section, limitations and the evidence they rest on, one nested row each.

The sections of a report are small frames (claims, KPI rows, ranked candidates, incidents); their rows are tagged
with the section and gathered by report.  Candidates and incidents have no bound, so a document holds
the first ``rows`` of each with their number; the evidence tables hold them all.  The first rows are found
in two phases (a few per task, then a few of those), so nothing unbounded meets in one task."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftscope.functions.scope import scope_label
from shiftscope.investigations import report_claims
from shiftscope.operators.ranking import top_k
from shiftscope.periods import Periods
from shiftscope.plans.claims import pct_text

# Titles and limitations of the six report types; {scope} is the scope as a reader sees it.
TITLES = {
    "root_cause_analysis": ("Revenue decline investigation ({scope})", "Revenue decline investigation"),
    "campaign_performance_analysis": ("Campaign performance investigation ({scope})", "Campaign performance investigation (all campaigns)"),
    "traffic_analysis": ("Traffic investigation ({scope})", "Traffic investigation (all traffic)"),
    "data_quality_analysis": ("Campaign attribution quality investigation",) * 2,
    "sentiment_analysis": ("Negative app-review investigation",) * 2,
}
EXPERIMENT_TITLE = "Experiment analysis ({name})"
LIMITATIONS = {
    "root_cause_analysis": (("Contribution and funnel evidence identify likely drivers, not experimental causality.",
                             "All evidence in this report is filtered to {scope}."),
                            ("Contribution and funnel evidence identify likely drivers, not experimental causality.",
                             "This report uses global data because no explicit scope was requested.")),
    "campaign_performance_analysis": (("Campaign KPI comparisons are observational and do not establish causality.", "Applied campaign scope: {scope}."),
                                      ("Campaign KPI comparisons are observational and do not establish causality.", "Applied campaign scope: none.")),
    "traffic_analysis": (("Traffic comparisons are observational and do not establish causality.", "Applied traffic scope: {scope}."),
                         ("Traffic comparisons are observational and do not establish causality.", "Applied traffic scope: none.")),
    "data_quality_analysis": (("Missing campaign IDs identify an instrumentation gap but not the point of failure.",),) * 2,
    "sentiment_analysis": (("Topic labels use an explicit keyword lexicon and do not infer intent or causality.",),) * 2,
}
POWER_LIMITATION = ("Observed power was {power}; ", "the result is below the 80% power threshold.", "the result meets the 80% power threshold.")
EXPERIMENT_LIMITATION = "Experiment estimates apply to the randomized population and observed exposure window."

NAMES = {"root_cause_analysis": "revenue", "campaign_performance_analysis": "campaign", "traffic_analysis": "traffic",
         "data_quality_analysis": "attribution", "sentiment_analysis": "sentiment"}
SECTIONS = ("summary", "primary_driver", "contributing_factors", "recommendations")
ROWS = 25
_CLAIM = "struct<claim_id:string,text:string,evidence_ids:array<string>>"
_KPI = "struct<metric:string,evidence_id:string,current:double,previous:double,absolute_change:double,percent_change:double>"
_CANDIDATE = ("struct<position:int,evidence_id:string,candidate_type:string,dimension:string,segment:string,score:double,transition:string,"
              "evidence:struct<metric:string,current:double,previous:double,absolute_change:double,percent_change:double,applied_scope:map<string,string>>>")
_INCIDENT = "struct<incident_date:date,incident_id:string,evidence_id:string,title:string,root_cause:string,resolution:string,impact:string>"


def scope_map(scope: Mapping[str, str] | None) -> Column:
    """the applied scope as a map column (dimensions without a value are left out)."""
    items = [F.lit(x) for kv in (scope or {}).items() if kv[1] is not None for x in kv]
    return (F.create_map(*items) if items else F.create_map()).cast("map<string,string>")


def candidate_evidence(candidates: DataFrame, scope: Mapping[str, str] | None) -> DataFrame:
    """candidates with ``applied_scope``, the scope that holds for the candidate: its own segment takes
    the place of the scope's value of that dimension (a dimension that cannot be scoped leaves it as it is)."""
    own = {k: v for k, v in (scope or {}).items() if v is not None}
    kept = F.map_filter(scope_map(own), lambda k, _: k != F.col("dimension"))
    return candidates.withColumn("applied_scope", F.when(
        F.col("segment").isNotNull() & F.col("dimension").isin("channel", "campaign", "device", "country", "customer_segment", "landing_page"),
        F.map_concat(kept, F.create_map("dimension", "segment"))).otherwise(scope_map(own)))


def _texts(question_type: str, scope: Mapping[str, str] | None) -> tuple[str, tuple[str, ...]]:
    label = scope_label({k: v for k, v in (scope or {}).items() if v is not None})
    which = 0 if label else 1
    return TITLES[question_type][which].replace("{scope}", label), tuple(x.replace("{scope}", label) for x in LIMITATIONS[question_type][which])


def report_headers(result: dict, periods: Periods, scope: Mapping[str, str] | None = None) -> DataFrame:
    """``(report, question_type, metric, title, limitations, applied_scope, current_start .. previous_end)``, one row
    per report; an experiment result has a report for each experiment."""
    kind = result["question_type"]
    dates = [F.lit(d).cast("date").alias(n) for n, d in zip(("current_start", "current_end", "previous_start", "previous_end"), periods.key_parts())]
    tail = [scope_map(scope).alias("applied_scope"), *dates]
    if kind == "experiment_analysis":
        lead, low, high = POWER_LIMITATION
        power = F.concat(F.lit(lead.split("{")[0]), pct_text("observed_power"), F.lit(lead.split("}")[1]), F.when(F.col("low_power_warning"), low).otherwise(high))
        before, after = EXPERIMENT_TITLE.split("{name}")
        return result["ranked_candidates"].select(
            F.concat(F.lit("experiment:"), "experiment_name").alias("report"), F.lit(kind).alias("question_type"), F.lit(result["metric"]).alias("metric"),
            F.concat(F.lit(before), "experiment_name", F.lit(after)).alias("title"), F.array(power, F.lit(EXPERIMENT_LIMITATION)).alias("limitations"), *tail)
    title, limitations = _texts(kind, scope)
    return result["kpis"].sparkSession.range(1).select(
        F.lit(NAMES[kind]).alias("report"), F.lit(kind).alias("question_type"), F.lit(result["metric"]).alias("metric"), F.lit(title).alias("title"),
        F.array(*[F.lit(x) for x in limitations]).alias("limitations"), *tail)


def _candidates(result: dict, scope: Mapping[str, str] | None) -> DataFrame:
    """Candidates of any family as ``(position, payload)``."""
    c = result["ranked_candidates"]
    place = "position" if "position" in c.columns else "rank_within_dimension"
    nothing = {"metric": "string", "current": "double", "previous": "double", "absolute_change": "double", "percent_change": "double", "transition": "string"}
    for name, kind in nothing.items():
        if name not in c.columns:
            c = c.withColumn(name, F.lit(None).cast(kind))
    c = candidate_evidence(c, scope)
    evidence = F.struct("metric", *[F.col(x).cast("double").alias(x) for x in ("current", "previous", "absolute_change", "percent_change")], "applied_scope")
    return c.select(F.col(place).cast("int").alias("position"), F.struct(
        F.col(place).cast("int").alias("position"), "evidence_id", "candidate_type", "dimension", "segment", F.col("score").cast("double").alias("score"),
        "transition", evidence.alias("evidence")).alias("payload"))


def _experiments(result: dict) -> dict[str, DataFrame]:
    """Evidence rows of every experiment, by report."""
    lift, report = result["ranked_candidates"], F.concat(F.lit("experiment:"), "experiment_name").alias("report")
    number = lambda c: F.col(c).cast("double")
    kpis = lift.select(report, F.inline(F.array(*[F.struct(
        F.lit(metric).alias("metric"), F.col(ident).alias("evidence_id"), number(cur).alias("current"), number(prev).alias("previous"),
        number(change).alias("absolute_change"), number(pct).alias("percent_change")) for metric, ident, cur, prev, change, pct in (
            ("conversion_rate", "conversion_evidence_id", "treatment_rate", "control_rate", "absolute_conversion_lift", "relative_conversion_lift"),
            ("revenue_per_user", "revenue_evidence_id", "treatment_revenue_per_user", "control_revenue_per_user", "revenue_per_user_lift",
             "revenue_per_user_percent_change"))])))
    payload = F.struct(F.lit(1).alias("position"), "evidence_id", F.lit("experiment_lift").alias("candidate_type"), F.lit("experiment").alias("dimension"),
                       F.lit("treatment").alias("segment"), number("score").alias("score"), F.lit(None).cast("string").alias("transition"),
                       F.struct(F.lit("conversion_rate").alias("metric"), number("treatment_rate").alias("current"), number("control_rate").alias("previous"),
                                number("absolute_conversion_lift").alias("absolute_change"), number("relative_conversion_lift").alias("percent_change"),
                                scope_map(None).alias("applied_scope")).alias("evidence"))
    return {"kpis": kpis, "candidates": lift.select(report, F.lit(1).alias("position"), payload.alias("payload"))}


def report_documents(result: dict, periods: Periods, scope: Mapping[str, str] | None = None, rows: int = ROWS) -> DataFrame:
    """S9 + R8: one nested row per report: the header, an array of claims per section (``primary_driver`` a single
    one), ``kpis``, the first ``rows`` of ``ranked_candidates`` and ``related_incidents`` and how many there are."""
    headers = report_headers(result, periods, scope)
    claims = report_claims(result)
    if result["question_type"] == "experiment_analysis":
        parts = _experiments(result)
        kpis, candidates, incidents = parts["kpis"], parts["candidates"], None
    else:
        label = F.lit(NAMES[result["question_type"]])
        kpis = result["kpis"].withColumn("report", label)
        candidates = _candidates(result, scope).withColumn("report", label)
        incidents = result["related_incidents"].withColumn("report", label)
    header = F.struct(*[c for c in headers.columns if c != "report"])
    kinds = {"claim": _CLAIM, "kpi": _KPI, "candidate": _CANDIDATE, "incident": _INCIDENT, "header": headers.select(header.alias("h")).schema["h"].dataType.simpleString(),
             "n_candidates": "long", "n_incidents": "long"}
    parts = []

    def add(df: DataFrame, kind: str, payload: Column) -> None:
        section = F.col("section") if kind == "claim" else F.lit(None).cast("string")
        parts.append(df.select("report", section.alias("section"), *[(payload if k == kind else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()]))

    add(headers, "header", header)
    add(claims, "claim", F.struct("claim_id", "text", "evidence_ids"))
    add(kpis, "kpi", F.struct("metric", "evidence_id", *[F.col(x).cast("double").alias(x) for x in ("current", "previous", "absolute_change", "percent_change")]))
    add(top_k(candidates, ["report"], [F.asc("position")], rows, "_place"), "candidate", F.col("payload"))
    add(candidates.groupBy("report").agg(F.count(F.lit(1)).alias("n")), "n_candidates", F.col("n"))
    if incidents is not None:
        earliest = top_k(incidents, ["report"], [F.asc("incident_date"), F.asc("incident_id")], rows, "_place")
        add(earliest, "incident", F.struct("incident_date", "incident_id", "evidence_id", "title", "root_cause", "resolution", "impact"))
        add(incidents.groupBy("report").agg(F.count(F.lit(1)).alias("n")), "n_incidents", F.col("n"))
    every = reduce(lambda a, b: a.unionByName(b), parts)
    listed = lambda kind, when: F.array_sort(F.collect_list(F.when(when, F.col(kind))))
    in_place = lambda arr: F.array_sort(arr, lambda a, b: a["position"] - b["position"])
    sections = [listed("claim", (F.col("section") == s) & F.col("claim").isNotNull()).alias(s) for s in SECTIONS]
    whole = every.groupBy("report").agg(
        F.first("header", ignorenulls=True).alias("header"), *sections, listed("kpi", F.col("kpi").isNotNull()).alias("kpis"),
        listed("incident", F.col("incident").isNotNull()).alias("related_incidents"), in_place(F.collect_list("candidate")).alias("ranked_candidates"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("n_candidates", "n_incidents")])
    told = lambda s: F.transform(F.col(s), lambda c: F.struct(c["claim_id"].alias("claim_id"), c["text"].alias("text"), c["evidence_ids"].alias("evidence_ids")))
    return whole.select(
        "report", "header.*", told("summary").alias("summary"), F.get(told("primary_driver"), 0).alias("primary_driver"),
        told("contributing_factors").alias("contributing_factors"), told("recommendations").alias("recommendations"), "kpis", "ranked_candidates",
        "related_incidents", "n_candidates", "n_incidents")


def write_reports(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per report below ``path``."""
    documents.write.mode(mode).option("ignoreNullFields", "false").json(path)
