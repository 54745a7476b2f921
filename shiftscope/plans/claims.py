"""Evidence-backed claims: evidence-id union (U2), claims from evidence (R8) and the
claim audit (R9, J7).

Claims are rows ``(report, section, claim_id, text, evidence_ids array<string>)``.
Every claim is built from a small evidence frame (KPI rows, ranked candidates,
incidents) by filters and one-row aggregates, so no driver round trip and no cross
join is needed.  A NULL percent change prints as ``n/a``; a report without candidates
gets no primary-driver claim.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftscope.functions.expr import text_or_none

# Claim wording of the six report types.
REVENUE_TEXT = {
    "revenue_change": "Revenue changed by {pct} versus the previous period.",
    "conversion_change": "Conversion rate changed by {pct}, indicating a conversion-led decline.",
    "primary_driver": "The leading dimensional driver was {dim}={seg}.",
    "funnel_drop": "The largest diagnostic funnel deterioration was {transition} for {seg}.",
    "contributor": "{dim}={seg} was an additional negative driver.",
    "recommendation_diagnostic": "Prioritize diagnostics for {seg} and validate the affected conversion path.",
    "recommendation_incident": "Review the documented resolution: {resolution}.",
}
CAMPAIGN_TEXT = {
    "campaign_metric_change": "{METRIC} changed by {pct} versus the previous period.",
    "primary_driver": "The leading campaign driver was {dim}={seg}.",
    "campaign_recommendation": "Review {dim}={seg} and the inputs to {METRIC}.",
    "campaign_incident": "Investigate the documented cause: {root_cause}.",
}
TRAFFIC_TEXT = {
    "traffic_metric_change": "{Metric} changed by {pct} versus the previous period.",
    "primary_driver": "The leading traffic driver was {dim}={seg}.",
    "traffic_recommendation": "Review acquisition and landing-page performance for {dim}={seg}.",
    "traffic_incident": "Investigate the documented cause: {root_cause}.",
}
ATTRIBUTION_TEXT = {
    "attribution_completeness_change": "Attribution completeness changed by {pct}.",
    "unattributed_session_change": "Unattributed sessions changed by {pct}.",
    "unattributed_session_counts": "Unattributed sessions increased from {prev} to {cur}.",
    "primary_driver": "The leading data-quality driver was {dim}={seg}.",
    "attribution_recommendation": ("Audit campaign-ID collection and preserve raw attribution "
                                   "parameters through session creation."),
    "attribution_incident": "Investigate the documented cause: {root_cause}.",
}
SENTIMENT_TEXT = {
    "negative_review_rate_change": "The negative-review rate changed by {pct}.",
    "primary_driver": "The leading review topic was {seg}.",
    "review_recommendation": "Prioritize product diagnostics and support review for topic={seg}.",
    "review_incident": "Investigate the documented cause: {root_cause}.",
}
EXPERIMENT_TEXT = {
    "experiment_conversion_lift": ("Treatment conversion rate was {cur} versus {prev} for control, "
                                   "a {lift} absolute lift that was {decision}."),
    "experiment_revenue_lift": "Treatment revenue per user changed by {pct} versus control.",
    "primary_driver": "The analyzed experiment variant was treatment.",
    "decision_significant": "Consider rollout only after validating operational guardrails and practical impact.",
    "decision_not_significant": "Collect more observations before making a rollout decision.",
    "significant": "statistically significant",
    "not_significant": "not statistically significant",
}
NULL_PERCENT = "n/a"
EVIDENCE_ID_PATTERN = r"\b(?:kpi|dim|fun|cmp|drv|trk|trf|att|atd|rev|top|exp|exd)_[0-9a-f]{12}\b"

CLAIM_COLUMNS = ("report", "section", "claim_id", "text", "evidence_ids")


def pct_text(c) -> Column:
    """F8: ``{x:.1%}`` text of a ratio; ``n/a`` for NULL."""
    c = c if isinstance(c, Column) else F.col(c)
    # half-up to one decimal of a percent first, so the printed digit never depends on
    # how a formatter breaks ties
    tenths = F.floor(c.cast("double") * F.lit(1000.0) + F.lit(0.5)) / F.lit(10.0)
    # (format_string prints a NULL argument as text, so NULL is handled first)
    return F.when(c.isNull(), F.lit(NULL_PERCENT)).otherwise(F.format_string("%.1f%%", tenths))


def _fill(template: str, **parts: Column) -> Column:
    """Column text from a template with ``{name}`` slots."""
    pieces, rest = [], template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        if head:
            pieces.append(F.lit(head))
        pieces.append(text_or_none(parts[name]))
    if rest:
        pieces.append(F.lit(rest))
    return F.concat(*pieces)


def _claim(df: DataFrame, report: str, section: str, claim_id, text: Column, ids: Column) -> DataFrame:
    cid = claim_id if isinstance(claim_id, Column) else F.lit(claim_id)
    return df.select(F.lit(report).alias("report"), F.lit(section).alias("section"), cid.alias("claim_id"),
                     text.alias("text"), ids.alias("evidence_ids"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _first_incident(incidents: DataFrame) -> DataFrame:
    """The earliest incident (ties by id) as 0 or 1 row."""
    one = incidents.agg(F.min_by(F.struct("evidence_id", "root_cause", "resolution"),
                                 F.struct("incident_date", "incident_id")).alias("i"))
    return one.filter(F.col("i").isNotNull()).select("i.*")


def _top(candidates: DataFrame, rank_col: str) -> DataFrame:
    """Candidate at rank 1 (0 or 1 row)."""
    return candidates.filter(F.col(rank_col) == 1)


def evidence_ids(*frames: DataFrame) -> DataFrame:
    """The distinct evidence ids of one report's evidence frames."""
    return _union([f.select("evidence_id") for f in frames]).distinct()


# --- R8: the six report templates -------------------------------------------------
def revenue_claims(kpis: DataFrame, candidates: DataFrame, incidents: DataFrame,
                   report: str = "revenue") -> DataFrame:
    t = REVENUE_TEXT
    rev = kpis.filter(F.col("metric") == "revenue")
    conv = kpis.filter(F.col("metric") == "conversion_rate")
    ranked = candidates.select("evidence_id", "candidate_type", "dimension", "segment", "transition", "position")
    primary = ranked.filter(F.col("position") == 1)
    funnel = (ranked.agg(F.min_by(F.struct("evidence_id", "transition", "segment"),
                                  F.when(F.col("candidate_type") == "funnel_driver", F.col("position")))
                         .alias("f"))
              .filter(F.col("f").isNotNull()).select("f.*"))
    contributors = ranked.filter(F.col("position").isin(2, 3))
    rec = ranked.agg(
        F.max(F.when(F.col("position") == 1, F.col("segment"))).alias("seg"),
        F.max(F.when(F.col("position") == 1, F.col("evidence_id"))).alias("pid"),
        F.min_by(F.col("evidence_id"), F.when(F.col("candidate_type") == "funnel_driver",
                                              F.col("position"))).alias("fid"),
        F.count_if(F.col("position") == 1).alias("n"))
    incident = _first_incident(incidents)
    return _union([
        _claim(rev, report, "summary", "revenue_change",
               _fill(t["revenue_change"], pct=pct_text("percent_change")), F.array("evidence_id")),
        _claim(conv, report, "summary", "conversion_change",
               _fill(t["conversion_change"], pct=pct_text("percent_change")), F.array("evidence_id")),
        _claim(primary, report, "primary_driver", "primary_driver",
               _fill(t["primary_driver"], dim=F.col("dimension"), seg=F.col("segment")), F.array("evidence_id")),
        _claim(funnel, report, "contributing_factors", "funnel_drop",
               _fill(t["funnel_drop"], transition=F.col("transition"), seg=F.col("segment")),
               F.array("evidence_id")),
        _claim(contributors, report, "contributing_factors",
               F.concat(F.lit("contributor_"), (F.col("position") - 1).cast("string")),
               _fill(t["contributor"], dim=F.col("dimension"), seg=F.col("segment")), F.array("evidence_id")),
        _claim(rec.filter(F.col("n") > 0), report, "recommendations", "recommendation_diagnostic",
               _fill(t["recommendation_diagnostic"], seg=F.col("seg")),
               F.array_compact(F.array("pid", "fid"))),
        _claim(incident, report, "recommendations", "recommendation_incident",
               _fill(t["recommendation_incident"], resolution=F.col("resolution")), F.array("evidence_id")),
    ])


def _simple_report(report: str, metric_rows: DataFrame, metric_claim: str, metric_text: Column,
                   candidates: DataFrame, rank_col: str, primary_text: Column,
                   rec_claim: str, rec_text: Column, incidents: DataFrame | None,
                   incident_claim: str, incident_template: str) -> list[DataFrame]:
    primary = _top(candidates, rank_col)
    frames = [
        _claim(metric_rows, report, "summary", metric_claim, metric_text, F.array("evidence_id")),
        _claim(primary, report, "primary_driver", "primary_driver", primary_text, F.array("evidence_id")),
        _claim(primary, report, "recommendations", rec_claim, rec_text, F.array("evidence_id")),
    ]
    if incidents is not None:
        frames.append(_claim(_first_incident(incidents), report, "recommendations", incident_claim,
                             _fill(incident_template, root_cause=F.col("root_cause")), F.array("evidence_id")))
    return frames


def campaign_claims(kpis: DataFrame, candidates: DataFrame, incidents: DataFrame | None, metric: str,
                    report: str = "campaign") -> DataFrame:
    t, up = CAMPAIGN_TEXT, F.lit(metric.upper())
    dim, seg = F.col("dimension"), F.col("segment")
    return _union(_simple_report(
        report, kpis.filter(F.col("metric") == metric), "campaign_metric_change",
        _fill(t["campaign_metric_change"], METRIC=up, pct=pct_text("percent_change")),
        candidates, "rank_within_dimension", _fill(t["primary_driver"], dim=dim, seg=seg),
        "campaign_recommendation", _fill(t["campaign_recommendation"], dim=dim, seg=seg, METRIC=up),
        incidents, "campaign_incident", t["campaign_incident"]))


def traffic_claims(kpis: DataFrame, candidates: DataFrame, incidents: DataFrame | None, metric: str,
                   report: str = "traffic") -> DataFrame:
    t = TRAFFIC_TEXT
    dim, seg = F.col("dimension"), F.col("segment")
    return _union(_simple_report(
        report, kpis.filter(F.col("metric") == metric), "traffic_metric_change",
        _fill(t["traffic_metric_change"], Metric=F.initcap(F.lit(metric)), pct=pct_text("percent_change")),
        candidates, "rank_within_dimension", _fill(t["primary_driver"], dim=dim, seg=seg),
        "traffic_recommendation", _fill(t["traffic_recommendation"], dim=dim, seg=seg),
        incidents, "traffic_incident", t["traffic_incident"]))


def attribution_claims(kpis: DataFrame, driver: DataFrame, incidents: DataFrame | None,
                       report: str = "attribution") -> DataFrame:
    t = ATTRIBUTION_TEXT
    un = kpis.filter(F.col("metric") == "unattributed_sessions")
    un_text = F.when(F.col("percent_change").isNotNull(),
                     _fill(t["unattributed_session_change"], pct=pct_text("percent_change"))) \
        .otherwise(_fill(t["unattributed_session_counts"],
                             prev=F.format_string("%.0f", F.col("previous")),
                         cur=F.format_string("%.0f", F.col("current"))))
    frames = _simple_report(
        report, kpis.filter(F.col("metric") == "attribution_completeness"), "attribution_completeness_change",
        _fill(t["attribution_completeness_change"], pct=pct_text("percent_change")),
        driver, "rank_within_dimension",
        _fill(t["primary_driver"], dim=F.col("dimension"), seg=F.col("segment")),
        "attribution_recommendation", F.lit(t["attribution_recommendation"]),
        incidents, "attribution_incident", t["attribution_incident"])
    frames.insert(1, _claim(un, report, "summary", "unattributed_session_change", un_text, F.array("evidence_id")))
    return _union(frames)


def sentiment_claims(kpis: DataFrame, topic: DataFrame, incidents: DataFrame | None,
                     report: str = "sentiment") -> DataFrame:
    t = SENTIMENT_TEXT
    seg = F.col("segment")
    return _union(_simple_report(
        report, kpis.filter(F.col("metric") == "negative_review_rate"), "negative_review_rate_change",
        _fill(t["negative_review_rate_change"], pct=pct_text("percent_change")),
        topic, "rank_within_dimension", _fill(t["primary_driver"], seg=seg),
        "review_recommendation", _fill(t["review_recommendation"], seg=seg),
        incidents, "review_incident", t["review_incident"]))


def experiment_claims(lift: DataFrame, report_prefix: str = "experiment") -> DataFrame:
    """One claim set per experiment row of ``experiment_lift``."""
    t = EXPERIMENT_TEXT
    report = F.concat(F.lit(report_prefix + ":"), F.col("experiment_name"))
    sig = F.col("statistically_significant")
    decision = F.when(sig, F.lit(t["significant"])).otherwise(F.lit(t["not_significant"]))

    def claim(section, cid, text, ids):
        return lift.select(report.alias("report"), F.lit(section).alias("section"), F.lit(cid).alias("claim_id"),
                           text.alias("text"), ids.alias("evidence_ids"))
    return _union([
        claim("summary", "experiment_conversion_lift",
              _fill(t["experiment_conversion_lift"], cur=pct_text("treatment_rate"), prev=pct_text("control_rate"),
                    lift=pct_text("absolute_conversion_lift"), decision=decision), F.array("evidence_id")),
        claim("summary", "experiment_revenue_lift",
              _fill(t["experiment_revenue_lift"], pct=pct_text("revenue_per_user_percent_change")),
              F.array("revenue_evidence_id")),
        claim("primary_driver", "primary_driver", F.lit(t["primary_driver"]), F.array("evidence_id")),
        claim("recommendations", "experiment_decision",
              F.when(sig, F.lit(t["decision_significant"])).otherwise(F.lit(t["decision_not_significant"])),
              F.array("evidence_id")),
    ])


# --- R9: claim audit ---------------------------------------------------------------
def claims_from_text(texts: DataFrame, id_col: str, text_col: str, report: str) -> DataFrame:
    """Claims whose evidence ids are cited inline in free text (whole texts are scanned)."""
    return texts.select(F.lit(report).alias("report"), F.lit("text").alias("section"),
                        F.col(id_col).cast("string").alias("claim_id"), F.col(text_col).alias("text"),
                        F.regexp_extract_all(F.col(text_col), F.lit(EVIDENCE_ID_PATTERN), 0).alias("evidence_ids"))


def audit_claims(claims: DataFrame, valid_ids: DataFrame) -> DataFrame:
    """Per claim, the number of cited ids, the unknown ones and an approved flag.

    The cited ids are exploded and left-joined to the evidence ids (J7); per-claim
    lists are bounded by what one claim cites.  Claims that share an id stay apart.
    """
    keyed = claims.withColumn("_row", F.monotonically_increasing_id())
    cited = keyed.select("_row", "report", "claim_id", F.explode_outer("evidence_ids").alias("evidence_id"))
    known = valid_ids.select("evidence_id", F.lit(True).alias("_known")).distinct()
    j = cited.join(known, "evidence_id", "left")
    per_claim = j.groupBy("_row", "report", "claim_id").agg(
        F.count("evidence_id").alias("n_evidence"),
        F.array_sort(F.collect_set(F.when(F.col("_known").isNull(), F.col("evidence_id")))).alias("unknown_ids"))
    return per_claim.select(
        "report", "claim_id", "n_evidence", "unknown_ids",
        (F.col("n_evidence") == 0).alias("missing_evidence"),
        ((F.col("n_evidence") > 0) & (F.size("unknown_ids") == 0)).alias("approved"))
