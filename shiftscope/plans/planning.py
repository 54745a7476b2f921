"""Plan tables: rule plans (R2+R3), plan audit (R5), agreement of two planners
and the consensus pick (R7).

A plan row is ``(request_id, question, current_start, current_end, previous_start,
previous_end, question_type, primary_metric, tool, <six scope fields>)``.  All jobs are
joins on ``request_id`` plus column expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftscope.plans.questions import (METRICS_BY_QUESTION_TYPE, SCOPE_FIELDS, TOOL_BY_QUESTION_TYPE,
                                        UNSUPPORTED, question_scope, question_type, scope_check)

REQUEST_FIELDS = ("question", "current_start", "current_end", "previous_start", "previous_end")
PLAN_COLUMNS = ("request_id",) + REQUEST_FIELDS + ("question_type", "primary_metric", "tool") + SCOPE_FIELDS


def rule_plans(requests: DataFrame, texts: DataFrame, text_col: str) -> DataFrame:
    """A plan per request from the dictionary scope (R2) and the ordered rules
    applied to ``texts`` (the request's own question, or another planner's text)."""
    scopes = question_scope(texts, "request_id", text_col)
    types = question_type(texts, scopes, "request_id", text_col)
    return requests.select("request_id", *REQUEST_FIELDS).join(types, "request_id", "left").select(*PLAN_COLUMNS)


def _tool_map() -> Column:
    return F.create_map(*[x for k, v in TOOL_BY_QUESTION_TYPE.items() for x in (F.lit(k), F.lit(v))])


def _metric_map() -> Column:
    return F.create_map(*[x for k, v in METRICS_BY_QUESTION_TYPE.items()
                          for x in (F.lit(k), F.array(*[F.lit(m) for m in v]))])


def plan_audit(plans: DataFrame, requests: DataFrame) -> DataFrame:
    """Fields a plan changed relative to its request, wrong tool, wrong metric."""
    r = requests.select("request_id", *[F.col(c).alias("_r_" + c) for c in REQUEST_FIELDS])
    j = plans.join(r, "request_id", "left")
    changed = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col("_r_" + c)), F.lit(c))
                                        for c in REQUEST_FIELDS]))
    unsupported = F.col("question_type").isNull() | (F.col("question_type") == UNSUPPORTED)
    expected_tool = F.try_element_at(_tool_map(), F.col("question_type"))
    allowed = F.try_element_at(_metric_map(), F.col("question_type"))
    errors = F.array_compact(F.array(
        F.when(F.size(changed) > 0, F.lit("changed_fields")),
        F.when(unsupported, F.lit("unsupported_question")),
        F.when(~unsupported & ~F.col("tool").eqNullSafe(expected_tool), F.lit("wrong_tool")),
        F.when(~unsupported & ~F.coalesce(F.array_contains(allowed, F.col("primary_metric")), F.lit(False)),
               F.lit("wrong_metric"))))
    return j.select("request_id", F.array_join(changed, ",").alias("changed_fields"),
                    F.array_join(errors, ",").alias("errors"), (F.size(errors) == 0).alias("valid"))


def _scope_equal(a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}")) for f in SCOPE_FIELDS])


def checked_plans(plans: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plans with their scope as R4 leaves it (placeholders dropped, values in canonical spelling), and
    ``(request_id, valid)``: a plan is valid when the audit (R5) finds no error and its question states
    every scope value that remains."""
    pairs = F.array(*[F.struct(F.lit(f).alias("dimension"), F.col(f).alias("value")) for f in SCOPE_FIELDS])
    proposed = plans.select("request_id", F.inline(pairs)).filter(F.col("value").isNotNull())
    checked = scope_check(proposed, requests).groupBy("request_id").agg(
        F.max(F.col("error").isNotNull()).alias("_unstated"),
        *[F.max(F.when((F.col("dimension") == f) & ~F.col("dropped"), F.col("canonical_value"))).alias(f) for f in SCOPE_FIELDS])
    audit = plan_audit(plans, requests).select("request_id", "valid")
    valid = audit.join(checked.select("request_id", "_unstated"), "request_id", "left").select(
        "request_id", (F.col("valid") & ~F.coalesce("_unstated", F.lit(False))).alias("valid"))
    rest = [c for c in PLAN_COLUMNS if c not in SCOPE_FIELDS]
    return plans.select(*rest).join(checked.drop("_unstated"), "request_id", "left").select(*PLAN_COLUMNS), valid


def plan_agreement(baseline: DataFrame, candidate: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request, whether the candidate plan is valid and which fields agree with
    the baseline plan (all False for an invalid candidate, which includes one whose scope the
    question does not state)."""
    candidate, audit = checked_plans(candidate, requests)
    j = (baseline.alias("b").join(candidate.alias("c"), "request_id", "left")
         .join(audit, "request_id", "left"))
    valid = F.coalesce(F.col("valid"), F.lit(False))

    def match(c: Column) -> Column:
        return valid & c
    type_m = match(F.col("b.question_type").eqNullSafe(F.col("c.question_type")))
    metric_m = match(F.col("b.primary_metric").eqNullSafe(F.col("c.primary_metric")))
    tools_m = match(F.col("b.tool").eqNullSafe(F.col("c.tool")))
    scope_m = match(_scope_equal("b", "c"))
    return j.select("request_id", valid.alias("valid"), (type_m & metric_m & tools_m & scope_m).alias("exact_match"),
                    type_m.alias("question_type_match"), metric_m.alias("primary_metric_match"),
                    tools_m.alias("tools_match"), scope_m.alias("scope_match"))


def plan_agreement_rates(agreement: DataFrame) -> DataFrame:
    """Share of requests for each agreement flag."""
    flags = ("valid", "exact_match", "question_type_match", "primary_metric_match", "tools_match", "scope_match")
    return agreement.agg(F.count(F.lit(1)).alias("total_cases"),
                         *[F.coalesce(F.avg(F.col(f).cast("double")), F.lit(0.0)).alias(f + "_rate")
                           for f in flags])


def plan_consensus(baseline: DataFrame, candidate: DataFrame, requests: DataFrame) -> DataFrame:
    """The candidate plan only when it is valid and its type, metric and scope equal
    the baseline's; otherwise the baseline (a fallback)."""
    candidate, audit = checked_plans(candidate, requests)
    j = (baseline.alias("b").join(candidate.alias("c"), "request_id", "left")
         .join(audit, "request_id", "left"))
    accept = (F.coalesce(F.col("valid"), F.lit(False))
              & F.col("b.question_type").eqNullSafe(F.col("c.question_type"))
              & F.col("b.primary_metric").eqNullSafe(F.col("c.primary_metric")) & _scope_equal("b", "c"))
    pick = [F.when(accept, F.col(f"c.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
            for c in ("question_type", "primary_metric", "tool") + SCOPE_FIELDS]
    return j.select("request_id", F.when(accept, F.lit("candidate")).otherwise(F.lit("baseline")).alias("source"),
                    *pick)
