"""Benchmark scoring as a table job.

Each investigation is reduced to one summary row with bounded fields (primary driver,
top-3 drivers, funnel transitions, claim-audit counts).  Cases join that summary on ``investigation_id`` (many
cases to one small row, which Spark broadcasts by measured size).  Whether an incident's cause holds a
case's expected text is looked up in a q-gram index of the causes: no case meets every cause, and
no list of causes is collected.  ``evaluate`` runs every family's investigation once and routes each case to its own.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLAGS = ("classification_correct", "primary_driver_correct", "funnel_transition_correct",
         "root_cause_correct", "evidence_valid", "tool_execution_success")


#: length of the grams that causes are indexed by
GRAM = 4


def investigation_summary(investigation_id: str, question_type: str, candidates: DataFrame,
                          claim_audit: DataFrame) -> DataFrame:
    """One row describing an investigation's outcome, from one aggregate over the
    candidates and claim-audit rows (tagged union, no joins).

    ``candidates`` carries ``position`` (1 = primary).
    """
    cand = F.struct(F.col("position").cast("int").alias("position"), F.lower("dimension").alias("d"), F.lower("segment").alias("s"),
                    "candidate_type", "transition")
    null_cand = F.lit(None).cast("struct<position:int,d:string,s:string,candidate_type:string,transition:string>")
    # only the leading candidates and funnel drivers say anything here
    few = candidates.filter("position <= 3 OR candidate_type = 'funnel_driver'")
    rows = (few.select(cand.alias("c"), F.lit(None).cast("boolean").alias("approved"))
            .unionByName(claim_audit.select(null_cand.alias("c"), "approved")))
    agg = rows.agg(
        F.min_by(F.struct(F.col("c.d").alias("d"), F.col("c.s").alias("s")), F.col("c.position")).alias("primary"),
        F.array_sort(F.collect_list(F.when(F.col("c.position") <= 3, F.struct(
            F.col("c.position").alias("position"), F.col("c.d").alias("d"), F.col("c.s").alias("s")))))
        .alias("top3"),
        F.collect_set(F.when(F.col("c.candidate_type") == "funnel_driver", F.col("c.transition"))).alias("transitions"),
        F.count("approved").alias("n_claims"),
        F.count_if(~F.col("approved")).alias("n_bad_claims"))
    return agg.select(F.lit(investigation_id).alias("investigation_id"),
                      F.lit(question_type).alias("question_type"), "primary", "top3", "transitions",
                      "n_claims", "n_bad_claims")


def investigation_causes(investigation_id: str, incidents: DataFrame) -> DataFrame:
    """``(investigation_id, cause)``: the distinct lower-cased root causes of an investigation's incidents."""
    return incidents.select(F.lit(investigation_id).alias("investigation_id"), F.lower("root_cause").alias("cause")) \
        .filter("cause IS NOT NULL").distinct()


def texts_found(wanted: DataFrame, causes: DataFrame, gram: int = GRAM) -> DataFrame:
    """``wanted(investigation_id, expected)`` whose text lies in a cause of the same investigation (exactly,
    both lower-cased), distinct.

    A text of n characters has grams of ``min(n, gram)``; all of them must be grams of a cause that holds the text.
    It is looked for under its rarest gram alone, and verified there.  An empty text lies in every cause."""
    wanted = wanted.select("investigation_id", F.lower("expected").alias("expected")).filter("expected IS NOT NULL AND investigation_id IS NOT NULL").distinct()
    sized = wanted.withColumn("g", F.least(F.length("expected"), F.lit(gram)))
    grams_of = lambda c: F.array_distinct(F.transform(
        F.when(F.length(c) >= F.col("g"), F.sequence(F.lit(1), F.length(c) - F.col("g") + 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.substring(F.col(c), i, F.col("g"))))
    lengths = causes.select("investigation_id", "cause", F.explode(F.sequence(F.lit(1), F.lit(gram))).alias("g"))
    index = lengths.join(sized.select("investigation_id", "g").distinct(), ["investigation_id", "g"], "left_semi") \
        .withColumn("gram", F.explode(grams_of("cause"))).select("investigation_id", "g", "gram", "cause")
    # one cause stands for all where the empty text is looked for
    index = index.unionByName(causes.groupBy("investigation_id").agg(F.min("cause").alias("cause")).select(
        "investigation_id", F.lit(0).alias("g"), F.lit("").alias("gram"), "cause"))
    counts = index.groupBy("investigation_id", "g", "gram").agg(F.count(F.lit(1)).alias("n"))
    parts = sized.withColumn("gram", F.explode(grams_of("expected"))).join(counts, ["investigation_id", "g", "gram"], "left")
    # a gram that no cause has rules the text out
    rarest = parts.groupBy("investigation_id", "g", "expected").agg(
        F.count_if(F.col("n").isNull()).alias("missing"), F.min_by("gram", F.struct("n", "gram")).alias("gram")).filter("missing = 0")
    found = rarest.join(index, ["investigation_id", "g", "gram"]).filter(F.contains("cause", F.col("expected")))
    return found.select("investigation_id", "expected").distinct()


def score_cases(cases: DataFrame, summaries: DataFrame, causes: DataFrame) -> DataFrame:
    """R10 (+ J8): per case status and the evaluation flags.

    ``cases``: case_id, investigation_id, expected_question_type, expected_dimension,
    expected_segment, expected_top_drivers array<struct<dimension,segment>>,
    expected_funnel_transition, expected_root_cause_contains.  ``causes``: (investigation_id, cause).
    Unsupported questions and missing results score 0 everywhere.
    """
    found = texts_found(cases.select("investigation_id", F.col("expected_root_cause_contains").alias("expected")), causes) \
        .select("investigation_id", F.col("expected").alias("_expected"), F.lit(True).alias("_found"))
    j = cases.join(summaries, "investigation_id", "left").withColumn("_expected", F.lower("expected_root_cause_contains")) \
        .join(found, ["investigation_id", "_expected"], "left")
    status = (F.when(F.col("question_type").isNull(), F.lit("failed"))
              .when(F.col("question_type") == "unsupported", F.lit("unsupported"))
              .otherwise(F.lit("completed")))
    done = status == "completed"
    recall = F.expr("""CASE WHEN size(expected_top_drivers) = 0 THEN 1.0 ELSE
        size(filter(expected_top_drivers, e -> exists(top3, a -> a.d = lower(e.dimension) AND a.s = lower(e.segment))))
        / size(expected_top_drivers) END""")
    flags = {
        "classification_correct": F.col("question_type") == F.col("expected_question_type"),
        "primary_driver_correct": (F.col("primary.d") == F.lower("expected_dimension"))
        & (F.col("primary.s") == F.lower("expected_segment")),
        "funnel_transition_correct": F.col("expected_funnel_transition").isNull()
        | F.array_contains("transitions", F.col("expected_funnel_transition")),
        "root_cause_correct": F.col("_found"),
        "evidence_valid": F.col("n_bad_claims") == 0,
        "tool_execution_success": F.lit(True),
    }
    out = j.select("case_id", status.alias("status"),
                   *[(done & F.coalesce(v, F.lit(False))).alias(k) for k, v in flags.items()],
                   F.when(done, recall).otherwise(F.lit(0.0)).cast("double").alias("top_three_driver_recall"),
                   F.when(done & (F.col("n_claims") > 0),
                          F.least(F.col("n_bad_claims") / F.col("n_claims"), F.lit(1.0)))
                   .otherwise(F.lit(0.0)).alias("unsupported_claim_rate"))
    return out


def evaluate(cases: DataFrame, results: Mapping[str, dict]) -> DataFrame:
    """R10 over several families: each investigation of ``results`` (id -> result) is run and audited once, and
    every case is scored against the one that its ``investigation_id`` names."""
    from shiftscope.investigations import report_claims, report_evidence_ids, stored
    from shiftscope.plans.claims import audit_claims
    summaries, causes = [], []
    for ident, result in results.items():
        result = stored(result)
        candidates = result["ranked_candidates"]
        if "position" not in candidates.columns:
            candidates = candidates.withColumn("position", F.col("rank_within_dimension"))
        if "transition" not in candidates.columns:
            candidates = candidates.withColumn("transition", F.lit(None).cast("string"))
        audit = audit_claims(report_claims(result), report_evidence_ids(result))
        summaries.append(investigation_summary(ident, result["question_type"], candidates, audit))
        if result.get("related_incidents") is not None:
            causes.append(investigation_causes(ident, result["related_incidents"]))
    union = lambda frames: reduce(lambda a, b: a.unionByName(b), frames)
    return score_cases(cases, union(summaries), union(causes))


def driver_recall(case_scores: DataFrame) -> DataFrame:
    """J8 view: primary-driver match and top-3 recall per case."""
    return case_scores.select("case_id", "status", "primary_driver_correct", "top_three_driver_recall")


def benchmark_aggregate(case_scores: DataFrame) -> DataFrame:
    """Counts per status; rates over all cases (unsupported and failed count as 0);
    evidence validity and unsupported-claim rate over completed cases only."""
    done = F.col("status") == "completed"

    def all_rate(c):
        return F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))

    def done_rate(c):
        return F.coalesce(F.avg(F.when(done, F.col(c).cast("double"))), F.lit(0.0))
    return case_scores.agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(done).alias("completed_cases"),
        F.count_if(F.col("status") == "unsupported").alias("unsupported_cases"),
        F.count_if(F.col("status") == "failed").alias("failed_cases"),
        F.coalesce(F.avg(done.cast("double")), F.lit(0.0)).alias("workflow_coverage"),
        all_rate("classification_correct").alias("classification_accuracy"),
        all_rate("primary_driver_correct").alias("primary_driver_accuracy"),
        all_rate("top_three_driver_recall").alias("mean_top_three_driver_recall"),
        all_rate("funnel_transition_correct").alias("funnel_accuracy"),
        all_rate("root_cause_correct").alias("root_cause_accuracy"),
        done_rate("evidence_valid").alias("evidence_validity_rate"),
        done_rate("unsupported_claim_rate").alias("unsupported_claim_rate"),
        all_rate("tool_execution_success").alias("tool_success_rate"))
