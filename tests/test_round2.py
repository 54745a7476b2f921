"""Rules without caps: dictionary values of any kind, exact money, incomplete experiments, claims apart."""
import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F


def test_dictionary_values_of_any_length_and_characters(spark):
    from shiftscope.plans.questions import question_scope
    words = spark.createDataFrame([("campaign", "One Two_three four-five six Seven", "one two three four five six seven", 0),
                                   ("experiment", "A/B copy", "a/b copy", 0), ("device", "R&D (new)", "r&d (new)", 0),
                                   ("country", "St. Louis", "st. louis", 0), ("channel", "++", "++", 0)],
                                  "dimension string, value string, term string, priority int")
    asked = spark.createDataFrame([("1", "why did one-two three Four_five six seven fall?"), ("2", "the A/B copy, in st. Louis!"), ("3", "r&d (NEW) or a/b copycat"),
                                   ("4", "one two three four five six sevens, st. louisiana"), ("5", "x ++ y"), ("6", None)], "request_id string, question string")
    got = {r.request_id: (r.country, r.device, r.channel, r.campaign, r.experiment) for r in question_scope(asked, dictionary=words).collect()}
    assert got == {"1": (None, None, None, "One Two_three four-five six Seven", None), "2": ("St. Louis", None, None, None, "A/B copy"),
                   "3": (None, "R&D (new)", None, None, None), "4": (None,) * 5, "5": (None, None, "++", None, None), "6": (None,) * 5}


def test_invented_scope_makes_a_plan_invalid(spark):
    from shiftscope.plans.planning import PLAN_COLUMNS, plan_agreement, plan_consensus, rule_plans
    day = dt.date(2024, 1, 1)
    req = spark.createDataFrame([(k, "Why did revenue fall for Android?", day, day, day, day) for k in "abc"],
                                "request_id string, question string, current_start date, current_end date, previous_start date, previous_end date")
    base = rule_plans(req, req, "question")
    other = base.withColumns({"device": F.when(F.col("request_id") == "b", "ANDROID").otherwise(F.col("device")),
                              "country": F.when(F.col("request_id") == "a", "India").when(F.col("request_id") == "b", "any")}).select(*PLAN_COLUMNS)
    got = {r.request_id: tuple(r)[1:] for r in plan_agreement(base, other, req).collect()}
    assert got == {"a": (False,) * 6, "b": (True,) * 6, "c": (True,) * 6}
    assert {r.request_id: (r.source, r.device) for r in plan_consensus(base, other, req).collect()} == {
        "a": ("baseline", "Android"), "b": ("candidate", "Android"), "c": ("candidate", "Android")}


def test_money_is_exact_for_every_partitioning(spark):
    from shiftscope.functions.expr import money_sum
    rng = random.Random(1)
    cents = [rng.randrange(1, 10 ** 12) for _ in range(4000)] + [10 ** 19 + 1]
    frame = spark.createDataFrame([(c / 10 ** 6,) for c in cents], "x double")
    totals = {frame.repartition(n).agg(money_sum("x")).first()[0] for n in (1, 3, 7, 16)}
    assert len(totals) == 1 and math.isclose(totals.pop(), sum(cents) / 10 ** 6, rel_tol=1e-15)


def test_experiments_without_a_variant(spark):
    from shiftscope.operators.experiment import experiment_lift, incomplete_experiments
    day, end = dt.date(2024, 1, 1), dt.date(2024, 2, 1)
    rows = [("full", v, day, 1, 2.5) for v in ("control", "Treatment")] + [("half", "control", day, 0, 1.0), ("other", "placebo", day, 0, 1.0)]
    e = spark.createDataFrame(rows, "experiment_name string, variant string, exposure_date date, conversion int, revenue double")
    got = {r.experiment_name: r.missing_variants for r in incomplete_experiments(e, day, end).collect()}
    assert got == {"half": ["treatment"], "other": ["control", "treatment"]}
    assert [r.experiment_name for r in experiment_lift(e, day, end).collect()] == ["full"]
    with pytest.raises(ValueError, match="no treatment"):
        experiment_lift(e, day, end, "half")


def test_claims_that_share_an_id_stay_apart(spark):
    from shiftscope.plans.claims import audit_claims
    claims = spark.createDataFrame([("r", "s", "c", "t", ["kpi_1"]), ("r", "s", "c", "u", ["kpi_2"]), ("r", "s", "d", "v", [])],
                                   "report string, section string, claim_id string, text string, evidence_ids array<string>")
    known = spark.createDataFrame([("kpi_1",)], "evidence_id string")
    got = sorted((r.claim_id, r.n_evidence, r.approved) for r in audit_claims(claims, known).collect())
    assert got == [("c", 1, False), ("c", 1, True), ("d", 0, False)]


@pytest.mark.parametrize("key", ["question_scope", "question_type", "scope_check", "plan_audit", "plan_agreement", "plan_consensus", "two_proportion_test"])
def test_question_keys_are_not_constant(spark, key):
    """Each of these keys once returned one constant row after another on the test data."""
    from shiftscope.queries import REGISTRY
    frame = REGISTRY[key](spark, "/root/testdata/sf0.01")
    keep = [c for c in frame.columns if c not in ("request_id", "_id")]
    distinct = {c: frame.select(c).distinct().count() for c in keep}
    assert sum(n > 1 for n in distinct.values()) >= 3, distinct
    want = {"question_type": ("question_type", 7), "plan_audit": ("errors", 4), "plan_consensus": ("source", 2), "scope_check": ("error", 2)}
    if key in want:
        assert distinct[want[key][0]] >= want[key][1], distinct
