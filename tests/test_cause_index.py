"""Expected texts in root causes by a q-gram index: against every pair; cases routed to their family."""

import random

from pyspark.sql import functions as F

from shiftscope.plans.evaluation import benchmark_aggregate, score_cases, texts_found


def test_texts_are_found_as_by_every_pair(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abé d") for _ in range(rng.randint(0, 12)))
    causes = [(rng.choice("xyz"), word()) for _ in range(120)] + [("x", "the anomaly of the source"), ("w", "")]
    wanted = [(rng.choice("xyzwv"), word()[:rng.randint(0, 7)].upper()) for _ in range(250)]
    wanted += [("x", "ANOMALY of"), ("x", "anomaly off"), ("y", "anomaly"), ("x", None), (None, "a"), ("w", ""), ("v", ""), ("x", "a"), ("x", "the anomaly of the source")]
    got = {tuple(r) for r in texts_found(spark.createDataFrame(wanted, "investigation_id string, expected string"),
                                         spark.createDataFrame(causes, "investigation_id string, cause string").repartition(3)).collect()}
    want = {(i, e.lower()) for i, e in wanted if e is not None and any(j == i and e.lower() in c for j, c in causes)}
    assert got == want and len(want) > 30


def test_index_makes_no_pairs(spark):
    causes = spark.range(1000).select((F.col("id") % 2).cast("string").alias("investigation_id"), F.concat(F.lit("common words about source "), "id").alias("cause"))
    wanted = spark.range(2000).select((F.col("id") % 2).cast("string").alias("investigation_id"), F.concat(F.lit("source "), "id").alias("expected"))
    df = texts_found(wanted, causes)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert df.count() == 1000


def test_cases_meet_their_own_investigation(spark):
    c = "case_id string, investigation_id string, expected_question_type string, expected_dimension string, expected_segment string, " \
        "expected_top_drivers array<struct<dimension:string,segment:string>>, expected_funnel_transition string, expected_root_cause_contains string"
    cases = spark.createDataFrame([
        ("a", "one", "t", "device", "IOS", [("device", "ios"), ("country", "peru")], None, "Release"),
        ("b", "two", "t", "device", "ios", [("device", "ios")], None, "release"),
        ("c", "two", "u", "x", "y", [], "a -> b", None),
        ("d", None, "t", "device", "ios", [("device", "ios")], None, "release")], c)
    s = "investigation_id string, question_type string, primary struct<d:string,s:string>, top3 array<struct<position:int,d:string,s:string>>, " \
        "transitions array<string>, n_claims long, n_bad_claims long"
    summaries = spark.createDataFrame([("one", "t", ("device", "ios"), [(1, "device", "ios"), (2, "country", "chile")], [], 4, 1),
                                       ("two", "u", ("x", "z"), [], ["a -> b"], 0, 0)], s)
    causes = spark.createDataFrame([("one", "a bad release"), ("two", "weather")], "investigation_id string, cause string")
    got = {r["case_id"]: r for r in score_cases(cases, summaries, causes).collect()}
    assert [got[k]["status"] for k in "abcd"] == ["completed", "completed", "completed", "failed"]
    assert [got[k]["root_cause_correct"] for k in "abcd"] == [True, False, False, False]
    assert [got[k]["top_three_driver_recall"] for k in "abcd"] == [0.5, 0.0, 1.0, 0.0]
    assert [got[k]["primary_driver_correct"] for k in "abcd"] == [True, False, False, False]
    assert [got[k]["funnel_transition_correct"] for k in "abcd"] == [True, True, True, False]
    assert got["a"]["unsupported_claim_rate"] == 0.25 and not got["a"]["evidence_valid"] and got["b"]["evidence_valid"]
    total = benchmark_aggregate(score_cases(cases, summaries, causes)).first()
    assert (total["total_cases"], total["completed_cases"], total["failed_cases"]) == (4, 3, 1)
