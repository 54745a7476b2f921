"""App-review sentiment."""

from __future__ import annotations

import datetime as dt
import functools
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftscope.functions.expr import clamp, evidence_id, pct_change, safe_ratio
from shiftscope.functions.scope import REVIEW_SCOPE, scope_identity, scope_predicate
from shiftscope.operators.compare import compare_long, single_period, widen
from shiftscope.periods import Periods
from shiftscope.tables import MarketingTables

# Negative rating threshold and the default negative-topic lexicon.
NEGATIVE_MAX_RATING = 2
NEGATIVE_TERMS = ("payment", "crash", "login", "refund")
REVIEW_METRICS = ("reviews", "negative_reviews", "negative_review_rate", "average_rating")


def any_term(text: Column, terms: Sequence[str]) -> Column:
    """Case-insensitive substring match of any term."""
    low = F.lower(text)
    return functools.reduce(lambda a, b: a | b, [low.contains(F.lit(t.lower())) for t in terms])


def _scoped_reviews(t: MarketingTables, periods: Periods, scope) -> DataFrame:
    pred = scope_predicate(scope, REVIEW_SCOPE, "Review analysis")
    return (t.app_reviews.filter(periods.in_either("timestamp") & pred)
            .withColumn("period", F.explode(periods.all_labels("timestamp"))))


def reviews_per_period(t: MarketingTables, periods: Periods,
                       scope: Mapping[str, str] | None = None) -> DataFrame:
    r = _scoped_reviews(t, periods, scope)
    agg = r.groupBy("period").agg(
        F.count(F.lit(1)).cast("double").alias("reviews"),
        F.count_if(F.col("rating") <= NEGATIVE_MAX_RATING).cast("double").alias("negative_reviews"),
        F.coalesce(F.sum("rating"), F.lit(0)).cast("double").alias("_rating_sum"))
    return agg.select("period", "reviews", "negative_reviews",
                      safe_ratio("negative_reviews", "reviews").alias("negative_review_rate"),
                      safe_ratio("_rating_sum", "reviews").alias("average_rating"))


def period_review_metrics(t: MarketingTables, start: dt.date, end: dt.date,
                          scope: Mapping[str, str] | None = None) -> DataFrame:
    p = Periods.of(start, end, start, end)
    return single_period(reviews_per_period(t, p, scope), REVIEW_METRICS)


def review_compare(t: MarketingTables, periods: Periods,
                   scope: Mapping[str, str] | None = None) -> DataFrame:
    wide = widen(reviews_per_period(t, periods, scope), REVIEW_METRICS)
    return compare_long(wide, REVIEW_METRICS, "rev_", "review_kpi", periods, scope_identity(scope))


def review_topic(t: MarketingTables, periods: Periods, scope: Mapping[str, str] | None = None,
                 terms: Sequence[str] = NEGATIVE_TERMS) -> DataFrame:
    """G12 + the topic driver: negative reviews mentioning any term, per period."""
    if not terms:
        raise ValueError("at least one topic term is required")
    topic = "/".join(terms)
    r = _scoped_reviews(t, periods, scope).filter(
        (F.col("rating") <= NEGATIVE_MAX_RATING) & any_term(F.col("review_text"), terms))
    wide = widen(r.groupBy("period").agg(F.count(F.lit(1)).alias("n")), ["n"])
    cur, prev = F.col("cur_n").cast("bigint"), F.col("prev_n").cast("bigint")
    pct = pct_change(cur, prev)
    return wide.select(
        evidence_id("top_", "review_topic", topic, *periods.key_parts(), scope_identity(scope)).alias("evidence_id"),
        F.lit("dimension_driver").alias("candidate_type"), F.lit("topic").alias("dimension"),
        F.lit(topic).alias("segment"), F.lit(1).alias("rank_within_dimension"),
        clamp(F.abs(F.coalesce(pct, F.lit(0.0))), 0.0, 1.0).alias("score"),
        F.lit("negative_reviews").alias("metric"), cur.alias("current"), prev.alias("previous"),
        (cur - prev).alias("absolute_change"), pct.alias("percent_change"),
        F.lit(", ".join(terms)).alias("terms"))
