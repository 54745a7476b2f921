"""Interaction of filters: what each of them removes, in every order of application.

One pass gives every document the bits of the filters it fails; documents of equal bits in a part are one
*mask cell* (at most 2^filters a part).  A recursive common table expression then extends prefixes of
filters by letters not yet used, joined with all masks and carrying the bits applied so far; each of its
levels is one step.  Steps meet the cells on the mask, so the enumeration is the same size for every corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stash

LETTERS = "ABCDE"
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3
# The symbols of filter D.
SYMBOLS = "#$%&*|"
_SPACE = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> dict[str, Column]:
    """Filters A to D as conditions that hold where ``text`` fails."""
    words = F.filter(F.split(text, _SPACE, -1), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n < LEAST_WORDS,
            "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n,
            "C": 100 * capitals > CAPITAL_PERCENT * F.length(text),
            "D": text.rlike(f"[{SYMBOLS}]")}


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents by part and by the bits of the filters they fail.

    Filter E asks whether an equal text has a smaller id, over the whole table; texts meet by their
    SHA-256, in rows that no longer hold the text.  Rows of one text are first combined to counts by part
    in every task, so a text that a third of all rows repeat is not collected."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.expr("int(quality <=> 1)")).alias("good"), F.max(F.expr("int(toxic <=> 1)")).alias("toxic"))
    tested = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), body.alias("text"))
    conditions = failures(F.col("text"))
    bits = sum((F.when(c, 1 << LETTERS.index(k)).otherwise(0) for k, c in conditions.items()), F.lit(0))
    rows = stash(tested.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), bits.alias("bits")), "filter_bits")
    rows = rows.join(marks, "doc_id", "left").select("part", "key", "bits", "doc_id", F.coalesce("good", F.lit(0)).alias("good"),
                                                     F.coalesce("toxic", F.lit(0)).alias("toxic"))
    # all rows of a text by part, less the rows of its smallest id, fail E
    per_text = rows.groupBy("key", "part", "bits").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"),
                                                       F.min("doc_id").alias("least"))
    least = per_text.groupBy("key").agg(F.min("least").alias("least"))
    # rows of the smallest id of a text (more than one only if the id repeats) and rows without an id pass E
    passing = rows.join(least.withColumnRenamed("least", "doc_id").filter("doc_id is not null"), ["key", "doc_id"], "left_semi") \
        .unionByName(rows.filter("doc_id is null"))
    e = 1 << LETTERS.index("E")
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    passed = passing.groupBy("part", F.col("bits").alias("mask")).agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    every = per_text.groupBy("part", F.col("bits").alias("mask")).agg(*sums)
    signed = passed.unionByName(every.withColumn("mask", F.col("mask").bitwiseOR(F.lit(e)))) \
        .unionByName(passed.select("part", F.col("mask").bitwiseOR(F.lit(e)).alias("mask"), *[(-F.col(c)).alias(c) for c in ("n", "good", "toxic")]))
    return stash(signed.groupBy("part", "mask").agg(*sums), "mask_cells")


def _enumeration(masks: int, letters: str) -> str:
    """Every prefix of distinct letters with every mask: the level's letter, the bits applied before it."""
    rows = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(letters))
    return f"""
    WITH RECURSIVE letters(letter, bit) AS (VALUES {rows}),
    masks(mask) AS (SELECT cast(id AS int) FROM range({masks})),
    walk(prefix, step, bit, before, applied, mask) AS (
      SELECT cast('' AS string), 0, 0, 0, 0, mask FROM masks
      UNION ALL
      SELECT concat(w.prefix, l.letter), w.step + 1, l.bit, w.applied, w.applied | l.bit, w.mask
      FROM walk w JOIN letters l ON w.applied & l.bit = 0)
    SELECT prefix, step, mask, substr(prefix, step, 1) AS letter,
      int(mask & applied = 0) AS kept, int(mask & before = 0 AND mask & bit <> 0) AS removed,
      int(mask & before <> 0 AND mask & bit <> 0) AS redundant, int(mask = bit) AS unique_fails
    FROM walk WHERE step > 0"""


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``:
    one row, zeros included, per part, order of all filters and step.

    A NULL lang is the part ``''``, a NULL text an empty one.  A row without an id has no smaller id and
    is not a repetition; rows that share an id and a text are none of each other.  Repeated label rows
    count once.  An empty table has no parts and gives no rows."""
    letters = LETTERS
    walk = docs.sparkSession.sql(_enumeration(1 << len(letters), letters))
    cells = mask_cells(docs, labels)
    steps = cells.join(F.broadcast(walk), "mask").groupBy("part", "prefix", "step", "letter").agg(
        *[F.sum(F.col("n") * F.col(c)).alias(c) for c in ("kept", "removed", "redundant", "unique_fails")],
        F.sum(F.col("good") * F.col("removed")).alias("good_lost"), F.sum(F.col("toxic") * F.col("removed")).alias("toxic_lost"))
    # the full orders are the last level of the same walk; an order's steps are its prefixes
    orders = walk.filter(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct().select(
        "filter_order", F.explode(F.transform(F.sequence(F.lit(1), F.lit(len(letters))), lambda s: F.substring(F.col("filter_order"), F.lit(1), s))).alias("prefix"))
    out = steps.join(F.broadcast(orders), "prefix")
    shapley = out.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return out.join(shapley, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
