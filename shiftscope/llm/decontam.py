"""Benchmark leaks by spaced seeds: columns and SQL functions only.

A mask names the token positions that count; the tokens between them are ignored, so a seed still
hits when one of those was substituted.  The three masks below hit every window of 13 tokens with
at most 3 substitutions (checked over all 286 patterns in the tests).  Hashes of the training texts
join hashes of the benchmark; around every hit the two token sequences are compared in place, and
an overlap counts when some window of 13 tokens that touches the seed has at least 10 equal ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stash

MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 6, 8), (0, 1, 2, 6, 8))
WINDOW, LEAST_EQUAL = 13, 10
#: Rows of the benchmark's seed table up to which it is sent to every executor (under 100 MB)
BROADCAST_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; NULL or blank text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def seeds(words: Column, masks: tuple[tuple[int, ...], ...] = MASKS) -> Column:
    """``array<struct<seed, at>>``: one hash per mask and start where the mask fits."""
    each = []
    for k, mask in enumerate(masks):
        n = F.size(words) - max(mask)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        each.append(F.transform(starts, lambda i: F.struct(
            F.xxhash64(F.lit(k), *[F.get(words, i + x) for x in mask]).alias("seed"), i.alias("at"))))
    return F.concat(*each)


def _best_window(equal: Column, touch: Column, window: int) -> Column:
    """Largest number of equal tokens in a window (at most ``window`` long) of ``equal`` over the seed."""
    n = F.size(equal)
    width = F.least(n, F.lit(window))
    first = F.greatest(touch - window + 1, F.lit(0))
    last = F.least(touch, n - width)
    return F.array_max(F.transform(F.sequence(F.least(first, last), last), lambda i: F.aggregate(
        F.slice(equal, i + 1, width), F.lit(0), lambda a, x: a + x)))


def leaks(docs: DataFrame, benchmark: DataFrame, masks: tuple[tuple[int, ...], ...] = MASKS, window: int = WINDOW,
          least_equal: int = LEAST_EQUAL) -> DataFrame:
    """``docs(doc_id, text)``, ``benchmark(item_id, text)`` -> ``(doc_id, item_id, n_equal, n_places)``.

    One row per document and item with a verified overlap: the most equal tokens in a window, and at
    how many alignments of the two texts an overlap was found.  An item shorter than a window must
    agree in the same proportion over its whole length; items that no mask fits (under 6 tokens) are
    too short to tell and match nothing, as do NULL or blank texts.  Rows with a NULL id are left out;
    rows that repeat an id give one result."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens(F.col("text")).alias("words")).filter("doc_id is not null")
    items = stash(benchmark.select("item_id", tokens(F.col("text")).alias("item_words")).filter("item_id is not null").distinct(), "items")
    probe = stash(items.select("item_id", F.explode(seeds(F.col("item_words"), masks)).alias("s"))
                  .select("item_id", F.col("s.seed").alias("seed"), F.col("s.at").alias("item_at")).distinct(), "seeds")
    if probe.count() <= BROADCAST_ROWS:
        probe = F.broadcast(probe)
    hits = source.select("doc_id", F.explode(seeds(F.col("words"), masks)).alias("s")) \
        .select("doc_id", F.col("s.seed").alias("seed"), F.col("s.at").alias("at")).join(probe, "seed") \
        .groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.collect_set("item_at").alias("touches"))
    hits = stash(hits, "hits")
    around = hits.join(source.join(hits.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id").join(items, "item_id")
    shift, words, item = F.col("shift"), F.col("words"), F.col("item_words")
    equal = F.transform(item, lambda w, j: F.when((shift + j >= 0) & (F.get(words, F.greatest(shift + j, F.lit(0))) == w), 1).otherwise(0))
    around = around.select("doc_id", "item_id", "shift", F.size("item_words").alias("n"), "touches", equal.alias("equal"))
    around = around.withColumn("n_equal", F.array_max(F.transform("touches", lambda t: _best_window(F.col("equal"), t, window))))
    return around.filter(F.col("n_equal") * window >= F.lit(least_equal) * F.least(F.col("n"), F.lit(window))) \
        .groupBy("doc_id", "item_id").agg(F.max("n_equal").alias("n_equal"), F.countDistinct("shift").alias("n_places"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a verified overlap, unchanged; rows without an id stay."""
    hit = stash(leaks(docs, benchmark).select("doc_id").distinct(), "leaks")
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)
