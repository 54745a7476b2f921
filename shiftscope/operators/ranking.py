"""Positions and best rows of groups of any size (W1, W2, W3, G13) without a window over a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftscope.session import cut_lineage


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[f"__{n}"])
    return cond


def with_group_total(df: DataFrame, by: Sequence[str], total: Column, name: str) -> DataFrame:
    """Add ``total`` (an aggregate) over the rows of the same ``by`` values, NULL being a value.

    A grouped sum, combined before the shuffle, joined back: one row per group, and a group's
    rows are not gathered.  ``df`` should be stored or cheap, since it is read twice."""
    sums = df.groupBy(*[F.col(b).alias(f"__{b}") for b in by]).agg(total.alias(name))
    return df.join(sums, _same(df, sums, by)).drop(*[f"__{b}" for b in by])


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Add ``name``: the 1-based position of each row among those of its ``by`` values, in ``order``.

    The rows are range-partitioned by group and order and stored once with their partition's number (a
    second evaluation could draw other range bounds).  A position is the row's number in its group's
    share of the partition plus the rows of the group in earlier partitions.  A group is cut into as many
    shares as its size asks for; the table of shares has at most a row per group and partition border.
    ``order`` should be total, or ties take any order.  ``by`` may be empty; NULL is a value."""
    placed = cut_lineage(df.repartitionByRange(*[F.col(b) for b in by], *order).withColumn("__part", F.spark_partition_id()))
    shares = placed.groupBy(*[F.col(b).alias(f"__{b}") for b in by], F.col("__part").alias("__share")).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(*[f"__{b}" for b in by]).orderBy("__share").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.withColumn("__offset", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows")
    local = placed.withColumn("__local", F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order)))
    joined = local.join(shares, _same(local, shares, by) & (local["__part"] == shares["__share"]))
    return joined.withColumn(name, (F.col("__offset") + F.col("__local")).cast("int")).drop(
        *[f"__{b}" for b in by], "__part", "__share", "__offset", "__local")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str) -> DataFrame:
    """The first ``k`` rows of each group, numbered in ``name``.

    Two phases: every task keeps the first ``k`` rows it holds of a group, and only these are
    shuffled and merged (Spark plans the bounded row number as a partial and a final group limit)."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, place).filter(F.col(name) <= k)
