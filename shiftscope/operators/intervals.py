"""Join of day intervals that overlap, for many intervals on both sides (P10, J6 in batch form).

An interval belongs to the level l of the smallest power of two that is not below its length, so it touches one or
two of the 2^l-day bins of that level and of every coarser one.  Of two overlapping intervals the shorter
meets the longer in a bin of the longer one's level, so two equi-joins on (level, bin) find every pair:
left intervals at their own level with right ones at all levels from their own up, and the other way round
with the levels above.  A pair that meets in two bins is kept in the bin where the later start lies.  An
interval gives at most two rows per level, however long it is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^22 days are longer than the range of dates
LEVELS = 23


def _bins(df: DataFrame, start: str, last: str, side: str, levels: Column) -> DataFrame:
    """One row per bin touched at each of ``levels``; ``__own``, ``__lo`` and ``__hi`` describe the interval."""
    lo, hi = F.unix_date(F.least(start, last)), F.unix_date(F.greatest(start, last))
    days = hi - lo + 1
    # the smallest l with 2^l >= days
    own = F.when(days <= 1, F.lit(0)).otherwise(F.length(F.bin((days - 1).cast("long"))))
    rows = df.withColumns({f"__{side}_lo": lo, f"__{side}_hi": hi}).withColumn(f"__{side}_own", own)
    rows = rows.withColumn("__level", F.explode(levels)) if levels is not None else rows.withColumn("__level", F.col(f"__{side}_own"))
    bin_of = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("__level"))).cast("long")
    return rows.withColumn("__bin", F.explode(F.sequence(bin_of(f"__{side}_lo"), bin_of(f"__{side}_hi"))))


def overlap_join(left: DataFrame, right: DataFrame, left_days: tuple[str, str], right_days: tuple[str, str],
                 on: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows whose closed day intervals (first and last day, both included) share a day and whose ``on``
    columns are equal; all columns of both sides, ``on`` once.

    One result per pair of rows.  An interval whose last day lies before its first is read as reversed here;
    callers test their own predicate on the result.  NULL bounds or ``on`` values meet nothing."""
    names = [c for c in left.columns if c in right.columns and c not in on]
    if names:
        raise ValueError(f"columns on both sides: {', '.join(names)}")
    left = left.filter(F.col(left_days[0]).isNotNull() & F.col(left_days[1]).isNotNull())
    right = right.filter(F.col(right_days[0]).isNotNull() & F.col(right_days[1]).isNotNull())
    keys = [*on, "__level", "__bin"]

    def from_own(side: str, above: int) -> Column:
        return F.sequence(F.least(F.col(f"__{side}_own") + above, F.lit(LEVELS)), F.lit(LEVELS))

    own_left = _bins(left, *left_days, "l", None)
    # right intervals travel at the levels that left ones have, of which there are at most LEVELS + 1
    levels = F.broadcast(own_left.select("__level").distinct())
    coarse_right = _bins(right, *right_days, "r", from_own("r", 0)).join(levels, "__level", "left_semi")
    coarse_left = _bins(left, *left_days, "l", from_own("l", 1))
    pairs = (own_left.join(coarse_right, keys)
             .unionByName(coarse_left.join(_bins(right, *right_days, "r", None), keys)))
    start = F.greatest("__l_lo", "__r_lo")
    here = F.floor(start / F.pow(F.lit(2.0), F.col("__level"))).cast("long") == F.col("__bin")
    met = pairs.filter((start <= F.least("__l_hi", "__r_hi")) & here)
    return met.drop("__level", "__bin", *[f"__{s}_{x}" for s in "lr" for x in ("lo", "hi", "own")])
