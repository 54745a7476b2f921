"""Load and data-quality audits.

Spark does not enforce declared keys, so the declared constraints become a job:
duplicate primary keys (``groupBy(pk).count() > 1``), unresolvable foreign keys
(``left_anti``) and NULLs in NOT NULL columns (``count_if``).  Each table is scanned
once per kind of check; only columns present in a frame are checked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftscope.operators.ranking import top_k
from shiftscope.schemas import FOREIGN_KEYS, PRIMARY_KEYS, not_null_columns
from shiftscope.tables import MarketingTables


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def table_row_counts(t: MarketingTables) -> DataFrame:
    """``(table_name, row_count)`` for every table present."""
    return _union([df.agg(F.count(F.lit(1)).cast("bigint").alias("row_count"))
                   .select(F.lit(name).alias("table_name"), "row_count")
                   for name, df in t.present().items()])


def constraint_audit(t: MarketingTables) -> DataFrame:
    """S3: ``(table_name, check_name, column_name, violations)``, one row per check."""
    tables = t.present()
    frames = []
    for name, df in tables.items():
        pk = [c for c in PRIMARY_KEYS.get(name, ()) if c in df.columns]
        if pk and len(pk) == len(PRIMARY_KEYS[name]):
            dup = (df.groupBy(*pk).count().filter(F.col("count") > 1)
                   .agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("violations")))
            frames.append(dup.select(F.lit(name).alias("table_name"), F.lit("primary_key").alias("check_name"),
                                     F.lit(",".join(pk)).alias("column_name"), "violations"))
        nn = [c for c in not_null_columns(name) if c in df.columns]
        if nn:
            counts = df.agg(*[F.count_if(F.col(c).isNull()).cast("bigint").alias(c) for c in nn])
            pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("violations")) for c in nn])
            frames.append(counts.select(F.inline(pairs)).select(
                F.lit(name).alias("table_name"), F.lit("not_null").alias("check_name"),
                "column_name", "violations"))
    for child, col, parent, pcol in FOREIGN_KEYS:
        if child in tables and parent in tables and col in tables[child].columns \
                and pcol in tables[parent].columns:
            # pre-aggregate child keys (a hot key shrinks to one row per task) before
            # the anti join against the parent's keys
            keys = tables[parent].select(F.col(pcol).alias("_k"))
            child_keys = (tables[child].select(F.col(col).alias("_k")).filter(F.col("_k").isNotNull())
                          .groupBy("_k").agg(F.count(F.lit(1)).alias("_n")))
            orphans = (child_keys.join(keys, "_k", "left_anti")
                       .agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("violations")))
            frames.append(orphans.select(F.lit(child).alias("table_name"),
                                         F.lit(f"foreign_key:{parent}.{pcol}").alias("check_name"),
                                         F.lit(col).alias("column_name"), "violations"))
    return _union(frames)


def _offending(t: MarketingTables) -> tuple[list[tuple[str, str, str]], DataFrame]:
    """All checks, and ``(table_name, check_name, column_name, key, rows)``: what offends each of them, ``key``
    being the row's primary key (NULL without one) or the foreign key's value."""
    tables = t.present()
    checks, frames = [], []

    def of(df: DataFrame, table: str, check: str, column) -> DataFrame:
        column = column if not isinstance(column, str) else F.lit(column)
        return df.select(F.lit(table).alias("table_name"), F.lit(check).alias("check_name"), column.alias("column_name"), "key", "rows")

    for name, df in tables.items():
        pk = PRIMARY_KEYS.get(name, ())
        key = F.concat_ws("|", *[F.col(c).cast("string") for c in pk]) if pk and set(pk) <= set(df.columns) else F.lit(None).cast("string")
        if pk and set(pk) <= set(df.columns):
            column = ",".join(pk)
            checks.append((name, "primary_key", column))
            twice = df.groupBy(*pk).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
            frames.append(of(twice.withColumn("key", key), name, "primary_key", column))
        required = [c for c in not_null_columns(name) if c in df.columns]
        if required:
            checks += [(name, "not_null", c) for c in required]
            # one scan for all columns: a row is written once per column it lacks
            lacking = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
            rows = df.select(key.alias("key"), F.explode(lacking).alias("column"), F.lit(1).cast("long").alias("rows"))
            frames.append(of(rows, name, "not_null", F.col("column")))
    for child, col, parent, pcol in FOREIGN_KEYS:
        if child in tables and parent in tables and col in tables[child].columns and pcol in tables[parent].columns:
            check = f"foreign_key:{parent}.{pcol}"
            checks.append((child, check, col))
            # child keys are counted before they meet the parent's: a hot key is one row
            found = tables[child].select(F.col(col).cast("string").alias("key")).filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
            orphans = found.join(tables[parent].select(F.col(pcol).cast("string").alias("key")), "key", "left_anti")
            frames.append(of(orphans, child, check, col))
    return checks, _union(frames)


def constraint_offenders(t: MarketingTables, examples: int = 3) -> DataFrame:
    """S3 with evidence: ``(table_name, check_name, column_name, violations, offending_keys, examples)``, one row per check.

    ``violations`` counts rows as ``constraint_audit`` does, ``offending_keys`` the distinct keys they have and
    ``examples`` names the first of these (``, ``-joined).  Examples are found in two phases, a few a task and a
    few of those, so a check that every row fails is summed before it is shuffled."""
    checks, rows = _offending(t)
    by = ["table_name", "check_name", "column_name"]
    keys = rows.groupBy(*by, "key").agg(F.sum("rows").alias("rows"))
    sums = keys.groupBy(*by).agg(F.sum("rows").alias("violations"), F.count("key").alias("offending_keys"))
    first = top_k(keys.filter("key is not null"), by, [F.asc("key")], examples, "place").groupBy(*by).agg(
        F.array_join(F.array_sort(F.collect_list("key")), ", ").alias("examples"))
    every = rows.sparkSession.createDataFrame(checks, "table_name string, check_name string, column_name string")
    return every.join(sums, by, "left").join(first, by, "left").select(
        *by, F.coalesce("violations", F.lit(0)).cast("long").alias("violations"),
        F.coalesce("offending_keys", F.lit(0)).cast("long").alias("offending_keys"), F.coalesce("examples", F.lit("")).alias("examples"))
