"""File sources and sinks.

* ``load_csv_tables`` reads the eleven tables from ``<dir>/<table>.csv`` with a header
  row and the declared schema (``FAILFAST``, header names checked); an empty field is
  NULL.  A missing directory or file is an error.
* ``benchmark_cases`` / ``recorded_plans`` read the evaluation inputs with explicit
  schemas.
* ``write_tables`` writes evidence tables (one folder per table).
* ``write_logical_tables`` / ``load_parquet_tables`` materialise the logical tables once,
  sessions and funnel events partitioned by day, so period filters prune partitions.
"""

from __future__ import annotations

import os
from typing import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftscope.schemas import SCHEMAS, TABLE_NAMES
from shiftscope.tables import MarketingTables

DRIVER = T.StructType([T.StructField("dimension", T.StringType()), T.StructField("segment", T.StringType())])
BENCHMARK_CASE = T.StructType([
    T.StructField("case_id", T.StringType()), T.StructField("question", T.StringType()),
    T.StructField("current_start", T.DateType()), T.StructField("current_end", T.DateType()),
    T.StructField("previous_start", T.DateType()), T.StructField("previous_end", T.DateType()),
    T.StructField("expected_question_type", T.StringType()),
    T.StructField("expected_primary_driver", DRIVER),
    T.StructField("expected_top_drivers", T.ArrayType(DRIVER)),
    T.StructField("expected_funnel_transition", T.StringType()),
    T.StructField("expected_root_cause_contains", T.StringType()),
])
SCOPE = T.StructType([T.StructField(f, T.StringType()) for f in
                      ("country", "device", "channel", "campaign", "customer_segment", "experiment")])
DECISION = T.StructType([T.StructField("question_type", T.StringType()),
                         T.StructField("primary_metric", T.StringType()),
                         T.StructField("scope", SCOPE)])


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on the file system that Spark would read it from."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _require(spark: SparkSession, path: str, what: str) -> None:
    if not _exists(spark, path):
        raise FileNotFoundError(f"{what} not found: {path}")


def read_csv_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One typed table; the header must name the declared columns."""
    path = os.path.join(directory, f"{name}.csv")
    _require(spark, path, "table file")
    return (spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
            .option("nullValue", "").option("timestampNTZFormat", "yyyy-MM-dd[ HH:mm:ss[.SSSSSS]]")
            .schema(SCHEMAS[name]).csv(path))


def load_csv_tables(spark: SparkSession, directory: str,
                    tables: Iterable[str] = TABLE_NAMES) -> MarketingTables:
    """The logical tables from ``<directory>/<table>.csv``; files are read lazily."""
    _require(spark, directory, "data directory")
    names = list(tables)
    for name in names:
        _require(spark, os.path.join(directory, f"{name}.csv"), "table file")
    return MarketingTables(**{n: (lambda n=n: read_csv_table(spark, directory, n)) for n in names})


def load_audit(spark: SparkSession, directory: str, tables: Iterable[str] = TABLE_NAMES) -> DataFrame:
    """Missing files fail; otherwise ``(table_name, row_count)`` per table."""
    from shiftscope.operators.audit import table_row_counts
    return table_row_counts(load_csv_tables(spark, directory, tables))


def benchmark_cases(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark cases from a JSON array file (or JSON lines) with an explicit schema."""
    _require(spark, path, "benchmark file")
    return spark.read.schema(BENCHMARK_CASE).option("mode", "FAILFAST").json(path, multiLine=True)


def recorded_plans(spark: SparkSession, path: str) -> DataFrame:
    """Recorded planner decisions, a JSON object mapping question to decision, as rows
    ``(question, question_type, primary_metric, <scope fields>)``.

    A decision that is no valid JSON or has other fields than these is an error.  One JSON document cannot be split, so the file is one task; recordings are small.
    """
    _require(spark, path, "recorded plans file")
    doc = spark.read.text(path, wholetext=True)
    raw = doc.select(F.explode(F.from_json("value", T.MapType(T.StringType(), T.StringType()), {"mode": "FAILFAST"})))
    value = F.from_json("value", DECISION, {"mode": "FAILFAST"})
    fields = F.concat(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")),
                      F.coalesce(F.json_object_keys(F.get_json_object("value", "$.scope")), F.array().cast("array<string>")))
    unknown = F.array_except(fields, F.array(*[F.lit(x) for x in (*DECISION.fieldNames(), *SCOPE.fieldNames())]))
    entries = raw.select("key", F.when(F.size(unknown) == 0, value).otherwise(F.raise_error(F.concat(
        F.lit("unknown fields in the recorded plan of "), "key", F.lit(": "), F.array_join(unknown, ", ")))).alias("value"))
    return entries.select(F.col("key").alias("question"), "value.question_type", "value.primary_metric",
                          *[F.col(f"value.scope.{f}").alias(f) for f in SCOPE.fieldNames()])


def write_tables(frames: Mapping[str, DataFrame], path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Write each evidence table to ``<path>/<name>`` in ``fmt`` (json or parquet)."""
    if fmt not in ("json", "parquet"):
        raise ValueError("fmt must be json or parquet")
    for name, df in frames.items():
        df.write.mode(mode).format(fmt).save(os.path.join(path, name))


#: the day that partitions a stored table; facts of sessions are stored with their session's day
DAY_OF = {"sessions": "day", "conversions": "session_day", "funnel_events": "session_day", "daily_campaign_metrics": "date"}
SESSION_TABLES = ("sessions", "conversions", "funnel_events")


def _with_day(t: MarketingTables, name: str, df: DataFrame) -> DataFrame:
    if name == "sessions":
        return df.withColumn("day", F.to_date("timestamp"))
    if name in SESSION_TABLES and t.has("sessions"):
        df = df.drop("session_day")
        days = t.sessions.select("session_id", F.to_date("timestamp").alias("session_day"))
        return df.join(days, "session_id", "left").select(*df.columns, "session_day")
    return df


def write_logical_tables(t: MarketingTables, path: str, mode: str = "overwrite") -> None:
    """Materialise the logical tables once as parquet under ``path`` (shared storage).

    Sessions get a ``day`` partition column, conversions and funnel events the day of **their session**
    (``session_day``), and daily metrics are partitioned by ``date``: a period's filter then prunes whole
    partitions of all of them.
    """
    for name, df in t.present().items():
        df = _with_day(t, name, df)
        day = DAY_OF.get(name)
        w = df.write.mode(mode)
        if day in df.columns:
            w = w.partitionBy(day)
        w.parquet(os.path.join(path, name))


def write_bucketed_tables(t: MarketingTables, prefix: str, buckets: int, mode: str = "overwrite") -> None:
    """Store the logical tables as catalog tables ``<prefix>_<name>`` in the warehouse.

    Sessions, conversions and funnel events are partitioned by the session's day and bucketed and sorted by
    ``session_id`` alike, so joins and aggregates on the session read them without an exchange."""
    for name, df in t.present().items():
        df = _with_day(t, name, df)
        day = DAY_OF.get(name)
        bucketed = name in SESSION_TABLES
        if day in df.columns:
            df = df.repartition(*([day] if not bucketed else [day, F.pmod(F.hash("session_id"), F.lit(buckets))]))
        w = df.write.mode(mode).format("parquet")
        if day in df.columns:
            w = w.partitionBy(day)
        if bucketed:
            w = w.bucketBy(buckets, "session_id").sortBy("session_id")
        w.saveAsTable(f"{prefix}_{name}")


def load_bucketed_tables(spark: SparkSession, prefix: str) -> MarketingTables:
    """The tables written by ``write_bucketed_tables``."""
    names = [n for n in TABLE_NAMES if spark.catalog.tableExists(f"{prefix}_{n}")]
    if not names:
        raise FileNotFoundError(f"no tables {prefix}_*")
    return MarketingTables(**{n: (lambda n=n: spark.table(f"{prefix}_{n}")) for n in names})


def load_parquet_tables(spark: SparkSession, path: str) -> MarketingTables:
    """The tables written by ``write_logical_tables`` (lazily, one reader each)."""
    _require(spark, path, "table directory")
    names = [n for n in TABLE_NAMES if _exists(spark, os.path.join(path, n))]
    return MarketingTables(**{n: (lambda n=n: spark.read.parquet(os.path.join(path, n))) for n in names})
