"""Explicit schemas of the eleven logical tables, with their declared constraints."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, TS, DB, L, I = (T.StringType(), T.DateType(), T.TimestampNTZType(), T.DoubleType(),
                      T.LongType(), T.IntegerType())


def _schema(*cols) -> T.StructType:
    return T.StructType([T.StructField(name, typ, nullable) for name, typ, nullable in cols])


SCHEMAS: dict[str, T.StructType] = {
    "customers": _schema(
        ("customer_id", S, False), ("signup_date", D, False), ("country", S, False),
        ("city", S, False), ("age_group", S, False), ("device_type", S, False),
        ("acquisition_channel", S, False), ("customer_segment", S, False)),
    "campaigns": _schema(
        ("campaign_id", S, False), ("campaign_name", S, False), ("platform", S, False),
        ("channel", S, False), ("start_date", D, False), ("end_date", D, False),
        ("budget", DB, False), ("spend", DB, False), ("impressions", L, False),
        ("clicks", L, False), ("conversions", L, False), ("revenue", DB, False)),
    "sessions": _schema(
        ("session_id", S, False), ("customer_id", S, False), ("timestamp", TS, False),
        ("device", S, False), ("country", S, False), ("traffic_source", S, False),
        ("campaign_id", S, True), ("landing_page", S, False),
        ("session_duration_seconds", I, False), ("pages_viewed", I, False)),
    "conversions": _schema(
        ("conversion_id", S, False), ("session_id", S, False), ("customer_id", S, False),
        ("timestamp", TS, False), ("product_id", S, False), ("revenue", DB, False),
        ("discount", DB, False), ("conversion_type", S, False)),
    "funnel_events": _schema(
        ("customer_id", S, False), ("session_id", S, False), ("timestamp", TS, False),
        ("event_name", S, False)),
    "daily_campaign_metrics": _schema(
        ("date", D, False), ("campaign_id", S, False), ("impressions", L, False),
        ("clicks", L, False), ("spend", DB, False), ("conversions", L, False),
        ("revenue", DB, False)),
    "app_reviews": _schema(
        ("review_id", S, False), ("timestamp", TS, False), ("rating", I, False),
        ("review_text", S, False), ("app_version", S, False), ("device", S, False),
        ("country", S, False)),
    "experiments": _schema(
        ("experiment_id", S, False), ("experiment_name", S, False), ("variant", S, False),
        ("customer_id", S, False), ("exposure_date", D, False), ("conversion", I, False),
        ("revenue", DB, False)),
    "marketing_incidents": _schema(
        ("incident_id", S, False), ("incident_date", D, False), ("title", S, False),
        ("description", S, False), ("affected_metric", S, False),
        ("affected_channel", S, False), ("root_cause", S, False), ("resolution", S, False),
        ("impact", S, False)),
    "metric_definitions": _schema(
        ("metric_name", S, False), ("definition", S, False), ("formula", S, False),
        ("required_columns", S, False), ("allowed_dimensions", S, False),
        ("business_context", S, False), ("owner", S, False)),
    "anomaly_ground_truth": _schema(
        ("scenario_id", S, False), ("start_date", D, False), ("end_date", D, False),
        ("affected_metric", S, False), ("affected_dimension", S, False),
        ("expected_direction", S, False), ("root_cause", S, False), ("severity", S, False)),
}

# Declared keys (fixed by the logical schema).
PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "customers": ("customer_id",),
    "campaigns": ("campaign_id",),
    "sessions": ("session_id",),
    "conversions": ("conversion_id",),
    "daily_campaign_metrics": ("date", "campaign_id"),
    "app_reviews": ("review_id",),
    "marketing_incidents": ("incident_id",),
    "metric_definitions": ("metric_name",),
    "anomaly_ground_truth": ("scenario_id",),
}

# (child table, child column, parent table, parent column)
FOREIGN_KEYS: list[tuple[str, str, str, str]] = [
    ("sessions", "customer_id", "customers", "customer_id"),
    ("conversions", "session_id", "sessions", "session_id"),
    ("conversions", "customer_id", "customers", "customer_id"),
    ("funnel_events", "customer_id", "customers", "customer_id"),
    ("funnel_events", "session_id", "sessions", "session_id"),
    ("daily_campaign_metrics", "campaign_id", "campaigns", "campaign_id"),
    ("experiments", "customer_id", "customers", "customer_id"),
]

TABLE_NAMES = tuple(SCHEMAS)


def not_null_columns(table: str) -> list[str]:
    return [f.name for f in SCHEMAS[table].fields if not f.nullable]
