"""The logical marketing tables every operator reads."""

from __future__ import annotations

from typing import Callable, Union

from pyspark.sql import DataFrame

TABLE_NAMES = ("customers", "campaigns", "sessions", "conversions", "funnel_events",
               "daily_campaign_metrics", "app_reviews", "experiments", "marketing_incidents",
               "metric_definitions", "anomaly_ground_truth")

Source = Union[DataFrame, Callable[[], DataFrame], None]


class MarketingTables:
    """Lazy DataFrames in the shapes of ``shiftscope.schemas``.

    Each table is given as a DataFrame or as a zero-argument builder that is called on
    first use, so an operator only plans the tables it reads.  Only the columns an
    operator uses need to be present.
    """

    def __init__(self, **tables: Source):
        unknown = set(tables) - set(TABLE_NAMES)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        self._sources = dict(tables)
        self._built: dict[str, DataFrame | None] = {}

    def __getattr__(self, name: str) -> DataFrame | None:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        built = self.__dict__["_built"]
        if name not in built:
            src = self.__dict__["_sources"].get(name)
            built[name] = src if (src is None or isinstance(src, DataFrame)) else src()
        return built[name]

    def has(self, name: str) -> bool:
        return self._sources.get(name) is not None

    def present(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in TABLE_NAMES if self._sources.get(n) is not None}
