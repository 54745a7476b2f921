"""Comparison periods: two half-open ``[start, end)`` date ranges."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_date(value) -> _dt.date:
    if isinstance(value, _dt.datetime):
        return value.date()
    if isinstance(value, _dt.date):
        return value
    return _dt.date.fromisoformat(str(value))


@dataclass(frozen=True)
class Periods:
    """Current and previous half-open periods (``end`` is exclusive)."""

    current_start: _dt.date
    current_end: _dt.date
    previous_start: _dt.date
    previous_end: _dt.date

    @classmethod
    def of(cls, cs, ce, ps, pe) -> "Periods":
        return cls(_as_date(cs), _as_date(ce), _as_date(ps), _as_date(pe))

    def key_parts(self) -> list[str]:
        """ISO date strings in evidence-key order: cs, ce, ps, pe."""
        return [d.isoformat() for d in (self.current_start, self.current_end,
                                        self.previous_start, self.previous_end)]

    # --- column predicates (P1) ------------------------------------------------
    @staticmethod
    def in_range(ts, start: _dt.date, end: _dt.date, as_date: bool = False) -> Column:
        """Half-open ``start <= ts < end``; literals are typed to the column's kind.

        ``ts`` is a column name (one SQL expression) or a Column.
        """
        kind = "DATE" if as_date else "TIMESTAMP_NTZ"
        if isinstance(ts, str):
            return F.expr(f"(`{ts}` >= {kind} '{start.isoformat()}' AND `{ts}` < {kind} '{end.isoformat()}')")
        lo = F.lit(start.isoformat()).cast(kind.lower())
        hi = F.lit(end.isoformat()).cast(kind.lower())
        return (ts >= lo) & (ts < hi)

    def in_current(self, ts: Column, as_date: bool = False) -> Column:
        return self.in_range(ts, self.current_start, self.current_end, as_date)

    def in_previous(self, ts: Column, as_date: bool = False) -> Column:
        return self.in_range(ts, self.previous_start, self.previous_end, as_date)

    def in_either(self, ts: Column, as_date: bool = False) -> Column:
        return self.in_current(ts, as_date) | self.in_previous(ts, as_date)

    def _sql(self, ts: str, start, end, as_date: bool) -> str:
        kind = "DATE" if as_date else "TIMESTAMP_NTZ"
        return f"(`{ts}` >= {kind} '{start.isoformat()}' AND `{ts}` < {kind} '{end.isoformat()}')"

    def first_match_label(self, ts: str, as_date: bool = False) -> Column:
        """P7: 'current' if in the current period, else 'previous' if in the previous one."""
        cur = self._sql(ts, self.current_start, self.current_end, as_date)
        prev = self._sql(ts, self.previous_start, self.previous_end, as_date)
        return F.expr(f"CASE WHEN {cur} THEN 'current' WHEN {prev} THEN 'previous' END")

    def all_labels(self, ts: str, as_date: bool = False) -> Column:
        """Array of every period a row falls in (a row in both periods counts twice)."""
        cur = self._sql(ts, self.current_start, self.current_end, as_date)
        prev = self._sql(ts, self.previous_start, self.previous_end, as_date)
        return F.expr(f"array_compact(array(CASE WHEN {cur} THEN 'current' END, "
                      f"CASE WHEN {prev} THEN 'previous' END))")
