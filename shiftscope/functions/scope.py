"""Scope filters (P2-P6) and scope identity.

A scope is a mapping of dimension name to one value.  Each analysis family accepts its
own allow-list of dimensions; an unknown dimension is an error, a ``None`` value is
skipped.
"""

from __future__ import annotations

import functools
from typing import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dimension names in their canonical order, per analysis family.
SESSION_SCOPE = ("country", "device", "channel", "campaign", "customer_segment")
CAMPAIGN_SCOPE = ("channel", "campaign")
REVIEW_SCOPE = ("device", "country")


def check_scope(scope: Mapping[str, str] | None, allowed: tuple[str, ...], family: str) -> dict:
    scope = dict(scope or {})
    unknown = sorted(set(scope) - set(allowed))
    if unknown:
        raise ValueError(f"{family} can be scoped by {', '.join(allowed)}, not by {', '.join(unknown)}")
    return scope


def ordered_scope(scope: Mapping[str, str] | None, allowed: tuple[str, ...]) -> list[tuple[str, str]]:
    scope = scope or {}
    return [(name, scope[name]) for name in allowed if scope.get(name) is not None]


def scope_predicate(scope: Mapping[str, str] | None, allowed: tuple[str, ...],
                    family: str = "analysis", columns: Mapping[str, Column] | None = None) -> Column:
    """AND of ``column == value`` for every scoped dimension (TRUE when unscoped)."""
    check_scope(scope, allowed, family)
    columns = columns or {}
    preds = [(columns.get(name, F.col(name)) == F.lit(value))
             for name, value in ordered_scope(scope, allowed)]
    return functools.reduce(lambda a, b: a & b, preds, F.lit(True))


def scope_identity(scope: Mapping[str, str] | None) -> str:
    """``name=value;...`` in canonical order over the session dimensions, else ``global``."""
    parts = [f"{name}={value}" for name, value in ordered_scope(scope, SESSION_SCOPE)]
    return ";".join(parts) if parts else "global"


def scope_identity_col(scope: Mapping[str, str] | None, override_dim: str,
                       override_value: Column) -> Column:
    """Scope identity when one dimension's value comes from a column (P6 drill-down)."""
    scope = dict(scope or {})
    parts = []
    for name in SESSION_SCOPE:
        if name == override_dim:
            parts.append(F.concat(F.lit(f"{name}="), override_value))
        elif scope.get(name) is not None:
            parts.append(F.lit(f"{name}={scope[name]}"))
    joined = F.concat_ws(";", *parts) if parts else F.lit("")
    return F.when(joined == "", F.lit("global")).otherwise(joined)


def scope_label(scope: Mapping[str, str] | None) -> str:
    """``dim=value, ...`` in the caller's insertion order (report titles)."""
    return ", ".join(f"{k}={v}" for k, v in (scope or {}).items())
