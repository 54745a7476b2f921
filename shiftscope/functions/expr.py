"""Scalar column helpers: safe ratios, percent change, evidence ids, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def lit_or_col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def safe_ratio(num, den) -> Column:
    """F1: ``num / den`` as a double, 0.0 when the denominator is 0 or NULL."""
    return F.coalesce(F.try_divide(col(num).cast("double"), col(den).cast("double")),
                      F.lit(0.0))


def pct_change(cur, prev) -> Column:
    """``(cur - prev) / prev``; NULL when ``prev`` is 0."""
    cur, prev = col(cur).cast("double"), col(prev).cast("double")
    return F.when(prev != 0, (cur - prev) / prev)


def rnd(c, places: int) -> Column:
    """Round half-up and normalise negative zero, so engines agree on printed values."""
    return F.round(col(c).cast("double"), places) + F.lit(0.0)


def sha_prefix(key: Column, n: int) -> Column:
    return F.substring(F.sha2(key, 256), 1, n)


class C(str):
    """Marks an evidence-key part as a column name (a plain ``str`` is a literal)."""


def sql_lit(value: str) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def evidence_id(prefix: str, *parts, n: int = 12) -> Column:
    """``prefix`` + first ``n`` hex chars of SHA-256 of the ``|``-joined key parts.

    Parts are literal strings, ``C("column")`` names or Columns; NULL column parts must
    be coalesced by the caller (the key spells a missing segment as ``None``).  Without
    Column parts the id is one SQL expression.
    """
    if not any(isinstance(p, Column) for p in parts):
        items = [f"`{p}`" if isinstance(p, C) else sql_lit(p) for p in parts]
        return F.expr(f"concat({sql_lit(prefix)}, substring(sha2(concat_ws('|', {', '.join(items)}), 256), 1, {n}))")
    key = F.concat_ws("|", *[lit_or_col(p) for p in parts])
    return F.concat(F.lit(prefix), sha_prefix(key, n))


def text_or_none(c) -> Column:
    """How a key spells a NULL value."""
    return F.coalesce(col(c).cast("string"), F.lit("None"))


MONEY_TYPE = "DECIMAL(28, 8)"


def money_sum_sql(c: str) -> str:
    return f"cast(sum(cast({c} as {MONEY_TYPE})) as double)"


def money_sum(c: str) -> Column:
    """Exact sum of a money column, as a double once it is summed.

    Floating-point sums depend on the order rows arrive in, which differs between runs
    of a distributed job.  The column is summed as a decimal with eight places (amounts up
    to 1e20), so the total is the same for every partitioning and nothing is rounded away.
    """
    return F.expr(money_sum_sql(c))


def clamp(c, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))
