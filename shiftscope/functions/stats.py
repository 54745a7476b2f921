"""Significance tests as native Spark SQL expressions (T1, T2, F6). No Python UDF.

``erfc`` of x < 1.5 uses the positive-term series
    erf(x) = exp(-x^2) * sum_{n>=0} x^(2n+1) / Gamma(n + 3/2)
with terms built by the recurrence t_n = t_(n-1) * x^2 / (n + 1/2); for x >= 1.5 it uses
Laplace's continued fraction
    erfc(x) = exp(-x^2) / sqrt(pi) / (x + (1/2) / (x + 1 / (x + (3/2) / (x + ...))))
evaluated backwards from 60 terms.  Both are Spark higher-order ``aggregate`` calls
over fixed-length sequences; the result is accurate to about 1e-14 relative.  Only
aggregated result rows reach these expressions, so their cost does not grow with the
fact tables.

Builders return SQL expression text over column names, so a whole test is one
expression (one round trip to the JVM, no duplicated Column subtrees); callers that
want a Column wrap it with ``F.expr``.  Arguments must be column names or other
cheap expressions because they are repeated inside the text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TERMS = 150
_SPLIT = 1.5
_CF_TERMS = 60
Z_95 = 1.96           # two-sided 95% critical value used by the interval and power
ALPHA = 0.05          # significance threshold
_TWO_OVER_SQRT_PI = repr(2.0 / math.sqrt(math.pi))
_SQRT2 = repr(math.sqrt(2.0))


def _d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def erfc_nonneg_sql(ax: str) -> str:
    """erfc of a non-negative argument."""
    t0 = f"{ax} * {_TWO_OVER_SQRT_PI}D"
    step = f"acc.t * {ax} * {ax} / (CAST(n AS DOUBLE) + 0.5D)"
    series = (f"aggregate(sequence(1, {_TERMS}), named_struct('t', {t0}, 's', {t0}), "
              f"(acc, n) -> named_struct('t', {step}, 's', acc.s + {step})).s")
    frac = (f"aggregate(sequence({_CF_TERMS}, 1, -1), CAST({ax} AS DOUBLE), "
            f"(u, k) -> {ax} + CAST(k AS DOUBLE) * 0.5D / u)")
    return (f"(CASE WHEN {ax} < {_SPLIT}D THEN 1.0D - exp(-({ax}) * ({ax})) * {series} "
            f"ELSE exp(-({ax}) * ({ax})) / ({repr(math.sqrt(math.pi))}D * {frac}) END)")


def erfc_sql(x: str) -> str:
    x = _d(x)
    return (f"(CASE WHEN {x} IS NULL THEN CAST(NULL AS DOUBLE) WHEN {x} >= 0 THEN {erfc_nonneg_sql(x)} "
            f"ELSE 2.0 - {erfc_nonneg_sql('(-' + x + ')')} END)")


def erfc(x) -> Column:
    """Complementary error function of a double column given by name."""
    return F.expr(erfc_sql(x if isinstance(x, str) else str(x)))


def normal_cdf_sql(y: str) -> str:
    return f"(0.5 * {erfc_sql(f'(-({y}) / {_SQRT2})')})"


def t1_var_sql(sa: str, na: str, sb: str, nb: str) -> str:
    """Pooled variance term of T1, NULL when either total is 0."""
    pooled = f"(({_d(sa)} + {_d(sb)}) / ({_d(na)} + {_d(nb)}))"
    return (f"(CASE WHEN {na} = 0 OR {nb} = 0 THEN CAST(NULL AS DOUBLE) ELSE "
            f"{pooled} * (1.0 - {pooled}) * (1.0 / {_d(na)} + 1.0 / {_d(nb)}) END)")


def t1_z_sql(sa: str, na: str, sb: str, nb: str, var: str) -> str:
    return (f"(CASE WHEN {var} > 0 THEN ({_d(sa)} / {_d(na)} - {_d(sb)} / {_d(nb)}) / sqrt({var}) "
            f"ELSE CAST(NULL AS DOUBLE) END)")


def t1_p_sql(var: str, z: str) -> str:
    """T1 p-value from the variance and z columns: NULL when the totals are 0 or the
    variance is negative (a "rate" above 1), 1.0 when the standard error is 0."""
    return (f"(CASE WHEN {var} IS NULL OR {var} < 0 THEN CAST(NULL AS DOUBLE) WHEN {var} = 0 THEN 1.0 "
            f"ELSE {erfc_nonneg_sql(f'(abs({z}) / {_SQRT2})')} END)")


def with_two_proportion_test(df: DataFrame, sa: str, na: str, sb: str, nb: str,
                             p: str = "p_value", z: str = "z_score",
                             significant: str = "statistically_significant") -> DataFrame:
    """Pooled two-proportion z-test, two-sided, as three added columns."""
    df = df.withColumn("_t1_var", F.expr(t1_var_sql(sa, na, sb, nb)))
    df = df.withColumn(z, F.expr(t1_z_sql(sa, na, sb, nb, "_t1_var")))
    df = df.withColumn(p, F.expr(t1_p_sql("_t1_var", z)))
    return df.withColumn(significant, F.expr(f"coalesce({p} < {ALPHA}, false)")).drop("_t1_var")


def two_proportion_p_value(sa: str, na: str, sb: str, nb: str) -> Column:
    """T1 p-value as one Column (inputs are column names)."""
    var = t1_var_sql(sa, na, sb, nb)
    return F.expr(t1_p_sql(var, t1_z_sql(sa, na, sb, nb, var)))


def z_score(sa: str, na: str, sb: str, nb: str) -> Column:
    return F.expr(t1_z_sql(sa, na, sb, nb, t1_var_sql(sa, na, sb, nb)))


def is_significant(p) -> Column:
    p = p if isinstance(p, Column) else F.col(p)
    return F.coalesce(p < F.lit(ALPHA), F.lit(False))


def with_experiment_test(df: DataFrame, cs: str, cn: str, ts: str, tn: str) -> DataFrame:
    """Rates, lift, pooled-SE p-value, unpooled 95% interval and observed power,
    added as columns control_rate, treatment_rate, absolute_lift, p_value, ci_low,
    ci_high, observed_power."""
    df = df.withColumns({
        "control_rate": F.expr(f"CASE WHEN {cn} <> 0 THEN {_d(cs)} / {_d(cn)} ELSE 0.0 END"),
        "treatment_rate": F.expr(f"CASE WHEN {tn} <> 0 THEN {_d(ts)} / {_d(tn)} ELSE 0.0 END"),
        "_t2_var": F.expr(t1_var_sql(cs, cn, ts, tn)),
    })
    df = df.withColumns({
        "absolute_lift": F.expr("treatment_rate - control_rate"),
        "_t2_ise": F.expr(f"sqrt(control_rate * (1.0 - control_rate) / {_d(cn)} "
                          f"+ treatment_rate * (1.0 - treatment_rate) / {_d(tn)})"),
    })
    df = df.withColumns({
        "p_value": F.expr(f"CASE WHEN _t2_var < 0 THEN CAST(NULL AS DOUBLE) WHEN _t2_var = 0 THEN 1.0 "
                          f"ELSE {erfc_nonneg_sql(f'(abs(absolute_lift) / sqrt(_t2_var) / {_SQRT2})')} END"),
        "ci_low": F.expr(f"absolute_lift - {Z_95} * _t2_ise"),
        "ci_high": F.expr(f"absolute_lift + {Z_95} * _t2_ise"),
        "_t2_eff": F.expr("CASE WHEN _t2_ise <> 0 THEN abs(absolute_lift) / _t2_ise ELSE 0.0 END"),
    })
    df = df.withColumn("observed_power", F.expr(
        f"1.0 - {normal_cdf_sql(f'{Z_95} - _t2_eff')} + {normal_cdf_sql(f'-{Z_95} - _t2_eff')}"))
    return df.drop("_t2_var", "_t2_ise", "_t2_eff")
