import math

import pytest
from shiftscope.functions.stats import erfc, two_proportion_p_value, with_experiment_test, with_two_proportion_test


def _py_t1(sa, na, sb, nb):
    if na == 0 or nb == 0:
        return None
    pooled = (sa + sb) / (na + nb)
    var = pooled * (1 - pooled) * (1 / na + 1 / nb)
    if var < 0:
        return None
    se = math.sqrt(var)
    if se == 0:
        return 1.0
    return math.erfc(abs((sa / na - sb / nb) / se) / math.sqrt(2))


def test_erfc_matches_math_erfc(spark):
    xs = [i / 8 for i in range(-56, 57)] + [7.0, 9.5, -9.5, 1e-9]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", erfc("x").alias("y"))
    for x, y in df.collect():
        assert y == pytest.approx(math.erfc(x), rel=1e-9, abs=1e-15), x


def test_two_proportion_edges(spark):
    rows = [(62, 450, 44, 450), (0, 0, 3, 10), (5, 10, 5, 0), (10, 10, 10, 10), (0, 10, 0, 10),
            (12, 10, 3, 10), (479, 370, 100, 300), (1, 1000, 2, 1000)]
    df = spark.createDataFrame(rows, "sa long, na long, sb long, nb long")
    got = df.select("*", two_proportion_p_value("sa", "na", "sb", "nb").alias("p")).collect()
    for r in got:
        exp = _py_t1(r.sa, r.na, r.sb, r.nb)
        if exp is None:
            assert r.p is None
        else:
            assert r.p == pytest.approx(exp, rel=1e-11)
    sig = with_two_proportion_test(df, "sa", "na", "sb", "nb").collect()
    assert all(isinstance(r.statistically_significant, bool) for r in sig)


def test_two_proportion_equals_chi_square(spark):
    """The pooled z-test is the 2x2 Pearson chi-square test: an independent check."""
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.stat import ChiSquareTest
    sa, na, sb, nb = 62, 450, 44, 450
    rows = ([(1.0, Vectors.dense([0.0]))] * sa + [(0.0, Vectors.dense([0.0]))] * (na - sa)
            + [(1.0, Vectors.dense([1.0]))] * sb + [(0.0, Vectors.dense([1.0]))] * (nb - sb))
    chi = ChiSquareTest.test(spark.createDataFrame(rows, ["label", "features"]), "features", "label").head()
    ours = spark.createDataFrame([(sa, na, sb, nb)], "sa long, na long, sb long, nb long") \
        .select(two_proportion_p_value("sa", "na", "sb", "nb")).head()[0]
    assert ours == pytest.approx(chi.pValues[0], rel=1e-9)


def test_experiment_golden_case(spark):
    """Treatment 62/450 vs control 44/450 (expected values in FIXTURES.md §4)."""
    df = spark.createDataFrame([(44, 450, 62, 450)], "cs long, cn long, ts long, tn long")
    r = with_experiment_test(df, "cs", "cn", "ts", "tn").head()
    assert r.absolute_lift == pytest.approx(0.04, abs=1e-9)
    assert (r.treatment_rate - r.control_rate) / r.control_rate == pytest.approx(0.409091, abs=1e-6)
    assert r.p_value == pytest.approx(0.062693, abs=1e-6)
    assert r.ci_low == pytest.approx(-0.002039, abs=1e-6)
    assert r.ci_high == pytest.approx(0.082039, abs=1e-6)
    assert r.observed_power == pytest.approx(0.462205, abs=1e-6)
    assert r.observed_power < 0.8 and r.p_value >= 0.05
