"""Column expressions and statistics vectors (Fixture C), checked against
pandas / numpy / plain Python as the specification."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vendorscope.functions.numeric import ieee_div, round_half_even
from vendorscope.functions.quantile import exact_quantiles, quantile_values
from vendorscope.functions.tdist import t_cdf, t_ppf, t_two_sided_p
from vendorscope.functions.text import dollar_label, fixed_decimals, py_float_repr, strip_ws
from vendorscope.operators.inventory import qcut


# (value, label) as the original prints them
DOLLAR_LABELS = [
    (1234567.0, "1.234567M"), (1000000.0, "1.000000M"), (999999.995, "1000.00K"), (85012345.678, "85.012346M"),
    (1e12, "1000000.000000M"), (1000.0, "1.00K"), (1125.0, "1.12K"), (1005.0, "1.00K"), (2675.0, "2.67K"),
    (45678.9, "45.68K"), (999.999, "999.999"), (500.0, "500.0"), (0.0, "0.0"), (0.5, "0.5"), (1e-05, "1e-05"),
    (-52002.78, "-52002.78"), (-12345678.5, "-12345678.5"), (-1e20, "-1e+20"), (float("inf"), "infM"),
    (float("-inf"), "-inf"), (float("nan"), "nan"),
]


def test_ieee_div(spark):
    rows = [(5.0, 0.0), (-5.0, 0.0), (0.0, 0.0), (None, 1.0), (1.0, None), (6.0, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = [r[0] for r in df.select(ieee_div("a", "b")).collect()]
    assert got == [math.inf, -math.inf, None, None, None, 2.0]


def test_round_half_even_matches_numpy(spark):
    random.seed(11)
    vals = [0.125, 2.675, 1.005, -0.125, 0.285] + [random.uniform(-1e5, 1e5) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(round_half_even("x", 2)).collect()]
    assert got == [float(np.round(v, 2)) for v in vals]
    assert got[0] == 0.12


def test_strip_matches_python(spark):
    vals = ["  ACME ", "Bolt\t", None, "　x ", "\x1cy\x1f", "a b", "", " \n"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(strip_ws("s")).collect()]
    assert got == [None if v is None else v.strip() for v in vals]


def test_dollar_labels(spark):
    df = spark.createDataFrame([(v, t) for v, t in DOLLAR_LABELS], "x double, t string")
    for r in df.select("x", "t", dollar_label("x").alias("d")).collect():
        assert r.d == r.t, r.x


def test_float_repr_matches_python(spark):
    random.seed(5)
    vals = [v for v, _ in DOLLAR_LABELS] + [random.uniform(-1e9, 1e9) for _ in range(1500)]
    vals += [10 ** random.uniform(-8, 15) * random.choice([1, -1]) for _ in range(1500)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for r in df.select("x", py_float_repr("x").alias("r")).collect():
        assert r.r == repr(r.x), r.x


def test_fixed_decimals_half_even(spark):
    df = spark.createDataFrame([(1.125,), (2.675,), (-0.001,), (1234567.891,)], "x double")
    got = [r[0] for r in df.select(fixed_decimals("x", 2)).collect()]
    assert got == [format(v, ".2f") for v in (1.125, 2.675, -0.001, 1234567.891)]


@pytest.mark.parametrize("vector, probs", [
    ([1.0, 2.0, 4.0, 8.0, 16.0], [0.15, 0.25, 0.75]),
    ([1.0, 2.0, float("-inf")], [0.25, 0.5]),
    ([3.5], [0.0, 0.5, 1.0]),
])
def test_quantile_vectors(spark, vector, probs):
    df = spark.createDataFrame([(v,) for v in vector], "x double")
    got = quantile_values(df, "x", probs).first()
    expected = pd.Series(vector).quantile(probs)
    for i, p in enumerate(probs):
        assert got[f"q{i}"] == expected[p]


def test_exact_quantiles_random_against_pandas(spark):
    random.seed(3)
    groups = {
        "uniform": [random.uniform(-100, 100) for _ in range(3000)],
        "ties": [random.choice([1.0, 2.0, 3.0]) for _ in range(2000)] + [7.0] * 1500,
        "ints": [float(random.randint(0, 40)) for _ in range(2500)],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    probs = [0.15, 0.25, 0.5, 0.75, 0.85, 1 / 3, 2 / 3]
    got = {(r.g, r.prob): r.value for r in exact_quantiles(df, ["v"], probs, by=["g"]).collect()}
    for g, vs in groups.items():
        exp = pd.Series(vs).quantile(probs)
        for p in probs:
            assert got[(g, p)] == exp[p], (g, p)


def test_qcut_matches_pandas(spark):
    vec = [1, 1, 2, 2, 2, 3, 4, 5, 6]
    df = spark.createDataFrame([(float(v),) for v in vec], "x double")
    got = [r[0] for r in df.select(qcut(df, "x")).collect()]
    exp = pd.qcut(pd.Series(vec), q=3, labels=["Small", "Medium", "Large"]).astype(str).tolist()
    assert got == exp == ["Small"] * 5 + ["Medium"] + ["Large"] * 3


def test_qcut_duplicate_edges_raise(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 2, 3, 4, 5, 6]], "x double")
    with pytest.raises(Exception, match="bin edges must be unique"):
        df.select(qcut(df, "x")).collect()
    with pytest.raises(ValueError):
        pd.qcut(pd.Series([1, 1, 1, 1, 2, 3, 4, 5, 6]), q=3)


def test_t_distribution():
    assert abs(t_ppf(0.975, 10) - 2.228138851986303) < 1e-12
    assert abs(t_two_sided_p(2.228138851986303, 10) - 0.05) < 1e-12
    assert abs(t_cdf(0.0, 7) - 0.5) < 1e-15
    # tiny tails do not underflow
    p = t_two_sided_p(12.172734008388675, 2590.4511093041515)
    assert 3.4e-33 < p < 3.5e-33
    # symmetric quantiles
    assert abs(t_ppf(0.025, 5) + t_ppf(0.975, 5)) < 1e-12


def test_corr_masked_pairwise(spark):
    from vendorscope.operators.stats import correlation_matrix
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (2.0, None, 1.0), (3.0, 3.0, 1.0), (4.0, 3.0, 1.0)],
                               "x double, y double, c double")
    got = {(r.col_x, r.col_y): r.corr for r in correlation_matrix(df).collect()}
    exp = pd.DataFrame({"x": [1, 2, 3, 4], "y": [1, None, 3, 3], "c": [1, 1, 1, 1]}, dtype=float).corr()
    assert abs(got[("x", "y")] - exp.loc["x", "y"]) < 1e-12
    assert got[("x", "y")] == got[("y", "x")]
    assert got[("x", "c")] is None and math.isnan(exp.loc["x", "c"])
    assert abs(got[("x", "x")] - 1.0) < 1e-12


def test_corr_of_shifted_columns_any_partitioning(spark):
    """Columns shifted by 1e9 keep their digits; missing values pair by pair;
    an infinite value voids its own pairs only."""
    from vendorscope.operators.stats import correlation_matrix
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 4)) @ rng.normal(size=(4, 4))
    shifted = x + np.array([1e9, -1e9, 0.0, 1e9])
    frame = pd.DataFrame(shifted, columns=list("abcd"))
    exact = pd.DataFrame(shifted - np.array([1e9, -1e9, 0.0, 1e9]), columns=list("abcd"))
    for f in (frame, exact):
        f.loc[::7, "a"] = np.nan
        f.loc[::11, "b"] = np.nan
    frame["e"] = np.where(np.arange(4000) == 17, np.inf, 1.0 * np.arange(4000))
    frame.loc[17, "a"] = exact.loc[17, "a"] = np.nan
    exact["e"] = np.arange(4000) * 1.0
    want = exact.corr()
    for parts in (1, 7, 40):
        df = spark.createDataFrame(frame).repartition(parts)
        got = {(r.col_x, r.col_y): r.corr for r in correlation_matrix(df).collect()}
        for i in "abcd":
            for j in "abcd":
                assert abs(got[i, j] - want.loc[i, j]) < 1e-12 and got[i, j] == got[j, i]
        assert got["c", "e"] is None and abs(got["a", "e"] - want.loc["a", "e"]) < 1e-12
    empty = correlation_matrix(df.filter("false")).collect()
    assert empty == []


def test_describe_against_pandas(spark):
    from vendorscope.operators.stats import describe
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"a": rng.normal(size=3000) + 1e9, "b": 7.0, "c": rng.integers(0, 9, 3000) * 1.0,
                          "d": np.nan, "e": np.where(np.arange(3000) == 3, -np.inf, 1.5)})
    frame.loc[::5, "a"] = np.nan
    want = frame.describe()
    for parts in (1, 9):
        got = {r.column_name: r for r in describe(spark.createDataFrame(frame).repartition(parts)).collect()}
        for c in "abc":
            for ours, theirs in (("count", "count"), ("mean", "mean"), ("min", "min"), ("q25", "25%"), ("q50", "50%"),
                                 ("q75", "75%"), ("max", "max")):
                assert math.isclose(got[c][ours], want.loc[theirs, c], rel_tol=1e-15), (c, ours)
            assert math.isclose(got[c]["std"], want.loc["std", c], rel_tol=1e-9)
        assert got["b"]["std"] == 0.0 and got["d"]["count"] == 0 and got["d"]["mean"] is None
        # batches with and without the infinite value
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
        split = describe(spark.createDataFrame(frame[["e"]]).coalesce(1)).first()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert split["mean"] == -math.inf and split["std"] is None
        assert got["e"]["mean"] == -math.inf and got["e"]["std"] is None and got["e"]["q50"] == 1.5


def test_nan_never_emitted(spark):
    df = spark.createDataFrame([(0.0, 0.0)], "a double, b double")
    r = df.select(ieee_div("a", "b").alias("q"), F.isnan(ieee_div("a", "b")).alias("n")).first()
    assert r.q is None


def test_histogram_matches_numpy_on_edges(spark):
    from vendorscope.operators.distributions import histogram
    random.seed(9)
    vals = [random.uniform(-50, 250) for _ in range(3000)]
    lo, hi = min(vals), max(vals)
    edges = np.histogram_bin_edges(vals, bins=30)
    vals += [float(e) for e in edges] * 3          # values sitting exactly on edges
    vals += [float(np.nextafter(e, -np.inf)) for e in edges[1:-1]]
    df = spark.createDataFrame([(v, 7.0) for v in vals], "v double, const double")
    got = {(r.column_name, r.bin): r["count"] for r in histogram(df, ["v", "const"]).collect()}
    counts, e = np.histogram(vals, bins=np.histogram_bin_edges(vals, bins=30))
    assert [got[("v", i)] for i in range(30)] == counts.tolist()
    c2, _ = np.histogram([7.0] * len(vals), bins=30)
    assert [got[("const", i)] for i in range(30)] == c2.tolist()
    assert lo < hi


def test_exact_quantiles_drop_null_group_keys(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), ("b", 2.0)], "g string, v double")
    got = {(r.g, r.prob): r.value for r in exact_quantiles(df, ["v"], [0.5], by=["g"]).collect()}
    exp = pd.DataFrame({"g": ["a", "a", None, "b"], "v": [1.0, 3.0, 5.0, 2.0]}).groupby("g")["v"].quantile(0.5)
    assert got == {(g, 0.5): v for g, v in exp.items()}


@pytest.mark.parametrize("df", [1e6, 1e9, 1e12, 1e15])
def test_t_tail_at_large_dof(df):
    """Against the normal tail with its first correction in 1/dof."""
    z = 1.959963984540054
    normal = math.erfc(z / math.sqrt(2))
    pdf = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    want = normal + 2 * pdf * (z ** 3 + z) / (4 * df)
    assert math.isclose(t_two_sided_p(z, df), want, rel_tol=1e-9)
    assert math.isclose(t_ppf(0.975, df), z + (z ** 3 + z) / (4 * df), rel_tol=1e-9)
    assert math.isclose(t_cdf(-z, df) * 2, want, rel_tol=1e-9)
