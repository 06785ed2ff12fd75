"""Statistics operators against a brute-force pandas/numpy computation on the
small sf0.001 mart (collected to pandas in the test only)."""

import math

import numpy as np
import pandas as pd
import pytest

from tests.conftest import SF001
from vendorscope.operators import distributions as D
from vendorscope.operators import stats as ST
from vendorscope.plans.context import context_for


def rel(a, b, tol=1e-9):
    if a is None or (isinstance(a, float) and math.isnan(a)):
        return b is None or (isinstance(b, float) and math.isnan(b))
    if b is None:
        return False
    if a == b:
        return True
    return abs(a - b) <= tol * max(1.0, abs(b))


@pytest.fixture(scope="module")
def frames(spark):
    ctx = context_for(spark, SF001)
    return ctx, ctx.summary.toPandas(), ctx.clean.toPandas()


def test_describe_matches_pandas(frames):
    ctx, summary, _ = frames
    exp = summary.select_dtypes(include=np.number).describe().T
    got = {r.column_name: r for r in ST.describe(ctx.summary).collect()}
    assert list(got) and set(got) == set(exp.index)
    for col, row in exp.iterrows():
        g = got[col]
        assert g["count"] == row["count"]
        for ours, theirs in (("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"),
                             ("q50", "50%"), ("q75", "75%"), ("max", "max")):
            e = row[theirs]
            assert rel(g[ours], None if pd.isna(e) else float(e)), (col, ours, g[ours], e)


def _mpl_box(x: np.ndarray, whis=1.5):
    """matplotlib.cbook.boxplot_stats' rules, restated with numpy."""
    q1, med, q3 = np.percentile(x, [25, 50, 75])
    iqr = q3 - q1
    lo, hi = q1 - whis * iqr, q3 + whis * iqr
    wiskhi = x[x <= hi]
    whishi = q3 if len(wiskhi) == 0 or np.max(wiskhi) < q3 else np.max(wiskhi)
    wisklo = x[x >= lo]
    whislo = q1 if len(wisklo) == 0 or np.min(wisklo) > q1 else np.min(wisklo)
    fliers = np.concatenate([x[x < whislo], x[x > whishi]])
    return q1, med, q3, whislo, whishi, len(fliers)


def test_boxplot_matches_matplotlib_rules(frames):
    ctx, summary, _ = frames
    got = {r.column_name: r for r in D.boxplot_stats(ctx.summary).collect()}
    for col in summary.select_dtypes(include=np.number).columns:
        x = summary[col].astype(float).to_numpy()
        x = x[np.isfinite(x)]
        q1, med, q3, wlo, whi, nf = _mpl_box(x)
        g = got[col]
        assert (g.q1, g.median, g.q3, g.whislo, g.whishi) == (q1, med, q3, wlo, whi), col
        assert g.n_outliers == nf and g.n == len(x)


def test_outlier_rows_match(frames):
    ctx, summary, _ = frames
    got = D.outliers(ctx.summary, ["TotalSalesDollars", "FreightCost"]).toPandas()
    for col in ("TotalSalesDollars", "FreightCost"):
        x = summary[col].astype(float).to_numpy()
        x = x[np.isfinite(x)]
        *_, nf = _mpl_box(x)
        assert (got["column_name"] == col).sum() == nf


def test_kde_matches_exact_numpy(frames):
    ctx, _, clean = frames
    got = D.kde(ctx.clean, ["ProfitMargin", "TotalSalesDollars"], prebin=None).toPandas()
    for col in ("ProfitMargin", "TotalSalesDollars"):
        x = clean[col].astype(float).to_numpy()
        n, sd = len(x), np.std(x, ddof=1)
        bw = sd * n ** (-0.2)
        grid = np.linspace(x.min(), x.max(), 200)
        dens = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / bw) ** 2).sum(axis=1) / (n * bw * np.sqrt(2 * np.pi))
        g = got[got.column_name == col].sort_values("grid")
        assert np.allclose(g["x"].to_numpy(), grid, rtol=0, atol=1e-9 * max(1, abs(grid).max()))
        assert np.allclose(g["density"].to_numpy(), dens, rtol=1e-9, atol=0)


def test_category_counts_match_value_counts(frames):
    ctx, _, clean = frames
    got = D.category_counts(ctx.clean).toPandas()
    for col in ("VendorName", "Description"):
        vc = clean[col].value_counts()
        exp = sorted(vc.items(), key=lambda kv: (-kv[1], kv[0]))[:10]
        g = got[got.column_name == col].sort_values("rank")
        assert list(zip(g["value"], g["count"])) == exp


def test_prebinned_kde_close_to_exact(frames):
    ctx, _, _ = frames
    exact = D.kde(ctx.clean, ["ProfitMargin"], prebin=None).toPandas().sort_values("grid")
    binned = D.kde(ctx.clean, ["ProfitMargin"]).toPandas().sort_values("grid")
    peak = exact["density"].max()
    assert np.max(np.abs(exact["density"].to_numpy() - binned["density"].to_numpy())) < 5e-4 * peak
