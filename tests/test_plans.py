"""Plan-shape checks: the relational jobs stay in the JVM (no Python UDF
operators), filters and column pruning reach the Parquet scan, and windows
without a partition only ever see already-limited rows."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF001
from vendorscope.operators import inventory as I
from vendorscope.operators import rankings as R
from vendorscope.plans.context import context_for


def physical(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def ctx(spark):
    return context_for(spark, SF001)


JVM_ONLY = ["vendor_summary_raw", "purchase_summary", "sales_summary", "freight_by_vendor",
            "brand_performance", "target_brands", "top_vendors_sales", "top_brands_sales",
            "vendor_pareto", "vendor_dependency", "order_size", "unit_price_by_order_size",
            "slow_vendors", "unsold_total", "unsold_by_vendor",
            "category_counts"]
# reduced to a few numbers a task in vectors, in one scan
ONE_SCAN = ["describe", "correlation", "boxplot", "histogram"]


@pytest.mark.parametrize("name", JVM_ONLY)
def test_no_python_in_plan(spark, name):
    df = E.queries()[name](spark, SF001)
    plan = physical(df)
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


@pytest.mark.parametrize("name", ONE_SCAN)
def test_one_vectorised_scan(spark, name):
    plan = physical(E.queries()[name](spark, SF001))
    assert "PythonUDF" not in plan and "MapInArrow" in plan
    assert len(re.findall(r"^\(\d+\) Scan parquet", plan, re.M)) == 1


def test_filter_pushdown_and_pruning(ctx):
    df = ctx.clean.select("VendorName", "TotalSalesDollars")
    plan = physical(df)
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan).group(1)
    for f in ("GreaterThan(GrossProfit,0.0)", "GreaterThan(ProfitMargin,0.0)", "GreaterThan(TotalSalesQuantity,0.0)"):
        assert f in pushed
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert set(n.split(":")[0] for n in schema.split(",")) == {
        "VendorName", "TotalSalesDollars", "GrossProfit", "ProfitMargin", "TotalSalesQuantity"}


def test_source_scan_pushdown(ctx):
    plan = physical(ctx.sources.sales)
    assert "EqualTo(l_linestatus,O)" in plan


def nodes(plan):
    """(depth, name and arguments) of every operator of a printed plan."""
    out = []
    for line in plan.splitlines():
        m = re.match(r"^([ :+\-]*)(?:\*\(\d+\) )?(\w.*)$", line)
        if m:
            out.append((len(m.group(1)), m.group(2)))
    return out


def test_unpartitioned_windows_only_after_limits(ctx):
    """A window without PARTITION BY pulls all rows into one task; here the
    first operator below such a window that is no sort, projection or other
    window must be the top k itself."""
    for df in (R.vendor_pareto(ctx.clean), R.vendor_dependency(ctx.clean), R.top_vendor_share(ctx.clean),
               I.slow_vendors(ctx.clean)):
        plan = nodes(physical(df))
        for k, (depth, text) in enumerate(plan):
            if text.startswith("Window ") and not re.search(r"\], \[\w+#\d+\]|partition by", text):
                below = next(t for d, t in plan[k + 1:] if d > depth
                             and not re.match(r"(Sort|Project|Window|Exchange SinglePartition|InputAdapter|WholeStage)", t))
                assert below.startswith("TakeOrderedAndProject"), below


def test_pareto_ranks_once_and_never_sorts_all_vendors(ctx):
    for df in (R.vendor_pareto(ctx.clean), R.vendor_dependency(ctx.clean), R.top_vendor_share(ctx.clean)):
        plan = physical(df)
        tree = plan.split("\n\n")[0]                        # the details repeat every operator
        assert tree.count("TakeOrderedAndProject") == 1 and "rangepartitioning" not in plan


def test_top_k_plans_as_take_ordered(ctx):
    plan = physical(R.top_vendors_by_sales(ctx.clean))
    assert "TakeOrderedAndProject" in plan


def test_thresholds_are_scalar_subqueries_not_joins(ctx):
    plan = physical(R.target_brands(ctx.clean))
    assert "Subquery" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry_contract(spark):
    df = E.entry(spark)
    assert df.count() == 925
    assert len(df.columns) == 18
    assert set(E.oracle_sql()) <= set(E.queries())
    # every registered query is a fresh lazy DataFrame over the given folder
    assert all(callable(f) for f in E.queries().values())
    assert F is not None


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_cross_joins(spark, name):
    plan = physical(E.queries()[name](spark, SF001))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
