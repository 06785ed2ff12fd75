"""Write PLANS.md: the physical plan (operator tree) of the headline jobs.

    python scripts/dump_plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from vendorscope.operators import summary as S  # noqa: E402
from vendorscope.plans.context import context_for  # noqa: E402
from vendorscope.plans.registry import REGISTRY, _load  # noqa: E402
from vendorscope.session import get_session  # noqa: E402

JOBS = ["target_brands", "vendor_pareto", "unit_price_by_order_size", "margin_ci", "welch_test",
        "describe", "correlation", "histogram", "kde", "boxplot", "category_counts", "distinct_po"]


def tree(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    head = text.split("\n\n\n")[0]
    return re.sub(r"\n{3,}", "\n\n", head).strip()


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session(8, 8)
    _load()
    ctx = context_for(spark, sf_dir)
    s = ctx.sources
    out = ["# Physical plans", "",
           f"Generated by `scripts/dump_plans.py` on `{os.path.basename(sf_dir)}` (local[8], AQE on; "
           "final adaptive plans). Small tables are broadcast here because the test data is small; "
           "on large inputs AQE plans the same joins as sort-merge joins with skew splitting "
           "(exercised in `tests/test_scale_paths.py`).", ""]
    out += ["## vendor_summary (B1, the mart before it is stored)", "", "```",
            tree(S.vendor_sales_summary(s.purchases, s.purchase_prices, s.vendor_invoice, s.sales, totals=s.purchase_totals)),
            "```", ""]
    for name in JOBS:
        out += [f"## {name}", "", "```", tree(REGISTRY[name].build(ctx)), "```", ""]
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
