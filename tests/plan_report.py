"""Write PLANS.md: the physical operator tree of headline queries plus the
scan lines (ReadSchema / PushedFilters) that show pruning and pushdown.

Usage: python tests/plan_report.py [sf_dir]
"""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

QUERIES = ["clean_sales", "kpi_metrics", "revenue_daily", "revenue_ma7", "product_abc", "basket_itemsets",
           "business_brief", "load_status"]


def tree_and_scans(df) -> tuple[str, list[str]]:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    head = text.split("\n\n")[0]
    tree = "\n".join(ln for ln in head.splitlines() if not ln.startswith("=="))
    scans = []
    for block in text.split("\n\n"):
        first = block.strip().splitlines()[0] if block.strip() else ""
        if "Scan parquet" in first:
            keep = [ln for ln in block.splitlines() if ln.startswith(("PushedFilters", "ReadSchema"))]
            name = re.search(r"\[file:[^\]]*/([^/\]]+)\]", block)
            scans.append(f"{name.group(1) if name else 'scan'}: " + " | ".join(keep))
    return tree, sorted(set(scans))


def mining_plan(spark, sf):
    """Itemsets as planned, before ``mine`` runs and stores them."""
    from tillroll.operators import basket
    from tillroll.plans import fixtures
    import __spark_entry__ as E
    sales = fixtures.sales(spark, sf)
    n = basket.order_count(sales, "transaction_id", E.BASKET_ITEM)
    return basket.frequent_itemsets(basket.presence(sales, "transaction_id", E.BASKET_ITEM), n, E.BASKET_SUPPORT)


def main():
    from tillroll.session import get_spark
    import __spark_entry__ as E
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[2]", 8)
    out = ["# Physical plans of headline queries", "",
           f"Generated by `tests/plan_report.py` at `{sf}` (AQE on; the tree is the initial plan, AQE may",
           "turn shuffle joins of small sides into broadcast joins at run time).", ""]
    for name in QUERIES:
        df = mining_plan(spark, sf) if name == "basket_itemsets" else E.queries()[name](spark, sf)
        tree, scans = tree_and_scans(df)
        out += [f"## {name}", "", "```", tree, "```", ""]
        out += [f"- {s}" for s in scans] + [""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
