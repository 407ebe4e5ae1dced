"""What the physical plans must look like, whatever the data size."""

import os
import re

import pytest

from tillworks.operators import reports
from tillworks.plans.all_queries import QUERIES
from tillworks.plans.registry import Tables
from tillworks.sources import tables

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scan_rows(df) -> list[int]:
    """Rows read by each Parquet scan of the finished plan."""
    df.collect()
    found = []

    def walk(node):
        name = node.nodeName()
        if name.startswith("Scan parquet"):
            found.append(node.metrics().apply("numOutputRows").value())
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, FOLDER)


def test_no_pairing_joins(spark, t):
    """No cross or nested-loop join in any query that is planned as a whole."""
    eager = {"a", "e5", "e6", "f1", "f2", "f3", "g_", "s1", "s2", "h1_i", "h8_s", "h10"}
    for name, q in QUERIES.items():
        if not any(name.startswith(e) for e in eager):
            text = plan(q.run(t))
            assert "Cartesian" not in text and "NestedLoop" not in text, name


def test_range_and_columns_reach_the_scan(t):
    text = plan(QUERIES["d1_period_summary"].run(t))
    scan = text[text.index("FileScan"):]
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(o_orderdate.*LessThan\(o_orderdate",
                     scan)
    schema = re.search(r"ReadSchema: struct<(.*?)>", scan).group(1)
    # 3 columns: status, day, total
    assert set(re.findall(r"(\w+):", schema)) <= {
        "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus"}


def test_top_n_and_pages_do_not_sort_everything(t):
    for name in ("d3_top_quantity", "c1_sales_page", "b7_low_stock"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name].run(t)), name


def test_search_trims_groups_before_the_shuffle(t):
    assert "WindowGroupLimit" in plan(QUERIES["b10_search"].run(t))


def test_lines_of_other_periods_are_not_read(spark, make, tmp_path):
    root, days = str(tmp_path), 200
    sales = make("sales", [
        dict(id=i, sold_at=f"2025-{1 + i // 400:02d}-{1 + i // 20 % 20:02d} 10:00:00", user_id=1,
             total=1, status="completada") for i in range(days * 20)])
    lines = spark.range(400_000).selectExpr(
        "id", "id div 100 as sale_id", "id % 50 as product_id", "1L as quantity",
        "cast(1 as decimal(18,2)) as unit_price", "cast(1 as decimal(18,2)) as line_subtotal")
    products = make("products", [dict(id=i, product_name="x") for i in range(50)])
    spark.conf.set("parquet.block.size", str(1 << 18))
    tables.commit_tables(
        spark, root, {"sales": sales, "sale_lines": lines, "products": products})
    stored = {n: tables.read_table(spark, root, n) for n in ("sales", "sale_lines", "products")}
    week = reports.product_totals(
        stored["sales"], stored["sale_lines"], stored["products"], "2025-03-01", "2025-03-02")
    assert max(scan_rows(week)) < 200_000
    assert sum(r.total_quantity for r in week.collect()) == 4000


def test_period_report_reads_sales_once(t):
    df = reports.period_report(t.sales, "1996-01-01", "1996-12-31")
    df.collect()
    assert "ReusedExchange" in plan(df)
