"""Every registered query against its check SQL at the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                                "tools"))

import check_queries  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return check_queries.duck(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    assert check_queries.compare(spark, con, FOLDER, name) == ""


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_reports_agree(spark):
    from tillworks.operators import reports
    from tillworks.plans.registry import Tables

    t, year = Tables(spark, FOLDER), ("1996-01-01", "1996-12-31")
    total = reports.period_summary(t.sales, *year).first()
    for parts in (reports.payment_breakdown(t.sales, *year),
                  reports.sales_by_user(t.sales, t.users, *year)):
        rows = parts.collect()
        assert sum(r.n_sales for r in rows) == total.n_sales
        assert sum(r.total_sales for r in rows) == total.total_sales
