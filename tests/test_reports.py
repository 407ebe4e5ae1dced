import pytest

from tillworks.functions.dates import parse_day
from tillworks.operators import history, paging, reports

WEEK = ("2025-06-22", "2025-06-29")


def test_summary_and_breakdown(shop, rows):
    assert rows(reports.period_summary(shop["sales"], *WEEK)) == [(4, 191.0, 47.75)]
    assert rows(reports.payment_breakdown(shop["sales"], *WEEK)) == [
        ("efectivo", 140.0, 2), ("tarjeta_debito", 31.0, 1), (None, 20.0, 1)]
    report = reports.period_report(shop["sales"], *WEEK)
    assert rows(report.filter("is_summary"), "n_sales", "total_sales") == [(4, 191.0)]
    assert report.filter("not is_summary").count() == 3


@pytest.mark.parametrize("bound", ["2025-6-1", "garbage", "2025-02-30", "2025-06-01 00:00"])
def test_unreadable_bound_matches_nothing(shop, rows, bound):
    assert parse_day(bound) is None
    assert rows(reports.period_summary(shop["sales"], bound, "2025-12-31")) == [(0, None, None)]
    assert reports.payment_breakdown(shop["sales"], bound, "2025-12-31").count() == 0
    report = reports.period_report(shop["sales"], bound, "2025-12-31")
    assert rows(report, "is_summary", "n_sales", "total_sales") == [(True, 0, None)]


def test_missing_bound_is_refused(shop):
    for bounds in [("", "2025-01-01"), ("2025-01-01", None)]:
        with pytest.raises(ValueError):
            reports.period_summary(shop["sales"], *bounds)


def test_top_products(shop, rows):
    totals = reports.product_totals(
        shop["sales"], shop["sale_lines"], shop["products"], *WEEK)
    by_quantity = reports.top_products_by_quantity(totals, 2).collect()
    assert [(r.product_id, r.total_quantity) for r in by_quantity] == [(10, 2), (11, 2)]
    by_value = reports.top_products_by_value(totals, "2").collect()
    assert [(r.product_id, float(r.total_value)) for r in by_value] == [(12, 90.0), (10, 50.0)]
    for n in (0, -1, "x", None):
        with pytest.raises(ValueError):
            reports.top_products_by_value(totals, n)


def test_sales_by_user_drops_missing_users(shop):
    found = reports.sales_by_user(shop["sales"], shop["users"], *WEEK).collect()
    assert [(r.username, r.n_sales, float(r.total_sales)) for r in found] == [
        ("ana", 1, 90.0), ("beto", 2, 81.0)]
    detail = reports.period_sales_detail(shop["sales"], shop["users"], *WEEK).collect()
    assert [r.id for r in detail] == [1, 2, 3]


def test_history_pages(shop):
    sales, users = shop["sales"], shop["users"]
    info = paging.page_info(history.filter_sales(sales, users), 1, 2).first()
    assert tuple(info) == (5, 1, 3)
    assert paging.page_info(history.filter_sales(sales, users), 1, None).first().total_pages == 1
    found = history.list_sales(sales, users, client="luis").collect()
    assert [r.id for r in found] == [3, 1]
    pages = [history.list_sales(sales, users, page=p, limit=2).collect() for p in (0, 1, 2, 3, 4)]
    assert [[r.id for r in p] for p in pages] == [[4, 3], [4, 3], [5, 2], [1], []]
    everything = [r.id for r in history.list_sales(sales, users, limit=None).collect()]
    assert everything == [4, 3, 5, 2, 1]
    after = history.list_sales(sales, users, after=("2025-06-26 08:00:00", 5), limit=2).collect()
    assert [r.id for r in after] == [2, 1]


def test_sale_documents(shop):
    tables = [shop[n] for n in ("sales", "users", "sale_lines", "products")]
    found = {r.id: r for r in history.sale_documents(*tables).collect()}
    assert sorted(found) == [1, 2, 3, 4, 5]
    assert [(x.product_name, x.barcode, x.quantity) for x in found[1].lines] == [
        ("Leche 1L", "7501", 2)]
    without_users = shop["users"].unionByName(
        shop["users"].filter("id = 1").selectExpr("7L as id", "* except (id)"))
    found = history.sale_documents(tables[0], without_users, *tables[2:],
                                   sale_ids=shop["sales"].filter("id >= 5").select("id"))
    assert {r.id: len(r.lines) for r in found.collect()} == {5: 1, 6: 0}


def test_large_documents_come_in_parts(spark, make, shop):
    lines = make("sale_lines", [
        dict(id=i, sale_id=1 if i % 3 else 2, product_id=10, quantity=1 + i % 4,
             line_subtotal=1) for i in range(200)])
    tables = (shop["sales"], shop["users"], lines, shop["products"])
    whole = {r.id: r.lines for r in history.sale_documents(*tables).collect()}
    parts = history.sale_documents(*tables, part_lines=70).collect()
    sizes = {}
    for r in parts:
        sizes.setdefault(r.id, []).append((r.part, r.lines))
    assert len(sizes[2]) == 1 and len(sizes[1]) > 1
    for sale, pieces in sizes.items():
        assert all(len(x) <= 70 for _, x in pieces)
        joined = [x for _, piece in sorted(pieces, key=lambda p: p[0]) for x in piece]
        assert joined == whole[sale]


def test_parts_do_not_depend_on_the_layout(spark, make, shop):
    lines = make("sale_lines", [
        dict(id=i, sale_id=1 + i % 2, product_id=10, quantity=1, line_subtotal=1)
        for i in range(300)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in (2, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            parts = history.sale_documents(
                shop["sales"], shop["users"], lines, shop["products"], part_lines=40)
            found.append(sorted((r.id, r.part, [x.id for x in r.lines]) for r in parts.collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
    assert [(p, len(x)) for sale, p, x in found[0] if sale == 1] == [
        (0, 40), (1, 40), (2, 40), (3, 30)]


def test_numbering_parts_shuffles_lines_once(make):
    lines = make("sale_lines", [
        dict(id=i, sale_id=i % 3, product_id=i % 7, quantity=1, line_subtotal=1)
        for i in range(200)])
    parts = history._numbered_parts(lines, 10)
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan  # lines are shuffled by range, before
    found = {(r.sale_id, r.id): r.part for r in parts.collect()}
    assert found == {(i % 3, i): i // 3 // 10 for i in range(200)}


def test_visible_sales(spark, shop, rows):
    grants = spark.createDataFrame(
        [(1, history.SEE_ALL), (2, history.SEE_OWN), (2, "x")], "user_id long, permission string")
    sales = shop["sales"]
    assert history.visible_sales(sales, grants, 1).count() == 6
    assert history.visible_sales(sales, grants, 1, user_id=2).count() == 3
    for asked in (None, 1, 2):
        own = history.visible_sales(sales, grants, 2, user_id=asked)
        assert {r.user_id for r in own.collect()} == {2}
    assert history.visible_sales(sales, grants, 3).count() == 0
    documents = history.visible_documents(
        sales, shop["users"], shop["sale_lines"], shop["products"], grants, 2,
        sales.select("id").filter("id in (1, 3, 5)")).collect()
    assert {r.id for r in documents} == {1, 5}
    assert rows(history.visible_totals(sales, shop["users"], grants)) == [
        (1, "all", 5, 1195.0), (2, "own", 3, 1080.0), (3, "refused", 0, None)]


def test_product_report_reads_sales_and_lines_once(spark, shop, monkeypatch):
    week = ("2025-06-22", "2025-06-29")
    totals = reports.product_totals(shop["sales"], shop["sale_lines"], shop["products"], *week)
    report = reports.product_report(
        shop["sales"], shop["sale_lines"], shop["products"], *week, n=2)
    rows = report.collect()
    for ranking, top, column in (
            ("quantity", reports.top_products_by_quantity(totals, 2), "total_quantity"),
            ("value", reports.top_products_by_value(totals, 2), "total_value")):
        got = {(r.product_id, r[column]) for r in rows if r.ranking == ranking}
        assert got == {(r.product_id, r[column]) for r in top.collect()}
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
    with pytest.raises(ValueError):
        reports.product_report(
            shop["sales"], shop["sale_lines"], shop["products"], *week, n=0)
    empty = reports.product_report(
        shop["sales"], shop["sale_lines"], shop["products"], "2001-01-01", "2001-01-02")
    assert empty.count() == 0
