import re

import pytest
from pyspark.sql import functions as F

from tillworks.functions import text
from tillworks.functions.pricing import stock_band, tender, tier_price
from tillworks.operators import catalog
from tillworks.schemas import EXPORT_COLUMNS


def ids(df):
    return [r.id for r in df.collect()]


def listed(shop, **options):
    return ids(catalog.list_products(
        shop["products"], shop["categories"], shop["suppliers"], **options))


def test_product_filters(shop):
    assert listed(shop) == [12, 10, 11]
    assert listed(shop, only_active=False, limit=None) == [12, 13, 10, 11]
    assert listed(shop, name="café") == []
    assert listed(shop, name="caf") == [12]
    assert listed(shop, name="jugo_", only_active=False) == [13]
    assert listed(shop, name="") == [12, 10, 11]
    assert listed(shop, category_id=0) == []
    assert listed(shop, supplier_id=1) == [10, 11]
    assert listed(shop, page=2, limit=2) == [11]
    dims = (shop["products"], shop["categories"], shop["suppliers"])
    assert sorted(ids(catalog.low_stock(*dims))) == [11, 12]
    found = catalog.products_by_key(*dims, shop["products"].select("id"))
    assert sorted(ids(found)) == [10, 11, 12]


def test_dangling_names_are_null(shop):
    dims = (shop["products"], shop["categories"], shop["suppliers"])
    found = {r.id: r for r in catalog.enrich_products(*dims).collect()}
    assert found[12].category_name is None and found[12].supplier_name is None
    assert found[10].category_name == "Lácteos" and found[13].supplier_name == "Bimbo"


def test_bands_and_tiers(spark, shop):
    band = stock_band(F.col("stock"), F.col("min_stock"))
    found = {r.id: r.b for r in shop["products"].select("id", band.alias("b")).collect()}
    assert found == {10: "ok", 11: "low", 12: "out", 13: "ok"}
    asked = spark.createDataFrame(
        [(10, 5), (10, 6), (11, 99), (12, 99)], "id long, quantity long")
    price = tier_price(F.col("quantity"), F.col("retail_price"), F.col("wholesale_price"),
                       F.col("wholesale_min_qty"))
    got = asked.join(shop["products"], "id").select("id", "quantity", price.alias("p")).collect()
    assert {(r.id, r.quantity): float(r.p) for r in got} == {
        (10, 5): 25.0, (10, 6): 22.0, (11, 99): 15.5, (12, 99): 90.0}


@pytest.mark.parametrize("tendered,paid,want", [
    ("100", "efectivo", (50.0, None)), ("40", "efectivo", (None, "short_cash")),
    ("40", "tarjeta_debito", (None, None)), ("x", "efectivo", (None, "bad_tender")),
    ("nan", "efectivo", (None, "bad_tender")), (None, "efectivo", (None, None)),
    ("40", None, (None, "short_cash")), (" 6e1 ", None, (10.0, None)),
])
def test_tender(spark, tendered, paid, want):
    row = spark.createDataFrame([(tendered, paid)], "t string, p string").select(
        tender(F.lit(50).cast("decimal(18,2)"), F.col("t"), F.col("p")).alias("x")
    ).select("x.*").first()
    change = None if row.change_due is None else float(row.change_due)
    assert (change, row.reason) == want


def test_text_functions(spark):
    one = spark.range(1)
    assert one.select(text.currency_text(F.lit("7580.50").cast("decimal(18,2)"))).first()[0] == (
        "$7580.50")
    assert one.select(text.currency_text(F.lit(None).cast("decimal(18,2)"))).first()[0] == "$0.00"
    assert one.select(
        text.currency_grouped(F.lit("1234567.5").cast("decimal(18,2)"))).first()[0] == (
        "$1,234,567.50")
    assert one.select(text.sha256_hex(F.lit("admin"))).first()[0] == (
        "8c6976e5b5410415bde908bd4dee15dfb167a9c873fc4bb8a81f6f2ab448a918")
    assert one.select(text.permission_label(F.lit("ver_precio_compra"))).first()[0] == (
        "Ver precio compra")


def like(pattern, value):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    wild = "".join(
        ".*" if c == "%" else "." if c == "_" else re.escape(c)
        for c in f"%{pattern}%".translate(fold))
    return re.fullmatch(wild, value.translate(fold), re.DOTALL) is not None


NAMES = ["Leche 1L", "leche entera", "Pan blanco", "CAFÉ molido", "café", "a_b", "a%b", "a\\b",
         "axb", "Z", "123456", "Jugo_naranja", "ab ab ab"]


@pytest.mark.parametrize("needle", ["lech", "LECHE", "café", "CAF", "_", "a_b", "a%b", "\\", "%",
                                    "b a", "__", "z"])
def test_contains_text(spark, needle):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    found = {r.name for r in df.filter(text.contains_text("name", needle)).collect()}
    assert found == {n for n in NAMES if like(needle, n)}


def test_search_against_brute_force(spark, make):
    names = NAMES * 3
    products = [
        dict(id=i, product_name=n, barcode=f"75000{i}" if i % 4 else None, active=i % 7 != 3)
        for i, n in enumerate(names)]
    terms = ["lech", " LECHE ", "café", "CAF", "_", "__", "%", "", "   ", "a_b", "a%b", "\\", "b",
             "ab ab", "750005", "7500010", "750003", "123456", "999999", "_____________",
             "e_e", "n%o", "a", "é_m"]
    term_rows = spark.createDataFrame([(t,) for t in terms + terms], "term string")
    want = set()
    live = [p for p in products if p["active"]]
    for term in {t.strip() for t in terms} - {""}:
        hits = [p for p in live if p["barcode"] == term] if (
            term.isdigit() and len(term) > 5) else []
        if not hits:
            hits = sorted((p for p in live if like(term, p["product_name"])),
                          key=lambda p: (p["product_name"].encode(), p["id"]))[:5]
        want |= {(term, i + 1, p["id"]) for i, p in enumerate(hits)}
    got = catalog.search_products(term_rows, make("products", products))
    assert {(r.term, r.position, r.product_id) for r in got.collect()} == want
    assert got.count() == len(want)


def test_export_has_the_file_headers(shop):
    out = catalog.export_catalogue(shop["products"], shop["categories"], shop["suppliers"])
    assert out.columns == list(EXPORT_COLUMNS) and len(out.columns) == 18
    assert {r["ID"]: r["Activo"] for r in out.collect()} == {
        10: "Sí", 11: "Sí", 12: "Sí", 13: "No"}


def test_search_joins_by_the_rarest_piece(spark, make, monkeypatch):
    names = [f"widget {i:04d}" for i in range(400)] + [f"other widget x{i}" for i in range(30)]
    products = make("products", [
        dict(id=i, product_name=n, barcode=None, active=True) for i, n in enumerate(names)])
    terms = [f"widget%{i:03d}" for i in range(300)] + ["wid_et", "WIDGET", "widget", "x2%%", "_",
                                                        "nothing%widget", "widget%%nothing"]
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    joined = []
    like = F.like

    def counting(*args):
        joined.append(args)
        return like(*args)

    monkeypatch.setattr(catalog.F, "like", counting)
    got = {}
    for r in catalog.search_products(asked, products).collect():
        got.setdefault(r.term, {})[r.position] = r.product_id
    assert len(joined) == 1

    def matches(pattern, text):
        import re

        rule = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern)
        return re.search(rule, text, re.S) is not None

    for t in terms:
        want = sorted((n, i) for i, n in enumerate(names) if matches(t.lower(), n))[:5]
        assert [i for _, i in want] == [got.get(t, {})[p] for p in sorted(got.get(t, {}))], t


def test_catalogue_pages_by_key(spark, make):
    products = make("products", [
        dict(id=i, product_name=f"n{i % 7}", active=i % 5 != 0) for i in range(60)])
    none = make("categories", []), make("suppliers", [])
    pages, after = [], None
    while True:
        rows = catalog.list_products(products, *none, limit=9, after=after).collect()
        if not rows:
            break
        pages += [r.id for r in rows]
        after = (rows[-1].product_name, rows[-1].id)
    every = catalog.list_products(products, *none, limit=None).collect()
    assert pages == [r.id for r in every] and len(pages) == 48
