import random

import pytest

from tillworks.operators import ingest
from tillworks.schemas import FEED_COLUMNS

COLUMNS = ["row_no", *FEED_COLUMNS.values()]
FEED = "row_no long, " + ", ".join(f"{c} string" for c in FEED_COLUMNS.values())


def feed(spark, rows):
    return spark.createDataFrame(
        [tuple(r.get(c) for c in COLUMNS) for r in rows], FEED)


def run(spark, shop, now, rows, **options):
    return ingest.upsert_products(
        shop["products"], feed(spark, rows), shop["categories"], shop["suppliers"], now, **options)


def log(result):
    return {r.row_no: (r.status, r.message) for r in result.log.collect()}


def test_feed_cases(spark, shop, now):
    rows = [
        dict(row_no=2, barcode="IMP001", product_name="Nuevo", retail_price="15", active="No",
             category="LÁCTEOS", supplier="nadie"),
        dict(row_no=3, barcode="IMP002", product_name="Sin precio"),
        dict(row_no=4, barcode="IMP003", product_name="Cero", retail_price="0"),
        dict(row_no=5, id="10", product_name="Leche 2L", retail_price="30", category="Nada",
             stock="7", active="Si", cost_price="1e1"),
        dict(row_no=6, id="13", barcode="7504", product_name="Jugo", retail_price="21",
             active="TRUE"),
        dict(row_no=7, id="x", product_name="Mal id", retail_price="1"),
        dict(row_no=8, id="11", product_name="Mal stock", retail_price="1", stock="abc"),
        dict(row_no=9, id="11", product_name="Mal stock", retail_price="1", stock="5.0"),
        dict(row_no=10, id="11", barcode="7501", product_name="Ajeno", retail_price="1"),
        dict(row_no=11, product_name=None, barcode="IMP009", retail_price="1"),
        dict(row_no=12, product_name="", barcode="IMP010", retail_price="1"),
        dict(row_no=13),
        dict(row_no=14, barcode="IMP001", product_name="Nuevo otra vez", retail_price="16",
             description="d"),
        dict(row_no=15, barcode="", product_name="Sin código", retail_price="2", unit="kg"),
        dict(row_no=16, id="999", product_name="Id ajeno", retail_price="nan"),
        dict(row_no=17, id="999", product_name="Id nuevo", retail_price="3"),
    ]
    result = run(spark, shop, now, rows)
    found = log(result)
    assert {k: v[0] for k, v in found.items()} == {
        2: "creado", 3: "error", 4: "error", 5: "actualizado", 6: "actualizado", 7: "error",
        8: "error", 9: "error", 10: "error", 14: "actualizado", 15: "creado", 16: "error",
        17: "creado"}
    table = {(r.barcode, r.product_name): r for r in result.products.collect()}
    assert len(table) == 7
    new = table["IMP001", "Nuevo otra vez"]
    assert (new.category_id, new.supplier_id, new.description) == (1, None, "d")
    assert float(new.retail_price) == 16 and new.active and new.id > 13
    milk = table["7501", "Leche 2L"]
    assert (milk.id, milk.category_id, milk.stock, float(milk.cost_price)) == (10, 1, 7, 10.0)
    assert milk.wholesale_price is None and milk.description is None
    assert milk.modified_at is not None and milk.unit == "unidad"
    assert table["7504", "Jugo"].active and table["7504", "Jugo"].id == 13
    assert table["7502", "Pan blanco"].modified_at is None
    assert table[None, "Sin código"].unit == "kg"
    counts = {r.status: r.n_rows for r in ingest.import_counts(result.log).collect()}
    assert counts == {"creado": 3, "actualizado": 3, "error": 7}


def test_missing_values(spark, shop, now):
    rows = [dict(row_no=2, id="10", product_name="Leche 1L", retail_price="25")]
    reset = {r.id: r for r in run(spark, shop, now, rows).products.collect()}[10]
    assert (reset.stock, float(reset.cost_price), reset.min_stock) == (0, 0.0, 0)
    kept = {r.id: r for r in run(spark, shop, now, rows, missing="keep").products.collect()}[10]
    assert (kept.stock, float(kept.cost_price), kept.min_stock) == (20, 18.0, 5)


@pytest.mark.parametrize("word,want", [
    ("Si", True), ("TRUE", True), ("1", True), ("SÍ", True), ("yes", True), ("No", False),
    ("0", False), ("", False), (None, True)])
def test_flags(spark, word, want):
    df = ingest.parse_feed_flags(feed(spark, [dict(row_no=2, active=word)]))
    assert df.first().active is want


def test_new_barcode_goes_to_the_first_row(spark, shop, now):
    rows = [dict(row_no=2, id="11", barcode="NEW", product_name="Pan", retail_price="1"),
            dict(row_no=3, id="10", barcode="NEW", product_name="Leche", retail_price="1"),
            dict(row_no=4, barcode="NEW", product_name="Otro", retail_price="1")]
    result = run(spark, shop, now, rows)
    assert {k: v[0] for k, v in log(result).items()} == {
        2: "actualizado", 3: "error", 4: "actualizado"}
    codes = [r.barcode for r in result.products.collect() if r.barcode]
    assert len(codes) == len(set(codes)) and "NEW" in codes


def test_freed_barcode_makes_a_new_product(spark, shop, now):
    rows = [dict(row_no=2, id="10", barcode="B", product_name="Milk2", retail_price="1"),
            dict(row_no=3, barcode="7501", product_name="Bread", retail_price="9"),
            dict(row_no=4, barcode="B", product_name="Milk3", retail_price="2"),
            dict(row_no=5, id="10", barcode="7501", product_name="Lost", retail_price="2"),
            dict(row_no=6, id="11", barcode="C", product_name="Pan", retail_price="2"),
            dict(row_no=7, id="10", barcode="7502", product_name="Milk4", retail_price="2"),
            dict(row_no=None, barcode="7502", product_name="No number", retail_price="2")]
    result = run(spark, shop, now, rows)
    assert {k: v[0] for k, v in log(result).items()} == {
        2: "actualizado", 3: "creado", 4: "actualizado", 5: "error", 6: "actualizado",
        7: "actualizado", None: "error"}
    table = {r.barcode: (r.id, r.product_name) for r in result.products.collect() if r.barcode}
    assert table["7502"] == (10, "Milk4") and table["C"] == (11, "Pan") and "B" not in table
    assert table["7501"] == (14, "Bread")
    again = run(spark, shop, now, rows, last_id=40)
    assert again.products.filter("product_name = 'Bread'").first().id == 41


def replay(products, rows):
    """Row by row over dicts: the plain meaning of an import."""
    table = {p["id"]: dict(p) for p in products}
    status, created = {}, 0
    for r in sorted(rows, key=lambda r: r["row_no"]):
        if not r.get("product_name"):
            continue
        target = None
        if r.get("id") and table.get(int(r["id"]), {}).get("active"):
            target = int(r["id"])
        if target is None and r.get("barcode"):
            target = next((i for i, p in table.items() if p["barcode"] == r["barcode"]), None)
        price = float(r.get("retail_price") or 0)
        wholesale = float(r.get("wholesale_price") or 0) or None
        values = dict(product_name=r["product_name"], description=r.get("description"),
                      retail_price=price, wholesale_price=wholesale,
                      stock=int(r.get("stock") or 0), unit=r.get("unit") or "unidad",
                      active=r.get("active") in (None, "si"))
        code = r.get("barcode")
        if target is not None and code and any(
                p["barcode"] == code for i, p in table.items() if i != target):
            status[r["row_no"]] = "error"
        elif target is not None:
            table[target].update(values)
            if code:
                table[target]["barcode"] = code
            status[r["row_no"]] = "actualizado"
        elif price:
            created += 1
            table[f"new{created}"] = dict(values, barcode=r.get("barcode"))
            status[r["row_no"]] = "creado"
        else:
            status[r["row_no"]] = "error"
    return table, status


def test_a_product_switched_off_is_not_found_by_id(spark, shop, now):
    rows = [dict(row_no=2, id="10", product_name="Milk", retail_price="1", active="no"),
            dict(row_no=3, id="10", product_name="Bread", retail_price="9"),
            dict(row_no=4, id="10", product_name="No price"),
            dict(row_no=5, barcode="7501", product_name="Milk again", retail_price="2"),
            dict(row_no=6, id="10", product_name="Milk once more", retail_price="3")]
    before = {r.id for r in shop["products"].collect()}
    assert shop["products"].filter("id = 10").first().barcode == "7501"
    result = run(spark, shop, now, rows)
    assert {k: v[0] for k, v in log(result).items()} == {
        2: "actualizado", 3: "creado", 4: "error", 5: "actualizado", 6: "actualizado"}
    table = {r.id: r for r in result.products.collect()}
    new = [r for i, r in table.items() if i not in before]
    assert [(r.product_name, float(r.retail_price), r.active) for r in new] == [
        ("Bread", 9.0, True)]
    assert table[10].product_name == "Milk once more" and table[10].active


@pytest.mark.parametrize("moves,seed", [
    ([], 3), (["swap"], 3), (["swap", "take"], 3), (["switch"], 4), (["switch", "swap", "take"], 5)])
def test_import_equals_replay(spark, make, now, moves, seed):
    rnd = random.Random(seed)
    products = [
        dict(id=i, barcode=f"B{i}" if i % 4 else None, product_name=f"p{i}", retail_price=9.0,
             wholesale_price=None, description="old", stock=3, unit="kg", active=i % 5 != 0)
        for i in range(40)]
    rows = []
    for n in range(2, 600):
        i = rnd.randint(0, 39)
        # a third of all rows belong to one new barcode
        kind = rnd.choice(["id", "code", "both", "new", "hot", "hot",
                           *[m for m in moves if m != "switch"]])
        r = dict(row_no=n, product_name=rnd.choice(["x", "y", "z", None]),
                 description=rnd.choice([None, f"d{n}"]),
                 retail_price=rnd.choice([None, "0", "5", "7.25"]),
                 wholesale_price=rnd.choice([None, "0", "4"]),
                 stock=rnd.choice([None, "1", "8"]), unit=rnd.choice([None, "lt"]))
        code = products[i]["barcode"]
        if kind in ("id", "both"):
            r["id"] = str(i)
        if kind in ("code", "both"):
            r["barcode"] = code
        if kind in ("swap", "take"):
            r["id"] = str(i)
            r["barcode"] = rnd.choice(["N1", "N2", f"B{rnd.randint(0, 12)}", f"M{n % 7}"])
            if kind == "take":
                r["barcode"] = rnd.choice(["HOT", None, r["barcode"]])
        if kind == "new":
            r["barcode"] = f"N{rnd.randint(0, 30)}"
        if kind == "hot":
            r["barcode"] = "HOT"
        if "switch" in moves and rnd.random() < 0.2:
            r["active"] = rnd.choice(["no", "si"])
        rows.append(r)
    result = ingest.upsert_products(
        make("products", products), feed(spark, rows), make("categories", []),
        make("suppliers", []), now)
    table, status = replay(products, rows)
    assert {k: v[0] for k, v in log(result).items()} == status

    def shown(r):
        number = None if r["wholesale_price"] is None else float(r["wholesale_price"])
        return (r["barcode"], r["product_name"], r["description"], float(r["retail_price"]),
                number, r["stock"], r["unit"], r["active"])

    got = sorted((shown(r.asDict()) for r in result.products.collect()), key=str)
    assert got == sorted((shown(r) for r in table.values()), key=str)
    ids = [r.id for r in result.products.collect()]
    assert len(ids) == len(set(ids))
