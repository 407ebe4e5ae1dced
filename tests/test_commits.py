"""Appends, rewritten files and concurrent writers of stored tables."""

import os

import pytest
from pyspark.sql import functions as F

from tillworks.sources import stored, tables



def now():
    return F.lit("2025-06-30 12:00:00").cast("timestamp_ntz")


def files(spark, root, name):
    found = tables.current(spark, root).tables[name]
    return {r.path: (r.n_rows, r.low, r.high) for r in tables.table_files(spark, found).collect()}


def many_products(spark, make, root, n=400):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.commit_tables(spark, root, {"products": make("products", [
            dict(id=i, product_name=f"p{i}", barcode=f"b{i}", stock=10, retail_price=1, cost_price=0,
                 active=True) for i in range(n)])})
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_files_and_their_ranges(spark, make, tmp_path):
    root = str(tmp_path)
    many_products(spark, make, root)
    held = sorted(files(spark, root, "products").values(), key=lambda f: f[1])
    assert len(held) == 4 and sum(n for n, _, _ in held) == 400
    assert all(a[2] < b[1] for a, b in zip(held, held[1:]))
    held = tables.current(spark, root).tables["products"]
    assert (held.n_rows, held.last_id) == (400, 399)


def test_an_append_leaves_old_files_alone(spark, make, tmp_path, monkeypatch):
    root = str(tmp_path)
    many_products(spark, make, root)
    before = files(spark, root, "products")
    monkeypatch.setattr(tables, "MOST_LISTS", 2)
    for i in range(3):
        tables.commit(spark, root, {"products": tables.Append(
            make("products", [dict(id=1000 + i, product_name="new", stock=1)]))})
    after = files(spark, root, "products")
    assert set(before) < set(after) and len(after) == len(before) + 3
    held = tables.current(spark, root)
    assert held.version == 4 and len(held.tables["products"].lists) <= 2
    assert held.tables["products"].n_rows == 403 and held.tables["products"].last_id == 1002
    assert tables.read_table(spark, root, "products").count() == 403


def test_one_changed_product_rewrites_one_file(spark, make, tmp_path):
    root = str(tmp_path)
    many_products(spark, make, root)
    before = files(spark, root, "products")
    held = tables.read_table(spark, root, "products")
    changes = spark.createDataFrame(
        [(1, 7, ["product_name"], "renamed"), (2, 5000, ["product_name"], "x"),
         (3, 8, ["barcode"], None)], "seq long, id long, fields array<string>, product_name string"
    ).withColumn("barcode", F.when(F.col("seq") == 3, F.lit("b300")))
    refused = stored.update_products(spark, root, changes, now())
    assert {(r.seq, r.reason) for r in refused.collect()} == {(2, "not_found"), (3, "duplicate")}
    after = files(spark, root, "products")
    assert len(set(before) & set(after)) == len(before) - 1
    rows = {r.id: r for r in tables.read_table(spark, root, "products").collect()}
    assert len(rows) == 400 and rows[7].product_name == "renamed" and rows[8].barcode == "b8"
    assert [i for i, r in rows.items() if r.modified_at is not None] == [7]
    assert held.filter("id = 7").first().product_name == "p7"  # a reader keeps its version


def test_deletes_inserts_and_updates_of_stored_tables(spark, make, shop, tmp_path):
    root = str(tmp_path)
    many_products(spark, make, root)
    ids = spark.createDataFrame([(3,), (399,), (9999,)], "id long")
    before = files(spark, root, "products")
    refused = stored.soft_delete(spark, root, ids, now())
    assert [r.id for r in refused.collect()] == [9999]
    assert len(set(before) & set(files(spark, root, "products"))) == 2
    off = tables.read_table(spark, root, "products").filter("not active")
    assert sorted(r.id for r in off.collect()) == [3, 399]
    stored.hard_delete(spark, root, "products", ids)
    held = tables.current(spark, root).tables["products"]
    assert (held.n_rows, held.last_id) == (398, 399)  # the highest id ever is kept

    tables.commit_tables(spark, root, {"users": shop["users"]})
    new = spark.createDataFrame(
        [(1, "dora", "h", "empleado"), (2, "ana", "h", "empleado"), (3, "dora", "h", "empleado")],
        "seq long, username string, password_hash string, role string")
    taken = {r.username for r in shop["users"].collect()}
    refused = stored.insert(spark, root, "users", new)
    want = {1: "dora" in taken, 2: "ana" in taken, 3: True}
    assert {r.seq for r in refused.collect()} == {s for s, bad in want.items() if bad}
    last = tables.last_ids(spark, root)["users"]
    stored.hard_delete(spark, root, "users", spark.createDataFrame([(last,)], "id long"))
    again = spark.createDataFrame(
        [(1, "eva", "h", "empleado")],
        "seq long, username string, password_hash string, role string")
    stored.insert(spark, root, "users", again)
    eva = tables.read_table(spark, root, "users").filter("username = 'eva'").first()
    assert eva.id == last + 1
    changes = spark.createDataFrame([(1, eva.id, "nuevo")], "seq long, id long, username string")
    assert stored.update(spark, root, "users", changes).isEmpty()
    assert tables.read_table(spark, root, "users").filter("username = 'nuevo'").count() == 1


def test_posting_appends(spark, make, tmp_path):
    root = str(tmp_path)
    many_products(spark, make, root)
    old_sales = make("sales", [dict(id=5, user_id=1, total=1, status="completada")])
    tables.commit_tables(spark, root, {
        "sales": old_sales,
        "sale_lines": make("sale_lines", [dict(id=9, sale_id=5, product_id=1, quantity=1)])})
    before = {n: files(spark, root, n) for n in ("sales", "sale_lines", "products")}
    new_sales = spark.createDataFrame(
        [(1, "s1", 1, "2.00"), (2, "s2", 1, "99.00"), (3, "s3", 2, "1.00")],
        "seq long, sale_ref string, user_id long, total string").select(
        "seq", "sale_ref", "user_id", F.col("total").cast("decimal(18,2)").alias("total"),
        *[F.lit(None).cast("string").alias(c) for c in (
            "client_name", "client_ident", "tendered", "payment_type", "status", "notes")])
    lines = spark.createDataFrame(
        [("s1", 1, 3, 2), ("s2", 1, 4, 99), ("s3", 1, 5, 1)],
        "sale_ref string, position long, product_id long, quantity long").withColumn(
        "unit_price", F.lit(1).cast("decimal(18,2)"))
    grants = spark.createDataFrame([(1, "realizar_ventas")], "user_id long, permission string")
    done = stored.post(spark, root, new_sales, lines, grants, now(), tag="till/1")
    assert {r.sale_ref: r.reason for r in done.refused.collect()} == {
        "s2": "insufficient_stock", "s3": "no_permission"}
    after = {n: files(spark, root, n) for n in before}
    assert set(before["sales"]) < set(after["sales"])
    assert set(before["sale_lines"]) < set(after["sale_lines"])
    assert len(set(before["products"]) & set(after["products"])) == 3
    assert sorted(r.id for r in tables.read_table(spark, root, "sales").collect()) == [5, 6]
    assert sorted(r.id for r in tables.read_table(spark, root, "sale_lines").collect()) == [9, 10]
    assert tables.read_table(spark, root, "products").filter("id = 3").first().stock == 8
    assert tables.is_tagged(spark, root, "till/1")


def test_two_writers(spark, make, tmp_path):
    root = str(tmp_path)
    many_products(spark, make, root, 8)
    base = tables.current(spark, root)
    row = make("products", [dict(id=50, product_name="x", stock=1)])
    tables.commit(spark, root, {"products": tables.Append(row)})
    # an append goes on top of the other commit, a rewrite of the older state is refused
    second = make("products", [dict(id=51, product_name="y", stock=1)])
    assert tables.commit(spark, root, {"products": tables.Append(second)}, base=base) == 3
    ids = spark.createDataFrame([(1,)], "id long")
    with pytest.raises(tables.CommitConflict):
        tables.commit(spark, root, {"products": tables.Rewrite(
            ids, lambda part: part.withColumn("stock", F.lit(0)))}, base=base)
    got = tables.read_table(spark, root, "products")
    assert got.count() == 10 and got.filter("stock = 0").isEmpty()
    assert sorted(n for n in os.listdir(f"{root}/versions") if n[0] not in "._") == [
        f"v{i:012d}.json" for i in (1, 2, 3)]


def test_only_the_newest_version_file_is_read(spark, make, tmp_path):
    root = str(tmp_path)
    many_products(spark, make, root, 8)
    tables.commit(spark, root, {"products": tables.Append(
        make("products", [dict(id=50, product_name="x", stock=1)]))})
    with open(f"{root}/versions/v000000000001.json", "w") as f:
        f.write("not a version")
    for crc in (f"{root}/versions/.v000000000001.json.crc",):
        if os.path.exists(crc):
            os.remove(crc)
    assert tables.read_table(spark, root, "products").count() == 9


def test_rewriting_nothing(spark, make, tmp_path):
    root = str(tmp_path)
    nothing = spark.createDataFrame([], "id long")
    change = tables.Rewrite(nothing, lambda part: part)
    assert tables.commit(spark, root, {"products": change}) == 1
    assert tables.read_table(spark, root, "products").count() == 0
    tables.commit_tables(spark, root, {"products": make("products", [])})
    assert tables.read_table(spark, root, "products").count() == 0
    far = spark.createDataFrame([(10**12,)], "id long")
    tables.commit(spark, root, {"products": tables.Rewrite(far, lambda part: part)})
    assert tables.current(spark, root).tables["products"].n_rows == 0
