from decimal import Decimal

from pyspark.sql import functions as F

from tillworks.operators import maintain, quality
from tillworks.operators.ids import with_new_ids
from tillworks.schemas import TABLES


def reasons(changed, key="seq"):
    return {r[key]: r.reason for r in changed.refused.collect()}


def test_insert_unique(spark, shop):
    rows = spark.createDataFrame(
        [(1, "dora", "h", "empleado"), (2, "ana", "h", "empleado"), (3, "dora", "h", "empleado"),
         (4, None, "h", "empleado"), (5, "eva", "h", "empleado")],
        "seq long, username string, password_hash string, role string")
    done = maintain.insert_rows("users", shop["users"], rows)
    assert reasons(done) == {2: "duplicate", 3: "duplicate", 4: "missing_value"}
    table = {r.username: r.id for r in done.table.collect()}
    assert set(table) == {"ana", "beto", "caro", "dora", "eva"}
    assert len(set(table.values())) == 5 and min(table["dora"], table["eva"]) > 3


def test_null_keys_never_collide(spark, shop):
    rows = spark.createDataFrame(
        [(1, "Bimbo", None), (2, "Bimbo", None), (3, "Lala", "1"), (4, "Lala", "2")],
        "seq long, supplier_name string, phone string")
    done = maintain.insert_rows("suppliers", shop["suppliers"], rows)
    assert reasons(done) == {3: "duplicate"} and done.table.count() == 5


def test_update_partial(spark, shop):
    changes = spark.createDataFrame(
        [(1, 1, "Quesos", None), (2, 1, None, "d"), (3, 2, "Quesos", None), (4, 2, None, None),
         (5, 9, "Nada", None), (6, 2, "Lácteos", None), (7, 2, "Pan", None), (8, 2, "Panes", None)],
        "seq long, id long, category_name string, description string")
    done = maintain.update_partial(shop["categories"], changes, ["category_name"])
    assert reasons(done) == {
        3: "duplicate", 4: "nothing_to_change", 5: "not_found", 6: "duplicate"}
    assert {r.id: (r.category_name, r.description) for r in done.table.collect()} == {
        1: ("Quesos", "d"), 2: ("Panes", None)}


def test_update_composite_key(spark, shop):
    changes = spark.createDataFrame(
        [(1, 2, "Lala", "1"), (2, 2, None, "5"), (3, 1, None, "1")],
        "seq long, id long, supplier_name string, phone string")
    done = maintain.update_partial(shop["suppliers"], changes, ["supplier_name", "phone"])
    assert reasons(done) == {1: "duplicate"}
    assert {r.id: (r.supplier_name, r.phone) for r in done.table.collect()} == {
        1: ("Lala", "1"), 2: ("Bimbo", "5")}


def test_update_products(spark, shop, now):
    changes = spark.createDataFrame(
        [(1, 10, ["description", "wholesale_price"], None, None, None),
         (2, 11, ["barcode"], None, None, "7501"), (3, 12, ["barcode"], None, None, "9"),
         (4, 13, ["created_at"], None, None, "x"), (5, 11, ["product_name"], None, None, "x"),
         (6, 12, ["wholesale_price"], None, Decimal(7), None)],
        "seq long, id long, fields array<string>, description string, "
        "wholesale_price decimal(18,2), barcode string"
    ).withColumn("product_name", F.lit(None).cast("string"))
    done = maintain.update_products(shop["products"], changes, now)
    assert reasons(done) == {2: "duplicate", 4: "nothing_to_change", 5: "missing_value"}
    table = {r.id: r for r in done.table.collect()}
    assert table[10].wholesale_price is None and table[10].modified_at is not None
    assert table[12].barcode == "9" and float(table[12].wholesale_price) == 7
    assert table[11].modified_at is None and table[11].product_name == "Pan blanco"


def test_deletes(spark, shop, now):
    ids = spark.createDataFrame([(10,), (10,), (99,)], "id long")
    soft = maintain.soft_delete_products(shop["products"], ids, now)
    assert {r.id for r in soft.table.filter("active").collect()} == {11, 12}
    assert reasons(soft, "id") == {99: "not_found"}
    hard = maintain.hard_delete(shop["products"], ids)
    assert {r.id for r in hard.table.collect()} == {11, 12, 13}
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    # category 1 has an active product; supplier 2 only an inactive one
    guarded = maintain.guarded_delete(
        shop["categories"], wanted, shop["products"], "category_id")
    assert reasons(guarded, "id") == {1: "in_use", 2: "in_use", 3: "not_found"}
    guarded = maintain.guarded_delete(shop["suppliers"], wanted, shop["products"], "supplier_id")
    assert reasons(guarded, "id") == {1: "in_use", 3: "not_found"}
    assert [r.id for r in guarded.table.collect()] == [1]


def test_last_admin_stays(spark, shop, make):
    overrides = make("user_permissions", [
        dict(id=1, user_id=2, permission_id=1, granted=True),
        dict(id=2, user_id=1, permission_id=1, granted=True)])
    ids = spark.createDataFrame([(1,), (2,), (9,)], "id long")
    done = maintain.delete_users(shop["users"], overrides, 1, ids)
    assert {r.id for r in done.users.collect()} == {1, 3}
    assert {r.user_id for r in done.user_permissions.collect()} == {1}
    assert reasons(done, "id") == {1: "last_admin", 9: "not_found"}
    two = shop["users"].withColumn("role", F.lit("administrador"))
    done = maintain.delete_users(two, overrides, 1, spark.createDataFrame([(1,)], "id long"))
    assert {r.id for r in done.users.collect()} == {2, 3} and done.refused.isEmpty()


def test_new_ids_grow_with_the_order(spark):
    rows = spark.range(1000).selectExpr("id * 37 % 1000 as seq")
    table = spark.createDataFrame([(41,)], "id long")
    out = [r.id for r in with_new_ids(rows, table, ["seq"]).orderBy("seq").collect()]
    assert out == list(range(42, 1042))
    above = with_new_ids(rows, table, ["seq"], last_id=99)
    assert above.agg(F.min("id")).first()[0] == 100


def test_integrity_report_groups_keys_as_they_are(spark):
    rows = spark.createDataFrame(
        [(1, "a", "h", "empleado"), (1, None, "h", "empleado"), (None, "a", None, "x"),
         (3, "b", "h", None)],
        "id long, username string, password_hash string, role string")
    report = quality.integrity_report("users", rows)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "to_json" not in plan and "structstojson" not in plan.lower()
    found = {(r.kind, r["columns"]): r.n_bad for r in report.collect()}
    assert found[("key", "id")] == 1 and found[("key", "username")] == 1
    assert found[("missing", "username")] == 1 and found[("missing", "password_hash")] == 1
    assert found[("missing", "role")] == 1 and found[("domain", "role")] == 1


def test_integrity_checks(spark, shop, make):
    users = make("users", [
        dict(id=1, username="a", role="jefe"), dict(id=2, username="a", role=None),
        dict(id=3, role="empleado"), dict(id=4, role="empleado")])
    counts = {r.column_name: r.n_bad for r in quality.check_not_null("users", users).collect()}
    assert counts == {"username": 2, "password_hash": 4, "role": 1}
    assert [tuple(r) for r in quality.check_unique(users, ["username"]).collect()] == [("a", 2)]
    assert [r.id for r in quality.check_domains("users", users)["role"].collect()] == [1]
    orphans = quality.check_reference(shop["products"], "category_id", shop["categories"])
    assert [r.id for r in orphans.collect()] == [12]
    tables = dict(shop)
    for name in ("permissions", "role_permissions", "user_permissions"):
        tables[name] = make(name, [])
    found = {(r.child, r.column_name): r.n_orphans
             for r in quality.orphan_counts(tables).collect()}
    assert found["products", "supplier_id"] == 1 and found["sales", "user_id"] == 1
    assert found["sale_lines", "product_id"] == 1 and found["user_permissions", "user_id"] == 0
    assert len(found) == 8


def test_conform_types(spark):
    raw = spark.createDataFrame(
        [("1", "a", "2.50", "true"), ("x", "b", "1", "true"), ("2", "c", "1..", "maybe"),
         (None, None, None, None)], "id string, barcode string, cost_price string, active string")
    typed = quality.conform_types(raw, TABLES["products"])
    assert [r.id for r in typed.good.orderBy("id").collect()] == [None, 1]
    assert {r.id: r.bad_columns for r in typed.quarantine.collect()} == {
        "x": ["id"], "2": ["cost_price", "active"]}


def test_fill_defaults(spark, make, now):
    got = quality.fill_defaults("products", make("products", [dict(id=1, stock=4)]), now).first()
    assert (got.stock, got.min_stock, got.unit, got.active) == (4, 0, "unidad", True)
    assert got.created_at is not None and got.barcode is None


def test_value_sets_are_kept(spark, shop):
    rows = spark.createDataFrame(
        [(1, "dora", "h", "jefe"), (2, "dora", "h", "empleado")],
        "seq long, username string, password_hash string, role string")
    done = maintain.insert_rows("users", shop["users"], rows)
    assert reasons(done) == {1: "bad_value"} and done.table.count() == 4
    changes = spark.createDataFrame(
        [(1, 2, "x", "jefe"), (2, 3, None, "administrador")],
        "seq long, id long, username string, role string")
    done = maintain.update_rows("users", shop["users"], changes)
    assert reasons(done) == {1: "bad_value"}
    assert {r.username: r.role for r in done.table.collect()} == {
        "ana": "administrador", "beto": "empleado", "caro": "administrador"}


def test_insert_products(spark, shop, now):
    rows = spark.createDataFrame(
        [(1, "7501", "a", Decimal(1), None), (2, "8", "b", Decimal(0), 3), (3, "8", "c", None, 1),
         (4, None, "", Decimal(1), 1), (5, None, "d", Decimal(2), None)],
        "seq long, barcode string, product_name string, retail_price decimal(18,2), stock long")
    done = maintain.insert_products(shop["products"], rows, now)
    assert reasons(done) == {1: "duplicate", 3: "missing_value", 4: "missing_value"}
    new = {r.product_name: r for r in done.table.filter("id > 13").collect()}
    assert set(new) == {"b", "d"}
    assert (new["d"].stock, new["d"].unit, new["d"].active) == (0, "unidad", True)
    assert new["b"].created_at == new["b"].modified_at is not None
