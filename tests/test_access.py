from pyspark.sql import functions as F

from tillworks.operators import access, catalog, maintain
from tillworks.schemas import PERMISSIONS


def tables(make):
    permissions, roles = maintain.seed_permissions(
        make("permissions", []), make("role_permissions", []))
    ids = {r.permission: r.id for r in permissions.collect()}
    users = make("users", [
        dict(id=1, username="usuario", role="administrador"),
        dict(id=2, username="empleado_test", role="empleado"),
        dict(id=3, username="otro", role="empleado")])
    overrides = make("user_permissions", [
        dict(id=1, user_id=2, permission_id=ids["gestionar_stock"], granted=True),
        dict(id=2, user_id=2, permission_id=ids["realizar_ventas"], granted=False),
        dict(id=3, user_id=9, permission_id=ids["ver_inventario"], granted=True)])
    return users, permissions, roles, overrides


def held(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.user_id, set()).add(r.permission)
    return out


def test_effective_permissions(spark, make):
    users, permissions, roles, overrides = tables(make)
    assert permissions.count() == 21 and roles.count() == 23
    grants = access.effective_permissions(users, permissions, roles, overrides)
    assert held(grants) == {
        1: set(PERMISSIONS), 2: {"gestionar_stock", "ver_dashboard_ventas"},
        3: {"realizar_ventas", "ver_dashboard_ventas"}}
    assert access.role_permissions_of(permissions, roles, "empleado").count() == 2
    matrix = access.permission_matrix(users, permissions, grants)
    assert matrix.count() == 63
    assert {r.permission for r in matrix.filter("held and user_id = 2").collect()} == {
        "gestionar_stock", "ver_dashboard_ventas"}
    checks = spark.createDataFrame(
        [(1, "sell"), (2, "sell"), (3, "sell"), (3, "see_cost"), (9, "sell"), (1, "nothing")],
        "user_id long, capability string")
    allowed = access.has_capability(checks, users, grants).collect()
    assert {(r.user_id, r.capability): r.allowed for r in allowed} == {
        (1, "sell"): True, (2, "sell"): False, (3, "sell"): True, (3, "see_cost"): False,
        (9, "sell"): False, (1, "nothing"): False}
    flags = {r.user_id: r for r in access.capability_flags(users, grants).collect()}
    assert flags[1].run_user_report and not flags[3].read_history


def test_seed_is_idempotent(make):
    _, permissions, roles, _ = tables(make)
    again, roles_again = maintain.seed_permissions(permissions, roles)
    assert again.exceptAll(permissions).isEmpty() and again.count() == 21
    assert roles_again.count() == 23


def test_mask_cost(make, shop):
    users, permissions, roles, overrides = tables(make)
    grants = access.effective_permissions(users, permissions, roles, overrides)
    admin = access.mask_cost(shop["products"], grants, 1)
    seller = access.mask_cost(shop["products"], grants, 3)
    assert admin.filter(F.col("cost_price").isNull()).isEmpty()
    assert seller.filter(F.col("cost_price").isNotNull()).isEmpty()
    assert "cost_price" not in access.hide_cost(shop["products"]).columns


def test_overrides(spark, make):
    users, permissions, roles, overrides = tables(make)
    changes = spark.createDataFrame(
        [(1, 3, "ver_inventario", True), (2, 3, "ver_inventario", False),
         (3, 2, "realizar_ventas", True), (4, 2, "volar", True)],
        "seq long, user_id long, permission string, granted boolean")
    done = maintain.set_user_permissions(overrides, permissions, changes)
    assert [(r.seq, r.reason) for r in done.refused.collect()] == [(4, "unknown_permission")]
    assert done.table.count() == 4
    grants = held(access.effective_permissions(users, permissions, roles, done.table))
    assert grants[2] == {"gestionar_stock", "ver_dashboard_ventas", "realizar_ventas"}
    assert "ver_inventario" not in grants[3]


def test_role_grants(spark, make):
    _, permissions, roles, _ = tables(make)
    pairs = spark.createDataFrame(
        [("empleado", "ver_inventario"), ("empleado", "realizar_ventas"), ("empleado", "volar")],
        "role string, permission string")
    done = maintain.grant_role(roles, permissions, pairs)
    assert done.table.count() == 24 and done.refused.count() == 1
    undone = maintain.revoke_role(done.table, permissions, pairs)
    assert undone.table.count() == 22
    again = maintain.revoke_role(undone.table, permissions, pairs)
    assert sorted(r.reason for r in again.refused.collect()) == [
        "not_found", "not_found", "unknown_permission"]


def test_gates(spark, make, shop):
    users, permissions, roles, overrides = tables(make)
    grants = access.effective_permissions(users, permissions, roles, overrides)
    assert access.gate(shop["products"], grants, 1, "read_catalogue").count() == 4
    for requester in (3, 99):
        assert access.gate(shop["products"], grants, requester, "read_catalogue").isEmpty()
    terms = spark.createDataFrame([("leche",), ("7501999",), ("750199",)], "term string")
    products = shop["products"].withColumn(
        "barcode", F.when(F.col("id") == 11, "7501999").otherwise(F.col("barcode")))
    for requester, want in ((1, {("leche", 10), ("7501999", 11)}), (3, {("7501999", 11)})):
        may = access.allowed(grants, requester, "read_catalogue")
        found = catalog.search_products(terms, products, names_allowed=may).collect()
        assert {(r.term, r.product_id) for r in found} == want


def test_password_hashes(spark):
    rows = spark.createDataFrame([(1, "admin"), (2, None)], "seq long, password string")
    got = {r.seq: r.password_hash for r in maintain.hash_passwords(rows).collect()}
    assert got[2] is None and got[1].startswith("8c6976e5b541")
