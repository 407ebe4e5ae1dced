"""Entitlements, table maintenance and integrity checks over the benchmark tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillworks.functions import dates, text
from tillworks.operators import access, maintain, quality
from tillworks.plans.driver_views import with_views
from tillworks.plans.registry import query
from tillworks.plans.report_queries import ACCESS, GRANTS_SQL, grants
from tillworks.schemas import CAPABILITIES, DOMAINS, MONEY, PAYMENT_TYPES, REQUIRED, UNIQUE

def now():
    """The statement time of the registered queries."""
    return F.lit("2025-06-30 12:00:00").cast("timestamp_ntz")


NOW_SQL = "timestamp '2025-06-30 12:00:00'"


# --- entitlements --------------------------------------------------------------------------


@query("i1_role_permissions", with_views("permissions role_permissions", """
    select distinct rp.role, p.permission from role_permissions rp
    join permissions p on rp.permission_id = p.id"""))
def i1(t):
    return access.role_permissions_of(t.permissions, t.role_permissions)


@query("i2_effective_permissions", with_views(ACCESS, GRANTS_SQL))
def i2(t):
    return grants(t)


def _rule_sql(capability: str) -> str:
    groups = [
        "coalesce(bool_or(g.permission in (" + ", ".join(f"'{p}'" for p in group) + ")), false)"
        for group in CAPABILITIES[capability]
    ]
    return " and ".join(groups) + f" as {capability}"


@query("i3_capability_flags", with_views(ACCESS, f"""
    with g as ({GRANTS_SQL})
    select u.id as user_id, {", ".join(_rule_sql(c) for c in CAPABILITIES)}
    from users u left join g on g.user_id = u.id group by 1"""))
def i3(t):
    return access.capability_flags(t.users, grants(t))


@query("i3_capability_checks", with_views(ACCESS, f"""
    with g as ({GRANTS_SQL}),
    flags as (select u.id as user_id, {", ".join(_rule_sql(c) for c in CAPABILITIES)}
              from users u left join g on g.user_id = u.id group by 1)
    select user_id, case user_id % 3 when 0 then 'sell' when 1 then 'run_user_report'
                         else 'fly' end as capability,
           case user_id % 3 when 0 then sell when 1 then run_user_report else false end as allowed
    from flags"""))
def i3_checks(t):
    asked = (
        F.when(F.col("id") % 3 == 0, "sell").when(F.col("id") % 3 == 1, "run_user_report")
        .otherwise("fly")
    )
    checks = t.users.select(F.col("id").alias("user_id"), asked.alias("capability"))
    return access.has_capability(checks, t.users, grants(t))


@query("i3_gated_catalogue", with_views(f"products {ACCESS}", f"""
    with g as ({GRANTS_SQL})
    select id, product_name from products where exists (
        select 1 from g where user_id = 50 and permission in ('ver_inventario',
                                                              'gestionar_inventario'))
    union all select id, product_name from products where exists (
        select 1 from g where user_id = 51 and permission = 'administrar_usuarios')"""))
def i3_gated(t):
    shown = t.products.select("id", "product_name")
    held = grants(t)
    return access.gate(shown, held, 50, "read_catalogue").unionByName(
        access.gate(shown, held, 51, "manage_users")
    )


@query("i4_permission_matrix", with_views(ACCESS, f"""
    with g as ({GRANTS_SQL})
    select u.id as user_id, p.permission, g.permission is not null as held
    from users u cross join permissions p
         left join g on g.user_id = u.id and g.permission = p.permission"""))
def i4(t):
    return access.permission_matrix(t.users, t.permissions, grants(t))


@query("i5_mask_cost", with_views(f"products {ACCESS}", f"""
    with g as ({GRANTS_SQL})
    select id, product_name, cast(case when exists (select 1 from g where user_id = 7
           and permission in ('ver_precio_compra', 'gestionar_inventario'))
           then cost_price end as double) as cost_price
    from products"""))
def i5(t):
    return access.mask_cost(t.products, grants(t), requester_id=7).select(
        "id", "product_name", F.col("cost_price").cast("double").alias("cost_price")
    )


@query("i5_shown_cost", with_views(f"products {ACCESS}", f"""
    with g as ({GRANTS_SQL})
    select id, product_name, cast(case when exists (select 1 from g where user_id = 8
           and permission in ('ver_precio_compra', 'gestionar_inventario'))
           then cost_price end as double) as cost_price
    from products"""))
def i5_shown(t):
    return access.mask_cost(t.products, grants(t), requester_id=8).select(
        "id", "product_name", F.col("cost_price").cast("double").alias("cost_price")
    )


# --- maintenance ---------------------------------------------------------------------------

_NEW_USERS = """
    select c_custkey as seq,
           case when c_custkey % 3 = 0 then c_name
                when c_custkey % 7 = 0 then null
                else c_mktsegment || cast(c_custkey % 50 as string) end as username,
           sha256(c_mktsegment) as password_hash,
           case when c_custkey % 13 = 5 then 'jefe' else 'empleado' end as role
    from customer"""


def _new_users(t):
    key = F.col("c_custkey")
    name = (
        F.when(key % 3 == 0, F.col("c_name"))
        .when(key % 7 == 0, F.lit(None))
        .otherwise(F.concat("c_mktsegment", (key % 50).cast("string")))
    )
    rows = t.base("customer").select(
        key.alias("seq"), name.alias("username"), F.col("c_mktsegment").alias("password"),
        F.when(key % 13 == 5, "jefe").otherwise("empleado").alias("role"),
    )
    return maintain.hash_passwords(rows)


def _inserted(t):
    users = t.users.withColumn("password_hash", F.lit(None).cast("string"))
    return maintain.insert_rows("users", users, _new_users(t))


@query("h1_insert_users", with_views("users", f"""
    with fresh as ({_NEW_USERS})
    select username, null as password_hash, role from users
    union all
    select username, password_hash, role from fresh
    where role <> 'jefe' and username not in (select username from users)
    qualify row_number() over (partition by username order by seq) = 1"""))
def h1(t):
    return _inserted(t).table.select("username", "password_hash", "role")


@query("h1_insert_refused", with_views("users", f"""
    with fresh as ({_NEW_USERS}),
    ranked as (select *, row_number() over (partition by username, role = 'jefe' order by seq) as r
               from fresh)
    select seq, case when username is null then 'missing_value'
                     when role = 'jefe' then 'bad_value' else 'duplicate' end as reason
    from ranked
    where username is null or role = 'jefe' or r > 1 or username in (select username from users)
    """))
def h1_refused(t):
    return _inserted(t).refused.select("seq", "reason")


_NEW_PRODUCTS = """
    select p_partkey as seq, case when p_partkey % 4 = 0 then null
           when p_partkey % 4 = 1 then '75' || lpad(cast(p_partkey as string), 12, '0')
           else '66' || cast(p_partkey // 8 as string) end as barcode,
           case when p_partkey % 9 = 0 then '' else 'copy ' || p_name end as product_name,
           case when p_partkey % 10 = 7 then null else cast(p_size as decimal(18,2)) end
               as retail_price,
           case when p_partkey % 3 = 0 then cast(p_size as bigint) end as stock
    from part"""


def _new_products(t):
    key = F.col("p_partkey")
    code = F.when(
        key % 4 == 1, F.concat(F.lit("75"), F.lpad(key.cast("string"), 12, "0"))
    ).when(key % 4 > 1, F.concat(F.lit("66"), F.floor(key / 8).cast("string")))
    rows = t.base("part").select(
        key.alias("seq"), code.alias("barcode"),
        F.when(key % 9 == 0, "").otherwise(F.concat(F.lit("copy "), "p_name"))
        .alias("product_name"),
        F.when(key % 10 != 7, F.col("p_size").cast(MONEY)).alias("retail_price"),
        F.when(key % 3 == 0, F.col("p_size").cast("long")).alias("stock"),
    )
    products = t.products.withColumns({
        c: F.lit(None).cast("timestamp_ntz") for c in ("created_at", "modified_at")
    })
    return maintain.insert_products(products, rows, now())


@query("h1_insert_products", with_views("products", f"""
    with fresh as ({_NEW_PRODUCTS}),
    judged as (
        select *, product_name = '' or retail_price is null as faulty,
               row_number() over (partition by barcode, product_name = '' or retail_price is null
                                  order by seq) as r
        from fresh)
    select barcode, product_name, cast(retail_price as double) as retail_price, stock, unit,
           active, cast(null as timestamp) as created_at
    from products
    union all
    select barcode, product_name, cast(retail_price as double), coalesce(stock, 0), 'unidad',
           true, {NOW_SQL}
    from judged where not faulty and (barcode is null or (r = 1 and barcode not in
         (select barcode from products)))"""))
def h1_products(t):
    return _new_products(t).table.select(
        "barcode", "product_name", F.col("retail_price").cast("double").alias("retail_price"),
        "stock", "unit", "active", "created_at",
    )


@query("h2_update_users", with_views("users", """
    select id, case when id % 5 = 1 then 'user ' || cast(id as string) else username end
               as username,
           case when id % 5 = 2 then 'administrador' else role end as role
    from users"""))
def h2_users(t):
    key = F.col("id")
    changes = t.users.select(
        key.alias("seq"), "id",
        F.when(key % 5 == 1, F.concat(F.lit("user "), key.cast("string")))
        .when(key % 5 == 4, "Customer#000000000").alias("username"),
        F.when(key % 5 == 2, "administrador").when(key % 5 == 3, "jefe").alias("role"),
    )
    return maintain.update_rows("users", t.users, changes).table


# supplier k: renamed in pairs to one name (second refused), some get only a phone, some nothing
_SUPPLIER_CHANGES = """
    select s_suppkey as seq, case when s_suppkey % 10 = 9 then s_suppkey + 1000000
                                  else s_suppkey end as id,
           case when s_suppkey % 4 = 1 then 'Joint ' || cast(s_suppkey // 8 as string)
                end as supplier_name,
           case when s_suppkey % 4 = 1 then '777' when s_suppkey % 4 = 2 then '888' end as phone
    from supplier"""


def _supplier_changes(t):
    key = F.col("s_suppkey")
    group = F.floor(key / 8).cast("string")
    return t.base("supplier").select(
        key.alias("seq"),
        F.when(key % 10 == 9, key + 1000000).otherwise(key).alias("id"),
        F.when(key % 4 == 1, F.concat(F.lit("Joint "), group)).alias("supplier_name"),
        F.when(key % 4 == 1, "777").when(key % 4 == 2, "888").alias("phone"),
    )


_JUDGED_SUPPLIERS = f"""
    with changes as ({_SUPPLIER_CHANGES}),
    judged as (
        select c.*, case when c.supplier_name is null and c.phone is null then 'nothing_to_change'
                         when s.id is null then 'not_found'
                         when c.supplier_name is not null and row_number() over (
                              partition by c.supplier_name, s.id is null order by c.seq) > 1
                              then 'duplicate' end as reason
        from changes c left join suppliers s on c.id = s.id)"""


def _updated_suppliers(t):
    return maintain.update_partial(t.suppliers, _supplier_changes(t), ["supplier_name", "phone"])


@query("h2_update_suppliers", with_views("suppliers", f"""
    {_JUDGED_SUPPLIERS}
    select s.id, coalesce(j.supplier_name, s.supplier_name) as supplier_name, s.contact,
           coalesce(j.phone, s.phone) as phone
    from suppliers s left join judged j on j.id = s.id and j.reason is null"""))
def h2(t):
    return _updated_suppliers(t).table


@query("h2_update_refused", with_views("suppliers", f"""
    {_JUDGED_SUPPLIERS} select seq, reason from judged where reason is not null"""))
def h2_refused(t):
    return _updated_suppliers(t).refused.select("seq", "reason")


def _product_changes(t):
    key = F.col("p_partkey")
    fields = (
        F.when(key % 3 == 0, F.array(F.lit("description"), F.lit("wholesale_price")))
        .when(key % 3 == 1, F.array(F.lit("barcode"), F.lit("modified_at")))
        .otherwise(F.array(F.lit("id")))
    )
    code = F.concat(F.lit("88"), F.floor(key / 6).cast("string"))
    return t.base("part").select(
        key.alias("seq"), key.alias("id"), fields.alias("fields"), code.alias("barcode"),
        F.lit(None).cast("string").alias("description"), F.lit(5).cast(MONEY)
        .alias("wholesale_price"),
    )


def _updated_products(t):
    products = t.products.withColumn("modified_at", F.lit(None).cast("timestamp_ntz"))
    return maintain.update_products(products, _product_changes(t), now())


_FIRST_OF_SIX = "p.id % 3 = 1 and p.id % 6 = (case when p.id % 6 < 3 then 1 else -1 end)"


@query("h3_update_products", with_views("products", f"""
    select p.id, case when {_FIRST_OF_SIX} then '88' || cast(p.id // 6 as string)
                      else p.barcode end as barcode,
           case when p.id % 3 = 0 then null else p.description end as description,
           cast(case when p.id % 3 = 0 then 5 else p.wholesale_price end as double)
               as wholesale_price,
           case when p.id % 3 = 0 or {_FIRST_OF_SIX} then {NOW_SQL} end as modified_at
    from products p"""))
def h3(t):
    return _updated_products(t).table.select(
        "id", "barcode", "description",
        F.col("wholesale_price").cast("double").alias("wholesale_price"), "modified_at",
    )


@query("h3_update_refused", with_views("products", f"""
    select id as seq, case when id % 3 = 2 then 'nothing_to_change' else 'duplicate' end as reason
    from products p where id % 3 = 2 or (id % 3 = 1 and not ({_FIRST_OF_SIX}))"""))
def h3_refused(t):
    return _updated_products(t).refused.select("seq", "reason")


_RETURNED = "select product_id as id from movements where kind = 'entrada' and quantity > 45"


def _returned(t):
    return t.movements.filter("kind = 'entrada' and quantity > 45").select(
        F.col("product_id").alias("id")
    )


@query("h4_soft_delete", with_views("products movements", f"""
    select id, active and id not in ({_RETURNED}) as active,
           case when id in ({_RETURNED}) then {NOW_SQL} end as modified_at
    from products"""))
def h4(t):
    products = t.products.withColumn("modified_at", F.lit(None).cast("timestamp_ntz"))
    return maintain.soft_delete_products(products, _returned(t), now()).table.select(
        "id", "active", "modified_at"
    )


@query("h5_hard_delete", with_views("products movements", f"""
    select id, product_name from products where id not in ({_RETURNED})"""))
def h5(t):
    return maintain.hard_delete(t.products, _returned(t)).table.select("id", "product_name")


@query("h5_delete_refused", with_views("suppliers products", """
    select distinct supplier_id as id, 'not_found' as reason from products
    where supplier_id not in (select id from suppliers)"""))
def h5_refused(t):
    named = t.products.select(F.col("supplier_id").alias("id"))
    return maintain.hard_delete(t.suppliers, named).refused


_IN_USE = "select supplier_id from products where active"


@query("h6_guarded_delete", with_views("suppliers products", f"""
    select id, 'kept' as outcome from suppliers where id in ({_IN_USE})
    union all select id, 'in_use' from suppliers where id in ({_IN_USE})
    union all select distinct supplier_id, 'not_found' from products
    where supplier_id not in (select id from suppliers)"""))
def h6(t):
    # every supplier is to go unless it has an active product; some ids do not exist
    ids = t.suppliers.select("id").unionByName(
        t.products.select(F.col("supplier_id").alias("id"))
    )
    done = maintain.guarded_delete(t.suppliers, ids, t.products, "supplier_id")
    return done.table.select("id", F.lit("kept").alias("outcome")).unionByName(
        done.refused.select("id", F.col("reason").alias("outcome"))
    )


def _idle_users(t):
    busy = t.sales.filter("status = 'completada'").select(F.col("user_id").alias("id"))
    return t.users.join(busy, "id", "left_anti").unionByName(
        t.users.filter("role = 'administrador'")
    )


_GONE = """
    select id from users where id <> 0 and (role = 'administrador'
        or id not in (select user_id from sales where status = 'completada'))"""


@query("h7_delete_users", with_views("users sales user_permissions", f"""
    select 'user' as kind, id from users where id not in ({_GONE})
    union all select 'override', id from user_permissions where user_id not in ({_GONE})
    union all select 'last_admin', cast(0 as bigint)"""))
def h7(t):
    # user 0 asks to delete all administrators, themselves included, and all idle users
    done = maintain.delete_users(t.users, t.user_permissions, 0, _idle_users(t).select("id"))
    return (
        done.users.select(F.lit("user").alias("kind"), "id")
        .unionByName(done.user_permissions.select(F.lit("override").alias("kind"), "id"))
        .unionByName(done.refused.select(F.col("reason").alias("kind"), "id"))
    )


# every sale sets one permission of its seller; the last one per pair holds
_PERMISSION_CHANGES = """
    select o_orderkey as seq, o_custkey as user_id,
           case when o_orderkey % 10 = 0 then 'volar' when o_orderkey % 2 = 0
                then 'ver_inventario' else 'ajustar_stock' end as permission,
           o_orderkey % 3 <> 0 as granted
    from orders"""


def _permission_changes(t):
    key = F.col("o_orderkey")
    name = (
        F.when(key % 10 == 0, "volar").when(key % 2 == 0, "ver_inventario")
        .otherwise("ajustar_stock")
    )
    return t.base("orders").select(
        key.alias("seq"), F.col("o_custkey").alias("user_id"), name.alias("permission"),
        (key % 3 != 0).alias("granted"),
    )


def _overrides(t):
    return maintain.set_user_permissions(
        t.user_permissions, t.permissions, _permission_changes(t)
    )


@query("h8_set_user_permissions", with_views("user_permissions permissions", f"""
    with named as (select c.*, p.id as permission_id from ({_PERMISSION_CHANGES}) c
                   join permissions p on p.permission = c.permission),
    latest as (select user_id, permission_id, granted from named
               qualify row_number() over (partition by user_id, permission_id
                                          order by seq desc) = 1)
    select user_id, permission_id, granted from latest
    union all
    select user_id, permission_id, granted from user_permissions u
    where not exists (select 1 from latest l where l.user_id = u.user_id
                      and l.permission_id = u.permission_id)"""))
def h8(t):
    return _overrides(t).table.select("user_id", "permission_id", "granted")


@query("h8_set_refused", f"""
    select seq, 'unknown_permission' as reason from ({_PERMISSION_CHANGES})
    where permission = 'volar'""")
def h8_refused(t):
    return _overrides(t).refused.select("seq", "reason")


def _role_changes(t):
    return t.user_permissions.join(
        t.permissions.withColumnRenamed("id", "permission_id"), "permission_id"
    ).filter("granted and permission like '%inventario'").select(
        F.lit("empleado").alias("role"), "permission"
    )


_ROLE_CHANGES = """
    select p.permission, p.id from user_permissions u join permissions p on u.permission_id = p.id
    where u.granted and p.permission like '%inventario'"""


@query("h9_grant_role", with_views("user_permissions permissions role_permissions", f"""
    select role, permission_id from role_permissions
    union select 'empleado', id from ({_ROLE_CHANGES})"""))
def h9(t):
    done = maintain.grant_role(t.role_permissions, t.permissions, _role_changes(t))
    return done.table.select("role", "permission_id")


@query("h9_revoke_role", with_views("user_permissions permissions role_permissions", f"""
    select role, permission_id from role_permissions
    where not (role = 'administrador' and permission_id in (
        select id from ({_ROLE_CHANGES})))"""))
def h9_revoke(t):
    wanted = _role_changes(t).withColumn("role", F.lit("administrador"))
    done = maintain.revoke_role(t.role_permissions, t.permissions, wanted)
    return done.table.select("role", "permission_id")


@query("h10_seed_permissions", with_views("permissions role_permissions", """
    select rp.role, p.permission from role_permissions rp
    join permissions p on rp.permission_id = p.id
    union all select 'permission', permission from permissions"""))
def h10(t):
    # the stored table lacks the inventory permissions; seeding brings them back
    some = t.permissions.filter("permission not like '%inventario'")
    kept = t.role_permissions.join(
        some.select(F.col("id").alias("permission_id")), "permission_id", "left_semi"
    )
    permissions, roles = maintain.seed_permissions(
        some.select("id", "permission"), kept.select("id", "role", "permission_id")
    )
    return access.role_permissions_of(permissions, roles).unionByName(
        permissions.select(F.lit("permission").alias("role"), "permission")
    )


# --- integrity -----------------------------------------------------------------------------

_NOT_NULL = {"users": "users", "products": "feed", "sales": "sales", "sale_lines": "sale_lines"}
_NOT_NULL_COLUMNS = {
    "users": ("username", "role"),
    "products": ("product_name", "cost_price", "retail_price", "stock"),
    "sales": ("user_id", "total"),
    "sale_lines": ("sale_id", "product_id", "quantity", "unit_price", "line_subtotal"),
}
assert all(set(v) <= set(REQUIRED[k]) for k, v in _NOT_NULL_COLUMNS.items())


@query("j1_not_null", with_views("users feed sales sale_lines", "\n union all ".join(
    f"select '{name}' as table_name, '{column}' as column_name, count(*) as n_bad "
    f"from {_NOT_NULL[name]} where {column} is null"
    for name, columns in _NOT_NULL_COLUMNS.items() for column in columns)))
def j1(t):
    parts = [
        quality.check_not_null(name, getattr(t, source)) for name, source in _NOT_NULL.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_FEED_TYPES = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("cost_price", MONEY),
    T.StructField("retail_price", MONEY), T.StructField("stock", T.LongType()),
])


@query("j1_types", with_views("feed", """
    select row_no, concat_ws(',',
               case when not regexp_full_match(id, '[0-9]+') then 'id' end,
               case when not regexp_full_match(stock, '[0-9]+') then 'stock' end) as bad_columns
    from feed where not regexp_full_match(id, '[0-9]+') or not regexp_full_match(stock, '[0-9]+')
    """))
def j1_types(t):
    bad = quality.conform_types(t.feed, _FEED_TYPES).quarantine
    return bad.select("row_no", F.array_join("bad_columns", ",").alias("bad_columns"))


@query("j2_unique", with_views("sale_lines", """
    select id, count(*) as n_rows from sale_lines group by id having count(*) > 1"""))
def j2(t):
    return quality.check_unique(t.sale_lines, ["id"])


@query("j3_domain", with_views("new_sales", """
    select seq, payment_type from new_sales where payment_type not in
    ('efectivo', 'tarjeta_credito', 'tarjeta_debito', 'transferencia', 'otro')"""))
def j3(t):
    return quality.check_domain(t.new_sales, "payment_type", PAYMENT_TYPES).select(
        "seq", "payment_type"
    )


# copies of rows and of keys, a missing value, and values outside their sets
_FAULTY = {
    "users": ("select id, case when id % 9 = 0 then null else username end as username, "
              "sha256(username) as password_hash, "
              "case when id % 5 = 0 then 'jefe' else role end as role from users "
              "union all select id + (id % 2), username, 'x', role from users where id % 4 = 0"),
    "suppliers": ("select id, supplier_name, phone from suppliers union all "
                  "select id + 100000, supplier_name, phone from suppliers where id % 3 = 0"),
    "products": ("select id, barcode, product_name, cost_price, retail_price, stock from products "
                 "union all select -id - 1, barcode, null, cost_price, null, stock from products "
                 "where id % 11 = 0"),
    "sales": ("select id, user_id, total, case when id % 7 = 0 then 'vale' else payment_type end "
              "as payment_type, case when id % 6 = 0 then 'rara' else status end as status "
              "from sales"),
}


def _faults_sql() -> str:
    parts = []
    for name in _FAULTY:
        for key in (("id",), *UNIQUE.get(name, ())):
            keys = ", ".join(key)
            known = " and ".join(f"{k} is not null" for k in key)
            parts.append(
                f"select '{name}' as table_name, 'key' as kind, '{','.join(key)}' as columns, "
                f"count(*) as n_bad from (select {keys} from bad_{name} where {known} "
                f"group by {keys} having count(*) > 1)")
        for c in REQUIRED[name]:
            parts.append(f"select '{name}', 'missing', '{c}', count(*) from bad_{name} "
                         f"where {c} is null")
        for c, values in DOMAINS.get(name, {}).items():
            listed = ", ".join(f"'{v}'" for v in values)
            parts.append(f"select '{name}', 'domain', '{c}', count(*) from bad_{name} "
                         f"where {c} not in ({listed})")
    return "\n union all ".join(parts)


@query("j_integrity", with_views(" ".join(_FAULTY), "with " + ", ".join(
    f"bad_{n} as ({text})" for n, text in _FAULTY.items()) + " " + _faults_sql()))
def j_integrity(t):
    """All declared keys, required values and value sets of four tables, one pass over each."""
    def text(c):
        return F.lit(c)

    users, products = t.users, t.products
    copies = users.filter("id % 4 = 0").select(
        (F.col("id") + F.col("id") % 2).alias("id"), "username", text("x").alias("password_hash"),
        "role")
    faulty = {
        "users": users.select(
            "id", F.when(F.col("id") % 9 != 0, F.col("username")).alias("username"),
            F.sha2("username", 256).alias("password_hash"),
            F.when(F.col("id") % 5 == 0, text("jefe")).otherwise(F.col("role")).alias("role"),
        ).unionByName(copies),
        "suppliers": t.suppliers.select("id", "supplier_name", "phone").unionByName(
            t.suppliers.filter("id % 3 = 0").select(
                (F.col("id") + 100000).alias("id"), "supplier_name", "phone")),
        "products": products.select(
            "id", "barcode", "product_name", "cost_price", "retail_price", "stock").unionByName(
            products.filter("id % 11 = 0").select(
                (-F.col("id") - 1).alias("id"), "barcode",
                F.lit(None).cast("string").alias("product_name"), "cost_price",
                F.lit(None).cast("decimal(18,2)").alias("retail_price"), "stock")),
        "sales": t.sales.select(
            "id", "user_id", "total",
            F.when(F.col("id") % 7 == 0, text("vale")).otherwise(F.col("payment_type"))
            .alias("payment_type"),
            F.when(F.col("id") % 6 == 0, text("rara")).otherwise(F.col("status")).alias("status")),
    }
    out = None
    for name, df in faulty.items():
        part = quality.integrity_report(name, df)
        out = part if out is None else out.unionByName(part)
    return out


@query("j4_orphan_products", with_views("products suppliers", """
    select id, supplier_id from products
    where supplier_id not in (select id from suppliers)"""))
def j4(t):
    return quality.check_reference(t.products, "supplier_id", t.suppliers).select(
        "id", "supplier_id"
    )


_ALL = f"{ACCESS} products categories suppliers sales sale_lines"


@query("j4_orphan_counts", with_views(_ALL, "\n union all ".join(
    f"select '{c}' as child, '{k}' as column_name, '{p}' as parent, count(*) as n_orphans "
    f"from {c} where {k} is not null and {k} not in (select id from {p})"
    for c, k, p in quality.REFERENCES)))
def j4_counts(t):
    return quality.orphan_counts({n: getattr(t, n) for n in _ALL.split()})


@query("j5_fill_defaults", with_views("new_sales", f"""
    select seq, coalesce(status, 'completada') as status,
           case when seq % 5 = 0 then {NOW_SQL} else timestamp '2025-01-01' end as sold_at
    from new_sales"""))
def j5(t):
    given = F.when(F.col("seq") % 5 != 0, F.lit("2025-01-01").cast("timestamp_ntz"))
    rows = t.new_sales.withColumn("sold_at", given)
    return quality.fill_defaults("sales", rows, now()).select("seq", "status", "sold_at")


# --- scalar functions ----------------------------------------------------------------------


@query("k5_hash", with_views("users", "select id, sha256(username) as digest from users"))
def k5(t):
    return t.users.select("id", text.sha256_hex("username").alias("digest"))


@query("k7_date_text", with_views("sales", """
    select id, strftime(sold_at, '%Y%m%d_%H%M%S') as stamp, strftime(sold_at, '%Y-%m-%d') as day
    from sales"""))
def k7(t):
    return t.sales.select(
        "id", dates.stamp_text(F.col("sold_at")).alias("stamp"),
        dates.day_text(F.col("sold_at")).alias("day"),
    )


@query("k8_currency", with_views("sales", """
    select id, '$' || cast(total as string) as plain, '$' || format('{:,.2f}', cast(total as double)) as grouped
    from sales"""))
def k8(t):
    return t.sales.select(
        "id", text.currency_text(F.col("total")).alias("plain"),
        text.currency_grouped(F.col("total")).alias("grouped"),
    )


@query("k9_labels", with_views("permissions", """
    select permission, upper(substr(permission, 1, 1))
           || lower(replace(substr(permission, 2), '_', ' ')) as label from permissions"""))
def k9(t):
    return t.permissions.select("permission", text.permission_label("permission").alias("label"))
