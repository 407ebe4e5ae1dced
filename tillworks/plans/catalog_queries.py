"""Catalogue queries over the benchmark tables."""

from pyspark.sql import functions as F

from tillworks.functions.pricing import stock_band
from tillworks.operators import catalog
from tillworks.plans.driver_views import with_views
from tillworks.plans.registry import fold_sql, query

_PRICES = ("cost_price", "retail_price", "wholesale_price")
_ENRICHED = """
    select p.id, p.barcode, p.product_name, p.description, p.category_id, p.supplier_id,
           cast(p.cost_price as double) as cost_price,
           cast(p.retail_price as double) as retail_price,
           cast(p.wholesale_price as double) as wholesale_price, p.wholesale_min_qty, p.stock,
           p.min_stock, p.unit, p.active, c.category_name, s.supplier_name
    from products p left join categories c on p.category_id = c.id
         left join suppliers s on p.supplier_id = s.id"""
_DIMS = "products categories suppliers"


def _plain(df):
    return df.withColumns({c: F.col(c).cast("double") for c in _PRICES})


def _dims(t):
    return t.products, t.categories, t.suppliers


@query("b1_categories", with_views("categories", "select id, category_name from categories"))
def b1(t):
    return catalog.list_categories(t.categories)


@query("b2_suppliers", with_views("suppliers", "select * from suppliers"))
def b2(t):
    return catalog.list_suppliers(t.suppliers)


@query("b3_users", with_views("users", "select id, username, role from users"))
def b3(t):
    return catalog.list_users(t.users)


@query("b4_lookup_users", with_views("users sales", """
    select id, username, role from users where id in (
        select user_id from sales where status = 'pendiente_pago' and payment_type = 'otro')"""))
def b4(t):
    late = t.sales.filter("status = 'pendiente_pago' and payment_type = 'otro'")
    return catalog.lookup(t.users, late.select(F.col("user_id").alias("id")), "id")


@query("b4_lookup_names", with_views("users permissions", """
    select id, permission from permissions where permission in (
        select case when id % 2 = 0 then 'ver_inventario' else username end from users)"""))
def b4_names(t):
    asked = t.users.select(
        F.when(F.col("id") % 2 == 0, "ver_inventario").otherwise(F.col("username"))
        .alias("permission")
    )
    return catalog.lookup(t.permissions, asked, "permission").select("id", "permission")


@query("b5_enriched", with_views(_DIMS, _ENRICHED))
def b5(t):
    return _plain(catalog.enrich_products(*_dims(t)))


@query("b6_product_page", with_views(_DIMS, f"""
    {_ENRICHED} where p.active and {fold_sql('p.product_name')} like '%ring%'
    order by p.product_name, p.id limit 25 offset 25"""))
def b6(t):
    return _plain(catalog.list_products(*_dims(t), page=2, limit=25, name="RinG"))


@query("b6_product_filters", with_views(_DIMS, f"""
    {_ENRICHED} where p.category_id = 2 and p.supplier_id = 3
      and {fold_sql('p.product_name')} like '%l_r%' and p.stock <= p.min_stock"""))
def b6_filters(t):
    return _plain(
        catalog.list_products(
            *_dims(t), limit=None, name="l_R", category_id=2, supplier_id=3, low_stock=True,
            only_active=False,
        )
    )


@query("b6_product_keyset", with_views(_DIMS, f"""
    {_ENRICHED} where p.active and (p.product_name > 'red gear'
                                    or (p.product_name = 'red gear' and p.id > 500))
    order by p.product_name, p.id limit 25"""))
def b6_keyset(t):
    return _plain(catalog.list_products(*_dims(t), after=("red gear", 500)))


@query("b6_low_in_category", with_views(_DIMS, f"""
    {_ENRICHED} where p.category_id = 3
      and {fold_sql('p.product_name')} like '%l_%r%' and p.stock <= p.min_stock"""))
def b6_low(t):
    return _plain(
        catalog.list_products(
            *_dims(t), limit=None, name="L_%r", category_id=3, low_stock=True, only_active=False))


@query("b7_low_stock", with_views(_DIMS, f"""
    {_ENRICHED} where p.active and p.stock <= p.min_stock
    order by p.product_name, p.id limit 25 offset 50"""))
def b7(t):
    return _plain(catalog.low_stock(*_dims(t), page=3))


@query("b8_stock_band", with_views("products movements", """
    with levels as (
        select p.id, greatest(0, p.stock - coalesce(m.sold, 0)) as stock,
               case when p.id % 2 = 0 then 0 else p.min_stock end as min_stock
        from products p left join (select product_id, cast(sum(quantity) as bigint) as sold
                                   from movements where kind = 'salida' group by 1) m
             on m.product_id = p.id)
    select id, stock, min_stock,
           case when stock = 0 then 'out' when stock <= min_stock and min_stock > 0 then 'low'
                else 'ok' end as band
    from levels"""))
def b8(t):
    sold = (
        t.movements.filter("kind = 'salida'").groupBy(F.col("product_id").alias("id"))
        .agg(F.sum("quantity").alias("sold"))
    )
    zero = F.lit(0).cast("long")
    levels = t.products.join(sold, "id", "left").select(
        "id",
        F.greatest(zero, F.col("stock") - F.coalesce("sold", zero)).alias("stock"),
        F.when(F.col("id") % 2 == 0, zero).otherwise(F.col("min_stock")).alias("min_stock"),
    )
    return levels.withColumn("band", stock_band(F.col("stock"), F.col("min_stock")))


@query("b9_by_barcode", with_views(f"{_DIMS} feed", f"""
    {_ENRICHED} where p.active and p.barcode in (
        select barcode from feed where unit = 'kg' and barcode is not null)"""))
def b9(t):
    keys = t.feed.filter("unit = 'kg'").select("barcode")
    return _plain(catalog.products_by_key(*_dims(t), keys, "barcode"))


@query("b9_by_id", with_views(f"{_DIMS} sale_lines", f"""
    {_ENRICHED} where p.active and p.id in (
        select product_id from sale_lines where quantity = 50)"""))
def b9_id(t):
    keys = t.sale_lines.filter("quantity = 50").select(F.col("product_id").alias("id"))
    return _plain(catalog.products_by_key(*_dims(t), keys))


@query("b10_search", with_views("products search_terms", f"""
    with asked as (select distinct trim(term) as term from search_terms where trim(term) <> ''),
    hits as (
        select a.term, cast(1 as bigint) as position, p.id as product_id, p.product_name,
               p.barcode
        from asked a join products p on p.active and p.barcode = a.term
             and regexp_matches(a.term, '^[0-9]{{6,}}$')),
    named as (
        select a.term, row_number() over (partition by a.term order by p.product_name, p.id)
                   as position, p.id as product_id, p.product_name, p.barcode
        from asked a join products p on p.active
             and {fold_sql('p.product_name')} like '%' || {fold_sql('a.term')} || '%'
        where a.term not in (select term from hits))
    select * from hits union all select * from named where position <= 5"""))
def b10(t):
    found = catalog.search_products(t.search_terms, t.products)
    return found.withColumn("position", F.col("position").cast("long"))


_WILD = """
    wild as (select distinct case when id % 3 = 0 then 'RING%' || cast(id % 40 as varchar)
                                  when id % 3 = 1 then substr(product_name, 1, 3) || '_%ge'
                                  else '%' || substr(product_name, 2, 4) || '%wid_et' end as term
             from products)"""


@query("b10_search_wildcards", with_views("products", f"""
    with {_WILD.strip()}
    select * from (
        select w.term, row_number() over (partition by w.term order by p.product_name, p.id)
                   as position, p.id as product_id, p.product_name, p.barcode
        from wild w join products p on p.active
             and {fold_sql('p.product_name')} like '%' || {fold_sql('w.term')} || '%')
    where position <= 5"""))
def b10_wild(t):
    """Terms of several pieces, many of which share one of them."""
    name, id_ = F.col("product_name"), F.col("id")
    term = F.when(id_ % 3 == 0, F.concat(F.lit("RING%"), (id_ % 40).cast("string"))).when(
        id_ % 3 == 1, F.concat(F.substring(name, 1, 3), F.lit("_%ge"))).otherwise(
        F.concat(F.lit("%"), F.substring(name, 2, 4), F.lit("%wid_et")))
    found = catalog.search_products(t.products.select(term.alias("term")).distinct(), t.products)
    return found.withColumn("position", F.col("position").cast("long"))


@query("b11_permissions", with_views("permissions", "select permission from permissions"))
def b11(t):
    return catalog.list_permissions(t.permissions)


@query("a3_catalogue_export", with_views(_DIMS, """
    select p.id as "ID", p.barcode as "Código Barras", p.product_name as "Nombre Producto",
           p.description as "Descripción", p.category_id as "Categoría ID",
           c.category_name as "Categoría", p.supplier_id as "Proveedor ID",
           s.supplier_name as "Proveedor", cast(p.cost_price as double) as "Precio Compra ($)",
           cast(p.retail_price as double) as "Precio Venta ($)",
           cast(p.wholesale_price as double) as "Precio Mayoreo ($)",
           p.wholesale_min_qty as "Cant. Mayoreo", p.stock as "Stock Actual",
           p.min_stock as "Stock Mínimo", p.unit as "Unidad Medida",
           case when p.active then 'Sí' else 'No' end as "Activo",
           '2024-01-01' as "Fecha Creación", cast(null as varchar) as "Última Modificación"
    from products p left join categories c on p.category_id = c.id
         left join suppliers s on p.supplier_id = s.id"""))
def a3(t):
    products = t.products.withColumns({
        "created_at": F.lit("2024-01-01"), "modified_at": F.lit(None).cast("string")
    })
    out = catalog.export_catalogue(products, t.categories, t.suppliers)
    money = [c for c in out.columns if "($)" in c]
    return out.withColumns({c: F.col(f"`{c}`").cast("double") for c in money})
