"""Bulk product import over the benchmark tables."""

from pyspark.sql import functions as F

from tillworks.operators import ingest
from tillworks.plans.admin_queries import now
from tillworks.plans.driver_views import with_views
from tillworks.plans.registry import query

_MONEY = "decimal(18,2)"
_WHOLE = "try_cast(case when regexp_full_match({0}, '[0-9]+') then {0} end as bigint)"

# the feed wants no barcode for two products, so the check needs no rule for that
_JUDGED = f"""
    parsed as (
        select row_no, id as id_text, try_cast(id as bigint) as wanted,
               nullif(barcode, '') as barcode, product_name, description,
               (select min(c.id) from categories c where lower(c.category_name) = lower(category))
                   as category_id,
               coalesce(try_cast(cost_price as {_MONEY}), 0) as cost_price,
               coalesce(try_cast(retail_price as {_MONEY}), 0) as retail_price,
               nullif(try_cast(wholesale_price as {_MONEY}), 0) as wholesale_price,
               nullif({_WHOLE.format('wholesale_min_qty')}, 0) as wholesale_min_qty,
               coalesce({_WHOLE.format('stock')}, 0) as stock,
               coalesce({_WHOLE.format('min_stock')}, 0) as min_stock,
               coalesce(unit, 'unidad') as unit,
               coalesce(lower(active) in ('sí', 'si', 'true', '1', 'yes'), true) as active,
               stock is not null and {_WHOLE.format('stock')} is null as bad_number,
               id is not null and try_cast(id as bigint) is null as bad_id
        from feed where product_name <> ''),
    matched as (
        select f.*, coalesce(a.id, b.id) as target
        from parsed f left join products a on a.id = f.wanted and a.active
             left join products b on b.barcode = f.barcode),
    started as (
        select barcode, min(row_no) as start from matched
        where target is null and not bad_number and not bad_id and retail_price <> 0
              and barcode is not null
        group by 1),
    judged as (
        select m.*, case when bad_number then 'bad_number' when bad_id then 'bad_id'
                         when target is not null then 'actualizado'
                         when m.barcode is null then
                              case when retail_price = 0 then 'price_required' else 'creado' end
                         when s.start is null or m.row_no < s.start then 'price_required'
                         when m.row_no = s.start then 'creado' else 'actualizado' end as outcome
        from matched m left join started s on s.barcode = m.barcode)"""

_LAST = ("product_name", "category_id", "cost_price", "retail_price", "stock", "min_stock",
         "unit", "active")
_LAST_NULL = ("description", "wholesale_price", "wholesale_min_qty")
_FOLDS = ", ".join(
    [f"arg_max({c}, row_no) as {c}" for c in _LAST]
    + [f"arg_max_null({c}, row_no) as {c}" for c in _LAST_NULL]
)
_SHOWN = ("barcode", "product_name", "description", "category_id", "cost_price", "retail_price",
          "wholesale_price", "wholesale_min_qty", "stock", "min_stock", "unit", "active")
_PRICES = ("cost_price", "retail_price", "wholesale_price")


def _shown(alias: str) -> str:
    return ", ".join(
        f"cast({alias}.{c} as double) as {c}" if c in _PRICES else f"{alias}.{c}" for c in _SHOWN
    )


def _import(t, **options):
    products = t.products.withColumns({
        c: F.lit(None).cast("timestamp_ntz") for c in ("created_at", "modified_at")
    })
    return ingest.upsert_products(products, t.feed, t.categories, t.suppliers, now(), **options)


_MERGED = ", ".join(
    ["p.barcode"]
    + [f"coalesce(u.{c}, p.{c}) as {c}" for c in _LAST]
    + [f"case when u.target is not null then u.{c} else p.{c} end as {c}" for c in _LAST_NULL]
)


@query("g_upsert", with_views("feed products categories", f"""
    with {_JUDGED.strip()},
    applied as (select * from judged where outcome in ('creado', 'actualizado')),
    updates as (select target, {_FOLDS} from applied where target is not null group by 1),
    merged as (select {_MERGED} from products p left join updates u on u.target = p.id),
    created as (select barcode, case when barcode is null then row_no end as single, {_FOLDS}
                from applied where target is null group by 1, 2)
    select {_shown('merged')} from merged union all select {_shown('created')} from created"""))
def g_upsert(t):
    table = _import(t).products.select(*_SHOWN)
    return table.withColumns({c: F.col(c).cast("double") for c in _PRICES})


@query("g_log", with_views("feed products categories", f"""
    with {_JUDGED.strip()}
    select row_no, product_name, case when outcome in ('creado', 'actualizado') then outcome
                                      else 'error' end as status,
           case outcome when 'creado' then 'product added'
                when 'actualizado' then 'product changed'
                when 'price_required' then 'a new product needs a sale price'
                when 'bad_number' then 'a price or a quantity is not a number'
                when 'bad_id' then 'the id is not a whole number' end as message
    from judged"""))
def g_log(t):
    return _import(t).log


@query("g_log_counts", with_views("feed products categories", f"""
    with {_JUDGED.strip()}
    select case when outcome in ('creado', 'actualizado') then outcome else 'error' end as status,
           count(*) as n_rows
    from judged group by 1"""))
def g_counts(t):
    return ingest.import_counts(_import(t).log)


@query("g4_resolve_names", with_views("feed categories", """
    select row_no, (select min(c.id) from categories c
                    where lower(c.category_name) = lower(category)) as category_id
    from feed"""))
def g4(t):
    return ingest.resolve_names(t.feed, t.categories, t.suppliers).select("row_no", "category_id")


@query("g2_g3_parse", with_views("feed", f"""
    select row_no, cast(coalesce(try_cast(cost_price as {_MONEY}), 0) as double) as cost_price,
           nullif({_WHOLE.format('wholesale_min_qty')}, 0) as wholesale_min_qty,
           coalesce({_WHOLE.format('stock')}, 0) as stock,
           stock is not null and {_WHOLE.format('stock')} is null as bad_number,
           coalesce(unit, 'unidad') as unit, nullif(barcode, '') as barcode,
           coalesce(lower(active) in ('sí', 'si', 'true', '1', 'yes'), true) as active
    from feed where product_name <> ''"""))
def g2_g3(t):
    parsed = ingest.parse_feed_flags(ingest.parse_feed_numbers(ingest.clean_feed(t.feed)))
    return parsed.select(
        "row_no", F.col("cost_price").cast("double").alias("cost_price"), "wholesale_min_qty",
        "stock", "bad_number", "unit", "barcode", "active",
    )


# four rows per product: by id switched off, by id only, by barcode switched on, by id only
_SWITCHING = """
    steps as (
        select p.id, p.id * 4 + k.k + 2 as row_no, k.k as n, case when k.k <> 3 then p.id end
                   as wanted, case when k.k = 3 then p.barcode end as barcode,
               case when k.k <> 4 or p.id % 2 = 0 then 5 else 0 end as price,
               case k.k when 1 then false when 3 then true else p.id % 3 <> 0 end as active
        from products p, (select unnest([1, 2, 3, 4]) as k) k),
    fold as (
        select id, cast(0 as bigint) as n, active as state, cast(null as bigint) as row_no,
               cast(null as varchar) as outcome from products
        union all
        select f.id, s.n, case when (s.wanted is not null and f.state) or s.barcode is not null
                               then s.active else f.state end,
               s.row_no, case when (s.wanted is not null and f.state) or s.barcode is not null
                              then 'actualizado' when s.price <> 0 then 'creado' else 'error' end
        from fold f join steps s on s.id = f.id and s.n = f.n + 1)"""


@query("g5_switched_products", with_views("products", f"""
    with {_SWITCHING.strip()}
    select f.row_no, f.outcome as status, l.state as active_after
    from fold f join fold l on l.id = f.id and l.n = 4 where f.n > 0""", recursive=True))
def g5_switched(t):
    """An import whose rows switch products off and on, and ask for them by id in between."""
    products = t.products.withColumns({
        c: F.lit(None).cast("timestamp_ntz") for c in ("created_at", "modified_at")
    })
    k = F.col("k")
    rows = products.withColumn("k", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])))
    active = F.when(k == 1, "no").when(k == 3, "si").when(F.col("id") % 3 != 0, "yes")
    feed = rows.select(
        (F.col("id") * 4 + k + 2).alias("row_no"),
        F.when(k != 3, F.col("id")).cast("string").alias("id"),
        F.when(k == 3, F.col("barcode")).alias("barcode"), F.lit("renamed").alias("product_name"),
        F.when((k != 4) | (F.col("id") % 2 == 0), "5").alias("retail_price"),
        F.coalesce(active, F.lit("no")).alias("active"),
        *[F.lit(None).cast("string").alias(c) for c in (
            "description", "category", "supplier", "cost_price", "wholesale_price",
            "wholesale_min_qty", "stock", "min_stock", "unit")])
    done = ingest.upsert_products(products, feed, t.categories, t.suppliers, now())
    after = done.products.select(F.col("id").alias("_id"), F.col("active").alias("active_after"))
    return done.log.join(after, F.expr("(row_no - 3) div 4") == F.col("_id")).select(
        "row_no", "status", "active_after")
