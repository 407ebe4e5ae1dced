"""Pricing, carts, sale posting and stock movements over the benchmark tables."""

from pyspark.sql import functions as F

from tillworks.operators import sales, stock
from tillworks.plans.driver_views import with_views
from tillworks.plans.registry import query
from tillworks.plans.admin_queries import now
from tillworks.plans.report_queries import ACCESS, GRANTS_SQL, grants
from tillworks.session import scratch_path
from tillworks.sources import stored, tables

MOVEMENT_ORDER = ["moved_at", "doc_no", "line_no", "party_no", "amount"]
_ORDER = ", ".join(MOVEMENT_ORDER)

_TIER = """case when p.wholesale_min_qty <> 0 and {q} >= p.wholesale_min_qty
            and p.wholesale_price is not null then p.wholesale_price else p.retail_price end"""
_PRICED = f"""
    select l.sale_id as cart_id, l.product_id, l.quantity, {_TIER.format(q='l.quantity')} as price
    from sale_lines l join products p on l.product_id = p.id and p.active"""


def _priced(t):
    lines = t.sale_lines.select(F.col("sale_id").alias("cart_id"), "product_id", "quantity")
    return sales.price_lines(lines, t.products)


@query("e1_tier_price", with_views("sale_lines products", f"""
    select cart_id, product_id, quantity, cast(price as double) as unit_price,
           cast(quantity * price as double) as line_subtotal
    from ({_PRICED})"""))
def e1(t):
    return _priced(t).select(
        "cart_id", "product_id", "quantity",
        F.col("unit_price").cast("double").alias("unit_price"),
        F.col("line_subtotal").cast("double").alias("line_subtotal"),
    )


@query("e2_cart_totals", with_views("sale_lines products", f"""
    select cart_id, count(*) as n_lines, cast(sum(quantity * price) as double) as total
    from ({_PRICED}) group by cart_id"""))
def e2(t):
    return sales.cart_totals(_priced(t)).select(
        "cart_id", "n_lines", F.col("total").cast("double").alias("total")
    )


_TENDER = """
    select *, case when tendered is not null and paid_by = 'efectivo' then
                   case when amount is null then 'bad_tender'
                        when amount < total then 'short_cash' end end as tender_reason
    from (select *, coalesce(payment_type, 'efectivo') as paid_by,
                 try_cast(tendered as decimal(18,2)) as amount from new_sales)"""


@query("e3_tender", with_views("new_sales", f"""
    select seq, paid_by as payment_type, cast(amount as double) as tendered,
           cast(case when tendered is not null and paid_by = 'efectivo' and amount >= total
                     then amount - total end as double) as change_due,
           tender_reason as reason
    from ({_TENDER})"""))
def e3(t):
    return sales.check_tender(t.new_sales).select(
        "seq", "payment_type", F.col("tendered").cast("double").alias("tendered"),
        F.col("change_due").cast("double").alias("change_due"), "reason",
    )


def _validated(check_stock: bool) -> str:
    """``validated``: seq, sale_ref and the reason of every new sale."""
    short = "when p.stock < l.quantity then 'insufficient_stock'" if check_stock else ""
    return f"""
    g as ({GRANTS_SQL}),
    checked as (
        select l.*, case when l.quantity <= 0 then 'bad_quantity'
                         when p.id is null then 'product_not_found' {short} end as reason
        from new_lines l left join products p on l.product_id = p.id and p.active),
    first_bad as (
        select sale_ref, reason from checked where reason is not null
        qualify row_number() over (partition by sale_ref
                                   order by position, product_id, quantity) = 1),
    validated as (
        select s.*, case when s.user_id not in
                              (select user_id from g where permission = 'realizar_ventas')
                              then 'no_permission'
                         when s.sale_ref not in (select sale_ref from new_lines) then 'empty_cart'
                         when b.reason is not null then b.reason
                         when s.tender_reason is not null then s.tender_reason
                         when s.paid_by = 'cheque' then 'bad_payment_type' end as reason
        from ({_TENDER}) s left join first_bad b on b.sale_ref = s.sale_ref)"""


@query("e4_validate", with_views(f"new_sales new_lines products {ACCESS}", f"""
    with {_validated(True).strip()}
    select seq, reason from validated"""))
def e4(t):
    checked = sales.validate_sales(t.new_sales, t.new_lines, t.products, grants(t))
    return checked.select("seq", "reason")


def _posting(t, **allocation):
    products = t.products.withColumn("modified_at", F.lit(None).cast("timestamp_ntz"))
    return sales.post_sales(
        t.new_sales, t.new_lines, products, grants(t), t.sales, t.sale_lines, now(),
        **allocation,
    )


# Rounds over the open lines: refused if a line exceeds what accepted sales left, accepted if it
# fits even after all open sales before it. Every round settles the first open sale.
_ALLOCATED = f"""
    {_validated(False).strip()},
    alloc as (
        select l.sale_ref, v.seq, l.product_id, sum(l.quantity) as need, min(p.stock) as room,
               'open' as state
        from new_lines l join validated v on v.sale_ref = l.sale_ref and v.reason is null
             join products p on p.id = l.product_id
        group by 1, 2, 3
        union all
        select sale_ref, seq, product_id, need, room,
               case when bool_or(need > room) over (partition by sale_ref) then 'refused'
                    when bool_and(ahead + need <= room) over (partition by sale_ref)
                         then 'accepted' else 'open' end
        from (select sale_ref, seq, product_id, need, state, room - coalesce(sum(case when state
                     = 'accepted' then need else 0 end) over earlier, 0) as room,
                     coalesce(sum(case when state = 'open' then need else 0 end) over earlier, 0)
                     as ahead
              from alloc where state <> 'refused'
              window earlier as (partition by product_id order by seq
                                 rows between unbounded preceding and 1 preceding))
        where state = 'open'),
    taken as (select distinct sale_ref from alloc where state = 'accepted')"""
_POST_VIEWS = f"new_sales new_lines products {ACCESS}"


@query("e5_post_sales", with_views(_POST_VIEWS, f"""
    with {_ALLOCATED.strip()},
    amounts as (select sale_ref, count(*) as n_lines, sum(quantity * unit_price) as amount
                from new_lines group by 1)
    select null as ref, 'posted' as outcome, v.user_id, cast(v.total as double) as total,
           v.paid_by as payment_type,
           cast(case when v.tendered is not null and v.paid_by = 'efectivo' and v.amount >= v.total
                     then v.amount - v.total end as double) as change_due,
           a.n_lines, cast(a.amount as double) as amount
    from validated v join taken using (sale_ref) join amounts a using (sale_ref)
    union all
    select sale_ref, coalesce(reason, 'insufficient_stock'), null, null, null, null, 0, null
    from validated where sale_ref not in (select sale_ref from taken)""", recursive=True))
def e5(t):
    done = _posting(t)
    lines = done.lines.groupBy(F.col("sale_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("line_subtotal").cast("double").alias("amount"),
    )
    posted = done.sales.join(lines, "id").select(
        F.lit(None).cast("long").alias("ref"), F.lit("posted").alias("outcome"), "user_id",
        F.col("total").cast("double").alias("total"), "payment_type",
        F.col("change_due").cast("double").alias("change_due"), "n_lines", "amount",
    )
    refused = done.refused.select(
        F.col("sale_ref").alias("ref"), F.col("reason").alias("outcome"),
        F.lit(0).cast("long").alias("n_lines"),
    )
    return posted.unionByName(refused, allowMissingColumns=True)


@query("e5_stock_after", with_views(_POST_VIEWS, f"""
    with {_ALLOCATED.strip()},
    sold as (select product_id, sum(quantity) as quantity
             from new_lines join taken using (sale_ref) group by 1)
    select p.id, cast(p.stock - coalesce(s.quantity, 0) as bigint) as stock,
           s.quantity is not null as moved
    from products p left join sold s on s.product_id = p.id""", recursive=True))
def e5_stock(t):
    # blocks so small that lines stay open from one to the next
    return _posting(t, block_lines=8_000).products.select(
        "id", "stock", F.col("modified_at").isNotNull().alias("moved")
    )


_TOTALS = {"sales": "user_id", "sale_lines": "quantity", "products": "stock"}


@query("e5_commit_posting", with_views(f"{_POST_VIEWS} sales sale_lines", f"""
    with {_ALLOCATED.strip()},
    headers as (
        select (select max(id) from sales) + row_number() over (order by seq) as id, user_id
        from validated join taken using (sale_ref)
        union all select id, user_id from sales),
    sold as (select product_id, quantity from new_lines join taken using (sale_ref)),
    all_lines as (
        select (select max(id) from sale_lines) + row_number() over () as id, quantity from sold
        union all select id, quantity from sale_lines),
    left_over as (
        select p.id, p.stock - coalesce(s.quantity, 0) as stock from products p left join
            (select product_id, sum(quantity) as quantity from sold group by 1) s
            on s.product_id = p.id)
    select 'sales' as table_name, cast(count(*) as bigint) as n_rows,
           cast(sum(id) as bigint) as id_sum, cast(sum(user_id) as bigint) as amount from headers
    union all select 'sale_lines', count(*), cast(sum(id) as bigint),
                     cast(sum(quantity) as bigint) from all_lines
    union all select 'products', count(*), cast(sum(id) as bigint),
                     cast(sum(stock) as bigint) from left_over""", recursive=True))
def e5_commit(t):
    """Posted to stored tables in one commit, and these read back."""
    root = scratch_path(t.spark, "tables")
    products = t.products.withColumn("modified_at", F.lit(None).cast("timestamp_ntz"))
    tables.commit_tables(t.spark, root, {
        "sales": t.sales, "sale_lines": t.sale_lines, "products": products})
    stored.post(t.spark, root, t.new_sales, t.new_lines, grants(t), now(), block_lines=1_000)
    out = None
    for name, column in _TOTALS.items():
        part = tables.read_table(t.spark, root, name).agg(
            F.count("*").alias("n_rows"), F.sum("id").alias("id_sum"),
            F.sum(column).cast("long").alias("amount"),
        ).select(F.lit(name).alias("table_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query("e6_cart_fold", with_views("cart_events products", f"""
    with ordered as (
        select e.*, p.retail_price, p.wholesale_price, p.wholesale_min_qty, p.active,
               row_number() over (partition by e.cart_id, e.product_id order by e.seq) as n,
               {_TIER.format(q='e.quantity')} as tier
        from cart_events e join products p on e.product_id = p.id),
    fold as (
        select cart_id, product_id, cast(0 as bigint) as n, cast(null as bigint) as count,
               cast(null as decimal(18,2)) as price
        from (select distinct cart_id, product_id from ordered)
        union all
        select f.cart_id, f.product_id, o.n,
               case when o.kind = 'add' then coalesce(f.count, 0) + o.quantity
                    when o.kind = 'remove' or f.count + o.quantity <= 0 then null
                    else f.count + o.quantity end,
               case when o.kind = 'add' and f.count is null then o.tier
                    when o.kind = 'add' then f.price
                    when o.kind = 'remove' or f.count is null or f.count + o.quantity <= 0
                         then null
                    when not o.active then f.price
                    when o.wholesale_min_qty <> 0 and f.count + o.quantity >= o.wholesale_min_qty
                         and o.wholesale_price is not null then o.wholesale_price
                    else o.retail_price end
        from fold f join ordered o on o.cart_id = f.cart_id and o.product_id = f.product_id
             and o.n = f.n + 1)
    select cart_id, product_id, count as quantity, cast(price as double) as unit_price,
           cast(count * price as double) as line_subtotal
    from (select * from fold qualify row_number() over (partition by cart_id, product_id
                                                        order by n desc) = 1)
    where count is not null""", recursive=True))
def e6(t):
    return sales.fold_cart_events(t.cart_events, t.products).select(
        "cart_id", "product_id", "quantity",
        F.col("unit_price").cast("double").alias("unit_price"),
        F.col("line_subtotal").cast("double").alias("line_subtotal"),
    )


def _moves_sql(source: str, keys: str = _ORDER) -> str:
    """Movements one after the other per product; ``stock`` after each, ``reason`` if refused."""
    return f"""
    ordered as (
        select m.*, p.stock as opening, row_number() over (partition by product_id
                                                           order by {_ORDER}) as n
        from {source} m left join products p on m.product_id = p.id and p.active),
    fold as (
        select product_id, n, {keys}, kind, quantity, notes,
               case when quantity <= 0 or opening is null then opening
                    when kind = 'entrada' then opening + quantity
                    when kind = 'salida' and opening >= quantity then opening - quantity
                    else opening end as stock,
               case when quantity <= 0 then 'bad_quantity'
                    when opening is null then 'product_not_found' when kind = 'entrada' then null
                    when kind <> 'salida' then 'bad_kind'
                    when opening < quantity then 'insufficient_stock' end as reason
        from ordered where n = 1
        union all
        select o.product_id, o.n, {", ".join("o." + k.strip() for k in keys.split(","))}, o.kind,
               o.quantity, o.notes,
               case when o.quantity <= 0 or f.stock is null then f.stock
                    when o.kind = 'entrada' then f.stock + o.quantity
                    when o.kind = 'salida' and f.stock >= o.quantity then f.stock - o.quantity
                    else f.stock end,
               case when o.quantity <= 0 then 'bad_quantity'
                    when f.stock is null then 'product_not_found' when o.kind = 'entrada' then null
                    when o.kind <> 'salida' then 'bad_kind'
                    when f.stock < o.quantity then 'insufficient_stock' end
        from fold f join ordered o on o.product_id = f.product_id and o.n = f.n + 1)"""


_SHOWN = ["product_id", *MOVEMENT_ORDER, "kind", "quantity", "notes", "stock", "reason"]


@query("f1_movements", with_views("movements products", f"""
    with {_moves_sql('movements').strip()}
    select {", ".join(_SHOWN)} from fold""", recursive=True))
def f1(t):
    return stock.apply_movements(t.products, t.movements, MOVEMENT_ORDER).select(*_SHOWN)


@query("f1_stock_after", with_views("movements products", f"""
    with {_moves_sql('movements').strip()},
    last as (select product_id, stock, bool_or(reason is null) over (partition by product_id)
                    as moved from fold
             qualify row_number() over (partition by product_id order by n desc) = 1)
    select p.id, coalesce(l.stock, p.stock) as stock, coalesce(l.moved, false) as moved
    from products p left join last l on l.product_id = p.id""", recursive=True))
def f1_stock(t):
    products = t.products.withColumn("modified_at", F.lit(None).cast("timestamp_ntz"))
    applied = stock.apply_movements(products, t.movements, MOVEMENT_ORDER)
    return stock.stock_after(products, applied, MOVEMENT_ORDER, now()).select(
        "id", "stock", F.col("modified_at").isNotNull().alias("moved")
    )


@query("f2_stock_in", with_views("movements products", f"""
    select m.product_id, {_ORDER}, m.quantity,
           cast(p.stock + sum(m.quantity) over (partition by m.product_id order by {_ORDER}
                                                rows unbounded preceding) as bigint) as stock,
           case when p.id is null then 'product_not_found' end as reason
    from movements m left join products p on m.product_id = p.id and p.active"""))
def f2(t):
    done = stock.stock_in(t.products, t.movements, MOVEMENT_ORDER)
    return done.select("product_id", *MOVEMENT_ORDER, "quantity", "stock", "reason")


@query("f3_adjustments", with_views("movements products", f"""
    with noted as (select product_id, quantity, 'salida' as kind, {_ORDER},
                          'AJUSTE MANUAL: ' || notes as notes
                   from movements where notes <> ''),
    {_moves_sql('noted').strip()}
    select {", ".join(_SHOWN)} from fold
    union all
    select product_id, {_ORDER}, 'salida', quantity, notes, null, 'note_required'
    from movements where notes is null""", recursive=True))
def f3(t):
    done = stock.stock_out_adjustment(t.products, t.movements, MOVEMENT_ORDER)
    return done.select(*_SHOWN)
