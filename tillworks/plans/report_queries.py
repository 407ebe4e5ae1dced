"""Period reports and sales history over the benchmark tables."""

from pyspark.sql import functions as F

from tillworks.operators import access, history, paging, reports
from tillworks.plans.driver_views import with_views
from tillworks.plans.registry import fold_sql, query

YEAR = ("1996-01-01", "1996-12-31")
_IN_YEAR = (
    "status = 'completada' and sold_at >= timestamp '1996-01-01' "
    "and sold_at < timestamp '1997-01-01'"
)


def _double(*names):
    return [F.col(n).cast("double").alias(n) for n in names]


@query("d1_period_summary", with_views("sales", f"""
    select count(id) as n_sales, cast(sum(total) as double) as total_sales,
           case when count(id) > 0 then cast(sum(total) as double) / count(id) end
               as average_sale
    from sales where {_IN_YEAR}"""))
def d1(t):
    return reports.period_summary(t.sales, *YEAR).select(
        "n_sales", *_double("total_sales"), "average_sale"
    )


@query("d1_d2_period_report", with_views("sales", f"""
    select true as is_summary, cast(null as varchar) as payment_type, count(id) as n_sales,
           cast(sum(total) as double) as total_sales,
           cast(sum(total) as double) / count(id) as average_sale
    from sales where {_IN_YEAR}
    union all
    select false, payment_type, count(id), cast(sum(total) as double),
           cast(sum(total) as double) / count(id)
    from sales where {_IN_YEAR} group by payment_type"""))
def d1_d2(t):
    return reports.period_report(t.sales, *YEAR).select(
        "is_summary", "payment_type", "n_sales", *_double("total_sales"), "average_sale"
    )


@query("d2_payment_breakdown", with_views("sales", f"""
    select payment_type, cast(sum(total) as double) as total_sales, count(id) as n_sales
    from sales where {_IN_YEAR} group by payment_type"""))
def d2(t):
    return reports.payment_breakdown(t.sales, *YEAR).select(
        "payment_type", *_double("total_sales"), "n_sales"
    )


_TOTALS = f"""
    select l.product_id, p.barcode, p.product_name,
           cast(sum(l.quantity) as bigint) as total_quantity,
           cast(sum(l.line_subtotal) as double) as total_value
    from sale_lines l join products p on l.product_id = p.id join sales s on l.sale_id = s.id
    where {_IN_YEAR} group by 1, 2, 3"""


def _product_totals(t):
    return reports.product_totals(t.sales, t.sale_lines, t.products, *YEAR)


@query("d3_top_quantity", with_views("sales sale_lines products", f"""
    select product_id, barcode, product_name, total_quantity from ({_TOTALS})
    order by total_quantity desc, product_id limit 10"""))
def d3(t):
    return reports.top_products_by_quantity(_product_totals(t))


@query("d4_top_value", with_views("sales sale_lines products", f"""
    select product_id, barcode, product_name, total_value from ({_TOTALS})
    order by total_value desc, product_id limit 10"""))
def d4(t):
    return reports.top_products_by_value(_product_totals(t)).select(
        "product_id", "barcode", "product_name", *_double("total_value")
    )


@query("d3_d4_product_totals", with_views("sales sale_lines products", _TOTALS))
def d3_d4(t):
    return _product_totals(t).select(
        "product_id", "barcode", "product_name", "total_quantity", *_double("total_value")
    )


@query("d5_sales_by_user", with_views("sales users", f"""
    select s.user_id, u.username, count(s.id) as n_sales,
           cast(sum(s.total) as double) as total_sales
    from sales s join users u on s.user_id = u.id where {_IN_YEAR} group by 1, 2"""))
def d5(t):
    return reports.sales_by_user(t.sales, t.users, *YEAR).select(
        "user_id", "username", "n_sales", *_double("total_sales")
    )


@query("d6_period_detail", with_views("sales users", f"""
    select s.id, s.sold_at, u.username, s.client_name, cast(s.total as double) as total,
           s.payment_type
    from sales s join users u on s.user_id = u.id where {_IN_YEAR}"""))
def d6(t):
    return reports.period_sales_detail(t.sales, t.users, *YEAR).select(
        "id", "sold_at", "username", "client_name", *_double("total"), "payment_type"
    )


# --- history -------------------------------------------------------------------------------

_FILTERS = {"date_from": "1996-03-01", "date_to": "1998-02-28", "client": "cLIENT#1"}
_HISTORY = f"""
    select s.id, s.sold_at, u.username, s.client_name, cast(s.total as double) as total,
           s.payment_type, s.status
    from sales s join users u on s.user_id = u.id
    where s.sold_at >= timestamp '1996-03-01' and s.sold_at < timestamp '1998-03-01'
      and ({fold_sql('s.client_name')} like '%client#1%'
           or {fold_sql('s.client_ident')} like '%client#1%')"""


def _money_total(df):
    return df.withColumn("total", F.col("total").cast("double"))


@query("c1_sales_page", with_views("sales users", f"""
    {_HISTORY} order by s.sold_at desc, s.id desc limit 25 offset 50"""))
def c1(t):
    return _money_total(history.list_sales(t.sales, t.users, page=3, limit=25, **_FILTERS))


@query("c1_sales_page_keyset", with_views("sales users", """
    select s.id, s.sold_at, u.username, s.client_name, cast(s.total as double) as total,
           s.payment_type, s.status
    from sales s join users u on s.user_id = u.id
    where s.sold_at < timestamp '1998-02-01' or (s.sold_at = timestamp '1998-02-01' and s.id < 9000)
    order by s.sold_at desc, s.id desc limit 25"""))
def c1_keyset(t):
    page = history.list_sales(t.sales, t.users, after=("1998-02-01 00:00:00", 9000))
    return _money_total(page)


@query("c2_page_info", with_views("sales users", f"""
    select count(*) as total_rows, cast(3 as bigint) as page,
           cast(ceil(count(*) / 25.0) as bigint) as total_pages
    from ({_HISTORY})"""))
def c2(t):
    return paging.page_info(history.filter_sales(t.sales, t.users, **_FILTERS), 3, 25)


@query("c3_sale_documents", with_views("sales users sale_lines products", """
    select s.id, u.username, cast(s.total as double) as total, cast(0 as bigint) as part,
           count(p.id) as n_lines,
           coalesce(cast(sum(case when p.id is not null then l.line_subtotal end) as double), 0)
               as lines_total,
           coalesce(string_agg(case when p.id is not null then p.barcode || 'x'
                    || cast(l.quantity as string) end, ','
                    order by l.id, l.product_id, l.quantity, l.unit_price, l.line_subtotal), '')
               as lines_text
    from sales s join users u on s.user_id = u.id
         left join sale_lines l on l.sale_id = s.id left join products p on l.product_id = p.id
    group by 1, 2, 3"""))
def c3(t):
    documents = history.sale_documents(t.sales, t.users, t.sale_lines, t.products)
    zero = F.lit(0).cast("decimal(28,2)")
    return documents.select(
        "id", "username", F.col("total").cast("double").alias("total"), "part",
        F.size("lines").cast("long").alias("n_lines"),
        F.aggregate("lines", zero, lambda a, x: (a + x["line_subtotal"]).cast("decimal(28,2)"))
        .cast("double").alias("lines_total"),
        F.array_join(
            F.transform("lines", lambda x: F.concat(x["barcode"], F.lit("x"),
                                                    x["quantity"].cast("string"))), ","
        ).alias("lines_text"),
    )


GRANTS_SQL = """
    select r.user_id, p.permission from (
        select u.id as user_id, rp.permission_id from users u
            join role_permissions rp on u.role = rp.role
        union select up.user_id, up.permission_id from user_permissions up
            join users u on up.user_id = u.id where up.granted
    ) r join permissions p on r.permission_id = p.id
    where not exists (select 1 from user_permissions x where not x.granted
                      and x.user_id = r.user_id and x.permission_id = r.permission_id)"""
ACCESS = "users permissions role_permissions user_permissions"


def grants(t):
    return access.effective_permissions(
        t.users, t.permissions, t.role_permissions, t.user_permissions
    )


@query("c4_visible_sales", with_views(f"sales {ACCESS}", f"""
    with g as ({GRANTS_SQL})
    select id, user_id, cast(total as double) as total from sales
    where case when exists (select 1 from g where g.user_id = 31
                            and permission = 'ver_historial_ventas_todas') then user_id = 12
               else exists (select 1 from g where g.user_id = 31
                            and permission = 'ver_historial_ventas_propias') and user_id = 31
          end"""))
def c4(t):
    found = history.visible_sales(t.sales, grants(t), requester_id=31, user_id=12)
    return found.select("id", "user_id", F.col("total").cast("double").alias("total"))


@query("c4_visible_totals", with_views(f"sales {ACCESS}", f"""
    with g as ({GRANTS_SQL}),
    flags as (
        select u.id as user_id,
               coalesce(bool_or(permission = 'ver_historial_ventas_todas'), false) as sees_all,
               coalesce(bool_or(permission = 'ver_historial_ventas_propias'), false) as sees_own
        from users u left join g on g.user_id = u.id group by 1)
    select f.user_id,
           case when sees_all then 'all' when sees_own then 'own' else 'refused' end as scope,
           case when sees_all then (select count(*) from sales s join users u on s.user_id = u.id)
                when sees_own then (select count(*) from sales s where s.user_id = f.user_id)
                else 0 end as n_sales,
           cast(case when sees_all
                     then (select sum(total) from sales s join users u on s.user_id = u.id)
                     when sees_own
                     then (select sum(total) from sales s where s.user_id = f.user_id)
                end as double) as total_sales
    from flags f"""))
def c4_totals(t):
    return history.visible_totals(t.sales, t.users, grants(t)).select(
        "user_id", "scope", "n_sales", *_double("total_sales")
    )


@query("d3_d4_product_report", with_views("sales sale_lines products", f"""
    with totals as ({_TOTALS})
    select * from (select 'quantity' as ranking, * from totals
                   order by total_quantity desc, product_id limit 10)
    union all
    select * from (select 'value' as ranking, * from totals
                   order by total_value desc, product_id limit 10)"""))
def d3_d4_report(t):
    return reports.product_report(t.sales, t.sale_lines, t.products, *YEAR).withColumn(
        "total_value", F.col("total_value").cast("double"))


def _seen(t, requester, **filters):
    found = history.visible_sales(t.sales, grants(t), requester_id=requester, **filters)
    return found.select("id", "user_id", F.col("total").cast("double").alias("total"))


# requester 20 may see all sales, 80 their own
@query("c4_all_sales", with_views(f"sales {ACCESS}", f"""
    with g as ({GRANTS_SQL})
    select id, user_id, cast(total as double) as total from sales
    where user_id = 3 and exists (select 1 from g where g.user_id = 20
                                  and permission = 'ver_historial_ventas_todas')"""))
def c4_all(t):
    return _seen(t, 20, user_id=3)


@query("c4_own_sales", with_views(f"sales {ACCESS}", f"""
    with g as ({GRANTS_SQL})
    select id, user_id, cast(total as double) as total from sales
    where user_id = 80 and exists (select 1 from g where g.user_id = 80
                                   and permission = 'ver_historial_ventas_propias')"""))
def c4_own(t):
    return _seen(t, 80, user_id=3)


@query("c4_visible_documents", with_views(f"sales users sale_lines products {ACCESS}", f"""
    with g as ({GRANTS_SQL})
    select s.id, u.username, count(p.id) as n_lines, coalesce(sum(
               case when p.id is not null then l.quantity end), 0)::bigint as quantity
    from sales s join users u on u.id = s.user_id left join sale_lines l on l.sale_id = s.id
         left join products p on p.id = l.product_id
    where s.user_id = 80 and exists (select 1 from g where g.user_id = 80
                                     and permission = 'ver_historial_ventas_propias')
    group by 1, 2"""))
def c4_documents(t):
    found = history.visible_documents(
        t.sales, t.users, t.sale_lines, t.products, grants(t), requester_id=80)
    quantity = F.aggregate(
        "lines", F.lit(0).cast("long"), lambda a, x: a + x["quantity"].cast("long"))
    return found.select(
        "id", "username", F.size("lines").cast("long").alias("n_lines"),
        quantity.alias("quantity"))


@query("c3_document_parts", with_views("sales users sale_lines products", """
    with placed as (
        select l.*, p.id as known, (row_number() over (partition by l.sale_id order by l.id,
                   l.product_id, l.quantity, l.unit_price, l.line_subtotal) - 1) as place,
               count(*) over (partition by l.sale_id) as n
        from sale_lines l join products p on l.product_id = p.id)
    select s.id, cast(case when n > 3 then place // 3 else 0 end as bigint) as part,
           count(known) as n_lines, coalesce(sum(quantity), 0)::bigint as quantity
    from sales s join users u on s.user_id = u.id left join placed l on l.sale_id = s.id
    group by 1, 2"""))
def c3_parts(t):
    """Documents in parts of three lines, so that most sales have several."""
    documents = history.sale_documents(
        t.sales, t.users, t.sale_lines, t.products, part_lines=3)
    quantity = F.aggregate(
        "lines", F.lit(0).cast("long"), lambda a, x: a + x["quantity"].cast("long"))
    return documents.select(
        "id", "part", F.size("lines").cast("long").alias("n_lines"), quantity.alias("quantity"))
