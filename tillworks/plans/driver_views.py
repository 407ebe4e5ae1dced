"""The retail tables, expressed over the TPC-H-like benchmark tables.

Every mapping is one SQL text that Spark and DuckDB both accept; ``{name}`` marks an input.
Spark runs the text for the query, and the check SQL uses the same text as a common table
expression, so both sides start from equal rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tillworks.schemas import PERMISSIONS, SELLER_PERMISSIONS

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_MONEY = "decimal(18,2)"
_PERMISSION_NAME = (
    "case c_custkey % 21 "
    + " ".join(f"when {i} then '{name}'" for i, name in enumerate(PERMISSIONS))
    + " end"
)
_SELLER = ", ".join(f"'{name}'" for name in SELLER_PERMISSIONS)
_CATEGORY_ID = (
    "case p_type when 'ECONOMY' then 1 when 'LARGE' then 2 when 'MEDIUM' then 3 "
    "when 'PROMO' then 4 when 'SMALL' then 5 when 'STANDARD' then 6 end"
)
_PAYMENT = (
    "case o_orderpriority when '1-URGENT' then 'efectivo' when '2-HIGH' then 'tarjeta_credito' "
    "when '3-MEDIUM' then 'tarjeta_debito' when '4-NOT SPECIFIED' then 'transferencia' "
    "else 'otro' end"
)
_BARCODE = "'75' || lpad(cast(p_partkey as string), 12, '0')"

VIEWS: dict[str, str] = {
    "sales": f"""
        select o_orderkey as id, o_orderdate as sold_at, o_custkey as user_id,
               'Client#' || cast(o_custkey % 97 as string) as client_name,
               cast(o_custkey as string) as client_ident,
               cast(o_totalprice as {_MONEY}) as total,
               {_PAYMENT} as payment_type,
               case o_orderstatus when 'F' then 'completada' when 'O' then 'en_proceso'
                    else 'pendiente_pago' end as status
        from {{orders}}""",
    # (sale, line number) repeats in the source, so these line ids are not quite unique
    "sale_lines": f"""
        select l_orderkey * 8 + l_linenumber as id, l_orderkey as sale_id,
               l_partkey as product_id, cast(l_quantity as bigint) as quantity,
               cast(floor(l_extendedprice / l_quantity) as {_MONEY}) as unit_price,
               cast(l_extendedprice as {_MONEY}) as line_subtotal
        from {{lineitem}}""",
    "users": """
        select c_custkey as id, c_name as username,
               case when c_custkey % 50 = 0 then 'administrador' else 'empleado' end as role
        from {customer}""",
    "categories": f"""
        select distinct cast({_CATEGORY_ID} as bigint) as id, p_type as category_name
        from {{part}}""",
    "suppliers": """
        select s_suppkey as id, s_name as supplier_name,
               'Nation ' || cast(s_nationkey as string) as contact,
               case when s_suppkey % 4 = 0 then null
                    else '55' || cast(s_nationkey as string) end as phone
        from {supplier}""",
    "products": f"""
        select p_partkey as id, {_BARCODE} as barcode, p_name as product_name,
               p_brand as description, cast({_CATEGORY_ID} as bigint) as category_id,
               p_partkey % 120 as supplier_id,
               cast(cast(p_retailprice as {_MONEY}) - 300 as {_MONEY}) as cost_price,
               cast(p_retailprice as {_MONEY}) as retail_price,
               cast(cast(p_retailprice as {_MONEY}) - 50 as {_MONEY}) as wholesale_price,
               case when p_size % 3 = 0 then null else cast(p_size as bigint) end
                   as wholesale_min_qty,
               cast(p_size * 10 as bigint) as stock, cast(100 as bigint) as min_stock,
               'unidad' as unit, p_partkey % 17 <> 0 as active
        from {{part}}""",
    "permissions": f"""
        select distinct c_custkey % 21 + 1 as id, {_PERMISSION_NAME} as permission
        from {{customer}}""",
    "role_permissions": f"""
        select id * 2 as id, 'administrador' as role, id as permission_id from {{permissions}}
        union all
        select id * 2 + 1, 'empleado', id from {{permissions}} where permission in ({_SELLER})""",
    "user_permissions": """
        select c_custkey * 2 as id, c_custkey as user_id,
               (c_custkey * 2) % 21 + 1 as permission_id, c_custkey % 3 <> 0 as granted
        from {customer}
        union all
        select c_custkey * 2 + 1, c_custkey, (c_custkey * 2 + 5) % 21 + 1, c_custkey % 5 = 0
        from {customer}""",
    # total order within a product: the five columns after kind
    "movements": """
        select l_partkey as product_id, cast(l_quantity as bigint) as quantity,
               case when l_returnflag = 'R' then 'entrada'
                    when l_returnflag = 'N' and l_linenumber = 7 then 'traslado'
                    else 'salida' end as kind,
               l_shipdate as moved_at, l_orderkey as doc_no, l_linenumber as line_no,
               l_suppkey as party_no, l_extendedprice as amount,
               case when l_linenumber % 4 = 0 then null
                    else 'linea ' || cast(l_linenumber as string) end as notes
        from {lineitem}""",
    "cart_events": """
        select user_id as cart_id, event_id as seq,
               cast(replace(replace(props, '{{"k": ', ''), '}}', '') as bigint) % 8 as product_id,
               case event_type when 'click' then 'add' when 'signup' then 'add'
                    when 'purchase' then 'remove' else 'step' end as kind,
               case event_type when 'view' then 1 when 'error' then -1
                    else 1 + cast(floor(value) as bigint) % 12 end as quantity
        from {events}""",
    # sales and lines as they come in from the tills; tendered is text: absent, enough, short, or
    # not a number
    "new_sales": """
        select id as seq, id as sale_ref, user_id, client_name, client_ident, total,
               case when id % 4 = 0 then null when id % 16 = 2 then cast(total - 10 as string)
                    when id % 16 = 3 then 'abc' else cast(total + 50 as string) end as tendered,
               case when id % 11 = 0 then null when id % 101 = 7 then 'cheque'
                    else payment_type end as payment_type,
               cast(null as string) as status, cast(null as string) as notes
        from {sales}""",
    "new_lines": f"""
        select l_orderkey as sale_ref, l_linenumber as position, l_partkey as product_id,
               case when l_partkey % 97 = 5 and l_linenumber = 3 then 0
                    else cast(l_quantity as bigint) end as quantity,
               cast(floor(l_extendedprice / l_quantity) as {_MONEY}) as unit_price
        from {{lineitem}}""",
    "search_terms": f"""
        select distinct term from (
            select {_BARCODE} as term from {{part}}
            union all select upper(substr(p_name, 1 + cast(p_partkey % 3 as int), 4)) from {{part}}
            union all select ' ' || substr(p_name, 2, 3) || '_' || substr(p_name, 6, 1) || ' '
                      from {{part}}
            union all select case when p_partkey % 2 = 0 then '_' else '   ' end from {{part}})""",
    # one feed row per product (updates) and one more per product (mostly new products)
    "feed": f"""
        select p_partkey * 2 + 2 as row_no,
               case when p_partkey % 5 = 0 then null
                    when p_partkey % 41 = 0 then 'x' || cast(p_partkey as string)
                    else cast(p_partkey as string) end as id,
               case when p_partkey % 7 = 3 then null else {_BARCODE} end as barcode,
               case when p_partkey % 29 = 0 then null else 'new ' || p_name end as product_name,
               case when p_partkey % 3 = 0 then null else 'feed ' || p_brand end as description,
               case when p_partkey % 4 = 0 then 'Unknown' else lower(p_type) end as category,
               cast(null as string) as supplier,
               case when p_partkey % 6 = 0 then null else '12.5' end as cost_price,
               cast(cast(p_retailprice as {_MONEY}) as string) as retail_price,
               case when p_partkey % 8 = 0 then '0' when p_partkey % 8 = 1 then null
                    else '700' end as wholesale_price,
               case when p_partkey % 8 = 2 then null else '6' end as wholesale_min_qty,
               case when p_partkey % 13 = 0 then '5.0' when p_partkey % 13 = 1 then null
                    else cast(p_size as string) end as stock,
               case when p_partkey % 9 = 0 then null else '3' end as min_stock,
               case when p_partkey % 10 = 0 then 'kg' else null end as unit,
               case p_partkey % 6 when 0 then 'No' when 1 then 'Si' when 2 then 'TRUE'
                    when 3 then '0' when 4 then '1' else null end as active
        from {{part}}
        union all
        select p_partkey * 2 + 3, null,
               case when p_partkey % 3 = 0 then null
                    else '99' || cast(p_partkey - p_partkey % 2 as string) end,
               case when p_partkey % 31 = 0 then '' else 'extra ' || p_name end,
               p_brand, p_type, null, '1e1',
               case when p_partkey % 5 = 0 then '0' when p_partkey % 5 = 1 then null
                    else '15.25' end,
               null, null, '7', null, null, 'Yes'
        from {{part}}""",
}

_INPUT = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def _inputs(name: str) -> list[str]:
    return list(dict.fromkeys(_INPUT.findall(VIEWS[name])))


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One retail table as a DataFrame over the driver's Parquet files."""
    inputs = {
        dep: view(spark, sf_dir, dep) if dep in VIEWS else base_table(spark, sf_dir, dep)
        for dep in _inputs(name)
    }
    return spark.sql(VIEWS[name], **inputs)


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """``body`` as DuckDB SQL with the named retail tables (and what they need) in front."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for dep in _inputs(name):
                visit(dep)
            ordered.append(name)

    for name in names.split():
        visit(name)
    ctes = ",\n".join(
        f"{name} as ({_INPUT.sub(lambda m: m.group(1), VIEWS[name])})".replace("{{", "{").replace(
            "}}", "}"
        )
        for name in ordered
    )
    head = "with recursive " if recursive else "with "
    text = body.strip()
    if text.lower().startswith("with "):
        return f"{head}{ctes},\n{text[5:]}"
    return f"{head}{ctes}\n{text}"
