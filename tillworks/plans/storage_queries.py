"""Sources, sinks, snapshots and streams, written to the shared scratch folder and read back."""

import datetime as dt

from pyspark.sql import functions as F

from tillworks.operators import catalog, reports
from tillworks.plans.driver_views import with_views
from tillworks.plans.registry import query
from tillworks.plans.report_queries import YEAR, _IN_YEAR
from tillworks.plans.stock_queries import MOVEMENT_ORDER, _moves_sql
from tillworks.schemas import (
    FEED_COLUMNS,
    REPORT_BY_USER,
    REPORT_CATALOGUE,
    REPORT_PERIOD,
    TABLES,
)
from tillworks.session import scratch_path, settle
from tillworks.sources import feed as feed_files
from tillworks.sources import report_files, snapshots, tables
from tillworks.streaming.stock import stream_movements
from tillworks.streaming import summary
from tillworks.streaming.summary import daily_payment_totals, stream_table, write_daily_totals

_NOW = dt.datetime(2025, 6, 30, 12, 0, 0)
_ALL = " ".join(TABLES)


def _stored(t, names=tuple(TABLES)) -> str:
    """The retail tables committed under a new root."""
    root = scratch_path(t.spark, "tables")
    commits = {}
    for name in names:
        df = getattr(t, name)
        if name == "users":
            df = df.withColumn("password_hash", F.sha2("username", 256))
        commits[name] = df
    tables.commit_tables(t.spark, root, commits)
    return root


@query("a1_read_table", with_views("sales", f"""
    select id, user_id, cast(total as double) as total from sales where {_IN_YEAR}"""))
def a1(t):
    root = _stored(t, ["sales"])
    found = reports.completed_sales(tables.read_table(t.spark, root, "sales"), *YEAR)
    return found.select("id", "user_id", F.col("total").cast("double").alias("total"))


@query("a2_read_feed", with_views("feed", "select * replace (nullif(barcode, '') as barcode, "
                                  "nullif(product_name, '') as product_name) from feed"))
def a2(t):
    path = scratch_path(t.spark, "feed")
    feed_files.write_feed(t.feed, path)
    return feed_files.read_product_feed(t.spark, path)


@query("a4_period_report", with_views("sales", f"""
    select payment_type as "Tipo de Pago", cast(count(*) as varchar) as "Transacciones",
           '$' || cast(sum(total) as varchar) as "Total ($)"
    from sales where {_IN_YEAR} group by payment_type"""))
def a4(t):
    report = settle(reports.period_report(t.sales, *YEAR), "report")
    folder = report_files.write_report(
        report_files.period_sheets(report), scratch_path(t.spark, "reports"),
        REPORT_PERIOD, _NOW,
    )
    return t.spark.read.option("header", True).csv(f"{folder}/tipo_pago")


@query("a4_product_report", with_views("sales sale_lines products", f"""
    with totals as (
        select p.id, p.barcode, p.product_name, sum(l.quantity) as quantity,
               sum(l.line_subtotal) as amount
        from sale_lines l join products p on l.product_id = p.id join sales s on l.sale_id = s.id
        where {_IN_YEAR} group by 1, 2, 3)
    select 'por_cantidad' as sheet, coalesce(barcode, 'N/A') as barcode, product_name,
           cast(quantity as varchar) as shown
    from (select * from totals order by quantity desc, id limit 10)
    union all
    select 'por_valor', coalesce(barcode, 'N/A'), product_name, '$' || cast(amount as varchar)
    from (select * from totals order by amount desc, id limit 10)"""))
def a4_products(t):
    report = reports.product_report(t.sales, t.sale_lines, t.products, *YEAR)
    folder = report_files.write_report(
        report_files.product_sheets(report), scratch_path(t.spark, "reports"),
        report_files.top_name(10), _NOW)
    out = None
    for sheet in ("por_cantidad", "por_valor"):
        back = t.spark.read.option("header", True).csv(f"{folder}/{sheet}")
        part = back.toDF("barcode", "product_name", "shown").withColumn("sheet", F.lit(sheet))
        out = part if out is None else out.unionByName(part)
    return out


@query("a4_user_report", with_views("sales users", f"""
    select u.username as "Nombre de Usuario", cast(count(*) as varchar) as "Número de Ventas",
           '$' || cast(sum(s.total) as varchar) as "Total Vendido ($)"
    from sales s join users u on u.id = s.user_id where {_IN_YEAR} group by u.id, u.username"""))
def a4_users(t):
    by_user = reports.sales_by_user(t.sales, t.users, *YEAR)
    folder = report_files.write_report(
        report_files.user_sheets(by_user), scratch_path(t.spark, "reports"),
        REPORT_BY_USER, _NOW)
    return t.spark.read.option("header", True).csv(f"{folder}/por_usuario")


@query("a2_numbered_feed", with_views("feed", """
    select row_number() over (order by row_no) + 1 as row_no,
           coalesce(product_name, '') as product_name from feed"""))
def a2_numbered(t):
    """A feed without row numbers, in several files: rows are numbered by their place."""
    path = scratch_path(t.spark, "feed")
    heads = {c: h for h, c in FEED_COLUMNS.items()}
    t.feed.repartitionByRange(5, "row_no").sortWithinPartitions("row_no").select(
        *[F.col(c).alias(h) for c, h in heads.items()]
    ).write.options(header=True, escape='"', emptyValue="").csv(path)
    return feed_files.read_product_feed(t.spark, path).select(
        "row_no", F.coalesce("product_name", F.lit("")).alias("product_name"))


_COUNTS = "\n union all ".join(
    f"select '{n}' as table_name, count(*) as n_rows, cast(coalesce(sum(id), 0) as bigint) "
    f"as id_sum from {n}" for n in TABLES
)


def _counts(frames):
    out = None
    for name, df in frames.items():
        part = df.agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"),
            F.coalesce(F.sum("id"), F.lit(0)).alias("id_sum"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("a5_export_snapshot", with_views(_ALL, _COUNTS))
def a5(t):
    root = _stored(t)
    out = scratch_path(t.spark, "backup")
    return _counts(snapshots.read_snapshot(t.spark, snapshots.export_snapshot(
        t.spark, root, out, _NOW)))


# the benchmark lines repeat their ids, which a restore refuses: one line of each id is stored
@query("a6_restore_snapshot", with_views(_ALL, _COUNTS.replace(
    "select 'sale_lines' as table_name, count(*) as n_rows, cast(coalesce(sum(id), 0)",
    "select 'sale_lines' as table_name, count(distinct id) as n_rows, "
    "cast(coalesce(sum(distinct id), 0)")))
def a6(t):
    # a state that passes the checks is exported, the tables change, and the export replaces them
    root = scratch_path(t.spark, "tables")
    before = {n: getattr(t, n) for n in TABLES}
    before["users"] = before["users"].withColumn("password_hash", F.sha2("username", 256))
    line = F.struct(*[c for c in before["sale_lines"].columns if c != "id"])
    before["sale_lines"] = before["sale_lines"].groupBy("id").agg(
        F.min(line).alias("line")).select("id", "line.*")
    tables.commit_tables(t.spark, root, before)
    out = scratch_path(t.spark, "backup")
    folder = snapshots.export_snapshot(t.spark, root, out, _NOW)
    tables.commit_tables(t.spark, root, {
        "sales": t.sales.filter("status = 'completada'"),
        "products": t.products.filter("not active"),
    })
    later = _NOW + dt.timedelta(minutes=1)
    snapshots.restore_snapshot(t.spark, folder, root, out, later)
    return _counts({n: tables.read_table(t.spark, root, n) for n in TABLES})


@query("a3_export_files", with_views("products", """
    select p.barcode as "Código Barras", p.product_name as "Nombre Producto",
           case when p.active then 'Sí' else 'No' end as "Activo",
           cast(p.retail_price as varchar) as "Precio Venta ($)"
    from products p"""))
def a3_files(t):
    products = t.products.withColumns({
        c: F.lit(None).cast("timestamp_ntz") for c in ("created_at", "modified_at")
    })
    out = catalog.export_catalogue(products, t.categories, t.suppliers)
    folder = report_files.write_report(
        {"productos": out}, scratch_path(t.spark, "reports"), REPORT_CATALOGUE, _NOW
    )
    back = t.spark.read.option("header", True).csv(f"{folder}/productos")
    return back.select("Código Barras", "Nombre Producto", "Activo", "`Precio Venta ($)`")


# --- streams -------------------------------------------------------------------------------


@query("s1_stream_daily_totals", with_views("sales", """
    select date_trunc('day', sold_at) as day, payment_type,
           cast(sum(total) as double) as total_sales, count(id) as n_sales
    from sales where status = 'completada'
      and date_trunc('day', sold_at) + interval 1 day
          <= (select max(sold_at) - interval 1 day from sales where status = 'completada')
    group by 1, 2"""))
def s1(t):
    folder = scratch_path(t.spark, "stream-in")
    t.sales.select("id", "sold_at", "total", "payment_type", "status").write.parquet(folder)
    schema = t.spark.read.parquet(folder).schema
    totals = daily_payment_totals(stream_table(t.spark, folder, schema))
    out = scratch_path(t.spark, "stream-out")
    running = write_daily_totals(totals, out, scratch_path(t.spark, "stream-checkpoint"))
    running.awaitTermination()
    return t.spark.read.parquet(out).withColumn(
        "total_sales", F.col("total_sales").cast("double")
    )


# three batches by time; some sales of the first come with the last
_CUTS = ("1997-01-01", "1999-06-01")
_BATCHES = f"""
    batches as (
        select *, case when sold_at < timestamp '{_CUTS[0]}'
                       then case when id % 50 = 0 then 2 else 0 end
                       when sold_at < timestamp '{_CUTS[1]}' then 1 else 2 end as batch
        from sales where status = 'completada'),
    kept as (
        select * from batches b where batch = 0 or cast(sold_at as date) >= (
            select cast(max(sold_at) - interval 1 day as date) from batches e
            where e.batch < b.batch))"""


def _in_turn(spark, parts, start) -> None:
    """Stream the parts, each as one micro-batch of as many files as it has, one after the other:
    the stream that ``start`` makes of the folder runs to its end after each part is there."""
    folder = scratch_path(spark, "stream-in")
    for rows in parts:
        rows.write.mode("append").parquet(folder)
        schema = spark.read.parquet(folder).schema
        start(stream_table(spark, folder, schema)).awaitTermination()


def _closed_days(t):
    early, later = (F.col("sold_at") < F.lit(c).cast("timestamp_ntz") for c in _CUTS)
    held_back = early & (F.col("id") % 50 == 0)
    rows = t.sales.select("id", "sold_at", "total", "payment_type", "status")
    out, checkpoint = (scratch_path(t.spark, x) for x in ("stream-out", "stream-checkpoint"))
    parts = (early & ~held_back, later & ~early, held_back | ~later)
    _in_turn(t.spark, [rows.filter(p) for p in parts],
             lambda stream: summary.write_day_sums(stream, out, checkpoint))
    summary.close_days(t.spark, out)
    return out


@query("s1_stream_closed_days", with_views("sales", f"""
    with {_BATCHES.strip()}
    select cast(sold_at as date) as day, payment_type, cast(sum(total) as double) as total_sales,
           count(id) as n_sales, true as is_closed
    from kept group by 1, 2"""))
def s1_closed(t):
    """All days of the stream, closed, from three batches of which the last brings late sales."""
    return summary.day_sums(t.spark, _closed_days(t)).withColumn(
        "total_sales", F.col("total_sales").cast("double"))


@query("s1_stream_late_sales", with_views("sales", f"""
    with {_BATCHES.strip()}
    select id, cast(total as double) as total from batches
    where id not in (select id from kept)"""))
def s1_late(t):
    late = summary.late_sales(t.spark, _closed_days(t))
    return late.select("id", F.col("total").cast("double").alias("total"))


@query("s2_stream_stock", with_views("movements products", f"""
    with {_moves_sql('movements').strip()},
    last as (select product_id, stock from fold
             qualify row_number() over (partition by product_id order by n desc) = 1)
    select p.id, coalesce(l.stock, p.stock) as stock
    from products p left join last l on l.product_id = p.id""", recursive=True))
def s2(t):
    root = _stored(t, ["products"])
    # two micro-batches, older movements first
    cut = F.lit("1998-06-01").cast("timestamp_ntz")
    log, checkpoint = (scratch_path(t.spark, x) for x in ("stream-log", "stream-checkpoint"))
    parts = (F.col("moved_at") < cut, F.col("moved_at") >= cut)
    _in_turn(t.spark, [t.movements.filter(p) for p in parts],
             lambda moves: stream_movements(
                 moves, root, log, checkpoint, MOVEMENT_ORDER, "movements"))
    return tables.read_table(t.spark, root, "products").select("id", "stock")
