import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tillworks.operators import maintain, reports
from tillworks.plans import storage_queries
from tillworks.schemas import REPORT_BY_USER, REPORT_PERIOD, TABLES
from tillworks.session import clear_scratch, scratch_path, scratch_root, settle
from tillworks.sources import feed, report_files, snapshots, tables
from tillworks.streaming import stock as stream_stock
from tillworks.streaming import summary

NOW = dt.datetime(2025, 6, 30, 4, 50, 35)


def test_versions(spark, shop, tmp_path):
    root = str(tmp_path)
    assert tables.read_table(spark, root, "sales").count() == 0
    assert tables.commit_tables(spark, root, {"sales": shop["sales"], "users": shop["users"]}) == 1
    held = tables.read_table(spark, root, "sales")
    fewer = held.filter("id > 3")
    assert tables.commit_tables(spark, root, {"sales": fewer}, tag="cut") == 2
    assert tables.read_table(spark, root, "sales").count() == 3
    assert held.count() == 6  # a reader keeps the version it opened
    assert tables.read_table(spark, root, "users").exceptAll(shop["users"]).isEmpty()
    assert tables.is_tagged(spark, root, "cut") and not tables.is_tagged(spark, root, "x")


def test_scratch_is_cleared(spark):
    kept = settle(spark.range(5), "x")
    path = scratch_path(spark, "y")
    assert kept.count() == 5 and path.startswith(scratch_root(spark))
    folder = path.rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    clear_scratch(spark)
    assert not os.path.isdir(folder)


def test_feed_files(spark, tmp_path):
    path = str(tmp_path / "feed.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("row_no,Código Barras,Nombre Producto,Precio Venta,Sobra\n2,IMP001,Nuevo,15.0,z\n"
                "3,,Otro,,\n")
    got = feed.read_product_feed(spark, path)
    assert got.columns[0] == "row_no" and len(got.columns) == 15
    found = [(r.row_no, r.barcode, r.product_name, r.retail_price, r.stock)
             for r in got.orderBy("row_no").collect()]
    assert found == [(2, "IMP001", "Nuevo", "15.0", None), (3, None, "Otro", None, None)]
    with open(path, "w", encoding="utf-8") as f:
        f.write("row_no,Código Barras,Nombre Producto\n2,1,a\n")
    with pytest.raises(ValueError, match="Precio Venta"):
        feed.read_product_feed(spark, path)
    lines = str(tmp_path / "feed.json")
    with open(lines, "w", encoding="utf-8") as f:
        f.write('{"row_no": "2", "Nombre Producto": "a", "Precio Venta": "1.50"}\n')
    assert feed.read_product_feed(spark, lines, "json").first().retail_price == "1.50"
    out = str(tmp_path / "written")
    feed.write_feed(got, out)
    assert feed.read_product_feed(spark, out).exceptAll(got).isEmpty()
    with pytest.raises(ValueError):
        feed.read_product_feed(spark, lines, "xlsx")


def stored(spark, shop, root):
    tables.commit_tables(spark, root, shop)
    return root


def test_snapshot_round_trip(spark, shop, tmp_path):
    root, out = stored(spark, shop, str(tmp_path / "root")), str(tmp_path / "out")
    folder = snapshots.export_snapshot(spark, root, out, NOW)
    assert folder.endswith("pos_backup_20250630_045035")
    before = {n: tables.read_table(spark, root, n) for n in TABLES}
    tables.commit_tables(spark, root, {"sales": shop["sales"].limit(1)})
    later = NOW + dt.timedelta(seconds=1)
    snapshots.restore_snapshot(spark, folder, root, out, later)
    for name, df in before.items():
        now = tables.read_table(spark, root, name)
        assert now.exceptAll(df).isEmpty() and df.exceptAll(now).isEmpty()
    safety = snapshots.read_snapshot(spark, f"{out}/pos_backup_20250630_045036")
    assert safety["sales"].count() == 1


def test_bad_snapshots_are_refused(spark, shop, make, tmp_path):
    out = str(tmp_path / "out")
    faulty = dict(shop, users=make("users", [dict(id=1, username="a"), dict(id=2, username="a")]))
    root = stored(spark, faulty, str(tmp_path / "faulty"))
    folder = snapshots.export_snapshot(spark, root, out, NOW)
    good = stored(spark, shop, str(tmp_path / "good"))
    with pytest.raises(ValueError, match="users: key repeated"):
        snapshots.restore_snapshot(spark, folder, good, out, NOW)
    strange = dict(shop, sales=shop["sales"].withColumn("status", F.lit("rara")))
    root = stored(spark, strange, str(tmp_path / "strange"))
    other = snapshots.export_snapshot(spark, root, out, NOW + dt.timedelta(seconds=5))
    with pytest.raises(ValueError, match="sales: value outside its set"):
        snapshots.restore_snapshot(spark, other, good, out, NOW)
    twice = dict(shop, sales=shop["sales"].unionByName(shop["sales"].filter("id = 1")))
    root = stored(spark, twice, str(tmp_path / "twice"))
    repeated = snapshots.export_snapshot(spark, root, out, NOW + dt.timedelta(seconds=9))
    with pytest.raises(ValueError, match="sales: key repeated"):
        snapshots.restore_snapshot(spark, repeated, good, out, NOW)
    shop["sales"].limit(2).write.mode("overwrite").parquet(f"{folder}/sales")
    with pytest.raises(ValueError, match="not complete"):
        snapshots.read_snapshot(spark, folder)


def test_report_files(spark, shop, tmp_path):
    week = ("2025-06-22", "2025-06-29")
    sheets = report_files.period_sheets(reports.period_report(shop["sales"], *week))
    folder = report_files.write_report(sheets, str(tmp_path), REPORT_PERIOD, NOW)
    assert folder.endswith("ReporteVentasPeriodo_20250630_045035")
    back = spark.read.option("header", True).csv(f"{folder}/resumen").first()
    assert tuple(back) == ("4", "$191.00", "$47.75")
    paid = spark.read.option("header", True).csv(f"{folder}/tipo_pago").collect()
    assert {tuple(r) for r in paid} == {
        ("efectivo", "2", "$140.00"), ("tarjeta_debito", "1", "$31.00"), ("N/A", "1", "$20.00")}
    empty = report_files.period_sheets(
        reports.period_report(shop["sales"], "2001-01-01", "2001-01-02"))
    assert tuple(empty["resumen"].first()) == (0, "$0.00", "$0.00")
    totals = reports.product_totals(
        shop["sales"], shop["sale_lines"], shop["products"], *week)
    tops = report_files.top_sheets(
        reports.top_products_by_quantity(totals, 2), reports.top_products_by_value(totals, 2))
    assert report_files.top_name(2) == "Top2Productos"
    assert [r[2] for r in tops["por_valor"].collect()] == ["$90.00", "$50.00"]
    by_user = report_files.user_sheets(reports.sales_by_user(shop["sales"], shop["users"], *week))
    json_folder = report_files.write_report(
        by_user, str(tmp_path), REPORT_BY_USER, NOW, "json")
    assert spark.read.json(f"{json_folder}/por_usuario").count() == 2


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_stream_daily_totals(spark, shop, tmp_path, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        check_daily_totals(spark, shop, tmp_path)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def check_daily_totals(spark, shop, tmp_path):
    shop["sales"].write.parquet(str(tmp_path / "in"))
    stream = summary.stream_table(spark, str(tmp_path / "in"), TABLES["sales"])
    running = summary.write_daily_totals(
        summary.daily_payment_totals(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    running.awaitTermination()
    got = {(str(r.day)[:10], r.payment_type): (float(r.total_sales), r.n_sales)
           for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # newest sale 30 June 00:00, so days up to the 28th are final
    assert got == {
        ("2025-06-22", "efectivo"): (50.0, 1), ("2025-06-25", "tarjeta_debito"): (31.0, 1),
        ("2025-06-26", None): (20.0, 1)}


def test_days_are_closed_and_late_sales_kept(spark, make, tmp_path):
    folder, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def sale(i, day, total, **more):
        return dict(id=i, sold_at=f"2025-06-{day:02d} 10:00:00", user_id=1, total=total,
                    payment_type="efectivo", status="completada") | more

    batches = [
        [sale(1, 1, 10), sale(2, 3, 5)],  # closes the 1st: newest is the 3rd less a day
        [sale(3, 1, 7), sale(4, 2, 1), sale(5, 5, 2), sale(6, 5, 9, status="cancelada")],
        [sale(7, 2, 4), sale(8, 6, 3), sale(9, 5, 1, payment_type=None)],
        [sale(10, 6, 8), sale(11, 9, 8)]]

    def run(checkpoint=cp):
        stream = summary.stream_table(
            spark, folder, TABLES["sales"], maxFilesPerTrigger=1)
        summary.write_day_sums(stream, out, checkpoint).awaitTermination()

    for rows in batches[:3]:
        make("sales", rows).coalesce(1).write.mode("append").parquet(folder)
        run()
    got = {(r.day.day, r.payment_type): (float(r.total_sales), r.n_sales, r.is_closed)
           for r in summary.day_sums(spark, out).collect()}
    assert got == {
        (1, "efectivo"): (10, 1, True), (2, "efectivo"): (1, 1, True),
        (3, "efectivo"): (5, 1, True), (5, "efectivo"): (2, 1, False), (5, None): (1, 1, False),
        (6, "efectivo"): (3, 1, False)}
    assert {(r.id, r.batch) for r in summary.late_sales(spark, out).collect()} == {(3, 1), (7, 2)}
    summary.close_days(spark, out)
    assert summary.day_sums(spark, out).filter("not is_closed").isEmpty()
    make("sales", batches[3]).coalesce(1).write.mode("append").parquet(folder)
    run()
    assert {r.id for r in summary.late_sales(spark, out).collect()} == {3, 7, 10, 11}
    run()  # nothing new
    assert summary.day_sums(spark, out).count() == 6


def test_stream_stock_is_applied_once(spark, shop, tmp_path):
    root = stored(spark, shop, str(tmp_path / "root"))
    for batch in ([(1, 10, 5, "salida"), (2, 10, 100, "salida")], [(3, 10, 85, "entrada")],
                  [(4, 10, 100, "salida")]):
        spark.createDataFrame(
            batch, "seq long, product_id long, quantity long, kind string"
        ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = summary.stream_table(
            spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
        stream_stock.stream_movements(
            stream, root, str(tmp_path / "log"), str(tmp_path / "cp"), ["seq"],
            "till").awaitTermination()
    assert tables.read_table(spark, root, "products").filter("id = 10").first().stock == 0
    logged = spark.read.parquet(str(tmp_path / "log"))
    assert {r.seq: r.reason for r in logged.collect()} == {
        1: None, 2: "insufficient_stock", 3: None, 4: None}
    # the same batches once more, as after a lost checkpoint: nothing changes
    stream_stock.stream_movements(
        stream, root, str(tmp_path / "log"), str(tmp_path / "cp2"), ["seq"],
        "till").awaitTermination()
    products = tables.read_table(spark, root, "products")
    assert products.filter(F.col("id") == 10).first().stock == 0


def test_movements_without_an_order_are_refused(spark, make, tmp_path):
    root, log = str(tmp_path / "root"), str(tmp_path / "log")
    tables.commit_tables(
        spark, root, {"products": make("products", [dict(id=1, stock=5, active=True)])})
    schema = "seq long, product_id long, quantity long, kind string"
    for batch in ([(None, 1, 3, "entrada")], [(1, 1, 1, "entrada"), (None, 1, 7, "entrada")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in"))
    fields = spark.read.parquet(str(tmp_path / "in")).schema
    for checkpoint in ("cp", "cp2"):  # the second as after a lost checkpoint
        stream = summary.stream_table(
            spark, str(tmp_path / "in"), fields, maxFilesPerTrigger=1)
        stream_stock.stream_movements(
            stream, root, log, str(tmp_path / checkpoint), ["seq"], "till").awaitTermination()
        assert tables.read_table(spark, root, "products").first().stock == 6
    logged = stream_stock.movement_log(spark, root, log, "till").collect()
    assert {(r.seq, r.quantity, r.reason) for r in logged} == {
        (1, 1, None), (None, 3, "bad_order"), (None, 7, "bad_order")}


def test_two_streams_over_one_root(spark, make, tmp_path):
    root = str(tmp_path / "root")
    tables.commit_tables(
        spark, root, {"products": make("products", [dict(id=1, stock=5, active=True)])})
    spark.createDataFrame(
        [(1, 1, 7, "entrada")], "seq long, product_id long, quantity long, kind string"
    ).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    for name in ("one", "two", "one"):
        stream = summary.stream_table(spark, str(tmp_path / "in"), schema)
        stream_stock.stream_movements(
            stream, root, str(tmp_path / "log"), str(tmp_path / f"cp-{name}-{os.urandom(4).hex()}"),
            ["seq"], name).awaitTermination()
    assert tables.read_table(spark, root, "products").first().stock == 19
    # a log folder without its commit does not count
    spark.createDataFrame([(2, "x")], "seq long, reason string").write.parquet(
        str(tmp_path / "log" / "stream=one" / "commit=none"))
    logged = stream_stock.movement_log(spark, root, str(tmp_path / "log"), "one")
    assert [r.seq for r in logged.collect()] == [1]
    with pytest.raises(ValueError, match="name"):
        stream_stock.stream_movements(stream, root, "x", "y", ["seq"], "a/b")


def test_ids_are_not_given_again(spark, shop, tmp_path):
    root = str(tmp_path)
    tables.commit_tables(spark, root, {"users": shop["users"]})
    tables.commit_tables(spark, root, {"users": shop["users"].filter("id < 3")})
    used = tables.last_ids(spark, root)
    assert used == {"users": 3}
    new = spark.createDataFrame(
        [(1, "dora", "h", "empleado")],
        "seq long, username string, password_hash string, role string")
    users = tables.read_table(spark, root, "users")
    done = maintain.insert_rows("users", users, new, used["users"])
    assert sorted(r.id for r in done.table.collect()) == [1, 2, 4]


def test_feed_with_line_breaks_and_bad_row_numbers(spark, tmp_path):
    path = str(tmp_path / "feed.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('row_no,Código Barras,Nombre Producto,Precio Venta,Descripción\n'
                '2,1,a,1.0,"two\nlines"\nx,2,b,1.0,\n')
    got = {r.product_name: (r.row_no, r.description)
           for r in feed.read_product_feed(spark, path).collect()}
    assert got == {"a": (2, "two\nlines"), "b": (None, None)}
    out = str(tmp_path / "written")
    feed.write_feed(feed.read_product_feed(spark, path), out)
    assert {r.description for r in feed.read_product_feed(spark, out).collect()} == {
        "two\nlines", None}


@pytest.mark.parametrize("split", ["128m", "60b"])
def test_rows_are_numbered_by_their_place(spark, tmp_path, split):
    folder = tmp_path / "feed"
    folder.mkdir()
    head = "Código Barras,Nombre Producto,Precio Venta,Descripción\n"
    (folder / "a.csv").write_text(
        head + '1,a,1.0,"two\nlines, and ""quotes"""\n\n2,b,2.0,\n3,"c",3.0,"\n\nx"\n', "utf-8")
    (folder / "b.csv").write_text(
        head + "".join(f"{i},n{i},1.0,plain {i}\n" for i in range(10, 60)), "utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {r.row_no: (r.barcode, r.product_name, r.description)
               for r in feed.read_product_feed(spark, str(folder)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = {2: ("1", "a", 'two\nlines, and "quotes"'), 4: ("2", "b", None),
            5: ("3", "c", "\n\nx")}
    want |= {6 + i: (str(10 + i), f"n{10 + i}", f"plain {10 + i}") for i in range(50)}
    assert got == want


def test_stream_batches_may_be_of_many_files(spark, tmp_path, monkeypatch):
    parts = [spark.range(10 * i, 10 * i + 10, numPartitions=4) for i in range(2)]
    target = scratch_path(spark, "many-files")
    batches = []

    def start(stream):
        return stream.writeStream.foreachBatch(
            lambda batch, _: batches.append(sorted(r.id for r in batch.collect()))
        ).option("checkpointLocation", target).trigger(availableNow=True).start()

    monkeypatch.setattr(storage_queries, "scratch_path", lambda *_: str(tmp_path / "in"))
    storage_queries._in_turn(spark, parts, start)
    assert batches == [list(range(10)), list(range(10, 20))]
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 8
