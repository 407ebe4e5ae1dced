import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tillworks.schemas import TABLES  # noqa: E402
from tillworks.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    # small inputs: fewer partitions, and no time spent on compiling plans
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Rows of a known table; columns not given are NULL."""

    def build(name, rows):
        schema = TABLES[name]
        filled = []
        for row in rows:
            values = []
            for field in schema:
                value = row.get(field.name)
                if value is not None and field.dataType.typeName() == "decimal":
                    value = Decimal(str(value))
                if isinstance(value, str) and field.dataType.typeName() == "timestamp_ntz":
                    value = dt.datetime.fromisoformat(value)
                values.append(value)
            filled.append(tuple(values))
        return spark.createDataFrame(filled, schema)

    return build


@pytest.fixture(scope="session")
def shop(make):
    """The small shop of the fixtures document."""
    products = [
        dict(id=10, barcode="7501", product_name="Leche 1L", category_id=1, supplier_id=1,
             cost_price=18, retail_price=25, wholesale_price=22, wholesale_min_qty=6, stock=20,
             min_stock=5, active=True),
        dict(id=11, barcode="7502", product_name="Pan blanco", category_id=2, supplier_id=1,
             cost_price=10, retail_price=15.50, stock=4, min_stock=5, active=True),
        dict(id=12, product_name="CAFÉ molido", category_id=9, supplier_id=9, cost_price=60,
             retail_price=90, wholesale_price=80, wholesale_min_qty=0, stock=0, min_stock=0,
             active=True),
        dict(id=13, barcode="7504", product_name="Jugo_naranja", category_id=1, supplier_id=2,
             cost_price=12, retail_price=20, wholesale_price=18, wholesale_min_qty=10, stock=50,
             active=False),
    ]
    sales = [
        (1, "2025-06-22 00:00:00", 2, "Luis", 50, "efectivo", "completada"),
        (2, "2025-06-25 12:00:00", 2, None, 31, "tarjeta_debito", "completada"),
        (3, "2025-06-29 23:59:59", 1, "luisa", 90, "efectivo", "completada"),
        (4, "2025-06-30 00:00:00", 1, None, 25, "efectivo", "completada"),
        (5, "2025-06-26 08:00:00", 2, None, 999, "otro", "cancelada"),
        (6, "2025-06-26 09:00:00", 7, None, 20, None, "completada"),
    ]
    lines = [(1, 1, 10, 2, 50), (2, 2, 11, 2, 31), (3, 3, 12, 1, 90), (4, 4, 10, 1, 25),
             (5, 5, 10, 30, 999), (6, 6, 99, 1, 20)]
    return {
        "users": make("users", [
            dict(id=1, username="ana", role="administrador", password_hash="x"),
            dict(id=2, username="beto", role="empleado", password_hash="x"),
            dict(id=3, username="caro", role="empleado", password_hash="x")]),
        "products": make("products", products),
        "categories": make("categories", [
            dict(id=1, category_name="Lácteos"), dict(id=2, category_name="Panadería")]),
        "suppliers": make("suppliers", [
            dict(id=1, supplier_name="Lala", phone="1"),
            dict(id=2, supplier_name="Bimbo")]),
        "sales": make("sales", [
            dict(zip(("id", "sold_at", "user_id", "client_name", "total", "payment_type",
                      "status"), s)) for s in sales]),
        "sale_lines": make("sale_lines", [
            dict(zip(("id", "sale_id", "product_id", "quantity", "line_subtotal"), x),
                 unit_price=x[4] / x[3])
            for x in lines]),
    }


@pytest.fixture
def small_slices(monkeypatch):
    """Cut small test data into several slices."""
    monkeypatch.setattr("tillworks.session.ROWS_PER_SLICE", 100)


@pytest.fixture(scope="session")
def now(spark):
    return F.lit("2025-06-30 12:00:00").cast("timestamp_ntz")


@pytest.fixture(scope="session")
def rows():
    def collect(df, *columns):
        chosen = df.select(*columns) if columns else df
        out = [
            tuple(float(v) if isinstance(v, Decimal) else v for v in r) for r in chosen.collect()
        ]
        return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))

    return collect
