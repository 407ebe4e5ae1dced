"""Report files: one time-stamped folder per report, one sub-folder per result set."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillworks.functions.dates import file_stamp
from tillworks.functions.text import currency_text
from tillworks.schemas import NOT_KNOWN, REPORT_TOP


def top_name(n: int) -> str:
    return REPORT_TOP.format(n=n)


def write_report(
    results: dict[str, DataFrame], out: str, base_name: str, now: dt.datetime,
    file_format: str = "csv",
) -> str:
    """Write the result sets under ``out/{base_name}_{time}``; returns that folder."""
    folder = f"{out}/{base_name}_{file_stamp(now)}"
    for name, df in results.items():
        writer = df.write.option("header", True) if file_format == "csv" else df.write
        writer.format(file_format).save(f"{folder}/{name}")
    return folder


def _or_dash(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(NOT_KNOWN))


def period_sheets(report: DataFrame) -> dict[str, DataFrame]:
    """Summary and payment sheets of ``period_report``; missing totals read as zero."""
    count = F.col("n_sales")
    return {
        "resumen": report.filter("is_summary").select(
            count.alias("Total Transacciones"),
            currency_text(F.col("total_sales")).alias("Total Ventas"),
            currency_text(F.round(F.col("total_sales") / F.nullif(count, F.lit(0)).cast(
                "decimal(20,0)"), 2).cast("decimal(28,2)")).alias("Venta Promedio"),
        ),
        "tipo_pago": report.filter(~F.col("is_summary")).select(
            _or_dash("payment_type").alias("Tipo de Pago"),
            count.alias("Transacciones"),
            currency_text(F.col("total_sales")).alias("Total ($)"),
        ),
    }


def top_sheets(by_quantity: DataFrame, by_value: DataFrame) -> dict[str, DataFrame]:
    names = [
        _or_dash("barcode").alias("Código Barras"),
        _or_dash("product_name").alias("Nombre Producto"),
    ]
    return {
        "por_cantidad": by_quantity.select(
            *names, F.col("total_quantity").alias("Total Cantidad Vendida")
        ),
        "por_valor": by_value.select(
            *names, currency_text(F.col("total_value")).alias("Total Valor Vendido ($)")
        ),
    }


def product_sheets(report: DataFrame) -> dict[str, DataFrame]:
    """Both sheets of ``product_report``."""
    return top_sheets(
        report.filter("ranking = 'quantity'").orderBy(F.desc("total_quantity"), "product_id"),
        report.filter("ranking = 'value'").orderBy(F.desc("total_value"), "product_id"))


def user_sheets(by_user: DataFrame) -> dict[str, DataFrame]:
    return {
        "por_usuario": by_user.select(
            _or_dash("username").alias("Nombre de Usuario"),
            F.col("n_sales").alias("Número de Ventas"),
            currency_text(F.col("total_sales")).alias("Total Vendido ($)"),
        )
    }
