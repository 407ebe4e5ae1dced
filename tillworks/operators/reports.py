"""Period reports over completed sales; both days of a range are inclusive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.functions.dates import day_range, require_days
from tillworks.schemas import COMPLETED, MONEY
from tillworks.session import settle


def completed_sales(sales: DataFrame, first: str, last: str) -> DataFrame:
    require_days(first, last)
    return sales.filter((F.col("status") == COMPLETED) & day_range("sold_at", first, last))


def _average(total: str, count: str):
    return F.when(F.col(count) > 0, F.col(total).cast("double") / F.col(count))


def period_summary(sales: DataFrame, first: str, last: str) -> DataFrame:
    """Exactly one row: number of sales, their total and average (NULL without sales)."""
    return (
        completed_sales(sales, first, last)
        .agg(F.count("id").alias("n_sales"), F.sum("total").alias("total_sales"))
        .withColumn("average_sale", _average("total_sales", "n_sales"))
    )


def payment_breakdown(sales: DataFrame, first: str, last: str) -> DataFrame:
    """Total and number of sales per payment type; a missing type is a group of its own."""
    return (
        completed_sales(sales, first, last)
        .groupBy("payment_type")
        .agg(F.sum("total").alias("total_sales"), F.count("id").alias("n_sales"))
    )


def period_report(sales: DataFrame, first: str, last: str) -> DataFrame:
    """Summary row and payment breakdown from one scan.

    The scan is reduced to one row per payment type (at most the few stored types), and the
    summary is added on top of those, so it exists even when no sale matches.
    """
    groups = payment_breakdown(sales, first, last).select(
        F.lit(False).alias("is_summary"), "payment_type", "n_sales", "total_sales"
    )
    # rollup over an empty input would give no summary row, a global aggregate gives one
    summary = groups.agg(
        F.lit(True).alias("is_summary"),
        F.lit(None).cast("string").alias("payment_type"),
        F.coalesce(F.sum("n_sales"), F.lit(0)).alias("n_sales"),
        F.sum("total_sales").cast("decimal(28,2)").alias("total_sales"),
    )
    return summary.unionByName(groups).withColumn(
        "average_sale", _average("total_sales", "n_sales")
    )


def _within_ids(lines: DataFrame, counted: DataFrame) -> DataFrame:
    """Only lines between the lowest and highest counted sale id.

    The join below implies it. But sale ids grow with time and lines are stored by sale id, so the
    two bounds, known before the scan starts, let Parquet skip the lines of other periods. Written
    as two top-1 reads: a pair of min and max would be merged into one struct, which Spark does not
    push into the scan.
    """
    ids = counted.select("sale_id")
    lowest = ids.orderBy("sale_id").limit(1).scalar()
    highest = ids.orderBy(F.desc("sale_id")).limit(1).scalar()
    return lines.filter((F.col("sale_id") >= lowest) & (F.col("sale_id") <= highest))


def product_totals(
    sales: DataFrame, lines: DataFrame, products: DataFrame, first: str, last: str,
    prune_by_id: bool = True,
) -> DataFrame:
    """Quantity and value sold per product.

    The sales side is only an existence test, and lines are summed per product before the
    product table is joined: that join then sees one row per product, whatever the skew.
    """
    counted = completed_sales(sales, first, last).select(F.col("id").alias("sale_id"))
    wanted = lines.select("sale_id", "product_id", "quantity", "line_subtotal")
    if prune_by_id:
        wanted = _within_ids(wanted, counted)
    sums = (
        wanted.join(counted, "sale_id", "left_semi")
        .groupBy("product_id")
        .agg(
            F.sum("quantity").alias("total_quantity"),
            F.sum("line_subtotal").alias("total_value"),
        )
    )
    names = products.select(F.col("id").alias("product_id"), "barcode", "product_name")
    return sums.join(names, "product_id")


def _check_top(n) -> int:
    try:
        count = int(n)
    except (TypeError, ValueError):
        count = 0
    if count <= 0:
        raise ValueError("the number of products must be a positive whole number")
    return count


def top_products_by_quantity(totals: DataFrame, n=10) -> DataFrame:
    """First ``n`` of ``product_totals`` by quantity; equal quantities by product id."""
    return (
        totals.select("product_id", "barcode", "product_name", "total_quantity")
        .orderBy(F.desc("total_quantity"), "product_id")
        .limit(_check_top(n))
    )


def top_products_by_value(totals: DataFrame, n=10) -> DataFrame:
    return (
        totals.select("product_id", "barcode", "product_name", "total_value")
        .orderBy(F.desc("total_value"), "product_id")
        .limit(_check_top(n))
    )


def sales_by_user(sales: DataFrame, users: DataFrame, first: str, last: str) -> DataFrame:
    """Number and total of sales per existing user, largest total first.

    Sales are summed per user before the join, so a user with very many sales is one row there.
    """
    sums = (
        completed_sales(sales, first, last)
        .groupBy("user_id")
        .agg(F.count("id").alias("n_sales"), F.sum("total").alias("total_sales"))
    )
    names = users.select(F.col("id").alias("user_id"), "username")
    return (
        sums.join(names, "user_id")
        .select("user_id", "username", "n_sales", "total_sales")
        .orderBy(F.desc("total_sales"), "user_id")
    )


def period_sales_detail(sales: DataFrame, users: DataFrame, first: str, last: str) -> DataFrame:
    """Completed sales of the range with their user name, oldest first."""
    names = users.select(F.col("id").alias("user_id"), "username")
    return (
        completed_sales(sales, first, last)
        .join(names, "user_id")
        .select(
            "id", "sold_at", "username", "client_name",
            F.col("total").cast(MONEY).alias("total"), "payment_type",
        )
        .orderBy("sold_at", "id")
    )


def product_report(
    sales: DataFrame, lines: DataFrame, products: DataFrame, first: str, last: str, n=10
) -> DataFrame:
    """Both rankings of a period: ranking, product_id, barcode, product_name, total_quantity,
    total_value.

    Sales and lines are read once and summed per product once; each ranking takes its first ``n`` from
    those sums, and only they are looked up in the products. Lines of products that do not exist are
    left out. The counted sales, one id each, are written first: their lowest and highest id then let
    the scan skip lines of other periods.
    """
    n = _check_top(n)
    counted = settle(
        completed_sales(sales, first, last).select(F.col("id").alias("sale_id")), "counted-sales")
    low, high = counted.agg(F.min("sale_id"), F.max("sale_id")).first()
    wanted = lines.select("sale_id", "product_id", "quantity", "line_subtotal").filter(
        F.col("sale_id").between(F.lit(low), F.lit(high)))
    known = products.select(F.col("id").alias("product_id"))
    sums = (
        wanted.join(counted, "sale_id", "left_semi")
        .groupBy("product_id")
        .agg(F.sum("quantity").alias("total_quantity"), F.sum("line_subtotal").alias("total_value"))
        .join(known, "product_id", "left_semi")
    )
    rankings = [
        sums.orderBy(F.desc(column), "product_id").limit(n).withColumn("ranking", F.lit(name))
        for name, column in (("quantity", "total_quantity"), ("value", "total_value"))
    ]
    names = products.select(F.col("id").alias("product_id"), "barcode", "product_name")
    return rankings[0].unionByName(rankings[1]).join(names, "product_id").select(
        "ranking", "product_id", "barcode", "product_name", "total_quantity", "total_value")
