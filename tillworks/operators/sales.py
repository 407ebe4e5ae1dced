"""Pricing, carts, sale validation and posting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillworks.functions.pricing import tender, tier_price
from tillworks.operators.folding import fold_in_order
from tillworks.operators.ids import with_new_ids
from tillworks.operators.stock import allocate_stock
from tillworks.schemas import COMPLETED, MONEY, PAYMENT_TYPES, STATUSES, TABLES
from tillworks.session import settle

SELL = "realizar_ventas"


def price_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Lines of active products with unit price by tier and subtotal."""
    prices = products.filter("active").select(
        F.col("id").alias("product_id"), "retail_price", "wholesale_price", "wholesale_min_qty"
    )
    price = tier_price(
        F.col("quantity"), F.col("retail_price"), F.col("wholesale_price"),
        F.col("wholesale_min_qty"),
    )
    return (
        lines.join(prices, "product_id")
        .withColumn("unit_price", price)
        .withColumn("line_subtotal", (F.col("quantity") * F.col("unit_price")).cast(MONEY))
        .select(*lines.columns, "unit_price", "line_subtotal")
    )


def cart_totals(priced: DataFrame, cart: str = "cart_id") -> DataFrame:
    return priced.groupBy(cart).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("line_subtotal").alias("total")
    )


def check_tender(sales: DataFrame) -> DataFrame:
    """Sales with payment type, tendered amount, change and reason worked out."""
    paid = tender(F.col("total"), F.col("tendered"), F.col("payment_type"))
    kept = [c for c in sales.columns if c not in ("payment_type", "tendered")]
    return sales.withColumn("_paid", paid).select(*kept, "_paid.*")


def validate_sales(
    sales: DataFrame,
    lines: DataFrame,
    products: DataFrame,
    grants: DataFrame,
    check_stock: bool = True,
) -> DataFrame:
    """``sales`` with a ``reason``; NULL means the sale may be posted.

    In this order: no permission, empty cart, the first failing line in cart order, tender, stored
    value sets. Each line is checked on its own against the opening stock; what the lines and the
    sales take together is the business of ``post_sales``. The total is taken as given.
    """
    active = products.filter("active").select(F.col("id").alias("product_id"), "stock")
    line_reason = F.when(F.coalesce(F.col("quantity") <= 0, F.lit(True)), "bad_quantity").when(
        F.col("stock").isNull(), "product_not_found"
    )
    if check_stock:
        line_reason = line_reason.when(F.col("stock") < F.col("quantity"), "insufficient_stock")
    place = F.struct("position", "product_id", "quantity")
    checked = (
        lines.join(active, "product_id", "left")
        .withColumn("reason", line_reason)
        .groupBy("sale_ref")
        .agg(
            F.min_by("reason", F.when(F.col("reason").isNotNull(), place)).alias("line_reason")
        )
        .withColumn("has_lines", F.lit(True))
    )
    sellers = grants.filter(F.col("permission") == SELL).select(
        "user_id", F.lit(True).alias("may_sell")
    )
    paid = tender(F.col("total"), F.col("tendered"), F.col("payment_type"))
    status = F.coalesce("status", F.lit(COMPLETED))
    reason = F.coalesce(
        F.when(F.col("may_sell").isNull(), F.lit("no_permission")),
        F.when(F.col("has_lines").isNull(), F.lit("empty_cart")),
        F.col("line_reason"),
        F.col("_paid.reason"),
        F.when(~F.col("_paid.payment_type").isin(*PAYMENT_TYPES), F.lit("bad_payment_type")),
        F.when(~status.isin(*STATUSES), F.lit("bad_status")),
    )
    return (
        sales.join(checked, "sale_ref", "left")
        .join(sellers, "user_id", "left")
        .withColumn("_paid", paid)
        .select(*sales.columns, reason.alias("reason"))
    )


@dataclass
class Posting:
    """New rows for ``sales`` and ``sale_lines``, the refused sales, and the new ``products``.

    ``sold`` is (id, quantity) of the products that the accepted sales took.
    """

    sales: DataFrame
    lines: DataFrame
    refused: DataFrame
    products: DataFrame
    sold: DataFrame


def post_sales(
    new_sales: DataFrame,
    new_lines: DataFrame,
    products: DataFrame,
    grants: DataFrame,
    sales: DataFrame | None,
    sale_lines: DataFrame | None,
    now: Column,
    last_ids: dict[str, int] | None = None,
    **allocation,
) -> Posting:
    """Post sales in the order of ``seq``; a sale is taken whole or refused whole.

    ``new_sales``: seq, sale_ref, user_id, client_name, client_ident, total, tendered (text),
    payment_type, status, notes. ``new_lines``: sale_ref, position, product_id, quantity,
    unit_price. ``last_ids``: the highest ids that sales and sale_lines ever had
    (``sources.tables.last_ids``); with them the two tables may be None.
    """
    used = last_ids or {}
    checked = settle(
        validate_sales(new_sales, new_lines, products, grants, check_stock=False), "post-checked"
    )
    valid = checked.filter("reason is null")
    demands = new_lines.join(valid.select("sale_ref", "seq"), "sale_ref").select(
        F.col("sale_ref").alias("txn"), "seq", "product_id", "quantity"
    )
    active = products.filter("active").select(F.col("id").alias("product_id"), "stock")
    verdicts = settle(
        allocate_stock(demands, active, **allocation).withColumnRenamed("txn", "sale_ref"),
        "post-verdicts",
    )
    taken = verdicts.filter("accepted").select("sale_ref")
    short = verdicts.filter(~F.col("accepted")).select("sale_ref")
    refused = checked.filter("reason is not null").select("seq", "sale_ref", "reason").unionByName(
        valid.join(short, "sale_ref").select(
            "seq", "sale_ref", F.lit("insufficient_stock").alias("reason")
        )
    )

    headers = with_new_ids(
        valid.join(taken, "sale_ref"), sales, ["seq"], used.get("sales", 0)
    )
    headers = headers.withColumn(
        "_paid", tender(F.col("total"), F.col("tendered"), F.col("payment_type"))
    )
    posted = headers.select(
        "id",
        now.alias("sold_at"),
        "user_id",
        "client_name",
        "client_ident",
        "total",
        F.col("_paid.tendered").alias("tendered"),
        F.col("_paid.change_due").alias("change_due"),
        F.col("_paid.payment_type").alias("payment_type"),
        F.coalesce("status", F.lit(COMPLETED)).alias("status"),
        "notes",
    )
    rows = with_new_ids(
        new_lines.join(headers.select("sale_ref", F.col("id").alias("sale_id")), "sale_ref"),
        sale_lines,
        ["sale_id", "position", "product_id", "quantity"],
        used.get("sale_lines", 0),
    ).select(
        "id",
        "sale_id",
        "product_id",
        "quantity",
        "unit_price",
        (F.col("quantity") * F.col("unit_price")).cast(MONEY).alias("line_subtotal"),
        F.lit(0).cast(MONEY).alias("line_discount"),
    )
    sold = rows.groupBy(F.col("product_id").alias("id")).agg(F.sum("quantity").alias("quantity"))
    return Posting(
        posted.select(*TABLES["sales"].names), rows, refused, take_sold(products, sold, now), sold)


def take_sold(products: DataFrame, sold: DataFrame, now: Column) -> DataFrame:
    """Products with the quantities of ``sold`` (id, quantity) taken off; ``modified_at`` is set."""
    left = products.join(sold.withColumnRenamed("quantity", "_sold"), "id", "left")
    hit = F.col("_sold").isNotNull()
    return left.select(
        *[
            (F.col("stock") - F.coalesce("_sold", F.lit(0))).alias("stock") if c == "stock"
            else F.when(hit, now).otherwise(F.col(c)).alias(c) if c == "modified_at"
            else F.col(c)
            for c in products.columns
        ]
    )


# --- carts ---------------------------------------------------------------------------------


def _cart_step(event: tuple, state: tuple) -> tuple[tuple, tuple]:
    """One event on one product of one cart; amounts in cents, an absent line is NULLs."""
    kind, amount, retail, wholesale, min_qty, active = event
    quantity, price = state

    def tier(count):
        return wholesale if min_qty and count >= min_qty and wholesale is not None else retail

    if kind == "add":
        if amount is None or amount <= 0:
            return state, ()
        if quantity is None:
            return (amount, tier(amount)), ()
        return (quantity + amount, price), ()
    if quantity is None:
        return state, ()
    if kind == "remove":
        return (None, None), ()
    if kind == "step":
        count = quantity + amount
        if count <= 0:
            return (None, None), ()
        return (count, tier(count) if active else price), ()
    return state, ()


def fold_cart_events(events: DataFrame, products: DataFrame) -> DataFrame:
    """(cart_id, product_id, quantity, unit_price, line_subtotal) left after all events.

    ``events``: cart_id, seq, product_id, kind (add, step, remove), quantity. The first add prices
    the line by the quantity added, a further add keeps the price, a step prices it anew by the
    whole quantity (not for a product that is inactive by now); at zero the line goes.
    """
    def cents(column):
        return (F.col(column) * 100).cast("long").alias(column)

    prices = products.select(
        F.col("id").alias("product_id"), cents("retail_price"), cents("wholesale_price"),
        "wholesale_min_qty", "active",
    )
    priced = settle(events.join(prices, "product_id"), "cart-events")
    no_state = prices.filter(F.lit(False)).select(
        F.lit(0).cast("long").alias("cart_id"), "product_id",
        F.lit(0).cast("long").alias("_count"), F.lit(0).cast("long").alias("_price"),
    )
    folded = fold_in_order(
        priced,
        key=["cart_id", "product_id"],
        order_by=["seq"],
        start=no_state,
        inputs=["kind", "quantity", "retail_price", "wholesale_price", "wholesale_min_qty",
                "active"],
        state=[T.StructField("_count", T.LongType()), T.StructField("_price", T.LongType())],
        result=[],
        step=_cart_step,
    )
    price = (F.col("last._price") / 100).cast(MONEY)
    return (
        folded.groupBy("cart_id", "product_id")
        .agg(F.max_by(F.struct("_count", "_price"), "seq").alias("last"))
        .filter("last._count is not null")
        .select(
            "cart_id",
            "product_id",
            F.col("last._count").alias("quantity"),
            price.alias("unit_price"),
            (F.col("last._count") * price).cast(MONEY).alias("line_subtotal"),
        )
    )
