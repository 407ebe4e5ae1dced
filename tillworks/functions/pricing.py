"""Price tier, stock band and cash tender rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillworks.schemas import CASH, MONEY


def tier_price(quantity: Column, retail: Column, wholesale: Column, min_qty: Column) -> Column:
    """Wholesale price from the minimum quantity on; a NULL or zero minimum means no tier."""
    in_tier = (min_qty != 0) & (quantity >= min_qty) & wholesale.isNotNull()
    return F.when(in_tier, wholesale).otherwise(retail)


def stock_band(stock: Column, min_stock: Column) -> Column:
    return (
        F.when(stock == 0, F.lit("out"))
        .when((stock <= min_stock) & (min_stock > 0), F.lit("low"))
        .otherwise(F.lit("ok"))
    )


_NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_WHOLE = r"^\s*[+-]?[0-9]+\s*$"


def money_from_text(text: Column) -> Column:
    """Finite decimal text to money; NULL when it is not a number or does not fit."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast(MONEY))


def whole_from_text(text: Column) -> Column:
    """Whole-number text to LONG; ``5.0`` is not one."""
    return F.when(text.rlike(_WHOLE), F.trim(text).try_cast("long"))


def tender(total: Column, tendered: Column, payment_type: Column) -> Column:
    """Struct (payment_type, tendered, change_due, reason) for one sale.

    The payment type defaults to cash first, so an unnamed one is checked as cash. Only cash
    with an amount is checked; other types keep change NULL.
    """
    paid_by = F.coalesce(payment_type, F.lit(CASH))
    amount = money_from_text(tendered)
    checked = tendered.isNotNull() & (paid_by == CASH)
    reason = F.when(checked & amount.isNull(), F.lit("bad_tender")).when(
        checked & (amount < total), F.lit("short_cash")
    )
    change = F.when(checked & (amount >= total), (amount - total).cast(MONEY))
    return F.struct(
        paid_by.alias("payment_type"),
        amount.alias("tendered"),
        change.alias("change_due"),
        reason.alias("reason"),
    )
