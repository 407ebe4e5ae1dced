"""Page arithmetic shared by the catalogue and the sales history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def take_page(df: DataFrame, order: list, page: int = 1, limit: int | None = 25) -> DataFrame:
    """Page ``page`` of ``df`` in the given total order; no limit means all rows."""
    ordered = df.orderBy(*order)
    if not limit:
        return ordered
    return ordered.offset((max(page, 1) - 1) * limit).limit(limit)


def page_info(filtered: DataFrame, page: int = 1, limit: int | None = 25) -> DataFrame:
    """One row: rows in the filtered set, the current page and the number of pages."""
    rows = F.count(F.lit(1))
    pages: Column = F.ceil(rows / F.lit(limit)).cast("long") if limit else F.lit(1).cast("long")
    return filtered.agg(
        rows.alias("total_rows"),
        F.lit(max(page, 1)).cast("long").alias("page"),
        pages.alias("total_pages"),
    )
