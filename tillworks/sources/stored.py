"""Operators applied to stored tables: read, judged, and committed as appends and rewritten files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks.operators import maintain
from tillworks.operators.sales import Posting, post_sales, take_sold
from tillworks.session import settle
from tillworks.sources.tables import Append, Rewrite, commit, current, read_table


def post(
    spark: SparkSession, root: str, new_sales: DataFrame, new_lines: DataFrame, grants: DataFrame,
    now: Column, tag: str | None = None, **allocation,
) -> Posting:
    """Post sales to the tables under ``root`` in one version.

    Headers and lines are appended, and only those product files are written again that hold a sold
    product. If products changed meanwhile, the commit is refused (CommitConflict) and nothing is posted.
    """
    base = current(spark, root)
    used = {name: t.last_id for name, t in base.tables.items()}
    products = read_table(spark, root, "products", base)
    done = post_sales(
        new_sales, new_lines, products, grants, None, None, now, used, **allocation)
    rows = settle(done.sales, "posted-sales"), settle(done.lines, "posted-lines")
    sold = settle(done.sold, "sold")
    commit(spark, root, {
        "sales": Append(rows[0]), "sale_lines": Append(rows[1]),
        "products": Rewrite(sold, lambda part: take_sold(part, sold, now))}, tag, base)
    return Posting(*rows, done.refused, read_table(spark, root, "products"), sold)


def insert(spark: SparkSession, root: str, name: str, rows: DataFrame, tag: str | None = None):
    """``maintain.insert_rows`` on a stored table; accepted rows are appended. Returns the refused."""
    base = current(spark, root)
    stored = base.tables.get(name)
    last = stored.last_id if stored else 0
    done = maintain.insert_rows(name, read_table(spark, root, name, base), rows, last)
    refused = settle(done.refused, "refused")
    # uniqueness was judged on the base, so a commit in between refuses this one
    new = settle(done.table.filter(F.col("id") > last), "inserted")
    nothing = spark.createDataFrame([], "id long")
    commit(spark, root, {name: Rewrite(nothing, lambda part: part, new)}, tag, base)
    return refused


def _change(spark, root, name, base, ids, judge, tag) -> DataFrame:
    """Commit what ``judge(table).table`` makes of the rows with ``ids``; returns its refused rows."""
    done = judge(read_table(spark, root, name, base))
    refused = settle(done.refused, "refused")
    changed = settle(done.table.join(ids, "id", "left_semi"), "changed")

    def change(part: DataFrame) -> DataFrame:
        return part.join(ids, "id", "left_anti").unionByName(changed)

    commit(spark, root, {name: Rewrite(ids, change)}, tag, base)
    return refused


def update(
    spark: SparkSession, root: str, name: str, changes: DataFrame, tag: str | None = None
) -> DataFrame:
    """``maintain.update_rows`` on a stored table: only files with a changed id are written again.

    Returns the refused changes.
    """
    ids = settle(changes.select("id").distinct(), "ids")
    return _change(
        spark, root, name, current(spark, root), ids,
        lambda table: maintain.update_rows(name, table, changes), tag)


def update_products(
    spark: SparkSession, root: str, changes: DataFrame, now: Column, tag: str | None = None
) -> DataFrame:
    """``maintain.update_products`` on the stored products."""
    ids = settle(changes.select("id").distinct(), "ids")
    return _change(
        spark, root, "products", current(spark, root), ids,
        lambda table: maintain.update_products(table, changes, now), tag)


def soft_delete(
    spark: SparkSession, root: str, ids: DataFrame, now: Column, tag: str | None = None
) -> DataFrame:
    """``maintain.soft_delete_products`` on the stored products."""
    ids = settle(ids.select("id").distinct(), "ids")
    return _change(
        spark, root, "products", current(spark, root), ids,
        lambda table: maintain.soft_delete_products(table, ids, now), tag)


def hard_delete(
    spark: SparkSession, root: str, name: str, ids: DataFrame, tag: str | None = None
) -> DataFrame:
    """``maintain.hard_delete`` on a stored table."""
    ids = settle(ids.select("id").distinct(), "ids")
    return _change(
        spark, root, name, current(spark, root), ids,
        lambda table: maintain.hard_delete(table, ids), tag)
