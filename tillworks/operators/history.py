"""Sales history: filtered pages, page counts, sale documents and who may see which sale."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillworks.functions.dates import from_day, until_day
from tillworks.functions.text import contains_text
from tillworks.operators.paging import take_page
from tillworks.session import settle

SEE_ALL = "ver_historial_ventas_todas"
SEE_OWN = "ver_historial_ventas_propias"
DOCUMENT_LINES = 10_000


def filter_sales(
    sales: DataFrame,
    users: DataFrame,
    date_from: str | None = None,
    date_to: str | None = None,
    user_id: int | None = None,
    client: str | None = None,
) -> DataFrame:
    """Sales of existing users under all given conditions, any status."""
    found = sales
    if date_from is not None:
        found = found.filter(from_day("sold_at", date_from))
    if date_to is not None:
        found = found.filter(until_day("sold_at", date_to))
    if user_id is not None:
        found = found.filter(F.col("user_id") == user_id)
    if client is not None:
        found = found.filter(
            contains_text("client_name", client) | contains_text("client_ident", client)
        )
    names = users.select(F.col("id").alias("user_id"), "username")
    return found.join(names, "user_id").select(
        "id", "sold_at", "username", "client_name", "total", "payment_type", "status"
    )


def list_sales(
    sales: DataFrame,
    users: DataFrame,
    page: int = 1,
    limit: int | None = 25,
    after: tuple[str, int] | None = None,
    **filters,
) -> DataFrame:
    """One page, newest first.

    ``after`` = (sold_at, id) of the last row seen continues from there without the offset:
    the offset form brings all skipped rows to one task, this one only ``limit`` rows per task.
    """
    found = filter_sales(sales, users, **filters)
    order = [F.desc("sold_at"), F.desc("id")]
    if after is None:
        return take_page(found, order, page, limit)
    sold_at, last_id = F.lit(after[0]).cast("timestamp_ntz"), F.lit(after[1])
    older = (F.col("sold_at") < sold_at) | ((F.col("sold_at") == sold_at) & (F.col("id") < last_id))
    return take_page(found.filter((F.col("sold_at") <= sold_at) & older), order, 1, limit)


def document_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Sale lines with product name and barcode; lines of deleted products are left out."""
    names = products.select(F.col("id").alias("product_id"), "product_name", "barcode")
    return lines.join(names, "product_id")


def sale_documents(
    sales: DataFrame,
    users: DataFrame,
    lines: DataFrame,
    products: DataFrame,
    sale_ids: DataFrame | None = None,
    part_lines: int = DOCUMENT_LINES,
) -> DataFrame:
    """Sale, user name and its nested lines in line-id order; no lines gives an empty list.

    A sale of at most ``part_lines`` lines is one document, part 0. A larger one comes in parts 0, 1,
    ... of so many lines each, the last of what is left, so no group is collected whole however many
    lines one sale holds.
    """
    if sale_ids is not None:
        wanted = sale_ids.select(F.col("id").alias("sale_id")).distinct()
        sales = sales.join(wanted.withColumnRenamed("sale_id", "id"), "id", "left_semi")
        lines = lines.join(wanted, "sale_id", "left_semi")
    named = document_lines(lines, products)
    # the id first, to sort by; lines are brought into the order of their columns afterwards
    shown = [c for c in named.columns if c != "sale_id"]
    found = F.collect_list(F.struct("id", *[c for c in shown if c != "id"])).alias("found")
    large_ids = settle(
        lines.groupBy("sale_id").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > part_lines).select("sale_id"),
        "large-sales",
    )
    whole = F.lit(0).cast("long").alias("part")
    if large_ids.isEmpty():
        collected = named.groupBy("sale_id").agg(whole, found)
    else:
        ordinary = named.join(large_ids, "sale_id", "left_anti")
        # grouped by a struct, which shares no partitioning with the join on sale_id
        pieces = (
            _numbered_parts(named.join(large_ids, "sale_id", "left_semi"), part_lines)
            .withColumn("piece", F.struct("sale_id", "part"))
            .groupBy("piece")
            .agg(found)
            .select("piece.sale_id", "piece.part", "found")
        )
        collected = ordinary.groupBy("sale_id").agg(whole, found).unionByName(pieces)
    nested = collected.select(
        F.col("sale_id").alias("id"),
        "part",
        F.transform(
            F.sort_array("found"), lambda x: F.struct(*[x[c].alias(c) for c in shown])
        ).alias("lines"),
    )
    names = users.select(F.col("id").alias("user_id"), "username")
    headed = sales.join(names, "user_id").join(nested, "id", "left")
    no_lines = F.array().cast(nested.schema["lines"].dataType)
    return headed.withColumn("part", F.coalesce("part", F.lit(0).cast("long"))).withColumn(
        "lines", F.coalesce("lines", no_lines)
    )


def _numbered_parts(large: DataFrame, part_lines: int) -> DataFrame:
    """Lines of large sales with their ``part``: the place within the sale divided by ``part_lines``.

    Places are numbered without a window over the sale and without a shuffle of their own: lines are
    laid out by range of (sale, line), numbered as they lie there, and written. A sale is cut by few
    ranges, so all that is joined to the lines is a few rows for each range: what earlier ranges
    hold of its first sale. So parts do not depend on the layout. The order covers every column;
    lines alike in all of them may change places.
    """
    order = ["sale_id", "id", *[c for c in large.columns if c not in ("sale_id", "id")]]
    schema = T.StructType([*large.schema, T.StructField("_range", T.IntegerType()),
                           T.StructField("_at", T.LongType())])
    laid = settle(
        large.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_range", F.spark_partition_id())
        .mapInArrow(_numbered, schema),
        "large-lines",
    )
    # only the first and the last sale of a range may lie in others as well
    ends = laid.groupBy("_range").agg(
        F.array(F.min("sale_id"), F.max("sale_id")).alias("ends")).select(
        "_range", F.explode(F.array_distinct("ends")).alias("sale_id"))
    earlier = (
        Window.partitionBy("sale_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = settle(
        laid.join(settle(ends, "large-ends"), ["sale_id", "_range"], "left_semi")
        .groupBy("sale_id", "_range").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.sum("_n").over(earlier))
        .filter("_start is not null").drop("_n"),
        "large-starts",
    )
    return (
        laid.join(starts, ["sale_id", "_range"], "left")
        .withColumn("part", F.expr(f"(coalesce(_start, 0) + _at) div {int(part_lines)}"))
        .drop("_range", "_at", "_start")
    )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by sale with ``_at``, their place among those of the sale, from 0."""
    last, held = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sale = batch.column("sale_id").dictionary_encode(null_encoding="encode")
        code = sale.indices.to_numpy()
        firsts = np.flatnonzero(np.diff(code, prepend=-1))
        sizes = np.diff(firsts, append=len(code))
        at = np.arange(len(code)) - np.repeat(firsts, sizes)
        values = sale.dictionary.to_pylist()
        if (values[code[0]],) == last:
            at[: sizes[0]] += held
        last, held = (values[code[-1]],), int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "_at"])


def visible_sales(
    sales: DataFrame,
    grants: DataFrame,
    requester_id: int,
    user_id: int | None = None,
) -> DataFrame:
    """The sales one requester may see; a refused requester gets none.

    ``grants`` holds (user_id, permission). With the right to all sales the optional user filter
    applies; with the right to one's own it is replaced by the requester.
    """
    mine = (F.col("user_id") == requester_id) & F.col("permission").isin(SEE_ALL, SEE_OWN)
    rights = grants.filter(mine).agg(
        F.struct(
            F.coalesce(F.max(F.col("permission") == SEE_ALL), F.lit(False)).alias("sees_all"),
            F.coalesce(F.max(F.col("permission") == SEE_OWN), F.lit(False)).alias("sees_own"),
        ).alias("rights")
    ).scalar()
    scope = F.lit(True) if user_id is None else F.col("user_id") == user_id
    own = rights["sees_own"] & (F.col("user_id") == requester_id)
    return sales.filter(F.when(rights["sees_all"], scope).otherwise(own))


def visible_documents(
    sales: DataFrame,
    users: DataFrame,
    lines: DataFrame,
    products: DataFrame,
    grants: DataFrame,
    requester_id: int,
    sale_ids: DataFrame | None = None,
) -> DataFrame:
    """``sale_documents`` of the asked sales that the requester may see."""
    seen = visible_sales(sales, grants, requester_id)
    return sale_documents(seen, users, lines, products, sale_ids)


def history_scope(users: DataFrame, grants: DataFrame) -> DataFrame:
    """(user_id, scope) for every user: all, own or refused."""
    rights = (
        grants.filter(F.col("permission").isin(SEE_ALL, SEE_OWN))
        .groupBy("user_id")
        .agg(F.max(F.col("permission") == SEE_ALL).alias("sees_all"))
    )
    scope = (
        F.when(F.col("sees_all"), "all")
        .when(~F.col("sees_all"), "own")
        .otherwise("refused")
    )
    return (
        users.select(F.col("id").alias("user_id"))
        .join(rights, "user_id", "left")
        .select("user_id", scope.alias("scope"))
    )


def visible_totals(sales: DataFrame, users: DataFrame, grants: DataFrame) -> DataFrame:
    """For every user as requester: scope, number and total of the sales open to them.

    Sales are summed per seller once; whoever sees all gets the sum of those sums, so no
    (requester, sale) pairs are formed.
    """
    per_seller = (
        sales.groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("amount"))
    )
    known = per_seller.join(users.select(F.col("id").alias("user_id")), "user_id")
    everything = known.agg(
        F.struct(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("amount").alias("amount")
        ).alias("s")
    ).scalar()
    scoped = history_scope(users, grants).join(known, "user_id", "left")
    own, every = F.col("scope") == "own", F.col("scope") == "all"
    return scoped.select(
        "user_id",
        "scope",
        F.when(every, everything["n"]).when(own, F.coalesce("n", F.lit(0)))
        .otherwise(F.lit(0)).alias("n_sales"),
        F.when(every, everything["amount"]).when(own, F.col("amount")).alias("total_sales"),
    )
