"""Stock movements, and all-or-nothing allocation of stock to ordered transactions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillworks.schemas import MANUAL_NOTE, STOCK_IN, STOCK_OUT
from tillworks.session import settle

BLOCK_LINES = 50_000
TASK_LINES = 100_000  # lines of the blocks that one task follows, one block after the other


# --- movements -----------------------------------------------------------------------------

#: no bound on the opening stock
_FAR = 1 << 62


def _laid_out(movements: DataFrame, order_by: list[str], slices: int | None) -> DataFrame:
    """Movements by range of (product, order), so that a very large product is cut into slices of
    ordinary size; ``_slice`` is the range. Spark chooses their number if none is given."""
    by_place = ["product_id", *order_by]
    number = [slices] if slices else []
    return movements.repartitionByRange(*number, *by_place).sortWithinPartitions(
        *by_place).withColumn("_slice", F.spark_partition_id())


def apply_movements(
    products: DataFrame, movements: DataFrame, order_by: list[str], slices: int | None = None
) -> DataFrame:
    """``movements`` with ``reason`` (NULL = accepted) and ``stock`` after each one.

    Movements of a product apply in the total order ``order_by``: in-movements add, out-movements
    subtract when the stock suffices. Only active products take movements.

    Verdicts depend on earlier verdicts, so a slice of a product is followed in order, all slices at
    once, each from the product's opening stock. What a slice did also holds for other stocks at its
    start: as long as no accepted movement would lack stock and no refused one would find it. That is an
    interval, and within it the slice changes the stock by the same amount. So the slices of a
    product are put together by sums of these amounts, and only a slice whose stock turns out to lie
    outside its interval is followed again, from the stock that the sums give; the first such slice of
    a product is then final. A product whose stock never runs out is followed once, however many
    slices it has. What slices tell each other is one row for each slice of a cut product.
    """
    opening = products.filter("active").select(F.col("id").alias("product_id"), "stock")
    start = opening.withColumnRenamed("stock", "_from")
    laid_out = _laid_out(movements.join(start, "product_id", "left"), order_by, slices)
    runs = [settle(_followed(laid_out.select(*movements.columns, "_slice", "_from")), "movements")]
    chosen, shifts = _put_together(runs, order_by)
    place = ["product_id", "_slice"]
    out = None
    for i, run in enumerate(runs):
        picked = run.withColumn("_run", F.lit(i))
        if len(runs) > 1:
            others = chosen.filter(F.col("_run") != i).select(*place)
            picked = picked.join(others, place, "left_anti")
        out = picked if out is None else out.unionByName(picked)
    if shifts is not None:
        out = out.join(shifts, place, "left").withColumn(
            "stock", F.col("stock") + F.coalesce("_shift", F.lit(0)))
    return out.select(*movements.columns, "stock", "reason")


def _followed(rows: DataFrame) -> DataFrame:
    """Rows of slices, in order, with stock and reason; ``_from`` is the stock before the slice."""
    schema = T.StructType([
        *rows.schema, T.StructField("stock", T.LongType()),
        T.StructField("reason", T.StringType())])
    return rows.mapInArrow(_follow_slices, schema)


def _follow_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, stock = None, None
    for batch in batches:
        columns = (batch.column(c).to_pylist()
                   for c in ("product_id", "_slice", "_from", "kind", "quantity"))
        stocks, reasons = [], []
        for product, piece, start, kind, quantity in zip(*columns):
            if (product, piece) != at:
                at, stock = (product, piece), start
            if quantity is None or quantity <= 0:
                reason = "bad_quantity"
            elif stock is None:
                reason = "product_not_found"
            elif kind == STOCK_IN:
                reason, stock = None, stock + quantity
            elif kind != STOCK_OUT:
                reason = "bad_kind"
            elif stock < quantity:
                reason = "insufficient_stock"
            else:
                reason, stock = None, stock - quantity
            stocks.append(stock)
            reasons.append(reason)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(stocks, pa.int64()), pa.array(reasons, pa.string())],
            names=[*batch.schema.names, "stock", "reason"])


def _slice_sums(run: DataFrame, only_cut: bool) -> list[tuple]:
    """(product, slice, from, change, low, high) of the slices (of products that are cut).

    The slice's verdicts hold for all stocks from low to high at its start: its accepted out-movements
    leave at least from - low, and its refused ones lack more than high - from.
    """
    left = F.when(F.col("reason").isNull() & (F.col("kind") == STOCK_OUT), F.col("stock"))
    lacking = F.when(
        F.col("reason") == "insufficient_stock", F.col("quantity") - F.col("stock") - 1)
    signed = F.when(F.col("kind") == STOCK_IN, F.col("quantity")).otherwise(-F.col("quantity"))
    sums = run.filter("_from is not null").groupBy("product_id", "_slice").agg(
        F.first("_from").alias("start"),
        F.coalesce(F.sum(F.when(F.col("reason").isNull(), signed)), F.lit(0)).alias("change"),
        F.coalesce(F.min(left), F.lit(_FAR)).alias("spare"),
        F.coalesce(F.min(lacking), F.lit(_FAR)).alias("more"))
    if only_cut:
        slices = F.count(F.lit(1)).over(W.partitionBy("product_id"))
        sums = sums.withColumn("_n", slices).filter("_n > 1")
    return [
        (r.product_id, r._slice, r.start, r.change, r.start - r.spare, r.start + r.more)
        for r in sums.collect()]


def _put_together(runs: list[DataFrame], order_by: list[str]):
    """Follow slices again until all fit; (product, slice, run) of those, and what to add to stocks.

    ``runs`` grows by one for each time. The driver holds a few numbers for each slice of a cut product,
    of which there are fewer than two for each range.
    """
    spark = runs[0].sparkSession
    key = runs[0].schema["product_id"].dataType
    ways: dict[tuple, list[tuple]] = {}
    opening: dict = {}
    for product, piece, *rest in _slice_sums(runs[0], only_cut=True):
        ways[product, piece] = [(0, *rest)]
        opening[product] = rest[0]
    if not ways:
        return None, None
    while True:
        wrong, plan, now, held = [], [], None, 0
        for product, piece in sorted(ways):
            if product != now:
                now, held = product, opening[product]
            tried = ways[product, piece]
            fit = next((w for w in tried if w[3] <= held <= w[4]), None)
            if fit is None:
                held = max(held, 0)
                wrong.append((product, piece, held))
                fit = tried[-1]  # to go on with, until the slice is followed from here
            plan.append((product, piece, fit[0], held - fit[1]))
            held += fit[2]
        if not wrong:
            break
        schema = T.StructType([T.StructField("product_id", key)]).add("_slice", T.IntegerType()).add(
            "_from", T.LongType())
        again = spark.createDataFrame(wrong, schema)
        rows = runs[0].drop("_from", "stock", "reason").join(again, ["product_id", "_slice"])
        rows = rows.repartition("product_id", "_slice").sortWithinPartitions(
            "product_id", "_slice", *order_by).select(*runs[0].drop("stock", "reason").columns)
        runs.append(settle(_followed(rows), "movements"))
        for product, piece, *rest in _slice_sums(runs[-1], only_cut=False):
            ways[product, piece].append((len(runs) - 1, *rest))
    schema = T.StructType([T.StructField("product_id", key)]).add("_slice", T.IntegerType()).add(
        "_run", T.IntegerType()).add("_shift", T.LongType())
    made = spark.createDataFrame(plan, schema)
    return made.drop("_shift"), made.filter("_shift <> 0").drop("_run")


def stock_after(products: DataFrame, applied: DataFrame, order_by: list[str], now) -> DataFrame:
    """Products with the stock left by ``apply_movements``; ``modified_at`` set where it moved."""
    moved = (
        applied.filter("reason is null")
        .groupBy(F.col("product_id").alias("id"))
        .agg(F.max_by("stock", F.struct(*order_by)).alias("_stock"))
    )
    changed = products.join(moved, "id", "left")
    return changed.select(
        *[
            F.coalesce("_stock", "stock").alias("stock") if c == "stock"
            else F.when(F.col("_stock").isNotNull(), now).otherwise(F.col(c)).alias(c)
            if c == "modified_at"
            else F.col(c)
            for c in products.columns
        ]
    )


def stock_in(
    products: DataFrame, deliveries: DataFrame, order_by: list[str], slices: int | None = None
) -> DataFrame:
    """Deliveries as in-movements; ``stock`` is the new stock.

    Nothing is refused for want of stock, so stocks are running sums: within a range of (product,
    order) by a window, and before it the sums of the product's earlier ranges. A product with much of
    the data is cut into ranges like any other.
    """
    columns = [c for c in deliveries.columns if c != "kind"]
    laid_out = settle(
        _laid_out(deliveries.select(*columns), order_by, slices), "deliveries")
    good = F.col("quantity") > 0
    amount = F.when(good, F.col("quantity")).otherwise(0)
    earlier = W.partitionBy("product_id").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    opening = products.filter("active").select(
        F.col("id").alias("product_id"), F.col("stock").alias("_open"))
    before = (
        laid_out.groupBy("product_id", "_slice").agg(F.sum(amount).alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .join(opening, "product_id")
        .select("product_id", "_slice", (F.col("_open") + F.col("_before")).alias("_start"))
    )
    so_far = W.partitionBy("product_id", "_slice").orderBy(*order_by).rowsBetween(
        W.unboundedPreceding, W.currentRow)
    reason = F.when(~F.coalesce(good, F.lit(False)), "bad_quantity").when(
        F.col("_start").isNull(), "product_not_found")
    return (
        laid_out.withColumn("_sum", F.sum(amount).over(so_far))
        .join(before, ["product_id", "_slice"], "left")
        .select(*columns, F.lit(STOCK_IN).alias("kind"),
                (F.col("_start") + F.col("_sum")).alias("stock"), reason.alias("reason"))
    )


def stock_out_adjustment(
    products: DataFrame, adjustments: DataFrame, order_by: list[str]
) -> DataFrame:
    """Manual out-movements. A note is required; accepted and refused rows carry a marked note."""
    noted = F.coalesce(F.col("notes") != "", F.lit(False))
    good_quantity = F.col("quantity") > 0
    marked = adjustments.withColumn("kind", F.lit(STOCK_OUT))
    ready = marked.filter(noted).withColumn("notes", F.concat(F.lit(MANUAL_NOTE), "notes"))
    refused = marked.filter(~noted).select(
        "*",
        F.lit(None).cast("long").alias("stock"),
        F.when(good_quantity, F.lit("note_required")).otherwise(F.lit("bad_quantity"))
        .alias("reason"),
    )
    return apply_movements(products, ready, order_by).unionByName(refused)


# --- allocation ----------------------------------------------------------------------------


def allocate_stock(
    demands: DataFrame, opening: DataFrame, block_lines: int = BLOCK_LINES
) -> DataFrame:
    """(txn, accepted) for transactions that take stock of several products at once.

    ``demands``: txn, seq, product_id, quantity. ``seq`` orders the transactions and is unique per
    transaction; all quantities of a transaction are positive (taking) or all negative (adding).
    ``opening``: product_id, stock. A transaction is accepted if every product it takes is left
    in sufficient quantity by the earlier accepted ones; a refused one takes nothing.

    Transactions are cut in order into blocks of about ``block_lines`` lines, and all blocks work
    at once, round by round. What earlier blocks surely took and what they may take yet, product by
    product, are sums; between these two bounds a block follows its own open transactions in order.
    One that does not fit the better bound is refused, one that fits the worse is accepted, the rest
    stays open for the next round. Chains inside a block are thus followed in one round, and nothing
    is open before the first block that has open lines, so each round finishes that block at least:
    there are never more rounds than blocks, and the outcome equals one-by-one processing. Only open
    lines and those just accepted go on to the next round; neighbouring blocks that few are left of
    become one, so blocks and rounds shrink with what is left. However small the blocks, a task gets
    enough neighbouring ones to be worth its start.
    """
    lines = settle(
        demands.groupBy("txn", "seq", "product_id")
        .agg(F.sum("quantity").alias("need"))
        .join(opening.select("product_id", F.col("stock").alias("room")), "product_id", "left")
        .withColumn("room", F.coalesce("room", F.lit(0)).cast("long")),
        "alloc-lines",
    )
    n_lines = lines.count()
    blocks = max(1, -(-n_lines // block_lines))
    each = -(-blocks // _tasks(lines.sparkSession, blocks, n_lines))
    # the place of a transaction's first line in its range tells the block; ids hold range and place
    first = F.min("_id").over(W.partitionBy("seq"))
    place = first.bitwiseAND((1 << _PLACE_BITS) - 1)
    laid_out = settle(
        lines.repartitionByRange(-(-blocks // each), "seq")
        .sortWithinPartitions("seq")
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("block", first - place + F.least(F.floor(place / block_lines), F.lit(each - 1)))
        .withColumn("open", F.col("need") > 0)
        .select(*_LINE),
        "alloc-start",
    )
    accepted = [laid_out.filter(~F.col("open")).select("txn")]
    work = laid_out
    while True:
        sizes = work.groupBy("block").agg(
            F.count(F.lit(1)).alias("n"), F.count_if("open").alias("n_open")).collect()
        if not any(r.n_open for r in sizes):
            break
        merged = _merge_blocks(sorted(sizes), block_lines)
        named = work.sparkSession.createDataFrame(merged, "block long, _merged long")
        work = work.join(named, "block").withColumn("block", F.col("_merged")).select(*_LINE)
        blocks = merged[-1][1] + 1
        tasks = _tasks(work.sparkSession, blocks, sum(r.n for r in sizes))
        work = settle(_follow(work, _before_blocks(work), blocks, tasks), "alloc-round")
        accepted.append(work.filter(~F.col("open")).select("txn"))
        if len(accepted) > UNION_INPUTS:
            accepted = [settle(_union(accepted), "alloc-accepted")]
    everyone = laid_out.select("txn").distinct()
    taken = _union(accepted).distinct().withColumn("accepted", F.lit(True))
    return everyone.join(taken, "txn", "left").withColumn(
        "accepted", F.coalesce("accepted", F.lit(False)))


_LINE = ("txn", "seq", "product_id", "need", "room", "block", "open")
_PLACE_BITS = 33  # monotonically_increasing_id holds the partition above so many bits
#: rounds whose verdicts are read from separate folders before they are written as one
UNION_INPUTS = 16


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _tasks(spark: SparkSession, blocks: int, n_lines: int) -> int:
    """Tasks for so many lines in blocks: one for TASK_LINES, and no core without work."""
    cores = spark.sparkContext.defaultParallelism
    return min(blocks, max(cores, -(-n_lines // TASK_LINES)))


def _merge_blocks(sizes: list[tuple], most: int) -> list[tuple[int, int]]:
    """(block, new block): neighbours become one as long as they hold ``most`` lines at most."""
    out, now, held = [], 0, 0
    for block, n, _ in sizes:
        if held and held + n > most:
            now, held = now + 1, 0
        held += n
        out.append((block, now))
    return out


def _before_blocks(work: DataFrame) -> DataFrame:
    """For each product that a block has open lines of: what earlier blocks took in the last round
    (``need``) and how much their open lines ask for (``room``).

    Lines are summed per block first, so a product is as many rows as there are blocks with it.
    """
    sums = work.groupBy("product_id", "block").agg(
        F.sum(F.when(F.col("open"), 0).otherwise(F.col("need"))).alias("took"),
        F.sum(F.when(F.col("open"), F.col("need")).otherwise(0)).alias("asks"),
    )
    earlier = W.partitionBy("product_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return (
        sums.withColumn("need", F.sum("took").over(earlier))
        .withColumn("room", F.sum("asks").over(earlier))
        .filter("asks > 0 and (need <> 0 or room <> 0)")
        .select("product_id", "need", "room", "block")
    )


def _follow(lines: DataFrame, before: DataFrame, blocks: int, tasks: int) -> DataFrame:
    """Lines still open and lines accepted now (``open`` false).

    Refused lines drop out. So do lines accepted before: they are taken off the ``room`` of the
    lines after them here.
    """
    schema = lines.select(*_LINE).schema
    bounds = before.select(
        *[
            F.col(c) if c in before.columns else F.lit(None).cast(schema[c].dataType).alias(c)
            for c in _LINE
        ]
    )
    return (
        bounds.withColumn("line", F.lit(False))
        .unionByName(lines.withColumn("line", F.lit(True)))
        .repartitionById(tasks, F.floor(F.col("block") * tasks / blocks).cast("int"))
        .sortWithinPartitions("block", "line", "seq", "product_id")
        .mapInArrow(_follow_blocks, schema)
    )


def _follow_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks one after the other; holds one block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for low, high in zip(edges, edges[1:]):
            if low == high:
                continue
            if held and held[0].column("block")[0].as_py() != block[low]:
                yield _follow_block(held)
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield _follow_block(held)


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, int]:
    """Values numbered, NULL like any other; and how many there are."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(), len(coded.dictionary)


def _follow_block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """A block's bounds come first, then its lines in order."""
    rows = pa.Table.from_batches(batches)
    product, n_products = _codes(rows.column("product_id"))
    seq, _ = _codes(rows.column("seq"))
    need, room = (rows.column(c).to_numpy() for c in ("need", "room"))
    is_line = rows.column("line").to_numpy()
    begin = int(np.count_nonzero(~is_line))
    # per product: taken by lines accepted before this round, with those accepted now, with all open
    before = np.zeros((2, n_products), np.int64)
    before[:, product[:begin]] = need[:begin], room[:begin]
    took, maybe = before[0].tolist(), before.sum(axis=0).tolist()
    surely = list(took)
    firsts = begin + np.flatnonzero(np.diff(seq[begin:], prepend=-1))
    open_ = rows.column("open").to_pylist()
    product, need, room = product.tolist(), need.tolist(), room.tolist()
    kept, left, still = [], [], []
    for low, high in zip(firsts.tolist(), [*firsts[1:].tolist(), len(seq)]):
        asked = [i for i in range(low, high) if open_[i]]
        if len(asked) < high - low:
            for i in range(low, high):
                if not open_[i]:
                    for sums in (took, surely, maybe):
                        sums[product[i]] += need[i]
        if any(need[i] > room[i] - surely[product[i]] for i in asked):
            continue
        fits = all(need[i] <= room[i] - maybe[product[i]] for i in asked)
        for i in asked:
            p, n = product[i], need[i]
            kept.append(i)
            left.append(room[i] - took[p])
            still.append(not fits)
            maybe[p] += n
            if fits:
                surely[p] += n
    out = rows.select(list(_LINE)).take(pa.array(kept, pa.int64())).combine_chunks()
    for name, values in (("room", left), ("open", still)):
        at = out.schema.get_field_index(name)
        out = out.set_column(at, name, pa.array(values, out.schema.field(name).type))
    return pa.RecordBatch.from_arrays([c.combine_chunks() for c in out.columns], names=list(_LINE))
