"""New row ids: dense, growing, never one that was given before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillworks.session import settle

_PART_BITS = 33  # monotonically_increasing_id holds the partition above so many bits


def with_new_ids(
    rows: DataFrame, table: DataFrame | None, order_by: list[str], last_id: int = 0
) -> DataFrame:
    """``rows`` with consecutive ids above those of ``table``, growing in the given order.

    ``last_id`` is the highest id the table ever had (``sources.tables.last_ids``), so that ids of
    deleted rows are not given again; with it the table need not be read (None). Range partitions number their own rows and add what the
    partitions before them hold, so there is no global sort in one task. The numbered rows are
    written first, because generated ids must not change when a part is computed again.
    """
    highest = F.lit(0) if table is None else table.agg(
        F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    numbered = settle(
        rows.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_n", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_n", _PART_BITS))
        .withColumn("_n", F.col("_n").bitwiseAND((1 << _PART_BITS) - 1)),
        "new-ids",
    )
    # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_size")).select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")
    )
    first = F.greatest(highest, F.lit(last_id)) + 1
    return (
        numbered.join(offsets, "_part")
        .withColumn("id", first + F.col("_before") + F.col("_n"))
        .drop("_n", "_part", "_before")
    )
