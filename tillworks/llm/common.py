"""Helpers shared by the corpus operators: tables, text expressions, Arrow passes, numbering."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillworks.session import settle

#: words of the contracts that split at white space, as a Java pattern
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(number: Column | str, parts: int) -> Column:
    """crc32 of an id's text, modulo ``parts``; NULL for a NULL id."""
    return F.crc32(F.col(number).cast("string") if isinstance(number, str) else number) % parts


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fields(df: DataFrame, *names: str) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType) for n in names]


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow whose freed memory goes back to the system as it ends.

    Python workers outlive their tasks, and the next stage's would come on top of what they hold.
    """

    def run_and_trim(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
        if trim:
            trim(0)

    return run_and_trim


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside hand Python batches of some 4 MB, however long the rows are.

    Executor and worker hold a batch each; Spark's own limit is a number of rows or 16 times the
    size. A limit that the session sets itself stays.
    """
    if spark.conf.get(_BATCH_BYTES, None) is not None:
        yield
        return
    spark.conf.set(_BATCH_BYTES, "4m")
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_BYTES)


def map_text(
    df: DataFrame,
    text: str,
    added: list[T.StructField],
    start: Callable[[], Callable[[list], dict]],
    rows: int | None = None,
    keep: bool = False,
) -> DataFrame:
    """Replace the text column by columns computed from it, batch by batch, in Arrow.

    With ``rows``, of a larger batch so many texts at once; with ``keep`` the text stays before
    the new columns.

    ``start()`` runs once per task and returns a function from the texts of a batch (bytes in
    UTF-8, or None) to the added columns, each a list or array of the batch's length.
    """
    kept = [c for c in df.columns if c != text]
    schema = T.StructType([*fields(df, *kept, *[text] * keep), *added])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        work = start()
        for whole in batches:
            for at in range(0, whole.num_rows, rows or whole.num_rows or 1):
                batch = whole.slice(at, rows)
                made = work(batch.column(kept_at).cast(pa.binary()).to_pylist())
                columns = [batch.column(i) for i in range(kept_at + keep)]
                columns += [pa.array(made[f.name], arrow.field(f.name).type) for f in added]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(
                    [pa.field(n, c.type) for n, c in zip(arrow.names, columns)]))

    kept_at = len(kept)
    return df.select(*kept, text).mapInArrow(giving_back(run), schema)


#: bits of a filter by hash; its size is fixed, and when it is full it lets more rows through
FILTER_BITS = 1 << 24
_PAGE = 32768  # bits of one page of Spark's bitmaps


def filter_bits(hashes: DataFrame) -> np.ndarray:
    """Packed bits, one for each value of the upper bits of the column hash.

    Gathered by Spark page by page: 2 MB at most, whatever the number of rows.
    """
    upper = F.shiftrightunsigned("hash", 64 - (FILTER_BITS.bit_length() - 1)) + 1
    pages = hashes.select(upper.alias("bit")).groupBy(
        F.bitmap_bucket_number("bit").alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for page, bits in pages.collect():
        out[(page - 1) * _PAGE // 8: page * _PAGE // 8] = np.frombuffer(bits, np.uint8)
    return out


def passes(packed: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Which unsigned 64-bit hashes pass a filter."""
    bits = np.unpackbits(packed, bitorder="little").view(bool)
    shift = np.uint64(64 - (FILTER_BITS.bit_length() - 1))
    return lambda hashes: bits[hashes >> shift]


def keep_hashes(
    df: DataFrame, column: str, wanted: DataFrame, others: bool = False
) -> DataFrame:
    """Rows whose hash is among those wanted (one column), and by chance some others.

    Comes before a join with few of many rows, so that the rest need not be shuffled. With
    ``others`` exactly the rows that are left out otherwise; a NULL hash counts as 0.
    """
    shared = df.sparkSession.sparkContext.broadcast(
        filter_bits(wanted.toDF("hash").filter("hash IS NOT NULL")))
    at = df.columns.index(column)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kept = passes(shared.value)
        for batch in batches:
            hashes = batch.column(at).fill_null(0).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(kept(hashes.view(np.uint64)) != others))

    return df.mapInArrow(giving_back(run), df.schema)


def numbered(df: DataFrame, order: str, name: str, label: str) -> DataFrame:
    """Number rows 0, 1, ... by one column, NULL last, without a window over all rows.

    Rows are laid out by range and written, so that the layout stays as it is; then each range
    counts its rows, and the counts (one row per range) give the place of its first row.
    """
    n = partitions(df.sparkSession)
    laid = settle(
        df.repartitionByRange(n, F.col(order).asc_nulls_last())
        .withColumn("_range", F.spark_partition_id()), label,
    )
    within = Window.partitionBy("_range").orderBy(F.col(order).asc_nulls_last())
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = laid.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        laid.withColumn("_at", F.row_number().over(within))
        .join(starts, "_range")
        .withColumn(name, (F.col("_start") + F.col("_at") - 1).cast("long"))
        .drop("_range", "_at", "_start")
    )
