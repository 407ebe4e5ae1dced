"""Daily sales totals over a stream of sales."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillworks.schemas import COMPLETED


def stream_table(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.parquet(path)


# watermarks need a TIMESTAMP; taken apart and put together, so that no session time zone enters
_INSTANT = (
    "timestamp_seconds(unix_date(cast(sold_at as date)) * 86400L + hour(sold_at) * 3600 "
    "+ minute(sold_at) * 60 + extract(second from sold_at))"
)
_DAY = "cast(date_from_unix_date(int(unix_seconds(w.start) div 86400)) as timestamp_ntz)"


def daily_payment_totals(sales: DataFrame, late: str = "1 day") -> DataFrame:
    """Completed sales per day and payment type.

    A day is final once the watermark, the newest sale minus ``late``, has passed its end; state is
    one row per open day and payment type.
    """
    counted = sales.filter(F.col("status") == COMPLETED).withColumn("sold_at", F.expr(_INSTANT))
    return (
        counted.withWatermark("sold_at", late)
        .groupBy(F.window("sold_at", "1 day").alias("w"), "payment_type")
        .agg(F.sum("total").alias("total_sales"), F.count("id").alias("n_sales"))
        .select(F.expr(_DAY).alias("day"), "payment_type", "total_sales", "n_sales")
    )


def write_daily_totals(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append final days to a Parquet folder until the available input is used up."""
    return (
        totals.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# --- days that are closed, with what came too late -----------------------------------------

_NEVER = "0001-01-01"
_ALWAYS = "9999-12-31"


def _folder(path: str, part: str, batch_id: int) -> str:
    return f"{path}/{part}/batch={batch_id}"


def _read(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(f"{schema}, batch long").parquet(f"{path}/{part}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, batch long")


_MARKS = "newest timestamp_ntz, closed date"
_SUMS = "day date, payment_type string, total_sales decimal(28,2), n_sales long"


def closed_before(spark: SparkSession, path: str, batch_id: int | None = None) -> str:
    """The first day that is still open, as of the batches before ``batch_id`` (or all)."""
    marks = _read(spark, path, "marks", _MARKS)
    if batch_id is not None:
        marks = marks.filter(F.col("batch") < batch_id)
    return marks.agg(F.max("closed").cast("string")).first()[0] or _NEVER


def write_day_sums(
    sales: DataFrame, path: str, checkpoint: str, late: str = "1 day"
) -> StreamingQuery:
    """Add up completed sales by day and payment type, batch by batch, below ``path``.

    After each batch the days before the newest sale minus ``late`` are closed. A completed sale of a
    day that earlier batches closed is not counted: it goes whole to ``late_sales``. Each batch writes
    its own sums, one row per day and payment type, under its number, so a batch that runs twice
    changes nothing. ``path`` belongs to this checkpoint. Sales without a time are late as well.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        closed = F.lit(closed_before(spark, path, batch_id)).cast("date")
        counted = batch.filter(F.col("status") == COMPLETED).withColumn(
            "day", F.col("sold_at").cast("date"))
        behind = F.coalesce(F.col("day") < closed, F.lit(True))
        counted.filter(behind).drop("day").write.mode("overwrite").parquet(
            _folder(path, "late", batch_id))
        on_time = counted.filter(~behind)
        on_time.groupBy("day", "payment_type").agg(
            F.sum("total").cast("decimal(28,2)").alias("total_sales"),
            F.count("id").alias("n_sales"),
        ).coalesce(1).write.mode("overwrite").parquet(_folder(path, "sums", batch_id))
        earlier = _read(spark, path, "marks", _MARKS).filter(F.col("batch") < batch_id)
        newest = on_time.agg(F.max("sold_at").alias("newest")).union(
            earlier.agg(F.max("newest"))).agg(F.max("newest").alias("newest"))
        open_from = (F.col("newest") - F.expr(f"interval '{late}'")).cast("date")
        newest.select("newest", F.greatest(open_from, closed).alias("closed")).write.mode(
            "overwrite").parquet(_folder(path, "marks", batch_id))

    return (
        sales.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def close_days(spark: SparkSession, path: str) -> None:
    """Close all days, as at the end of a stream; what comes later is late."""
    last = _read(spark, path, "marks", _MARKS).agg(F.max("batch")).first()[0]
    marks = spark.createDataFrame([(None, dt.date.fromisoformat(_ALWAYS))], _MARKS)
    # beside the mark of the last batch, which the batches after it see
    marks.write.mode("append").parquet(_folder(path, "marks", -1 if last is None else last))


def day_sums(spark: SparkSession, path: str) -> DataFrame:
    """day, payment_type, total_sales, n_sales and is_closed, of all batches so far."""
    closed = F.lit(closed_before(spark, path)).cast("date")
    return _read(spark, path, "sums", _SUMS).groupBy("day", "payment_type").agg(
        F.sum("total_sales").cast("decimal(28,2)").alias("total_sales"),
        F.sum("n_sales").alias("n_sales"),
    ).withColumn("is_closed", F.col("day") < closed)


def late_sales(spark: SparkSession, path: str) -> DataFrame:
    """The sales that came after their day was closed, with the batch they came in."""
    return spark.read.parquet(f"{path}/late")
