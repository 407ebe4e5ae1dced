"""Product feeds: delimited, JSON-lines or Parquet files of text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillworks.schemas import FEED_COLUMNS, FEED_REQUIRED
from tillworks.session import settle
from tillworks.sources.tables import string_schema

ROW_NO = "row_no"


_CSV = {"header": "true", "escape": '"'}


def numbered_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text) of delimited files: records numbered from 1 in each file.

    Files are read in parallel, in splits of any size. A record ends with a line up to whose end the
    file has an even number of quotes. Each split counts its lines' quotes and then the records that
    start in it, and sums over the splits before it (one row per split) give each line its place. Line
    breaks within a record read as ``\\n``; a quote that is never closed makes the rest of its file one
    record.
    """
    value = F.col("value")
    lines = settle(
        spark.read.text(path).select(
            "value", F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"),
            (F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))).alias("quotes"),
        ), "feed-lines")
    split = ["file", "block"]
    within = Window.partitionBy(*split).orderBy("at").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)

    def before(rows: DataFrame, what: str) -> DataFrame:
        sums = rows.groupBy(*split).agg(F.sum(what).alias("_n"))
        return sums.select(*split, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))

    closed = lines.withColumn("_so_far", F.sum("quotes").over(within)).join(
        before(lines, "quotes"), split).withColumn("_so_far", F.col("_so_far") + F.col("_before"))
    starts = (F.col("_so_far") - F.col("quotes")) % 2 == 0
    marked = settle(closed.select(
        "value", *split, "at", starts.cast("long").alias("starts"),
        (starts & (F.col("_so_far") % 2 == 0)).alias("whole")), "feed-starts")
    placed = marked.withColumn("_so_far", F.sum("starts").over(within)).join(
        before(marked, "starts"), split).withColumn("record", F.col("_so_far") + F.col("_before"))
    joined = placed.filter("not whole").groupBy("file", "record").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))),
                    lambda x: x["value"]), "\n").alias("text"))
    return placed.filter("whole").select("file", "record", value.alias("text")).unionByName(joined)


def _read_delimited(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.read.options(multiLine=True, **_CSV).csv(path).columns
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    records = numbered_records(spark, path)
    sizes = records.groupBy("file").agg((F.max("record") - 1).alias("_n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    first = sizes.select("file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rows = records.filter("record > 1 and text <> ''").join(first, "file").select(
        (F.col("record") + F.col("_before")).alias("_place"),
        F.from_csv("text", schema, _CSV).alias("_row"))
    if ROW_NO in columns:
        return rows.select("_row.*")
    return rows.select(F.col("_place").cast("string").alias(ROW_NO), "_row.*")


def read_product_feed(spark: SparkSession, path: str, file_format: str = "csv") -> DataFrame:
    """(row_no, id, barcode, ...), all text but the row number.

    The first line of a delimited file is its header, the same in all files of a feed. Rows without a
    row number in the file are numbered by their place: from 2, the line after the header, and on
    through the files by name; empty lines count and are left out. JSON lines and Parquet must bring
    the row number. Refused unless product name, barcode and sale price headers are present (JSON
    lines have no header: there a missing key is NULL); absent optional columns are NULL. A row number
    that is none reads as NULL, and the import refuses that row. Quoted texts may hold line breaks, and
    a quote in them is doubled.
    """
    if file_format == "csv":
        raw = _read_delimited(spark, path)
    elif file_format == "json":
        raw = spark.read.schema(string_schema([ROW_NO, *FEED_COLUMNS])).json(path)
    elif file_format == "parquet":
        raw = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown feed format: {file_format}")
    absent = [h for h in (ROW_NO, *FEED_REQUIRED) if h not in raw.columns]
    if absent:
        raise ValueError("the feed lacks the headers: " + ", ".join(absent))
    return raw.select(
        F.col(ROW_NO).try_cast("long").alias(ROW_NO),
        *[
            (F.col(f"`{h}`") if h in raw.columns else F.lit(None)).cast("string").alias(c)
            for h, c in FEED_COLUMNS.items()
        ],
    )


def write_feed(feed: DataFrame, path: str) -> None:
    """A feed under its file headers, as delimited text."""
    heads = {c: h for h, c in FEED_COLUMNS.items()}
    feed.select(ROW_NO, *[F.col(c).alias(h) for c, h in heads.items()]).write.options(
        **_CSV
    ).csv(path)
