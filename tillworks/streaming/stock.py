"""Stock movements as a stream; the current products table is the state."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillworks.operators.stock import apply_movements, stock_after
from tillworks.sources.tables import Rewrite, commit, current, read_table, versions


def movement_log(spark: SparkSession, root: str, log_path: str, name: str) -> DataFrame | None:
    """The movements that the stream ``name`` has applied; None if there are none yet.

    Folders whose commit never happened, as after a failure, are left out.
    """
    try:
        logged = spark.read.parquet(f"{log_path}/stream={name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    done = versions(spark, root).filter(F.col("tag").startswith(f"{name}/")).select(
        F.substring_index("tag", "/", -1).alias("commit")
    ).distinct()
    return logged.join(done, "commit", "left_semi").drop("commit")


def stream_movements(
    movements: DataFrame, root: str, log_path: str, checkpoint: str, order_by: list[str], name: str
) -> StreamingQuery:
    """Apply each micro-batch to the products table under ``root`` and commit a new version.

    Within a batch, movements apply in the total order ``order_by``, whose values tell the movements
    of the stream ``name`` apart: those that its log already has are not applied again, whatever
    batch they come in, so neither a batch that Spark runs twice nor a lost checkpoint changes
    anything. A movement with a NULL among these values cannot be told apart; it goes to the log
    with the reason ``bad_order`` and is not applied. Streams of other names share nothing but the
    products. The log is written before the commit that makes it valid, and read only in the range of
    the batch. A commit writes only the product files that hold a moved product. One stream writes to
    a root at a time; if another writer comes in between, the batch fails and runs again.
    """
    if not name or "/" in name:
        raise ValueError("a stream needs a name without slashes")

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = order_by[0]
        base = current(spark, root)
        unordered = F.lit(False)
        for c in order_by:
            unordered = unordered | F.col(c).isNull()
        refused, batch = batch.filter(unordered), batch.filter(~unordered)
        low, high = batch.agg(F.min(first), F.max(first)).first()
        known = movement_log(spark, root, log_path, name)
        if known is not None and low is not None:
            span = known.filter(F.col(first).between(F.lit(low), F.lit(high)))
            batch = batch.join(span.select(*order_by), order_by, "left_anti")
        if batch.isEmpty() and refused.isEmpty():
            return
        products = read_table(spark, root, "products", base)
        applied = apply_movements(products, batch, order_by).unionByName(
            refused.withColumns({
                "stock": F.lit(None).cast("long"), "reason": F.lit("bad_order")}))
        tag = uuid.uuid4().hex
        folder = f"{log_path}/stream={name}/commit={tag}"
        applied.write.parquet(folder)
        written = spark.read.schema(applied.schema).parquet(folder)
        now = F.convert_timezone(None, F.lit("UTC"), F.localtimestamp())
        moved = written.filter("reason is null").select(F.col("product_id").alias("id"))
        commit(spark, root, {"products": Rewrite(
            moved, lambda part: stock_after(part, written, order_by, now))}, f"{name}/{tag}", base)

    return (
        movements.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
