"""Full copies of all tables, and restoring them as a new version."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks.functions.dates import file_stamp
from tillworks.operators.quality import integrity_report
from tillworks.schemas import SNAPSHOT, TABLES
from tillworks.sources.tables import commit_tables, current, read_table, write_files

_MANIFEST = "table_name string, n_rows long"


def export_snapshot(spark: SparkSession, root: str, out: str, now: dt.datetime) -> str:
    """Copy every table to ``out/{SNAPSHOT}_{time}``; returns that folder.

    The manifest with the row counts is written last: a folder without one is not a snapshot.
    """
    folder = f"{out}/{SNAPSHOT}_{file_stamp(now)}"
    counts = [
        (name, write_files(read_table(spark, root, name), f"{folder}/{name}")) for name in TABLES
    ]
    spark.createDataFrame(counts, _MANIFEST).coalesce(1).write.json(f"{folder}/manifest")
    return folder


def read_snapshot(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a complete snapshot; refused if a table is missing or short."""
    rows = spark.read.schema(_MANIFEST).json(f"{folder}/manifest").collect()
    listed = {r.table_name: r.n_rows for r in rows}
    if set(listed) != set(TABLES):
        raise ValueError("the snapshot does not list exactly the known tables")
    tables = {n: spark.read.schema(s).parquet(f"{folder}/{n}") for n, s in TABLES.items()}
    for name, df in tables.items():
        if df.count() != listed[name]:
            raise ValueError(f"the snapshot of {name} is not complete")
    return tables


_FAULTS = {"missing": "required value missing", "key": "key repeated",
           "domain": "value outside its set"}


def snapshot_faults(tables: dict[str, DataFrame]) -> list[str]:
    """Tables that break a required column, a primary id or unique key, or a value set; each table is
    read once.

    Dangling references are legal.
    """
    faults = []
    for name, df in tables.items():
        broken = integrity_report(name, df).filter("n_bad > 0").collect()
        kinds = {r.kind for r in broken}
        faults += [f"{name}: {text}" for kind, text in _FAULTS.items() if kind in kinds]
    return faults


def restore_snapshot(
    spark: SparkSession, folder: str, root: str, safety: str, now: dt.datetime
) -> int:
    """Replace all tables by a snapshot, as a new version; the present state is copied first."""
    tables = read_snapshot(spark, folder)
    faults = snapshot_faults(tables)
    if faults:
        raise ValueError("; ".join(faults))
    if current(spark, root):
        export_snapshot(spark, root, safety, now)
    return commit_tables(spark, root, tables)
