"""Versioned tables: Parquet files named by lists, and one small file per version.

``root/versions/v000000000012.json`` names, for each table, the folders that list its files, its number
of rows and the highest id it ever held. A list has one row per data file: path, rows, least and
greatest id. Files are never changed: an append adds files and a list, a rewrite replaces only the files
that hold given ids, and versions share all others. Only the newest version file is read.

A commit writes data and lists first and its version file last, under a number that nobody has used;
if another writer was first, appends go on top of that version and all else is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillworks.schemas import TABLES
from tillworks.session import settle

LAYOUT = {"sales": ("sold_at", "id"), "sale_lines": ("sale_id", "id")}
MOST_LISTS = 32  # lists of a table before an append writes them as one
_FILES = "path string, n_rows long, low long, high long"
_VERSION = (
    "version long, tag string, tables map<string, struct<lists array<string>, n_rows long, "
    "last_id long>>"
)


class CommitConflict(Exception):
    """Another writer has committed since the tables were read."""


@dataclass(frozen=True)
class Stored:
    """A table of a version."""

    lists: tuple[str, ...] = ()
    n_rows: int = 0
    last_id: int = 0


@dataclass(frozen=True)
class Version:
    version: int = 0
    tables: dict[str, Stored] = field(default_factory=dict)

    def __bool__(self) -> bool:
        return self.version > 0


# --- reading -------------------------------------------------------------------------------


def _hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _version_names(spark: SparkSession, root: str) -> list[str]:
    folder = _hadoop_path(spark, f"{root}/versions")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    return [n for n in (s.getPath().getName() for s in fs.listStatus(folder)) if n[0] == "v"]


def versions(spark: SparkSession, root: str) -> DataFrame:
    """(version, tag) of all commits; reads every version file, so for looking back only."""
    try:
        return spark.read.schema(_VERSION).json(f"{root}/versions/v*.json").select("version", "tag")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "version long, tag string")


def current(spark: SparkSession, root: str) -> Version:
    """The newest version; false if nothing was ever committed."""
    names = _version_names(spark, root)
    if not names:
        return Version()
    row = spark.read.schema(_VERSION).json(f"{root}/versions/{max(names)}").first()
    return Version(row.version, {
        name: Stored(tuple(t.lists), t.n_rows, t.last_id) for name, t in row.tables.items()})


def last_ids(spark: SparkSession, root: str) -> dict[str, int]:
    """table name -> the highest id that any version of the table ever held."""
    return {name: t.last_id for name, t in current(spark, root).tables.items()}


def table_files(spark: SparkSession, stored: Stored | None) -> DataFrame:
    """path, n_rows, low and high (id) of the files of a table."""
    if stored is None or not stored.lists:
        return spark.createDataFrame([], _FILES)
    return spark.read.schema(_FILES).parquet(*stored.lists)


def _read_files(spark: SparkSession, name: str, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], TABLES[name])
    return spark.read.schema(TABLES[name]).parquet(*paths)


def _paths(files: DataFrame) -> list[str]:
    return sorted(r.path for r in files.select("path").collect())


def read_table(
    spark: SparkSession, root: str, name: str, version: Version | None = None
) -> DataFrame:
    """A table of the current (or given) version under its fixed schema; empty if never written."""
    stored = (version or current(spark, root)).tables.get(name)
    return _read_files(spark, name, _paths(table_files(spark, stored)))


def as_stored(name: str, df: DataFrame) -> DataFrame:
    """``df`` under the stored schema: columns in order, missing ones NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[name]
        ]
    )


def write_files(df: DataFrame, path: str, layout: tuple[str, ...] = ()) -> int:
    """Write a Parquet folder and return its row count (read from the file footers).

    ``layout`` puts rows close in its columns into the same files, so that row-group statistics
    prune ranges of them; its last column is a key that also divides a run of equal values.
    """
    if layout:
        df = df.repartitionByRange(*layout).sortWithinPartitions(*layout)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).count()


# --- changes -------------------------------------------------------------------------------


def _write_part(spark: SparkSession, root: str, name: str, rows: DataFrame) -> DataFrame:
    """Write rows as new files of a table; returns their list, from the id column of the new files."""
    path = f"{root}/data/{name}/{uuid.uuid4().hex}"
    layout = LAYOUT.get(name, ("id",))
    as_stored(name, rows).repartitionByRange(*layout).sortWithinPartitions(*layout) \
        .write.parquet(path)
    written = spark.read.schema(TABLES[name]).parquet(path)
    return written.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count("*").alias("n_rows"), F.min("id").alias("low"), F.max("id").alias("high"))


def _write_list(spark: SparkSession, root: str, name: str, files: DataFrame) -> Stored:
    path = f"{root}/lists/{name}/{uuid.uuid4().hex}"
    files.write.parquet(path)
    row = spark.read.schema(_FILES).parquet(path).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)), F.coalesce(F.max("high"), F.lit(0))).first()
    return Stored((path,), row[0], row[1])


@dataclass(frozen=True)
class Replace:
    """All rows of a table anew."""

    rows: DataFrame

    def write(self, spark: SparkSession, root: str, name: str, old: Stored) -> Stored:
        new = _write_list(spark, root, name, _write_part(spark, root, name, self.rows))
        return Stored(new.lists, new.n_rows, max(old.last_id, new.last_id))


@dataclass(frozen=True)
class Append:
    """New rows; no file of the table is read or written again."""

    rows: DataFrame

    def write(self, spark: SparkSession, root: str, name: str, old: Stored) -> Stored:
        return _write_list(spark, root, name, _write_part(spark, root, name, self.rows))

    def onto(self, spark: SparkSession, root: str, name: str, old: Stored, new: Stored) -> Stored:
        lists = (*old.lists, *new.lists)
        if len(lists) > MOST_LISTS:
            every = table_files(spark, Stored(lists))
            lists = _write_list(spark, root, name, every.coalesce(1)).lists
        return Stored(lists, old.n_rows + new.n_rows, max(old.last_id, new.last_id))


@dataclass(frozen=True)
class Rewrite:
    """Change the rows with the given ids: ``change`` turns the files that hold them into new rows.

    ``change`` gets whole files, so it must leave rows of other ids as they are. Files are found by their
    range of ids and then by their id column, which is all that is read of files without such ids.
    """

    ids: DataFrame
    change: Callable[[DataFrame], DataFrame]
    added: DataFrame | None = None

    def write(self, spark: SparkSession, root: str, name: str, old: Stored) -> Stored:
        files = table_files(spark, old)
        ids = settle(self.ids.select(F.col("id").cast("long")).distinct(), "changed-ids")
        low, high = ids.agg(F.min("id"), F.max("id")).first()
        touched: list[str] = []
        if low is not None:
            near = _paths(files.filter((F.col("high") >= low) & (F.col("low") <= high)))
            if near:
                held = spark.read.schema("id long").parquet(*near).select(
                    "id", F.col("_metadata.file_path").alias("path"))
                touched = _paths(held.join(ids, "id", "left_semi").select("path").distinct())
        gone = spark.createDataFrame([(p,) for p in touched], "path string")
        kept = files.join(gone, "path", "left_anti")
        parts = [self.change(_read_files(spark, name, touched))] if touched else []
        parts += [self.added] if self.added is not None else []
        for rows in parts:
            kept = kept.unionByName(_write_part(spark, root, name, rows))
        if not parts:
            return old
        new = _write_list(spark, root, name, kept.coalesce(1))
        return Stored(new.lists, new.n_rows, max(old.last_id, new.last_id))


Change = Replace | Append | Rewrite


# --- commits -------------------------------------------------------------------------------


def _publish(
    spark: SparkSession, root: str, version: int, tables: dict[str, Stored], tag: str | None
) -> bool:
    """Write a version file unless that version exists; whether it was written.

    The file is complete before it gets its name, and renaming does not overwrite. That is one step in
    HDFS; on a local disk the test and the renaming are two.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    final = _hadoop_path(spark, f"{root}/versions/v{version:012d}.json")
    draft = _hadoop_path(spark, f"{root}/versions/_draft-{uuid.uuid4().hex}")
    text = json.dumps({"version": version, "tag": tag, "tables": {
        name: {"lists": t.lists, "n_rows": t.n_rows, "last_id": t.last_id}
        for name, t in sorted(tables.items())}})
    fs = draft.getFileSystem(conf)
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    options = spark.sparkContext._gateway.new_array(
        getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(fs.makeQualified(draft), fs.makeQualified(final), options)
    except Py4JJavaError as error:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def commit(
    spark: SparkSession, root: str, changes: dict[str, Change], tag: str | None = None,
    base: Version | None = None,
) -> int:
    """Make a new version with the changed tables; the others stay as they are. Returns it.

    ``base`` is the version that the changes were made from, if not the newest. If another commit came
    in between, appends are put on top of it, and any other change raises CommitConflict. Folders
    that a failed or refused commit left behind are never read.
    """
    before = current(spark, root) if base is None else base
    made = {
        name: change.write(spark, root, name, before.tables.get(name, Stored()))
        for name, change in changes.items()
    }
    while True:
        tables = dict(before.tables)
        for name, new in made.items():
            if isinstance(changes[name], Append):
                old = before.tables.get(name, Stored())
                new = changes[name].onto(spark, root, name, old, new)
            tables[name] = new
        if _publish(spark, root, before.version + 1, tables, tag):
            return before.version + 1
        if not all(isinstance(c, Append) for c in changes.values()):
            raise CommitConflict(f"version {before.version + 1} was committed by another writer")
        before = current(spark, root)


def commit_tables(
    spark: SparkSession, root: str, tables: dict[str, DataFrame], tag: str | None = None
) -> int:
    """Write the given tables whole as a new version; the others stay as they are. Returns it.

    ``tag`` is kept with the version, for writers that must know whether a commit happened.
    """
    return commit(spark, root, {name: Replace(df) for name, df in tables.items()}, tag)


def is_tagged(spark: SparkSession, root: str, tag: str) -> bool:
    return not versions(spark, root).filter(F.col("tag") == tag).isEmpty()


def string_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])
