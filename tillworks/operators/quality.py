"""Integrity checks and column defaults."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillworks.schemas import DEFAULTS, DOMAINS, REFERENCES, REQUIRED, UNIQUE


def check_not_null(name: str, table: DataFrame) -> DataFrame:
    """(table_name, column_name, n_bad) for every required column, from one scan."""
    columns = [c for c in REQUIRED[name] if c in table.columns]
    counts = table.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "n_bad").select(
        F.lit(name).alias("table_name"), "column_name", "n_bad"
    )


@dataclass
class Typed:
    good: DataFrame
    quarantine: DataFrame


def conform_types(raw: DataFrame, schema: T.StructType) -> Typed:
    """All-text rows to the strict schema; rows with a value that does not fit are set aside."""
    fields = [f for f in schema if f.name in raw.columns]
    typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in fields}
    bad = [
        F.when(F.col(f.name).isNotNull() & typed[f.name].isNull(), F.lit(f.name)) for f in fields
    ]
    marked = raw.withColumn("bad_columns", F.array_compact(F.array(*bad)))
    clean = F.size("bad_columns") == 0
    return Typed(
        marked.filter(clean).select(*[typed[f.name].alias(f.name) for f in fields]),
        marked.filter(~clean),
    )


def check_unique(table: DataFrame, keys: list[str]) -> DataFrame:
    """Key values held by several rows, with their number; a NULL key part never collides."""
    return (
        table.select(*keys)
        .dropna()
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .filter("n_rows > 1")
    )


def check_unique_keys(name: str, table: DataFrame) -> list[DataFrame]:
    return [check_unique(table, list(keys)) for keys in UNIQUE.get(name, ())]


def check_domain(table: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Rows whose value is outside the set; NULL passes."""
    return table.filter(~F.col(column).isin(*values))


def check_domains(name: str, table: DataFrame) -> dict[str, DataFrame]:
    return {c: check_domain(table, c, v) for c, v in DOMAINS.get(name, {}).items()}


def integrity_report(name: str, table: DataFrame) -> DataFrame:
    """(table_name, kind, columns, n_bad) of all declared rules of a table.

    Kinds: ``key`` (values of the id or of a unique key that several rows hold), ``missing`` (rows
    without a required value), ``domain`` (rows with a value outside its set). Rows are counted in one
    pass without a shuffle; each key is one more pass over its own columns, grouped by them as they are.
    """
    held = set(table.columns)
    counts = {("missing", c): F.col(c).isNull() for c in REQUIRED[name] if c in held}
    counts |= {("domain", c): ~F.col(c).isin(*v) for c, v in DOMAINS.get(name, {}).items()}
    rule = "named_struct('kind', '{}', 'columns', '{}', 'n_bad', {})"
    found = [table.agg(*[F.count_if(when).alias("_".join(r)) for r, when in counts.items()]).select(
        F.inline(F.array(*[F.expr(rule.format(*r, f"`{'_'.join(r)}`")) for r in counts])))]
    for key in (("id",), *UNIQUE.get(name, ())):
        repeated = check_unique(table, list(key)).agg(F.count(F.lit(1)).alias("n_bad"))
        found.append(repeated.select(
            F.lit("key").alias("kind"), F.lit(",".join(key)).alias("columns"), "n_bad"))
    if not counts:
        found = found[1:]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(F.lit(name).alias("table_name"), "kind", "columns", "n_bad")


def check_reference(child: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """Rows of ``child`` that point to no row of ``parent``; NULL points nowhere and passes."""
    pointing = child.filter(F.col(column).isNotNull())
    return pointing.join(parent.select(F.col("id").alias(column)), column, "left_anti").select(
        *child.columns
    )


def orphan_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(child, column_name, parent, n_orphans) for the declared references.

    The child is reduced to (value, rows) first, so a value shared by many rows is one row in the
    join.
    """
    found = None
    for child, column, parent in REFERENCES:
        values = (
            tables[child]
            .filter(F.col(column).isNotNull())
            .groupBy(F.col(column).alias("id"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        count = (
            values.join(tables[parent].select("id"), "id", "left_anti")
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_orphans"))
            .select(
                F.lit(child).alias("child"),
                F.lit(column).alias("column_name"),
                F.lit(parent).alias("parent"),
                "n_orphans",
            )
        )
        found = count if found is None else found.unionByName(count)
    return found


def fill_defaults(name: str, rows: DataFrame, now: Column) -> DataFrame:
    """NULLs of the columns that have a default become that default."""
    filled = {}
    for column, default in DEFAULTS.get(name, {}).items():
        if column in rows.columns:
            value = now if default == "now" else F.lit(default).cast(rows.schema[column].dataType)
            filled[column] = F.coalesce(F.col(column), value)
    return rows.withColumns(filled)
