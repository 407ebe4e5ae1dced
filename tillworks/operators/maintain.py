"""Table maintenance as batches of changes: each returns the new table and the refused changes.

Changes carry ``seq``, their order. Keys are checked against the table as it stands before the
batch plus the batch's own earlier claims; a key that the batch itself would free counts as taken.
Per-key decisions are aggregates (first claim by ``min``/``min_by``), so a key that fills much of
a batch is combined before the shuffle rather than collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillworks.functions.text import sha256_hex
from tillworks.operators.ids import with_new_ids
from tillworks.operators.quality import fill_defaults
from tillworks.schemas import (
    DEFAULTS,
    DOMAINS,
    PERMISSIONS,
    REQUIRED,
    ROLES,
    SELLER_PERMISSIONS,
    TABLES,
    UNIQUE,
)

PRODUCT_FIELDS = tuple(
    c for c in TABLES["products"].names if c not in ("id", "created_at", "modified_at")
)


@dataclass
class Changed:
    table: DataFrame
    refused: DataFrame


def _any(conditions: list[Column]) -> Column:
    met = F.lit(False)
    for c in conditions:
        met = met | c
    return met


def _first_claims(claims: DataFrame, keys: list[str]) -> DataFrame:
    """The first claim per key; rows with a NULL key part never collide and are left out."""
    complete = claims.dropna(subset=keys)
    return complete.groupBy(*keys).agg(F.min("seq").alias("seq"))


def _outside(domains: dict[str, tuple[str, ...]]) -> Column:
    """A value lies outside its set; NULL passes."""
    return _any([F.coalesce(~F.col(c).isin(*v), F.lit(False)) for c, v in domains.items()])


def insert_unique(
    table: DataFrame,
    rows: DataFrame,
    keys: list[str],
    required: tuple[str, ...] = (),
    domains: dict[str, tuple[str, ...]] | None = None,
    last_id: int = 0,
) -> Changed:
    """Append ``rows`` under new ids; the first of equal keys wins, taken keys are refused.

    ``last_id`` is the highest id the table ever had, where higher than those in it.

    Rows that lack a required value or hold one outside its set are refused and claim no key.
    """
    missing = _any([F.col(c).isNull() for c in required])
    outside = _outside({c: v for c, v in (domains or {}).items() if c in rows.columns})
    faulty = missing | outside
    complete = rows.filter(~faulty)
    free = _first_claims(complete, keys).join(
        table.select(*keys).dropna(), keys, "left_anti"
    )
    judged = complete.join(free.withColumn("_first", F.lit(True)), [*keys, "seq"], "left")
    passed = _any([F.col(k).isNull() for k in keys]) | F.col("_first").isNotNull()
    added = with_new_ids(
        judged.filter(passed).select(*rows.columns), table, ["seq"], last_id
    )
    values = [
        F.col(f.name).cast(f.dataType).alias(f.name) if f.name in added.columns
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in table.schema
    ]
    fault = F.when(missing, F.lit("missing_value")).otherwise(F.lit("bad_value"))
    refused = rows.filter(faulty).withColumn("reason", fault).unionByName(
        judged.filter(~passed).select(*rows.columns, F.lit("duplicate").alias("reason"))
    )
    return Changed(table.unionByName(added.select(*values)), refused)


def hash_passwords(rows: DataFrame) -> DataFrame:
    """User rows with ``password`` replaced by ``password_hash``; no password gives no hash."""
    return rows.withColumn("password_hash", sha256_hex("password")).drop("password")


def insert_rows(name: str, table: DataFrame, rows: DataFrame, last_id: int = 0) -> Changed:
    """``insert_unique`` with the unique key, required fields and value sets of the named table."""
    return insert_unique(
        table, rows, list(UNIQUE[name][0]), REQUIRED[name], DOMAINS.get(name), last_id
    )


def insert_products(
    products: DataFrame, rows: DataFrame, now: Column, last_id: int = 0
) -> Changed:
    """New products with their defaults; name and sale price must be given."""
    named = rows.withColumn("product_name", F.nullif("product_name", F.lit("")))
    defaults = DEFAULTS["products"]
    absent = {
        c: F.lit(None).cast(TABLES["products"][c].dataType)
        for c in defaults if c not in rows.columns
    }
    filled = fill_defaults("products", named.withColumns(absent), now)
    stamped = filled.withColumn("modified_at", now)
    return insert_rows("products", products, stamped, last_id)


def _key_conflicts(
    table: DataFrame, wanted: DataFrame, keys: list[str]
) -> DataFrame:
    """``wanted`` (seq, id, keys) that claim a key owned by, or claimed earlier for, another id."""
    claims = wanted.dropna(subset=keys)
    winners = claims.groupBy(*keys).agg(F.min_by("id", "seq").alias("_winner"))
    owners = table.select(*keys, F.col("id").alias("_owner")).dropna(subset=keys)
    holders = winners.join(owners, keys, "left").select(
        *keys, F.coalesce("_owner", "_winner").alias("_holder")
    )
    return claims.join(holders, keys).filter(F.col("_holder") != F.col("id")).select("seq")


def _judge(
    table: DataFrame, changes: DataFrame, keys: list[str], new_key, supplied: Column,
    fault: Column,
) -> DataFrame:
    """``changes`` with a reason; NULL means the change is applied.

    ``fault`` is the reason a change is refused for its own values, or NULL.
    """
    known = table.select("id", *[F.col(k).alias(f"_now_{k}") for k in keys])
    found = changes.join(known.withColumn("_known", F.lit(True)), "id", "left")
    wanted = found.filter(supplied & F.col("_known") & fault.isNull()).select(
        "seq", "id", *[new_key(k).alias(k) for k in keys]
    )
    clashes = _key_conflicts(table, wanted, keys).withColumn("_clash", F.lit(True))
    reason = (
        F.when(~supplied, "nothing_to_change")
        .when(F.col("_known").isNull(), "not_found")
        .when(fault.isNotNull(), fault)
        .when(F.col("_clash").isNotNull(), "duplicate")
    )
    return found.join(clashes, "seq", "left").select(*changes.columns, reason.alias("reason"))


def update_rows(name: str, table: DataFrame, changes: DataFrame) -> Changed:
    """``update_partial`` with the unique key and value sets of the named table."""
    return update_partial(table, changes, list(UNIQUE[name][0]), DOMAINS.get(name))


def update_partial(
    table: DataFrame,
    changes: DataFrame,
    keys: list[str],
    domains: dict[str, tuple[str, ...]] | None = None,
) -> Changed:
    """Overwrite only the supplied (non-NULL) fields; the last supplied value per field wins."""
    fields = [c for c in changes.columns if c not in ("seq", "id")]
    supplied = _any([F.col(c).isNotNull() for c in fields])

    def new_key(k):
        now = F.col(f"_now_{k}")
        return F.coalesce(F.col(k), now) if k in fields else now

    outside = _outside({c: v for c, v in (domains or {}).items() if c in fields})
    judged = _judge(table, changes, keys, new_key, supplied, F.when(outside, "bad_value"))
    latest = (
        judged.filter("reason is null")
        .groupBy("id")
        .agg(
            *[
                F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_new_{c}")
                for c in fields
            ]
        )
    )
    merged = table.join(latest, "id", "left").select(
        *[
            F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c)
            for c in table.columns
        ]
    )
    return Changed(merged, judged.filter("reason is not null"))


def update_products(products: DataFrame, changes: DataFrame, now: Column) -> Changed:
    """Overwrite the fields named in ``fields`` (array); here a named NULL does overwrite.

    Names outside the white list are ignored. ``modified_at`` is set.
    """
    fields = [c for c in changes.columns if c in PRODUCT_FIELDS]
    names = F.array(*[F.lit(c) for c in fields])
    cleaned = changes.withColumn("fields", F.array_intersect("fields", names))
    required = [c for c in REQUIRED["products"] if c in fields]
    broken = _any([F.array_contains("fields", c) & F.col(c).isNull() for c in required])

    def new_key(k):
        now_value = F.col(f"_now_{k}")
        if k not in fields:
            return now_value
        return F.when(F.array_contains("fields", k), F.col(k)).otherwise(now_value)

    judged = _judge(
        products, cleaned, ["barcode"], new_key, F.size("fields") > 0,
        F.when(broken, "missing_value"),
    )
    named = {c: F.array_contains("fields", c) for c in fields}
    latest = (
        judged.filter("reason is null")
        .groupBy("id")
        .agg(
            *[F.max_by(c, F.when(named[c], F.col("seq"))).alias(f"_new_{c}") for c in fields],
            *[F.bool_or(named[c]).alias(f"_set_{c}") for c in fields],
        )
        .withColumn("_hit", F.lit(True))
    )

    def value(c):
        if c in fields:
            return F.when(F.col(f"_set_{c}"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
        if c == "modified_at":
            return F.when(F.col("_hit"), now).otherwise(F.col(c)).alias(c)
        return F.col(c)

    merged = products.join(latest, "id", "left").select(*[value(c) for c in products.columns])
    return Changed(merged, judged.filter("reason is not null"))


def soft_delete_products(products: DataFrame, ids: DataFrame, now: Column) -> Changed:
    """Mark as inactive; ids that do not exist are refused."""
    marks = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    joined = products.join(marks, "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    merged = joined.select(
        *[
            F.when(hit, F.lit(False)).otherwise(F.col(c)).alias(c) if c == "active"
            else F.when(hit, now).otherwise(F.col(c)).alias(c) if c == "modified_at"
            else F.col(c)
            for c in products.columns
        ]
    )
    return Changed(merged, _not_found(products, ids))


def _not_found(table: DataFrame, ids: DataFrame) -> DataFrame:
    return (
        ids.select("id").distinct().join(table.select("id"), "id", "left_anti")
        .withColumn("reason", F.lit("not_found"))
    )


def hard_delete(table: DataFrame, ids: DataFrame) -> Changed:
    return Changed(table.join(ids.select("id"), "id", "left_anti"), _not_found(table, ids))


def guarded_delete(
    dimension: DataFrame, ids: DataFrame, products: DataFrame, column: str
) -> Changed:
    """Delete categories or suppliers unless an active product refers to them."""
    in_use = products.filter("active").select(F.col(column).alias("id")).distinct()
    judged = (
        ids.select("id").distinct()
        .join(dimension.select("id", F.lit(True).alias("_known")), "id", "left")
        .join(in_use.withColumn("_used", F.lit(True)), "id", "left")
        .select("id", F.when(F.col("_known").isNull(), "not_found")
                .when(F.col("_used"), "in_use").alias("reason"))
    )
    return _remove(dimension, judged)


def _remove(table: DataFrame, judged: DataFrame) -> Changed:
    gone = judged.filter("reason is null").select("id")
    return Changed(table.join(gone, "id", "left_anti"), judged.filter("reason is not null"))


@dataclass
class DeletedUsers:
    users: DataFrame
    user_permissions: DataFrame
    refused: DataFrame


def delete_users(
    users: DataFrame, user_permissions: DataFrame, requester_id: int, ids: DataFrame
) -> DeletedUsers:
    """Delete users with their overrides.

    The requester cannot delete themselves if no other administrator would be left.
    """
    wanted = ids.select("id").distinct()
    admin = F.col("role") == ROLES[0]
    others_left = (
        users.filter(admin & (F.col("id") != requester_id))
        .join(wanted, "id", "left_anti")
        .agg((F.count(F.lit(1)) > 0).alias("x"))
        .scalar()
    )
    judged = wanted.join(users.select("id", "role"), "id", "left").select(
        "id",
        F.when(F.col("role").isNull(), "not_found")
        .when((F.col("id") == requester_id) & admin & ~others_left, "last_admin")
        .alias("reason"),
    )
    done = _remove(users, judged)
    gone = judged.filter("reason is null").select(F.col("id").alias("user_id"))
    return DeletedUsers(
        done.table,
        user_permissions.join(gone, "user_id", "left_anti").select(*user_permissions.columns),
        done.refused,
    )


def _with_permission_id(changes: DataFrame, permissions: DataFrame) -> DataFrame:
    ids = permissions.select(F.col("id").alias("permission_id"), "permission")
    return changes.join(ids, "permission", "left")


def _unknown_permission(named: DataFrame, columns: list[str]) -> DataFrame:
    return named.filter("permission_id is null").select(
        *columns, F.lit("unknown_permission").alias("reason")
    )


def set_user_permissions(
    user_permissions: DataFrame, permissions: DataFrame, changes: DataFrame, last_id: int = 0
) -> Changed:
    """Upsert overrides (seq, user_id, permission, granted); the last change per pair wins."""
    named = _with_permission_id(changes, permissions)
    pair = ["user_id", "permission_id"]
    latest = (
        named.filter("permission_id is not null")
        .groupBy(*pair)
        .agg(F.max_by("granted", "seq").alias("granted"))
    )
    kept = user_permissions.join(latest.select(*pair), pair, "left_anti")
    added = with_new_ids(latest, user_permissions, pair, last_id)
    columns = user_permissions.columns
    return Changed(
        kept.select(*columns).unionByName(added.select(*columns)),
        _unknown_permission(named, changes.columns),
    )


def grant_role(
    role_permissions: DataFrame, permissions: DataFrame, changes: DataFrame, last_id: int = 0
) -> Changed:
    """Add (role, permission) pairs that are not there yet."""
    named = _with_permission_id(changes, permissions)
    pair = ["role", "permission_id"]
    wanted = named.filter("permission_id is not null").select(*pair).distinct()
    missing = wanted.join(role_permissions.select(*pair), pair, "left_anti")
    added = with_new_ids(missing, role_permissions, pair, last_id)
    return Changed(
        role_permissions.unionByName(added.select(*role_permissions.columns)),
        _unknown_permission(named, changes.columns),
    )


def revoke_role(
    role_permissions: DataFrame, permissions: DataFrame, changes: DataFrame
) -> Changed:
    """Remove (role, permission) pairs; unknown names and absent pairs are refused."""
    named = _with_permission_id(changes, permissions)
    pair = ["role", "permission_id"]
    wanted = named.filter("permission_id is not null")
    absent = wanted.join(role_permissions.select(*pair), pair, "left_anti").select(
        *changes.columns, F.lit("not_found").alias("reason")
    )
    return Changed(
        role_permissions.join(wanted.select(*pair), pair, "left_anti")
        .select(*role_permissions.columns),
        _unknown_permission(named, changes.columns).unionByName(absent),
    )


def seed_permissions(
    permissions: DataFrame, role_permissions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Add the standard permissions and role grants that are missing.

    Administrators get every permission in the table, sellers the two selling ones.
    """
    spark = permissions.sparkSession
    standard = spark.createDataFrame(
        [(i, name) for i, name in enumerate(PERMISSIONS)], "seq long, permission string"
    )
    all_permissions = insert_unique(permissions, standard, ["permission"]).table
    admin, seller = ROLES
    grants = all_permissions.select(F.lit(admin).alias("role"), "permission").unionByName(
        all_permissions.filter(F.col("permission").isin(*SELLER_PERMISSIONS)).select(
            F.lit(seller).alias("role"), "permission"
        )
    )
    return all_permissions, grant_role(role_permissions, all_permissions, grants).table
