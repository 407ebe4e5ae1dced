"""Entitlements: role grants, personal overrides, capability rules and column masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillworks.schemas import CAPABILITIES


def role_permissions_of(
    permissions: DataFrame, role_permissions: DataFrame, role: str | None = None
) -> DataFrame:
    """(role, permission) for one role or all."""
    granted = role_permissions if role is None else role_permissions.filter(F.col("role") == role)
    names = permissions.select(F.col("id").alias("permission_id"), "permission")
    return granted.join(names, "permission_id").select("role", "permission").distinct()


def effective_permissions(
    users: DataFrame,
    permissions: DataFrame,
    role_permissions: DataFrame,
    user_permissions: DataFrame,
) -> DataFrame:
    """(user_id, permission): role permissions plus granted minus revoked overrides.

    Works on ids until the end. One aggregate over (user, permission) replaces union, distinct
    and anti-join: an override decides where there is one, else the role does.
    """
    members = users.select(F.col("id").alias("user_id"), "role")
    by_role = (
        members.join(role_permissions.select("role", "permission_id"), "role")
        .select("user_id", "permission_id", F.lit(None).cast("boolean").alias("granted"))
    )
    own = user_permissions.join(members, "user_id", "left_semi").select(
        "user_id", "permission_id", "granted"
    )
    held = (
        by_role.unionByName(own)
        .groupBy("user_id", "permission_id")
        .agg(F.coalesce(F.bool_and("granted"), F.lit(True)).alias("held"))
        .filter("held")
    )
    names = permissions.select(F.col("id").alias("permission_id"), "permission")
    return held.join(names, "permission_id").select("user_id", "permission")


def permission_sets(users: DataFrame, grants: DataFrame) -> DataFrame:
    """(user_id, permissions as a sorted array) for every user; bounded by the permission list."""
    sets = grants.groupBy("user_id").agg(F.sort_array(F.collect_set("permission")).alias("p"))
    none = F.array().cast("array<string>")
    return (
        users.select(F.col("id").alias("user_id"))
        .join(sets, "user_id", "left")
        .select("user_id", F.coalesce("p", none).alias("permissions"))
    )


def _rule(capability: str):
    met = F.lit(True)
    for group in CAPABILITIES[capability]:
        met = met & F.arrays_overlap("permissions", F.array(*[F.lit(p) for p in group]))
    return met


def has_capability(checks: DataFrame, users: DataFrame, grants: DataFrame) -> DataFrame:
    """Adds ``allowed`` to (user_id, capability) rows; unknown users or capabilities get false."""
    allowed = F.lit(False)
    for capability in CAPABILITIES:
        allowed = F.when(F.col("capability") == capability, _rule(capability)).otherwise(allowed)
    sets = permission_sets(users, grants)
    return (
        checks.join(sets, "user_id", "left")
        .withColumn("allowed", F.coalesce(allowed, F.lit(False)))
        .drop("permissions")
    )


def capability_flags(users: DataFrame, grants: DataFrame) -> DataFrame:
    """One row per user, one boolean column per capability."""
    return permission_sets(users, grants).select(
        "user_id", *[_rule(name).alias(name) for name in CAPABILITIES]
    )


def allowed(grants: DataFrame, requester_id: int, capability: str) -> Column:
    """One boolean value: may the requester do this? For use in a filter."""
    mine = grants.filter(F.col("user_id") == requester_id)
    return mine.agg(F.collect_set("permission").alias("permissions")).select(
        F.coalesce(_rule(capability), F.lit(False)).alias("allowed")
    ).scalar()


def gate(df: DataFrame, grants: DataFrame, requester_id: int, capability: str) -> DataFrame:
    """``df`` for a requester who has the capability, no rows for any other."""
    return df.filter(allowed(grants, requester_id, capability))


def permission_matrix(users: DataFrame, permissions: DataFrame, grants: DataFrame) -> DataFrame:
    """(user_id, permission, held) for every user and every permission.

    The permission names, a short list that only a release of the application changes, travel
    as one array value next to each user; no join is needed to lay them out.
    """
    every = permissions.agg(F.sort_array(F.collect_set("permission")).alias("p")).scalar()
    return (
        permission_sets(users, grants)
        .withColumn("permission", F.explode(every))
        .select(
            "user_id", "permission",
            F.array_contains("permissions", F.col("permission")).alias("held"),
        )
    )


def mask_cost(products: DataFrame, grants: DataFrame, requester_id: int) -> DataFrame:
    """``cost_price`` becomes NULL unless the requester may see it."""
    may_see = allowed(grants, requester_id, "see_cost")
    return products.withColumn("cost_price", F.when(may_see, F.col("cost_price")))


def hide_cost(products: DataFrame) -> DataFrame:
    """For a requester known not to see costs: the column is never read."""
    return products.drop("cost_price")
