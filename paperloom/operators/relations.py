"""References, children, roles and the latest of many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reference(rows: DataFrame, parents: DataFrame, key: str, columns: list[str], name: str, parent_key: str = "id", required: bool = False) -> DataFrame:
    """``rows`` with a struct of the parent's columns; null where the key is null or finds none (inner if required)."""
    side = parents.select(F.col(parent_key).alias("__key"), F.struct(*columns).alias(name))
    return rows.join(side, F.col(key) == F.col("__key"), "inner" if required else "left").drop("__key")


def references(rows: DataFrame, parents: DataFrame, roles: dict[str, str], columns: list[str]) -> DataFrame:
    """One parent table in several roles: key column -> name of the struct."""
    for key, name in roles.items():
        rows = reference(rows, parents, key, columns, name)
    return rows


def children(rows: DataFrame, items: DataFrame, parent: str, order: list[tuple[str, bool]], columns: list[str], name: str, key: str = "id") -> DataFrame:
    """``rows`` with a sorted array of child structs, empty without any. Page the parents first: the array keeps one row each."""
    wanted = [c for c, _ in order] + [c for c in columns if c not in {c for c, _ in order}]

    def before(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for c, down in reversed(order):
            less, more = (F.lit(1), F.lit(-1)) if down else (F.lit(-1), F.lit(1))
            out = F.when(a[c] < b[c], less).when(a[c] > b[c], more).otherwise(out)
        return out

    item = F.struct(*wanted)
    grouped = items.groupBy(F.col(parent).alias("__key")).agg(F.collect_list(item).alias("__items"))
    ordered = grouped.select("__key", F.transform(F.array_sort("__items", before), lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias(name))
    joined = rows.join(ordered, F.col(key) == F.col("__key"), "left").drop("__key")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(ordered.schema[name].dataType)))


def roles_by_user(user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """(user_id, roles): trimmed names, each once, in code point order."""
    named = user_roles.join(roles.select(F.col("id").alias("role_id"), "name"), "role_id").filter("name IS NOT NULL")
    return named.groupBy("user_id").agg(F.sort_array(F.collect_set(F.trim("name"))).alias("roles"))


def with_roles(staff: DataFrame, user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """Staff with their roles; an empty list without any."""
    found = roles_by_user(user_roles, roles)
    joined = staff.join(found, staff.identity_user_id == found.user_id, "left").drop("user_id")
    return joined.withColumn("roles", F.coalesce("roles", F.expr("CAST(array() AS array<string>)")))


def active_administrators(staff: DataFrame, user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """(administrators): how many active people hold the role."""
    joined = (
        staff.filter("is_active").select("identity_user_id")
        .join(user_roles, F.col("identity_user_id") == F.col("user_id"))
        .join(roles.filter("name = 'Administrator'").select(F.col("id").alias("role_id")), "role_id")
    )
    return joined.agg(F.count_distinct("identity_user_id").alias("administrators"))


def people_by_role(staff: DataFrame, user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """(name, people): how many active people hold each role, a person counted once however often the role is given."""
    held = staff.filter("is_active").select("identity_user_id").join(user_roles, F.col("identity_user_id") == F.col("user_id"))
    return held.join(roles.select(F.col("id").alias("role_id"), "name"), "role_id").groupBy("name").agg(F.count_distinct("identity_user_id").alias("people"))


def access_state(staff: DataFrame, users: DataFrame, staff_id: str, user_id: str) -> DataFrame:
    """(must_change_password) of an active person whose two ids belong together, else no row."""
    person = staff.filter((F.col("id") == staff_id) & (F.col("identity_user_id") == user_id) & F.col("is_active")).select("identity_user_id")
    return person.join(users, F.col("identity_user_id") == users.id).select("must_change_password")


def active_under_active_parent(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows that are active and whose parent is."""
    alive = parents.filter("is_active").select(F.col("id").alias("__key"))
    return rows.filter("is_active").join(alive, F.col(key) == F.col("__key"), "left_semi")


def latest(rows: DataFrame, key: str, order: str | Column, value: str, name: str, count: str | None = None) -> DataFrame:
    """(key, name): the value of the greatest order; with ``count``, also how many rows the key has."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(name), *([F.count(F.lit(1)).alias(count)] if count else []))


def next_number(parents: DataFrame, rows: DataFrame, key: str, number: str, name: str = "next", parent_key: str = "id") -> DataFrame:
    """(parent_key, name): one more than the greatest number, 1 without any."""
    most = rows.groupBy(F.col(key).alias("__key")).agg(F.max(number).alias("__most"))
    joined = parents.join(most, F.col(parent_key) == F.col("__key"), "left")
    return joined.select(parent_key, (F.coalesce("__most", F.lit(0)) + 1).alias(name))


def role_change(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """(user_id, added, removed) from two tables of (user_id, roles)."""
    both = current.withColumnRenamed("roles", "old").join(wanted.withColumnRenamed("roles", "new"), "user_id", "full_outer")
    none = F.expr("CAST(array() AS array<string>)")
    old, new = F.coalesce("old", none), F.coalesce("new", none)
    return both.select("user_id", F.sort_array(F.array_except(new, old)).alias("added"), F.sort_array(F.array_except(old, new)).alias("removed"))


def may_replace_roles(changes: DataFrame, administrators: int) -> DataFrame:
    """``changes`` with ``allowed``: the last active administrator keeps the role."""
    losing = F.array_contains("removed", "Administrator")
    return changes.withColumn("allowed", ~losing | F.lit(administrators > 1))
