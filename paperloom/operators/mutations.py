"""Changes as pure functions: an old snapshot and a request give a new snapshot and an outcome.

A Parquet table has no row updates, and there is a single writer for each table. The plans
are those of a MERGE where the tables' format has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inserted(rows: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """``rows`` and the new ones, stamped; columns that a new row lacks are null."""
    stamped = new.withColumns({"created_at": now, "updated_at": now})
    return rows.unionByName(stamped.select(*[c for c in rows.columns if c in stamped.columns]), allowMissingColumns=True)


def one_per_key(rows: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """The last row of each key by ``order``; ties, and all without an order, go to the greatest row, column by column."""
    whole = F.struct(*([F.col(order).alias("__order")] if order else []), *rows.columns)
    return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.max(whole).alias("__last")).select(*[F.col("__last")[c].alias(c) for c in rows.columns])


def patched(rows: DataFrame, patches: DataFrame, columns: list[str], now: Column | None = None, key: str = "id", order: str | None = None) -> DataFrame:
    """Sparse update: ``patches`` has the key and pairs has_x, x. A present null clears, an absent column stays.

    A key given twice takes its last patch as of ``one_per_key``.
    """
    side = one_per_key(patches, [key], order).select(F.col(key).alias("__key"), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for p in columns for c in (p, f"has_{p}")])
    joined = rows.join(side, F.col(key) == F.col("__key"), "left")
    out = {c: F.when(F.coalesce(F.col(f"__has_{c}"), F.lit(False)), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}
    if now is not None:
        out["updated_at"] = F.when(F.col("__hit"), now).otherwise(F.col("updated_at"))
    return joined.withColumns(out).select(*rows.columns)


def compare_and_set(rows: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Rows that meet the condition get the values; ``changed`` says which did."""
    hit = F.coalesce(condition, F.lit(False))
    marked = rows.withColumn("changed", hit)
    return marked.withColumns({c: F.when(F.col("changed"), v).otherwise(F.col(c)) for c, v in values.items()})


def affected(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if("changed").alias("affected"))


def insert_absent(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` and those of the new ones whose key isn't there; a key given twice comes in once."""
    return rows.unionByName(new.dropDuplicates(key).join(rows.select(*key), key, "left_anti").select(*rows.columns))


def upserted(rows: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """The new rows take the place of those with their keys; a key given twice comes in once, as of ``one_per_key``."""
    new = one_per_key(new, key, order)
    return rows.join(new.select(*key), key, "left_anti").select(*rows.columns).unionByName(new.select(*rows.columns))


def deleted(rows: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(keys.select(*key), key, "left_anti").select(*rows.columns)


def deactivated(members: DataFrame, member_id: str, now: Column) -> DataFrame:
    """Soft delete; ``changed`` is false everywhere if the member is already inactive or unknown."""
    return compare_and_set(members, (F.col("id") == member_id) & (F.col("status") == "Active"), {"status": F.lit("Inactive"), "updated_at": now})


def marked_read(history: DataFrame, reminder_id: str, recipient: str, now: Column) -> DataFrame:
    """The first reading sets the time; later ones change nothing."""
    mine = (F.col("id") == reminder_id) & (F.col("recipient_staff_id") == recipient) & (F.col("delivery_status") == "Unread")
    return compare_and_set(history, mine, {"delivery_status": F.lit("Read"), "read_at": now})


def seed_catalog(types: DataFrame, templates: DataFrame, definitions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Types and templates with what was missing of the definitions, and the counts.

    What exists stays as it is; a template isn't made under an inactive type.
    ``definitions`` has code, name, description, template_name, template_content, format_rules.
    """
    wanted = definitions.dropDuplicates(["code"])
    missing = wanted.join(types.select("code"), "code", "left_anti")
    made = missing.select(F.concat(F.lit("type:"), "code").alias("id"), "code", "name", "description", F.lit(True).alias("is_active"))  # a rerun makes the same ids
    all_types = inserted(types, made, now)
    placed = definitions.join(all_types.select(F.col("id").alias("document_type_id"), "code", F.col("is_active").alias("alive")), "code")
    exists = templates.select("document_type_id", F.col("name").alias("template_name"), F.lit(True).alias("known"))
    state = placed.join(exists, ["document_type_id", "template_name"], "left")
    new = state.filter("known IS NULL AND alive").select(
        F.concat_ws(":", F.lit("template"), "code", "template_name").alias("id"), "document_type_id", F.col("template_name").alias("name"),
        "template_content", "format_rules", F.lit(True).alias("is_active"),
    )
    counts = state.agg(
        F.count_if(F.col("known").isNull() & F.col("alive")).alias("templates_created"),
        F.count_if(F.col("known").isNotNull()).alias("templates_preserved"),
        F.count_if(F.col("known").isNull() & ~F.col("alive")).alias("templates_skipped"),
    )
    return all_types, inserted(templates, new, now), counts
