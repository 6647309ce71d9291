"""Constraint audits: the rows that break a rule or share a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def row_violations(rows: DataFrame, rules: dict[str, str], key: str = "id") -> DataFrame:
    """(key, rule) for each row and rule whose SQL is false; null passes. One scan for all rules."""
    broken = [F.when(~F.expr(sql), F.lit(name)) for name, sql in rules.items()]
    return rows.select(key, F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, rows) of keys that several rows have; keys with a null don't count."""
    return rows.dropna(subset=key).groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def missing_parents(rows: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Rows whose key isn't null and has no parent."""
    return rows.filter(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def written_with_counts(rows: DataFrame, write: Callable[[DataFrame], None], counts: dict[str, Column]) -> dict[str, int]:
    """Let ``write`` write the rows, and count in the same pass: name -> how many rows meet a condition, and ``rows`` of all.

    ``write`` runs one job over what it is given; a task that is retried counts once.
    """
    seen = Observation()
    write(rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()]))
    return dict(seen.get)


def audited_write(rows: DataFrame, rules: dict[str, str], write: Callable[[DataFrame], None]) -> dict[str, int]:
    """Write the rows with the names of the rules that each breaks in ``broken``; how many break each rule is counted meanwhile."""
    broken = F.array_compact(F.array(*[F.when(~F.expr(sql), F.lit(name)) for name, sql in rules.items()]))
    return written_with_counts(rows.withColumn("broken", broken), write, {name: F.array_contains("broken", name) for name in rules})
