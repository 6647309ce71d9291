"""Reports written as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(metrics: DataFrame, gates: DataFrame, cases: DataFrame, path: str) -> None:
    """Metrics (one row) with their gates, and a line for each case."""
    listed = gates.agg(F.collect_list(F.struct(*gates.columns)).alias("gates"))  # a few gates
    metrics.join(listed).coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    cases.write.mode("overwrite").json(f"{path}/cases")
