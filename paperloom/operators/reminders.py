"""Deadline reminders of a business date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["incoming_document_id", "recipient_staff_id", "reminder_kind", "reminder_date"]
DAYS_BEFORE = 3


def reminder_kind(deadline: Column, today: Column, days_before: int = DAYS_BEFORE) -> Column:
    """Overdue before today, DueDate today, BeforeDeadline exactly ``days_before`` ahead, else null."""
    return (
        F.when(deadline < today, F.lit("Overdue"))
        .when(deadline == today, F.lit("DueDate"))
        .when(deadline == F.date_add(today, days_before), F.lit("BeforeDeadline"))
    )


def candidates(docs: DataFrame, today: Column, days_before: int = DAYS_BEFORE) -> DataFrame:
    """Reminders that open, assigned documents call for."""
    kind = reminder_kind(F.col("deadline"), today, days_before)
    due = docs.filter((F.col("status") != "Completed") & F.col("assigned_to_staff_id").isNotNull()).withColumn("reminder_kind", kind)
    return due.filter("reminder_kind IS NOT NULL").select(
        F.col("id").alias("incoming_document_id"), F.col("assigned_to_staff_id").alias("recipient_staff_id"), "reminder_kind", today.alias("reminder_date")
    )


def run_day(docs: DataFrame, history: DataFrame, today: Column, now: Column, days_before: int = DAYS_BEFORE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, new reminders, counts of overdue, created, existing) of one run.

    Open documents past their deadline become overdue, assigned or not. Reminders that
    the history has are not made again, so a repeated run changes nothing.
    """
    late = F.coalesce(~F.col("status").isin("Completed", "Overdue") & (F.col("deadline") < today), F.lit(False))
    marked = docs.withColumn("__late", late)
    new_docs = marked.withColumns(
        {"status": F.when(F.col("__late"), F.lit("Overdue")).otherwise(F.col("status")), "updated_at": F.when(F.col("__late"), now).otherwise(F.col("updated_at"))}
    ).drop("__late")
    # Documents and history meet once, and all three counts are of what they make there.
    asks = (F.col("status") != "Completed") & F.col("assigned_to_staff_id").isNotNull()
    kind = F.when(asks, reminder_kind(F.col("deadline"), today, days_before))
    asked = docs.select(late.alias("__late"), F.col("id").alias("incoming_document_id"), F.col("assigned_to_staff_id").alias("recipient_staff_id"), kind.alias("reminder_kind"), today.alias("reminder_date"))
    there = history.filter(F.col("reminder_date") == today).select(*KEY).distinct().withColumn("__there", F.lit(True))
    met = asked.join(there, KEY, "left").withColumn("__new", F.col("reminder_kind").isNotNull() & F.col("__there").isNull())
    new = met.filter("__new").select(*KEY).withColumns(
        {"id": F.sha2(F.concat_ws("|", *KEY), 256), "delivery_status": F.lit("Unread"), "created_at": now, "read_at": F.lit(None).cast("timestamp")}
    )
    counts = met.agg(F.count_if("__late").alias("overdue"), F.count_if("__new").alias("created"), F.count_if(F.col("reminder_kind").isNotNull() & F.col("__there")).alias("existing"))
    return new_docs, new.select(*history.columns), counts
