"""State transitions of incoming and outgoing documents, as compare-and-set plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mutations import compare_and_set, one_per_key


def assignment_suggested(docs: DataFrame, suggestions: DataFrame, now: Column, order: str | None = None) -> DataFrame:
    """Take in suggestions (id, decision, staff_id, reason): Suggested sets the suggestion columns, any other decision clears them.

    A confirmed assignment is left alone. Of several suggestions for a document the last by
    ``order`` holds, as of ``one_per_key``.
    """
    side = one_per_key(suggestions, ["id"], order).select(F.col("id").alias("__id"), "decision", "staff_id", "reason")
    joined = docs.join(side, F.col("id") == F.col("__id"), "left")
    hit, yes = F.col("__id").isNotNull(), F.col("decision") == "Suggested"
    put = lambda value, old, kind: F.when(hit & yes, value).when(hit, F.lit(None).cast(kind)).otherwise(F.col(old))
    return joined.withColumns(
        {
            "suggested_staff_id": put(F.col("staff_id"), "suggested_staff_id", "string"),
            "assignment_suggestion_reason": put(F.col("reason"), "assignment_suggestion_reason", "string"),
            "assignment_confidence": F.when(hit, F.lit(None).cast("decimal(5,4)")).otherwise(F.col("assignment_confidence")),
            "assignment_suggested_at": put(now, "assignment_suggested_at", "timestamp"),
            "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        }
    ).select(*docs.columns)


def assignment_confirmed(docs: DataFrame, doc_id: str, staff_id: str, confirmed_by: str, now: Column) -> DataFrame:
    """A new document goes in progress, other open ones keep their state; completed ones don't change."""
    return compare_and_set(
        docs,
        (F.col("id") == doc_id) & (F.col("status") != "Completed"),
        {
            "assigned_to_staff_id": F.lit(staff_id),
            "assignment_confirmed_by_staff_id": F.lit(confirmed_by),
            "assignment_confirmed_at": now,
            "status": F.when(F.col("status") == "New", F.lit("InProgress")).otherwise(F.col("status")),
            "updated_at": now,
        },
    )


def completed(docs: DataFrame, doc_id: str, caller: str, is_clerk: bool, now: Column) -> DataFrame:
    """In progress or overdue, assigned, by a clerk or the assignee."""
    may = F.lit(True) if is_clerk else F.col("assigned_to_staff_id") == caller
    ready = F.col("status").isin("InProgress", "Overdue") & F.col("assigned_to_staff_id").isNotNull()
    return compare_and_set(docs, (F.col("id") == doc_id) & ready & may, {"status": F.lit("Completed"), "completed_at": now, "updated_at": now})


def draft_saved(docs: DataFrame, doc_id: str, seen_status: str, seen_at: Column, content: str, now: Column) -> DataFrame:
    """An AI draft, if the document is as it was seen. The first draft is kept for good; later ones count as editing."""
    first = F.col("ai_draft_content").isNull()
    return compare_and_set(
        docs,
        (F.col("id") == doc_id) & (F.col("status") == seen_status) & (F.col("updated_at") == seen_at),
        {
            "status": F.when(first, F.lit("AiDraft")).otherwise(F.lit("Editing")),
            "content": F.lit(content),
            "ai_draft_content": F.coalesce("ai_draft_content", F.lit(content)),
            "updated_at": now,
        },
    )


def review_claimed(docs: DataFrame, doc_id: str, seen_at: Column, now: Column) -> DataFrame:
    open_states = F.col("status").isin("Editing", "AiDraft", "ReviewFailed")
    return compare_and_set(docs, (F.col("id") == doc_id) & open_states & (F.col("updated_at") == seen_at), {"status": F.lit("PendingReview"), "updated_at": now})


def review_committed(docs: DataFrame, history: DataFrame, reviews: DataFrame, now: Column, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents and history after reviews (outgoing_document_id, review_source, reviewed_by_staff_id, review_result, review_issues).

    Only documents that were claimed take part. Several reviews of a document are attempts
    one after the other, by ``order`` and then by all columns: each is in the history, with
    numbers that go on from the last one there, and the last sets the document's state. A
    review that is repeated in all columns is one attempt.
    """
    claimed = docs.filter("status = 'PendingReview'").select(F.col("id").alias("outgoing_document_id"), F.col("content").alias("content_snapshot"))
    last = history.groupBy("outgoing_document_id").agg(F.max("attempt_no").alias("last"))
    turn = Window.partitionBy("outgoing_document_id").orderBy(*([order] if order else []), F.struct(*[c for c in reviews.columns if c != order]))
    numbered = reviews.distinct().withColumn("__turn", F.row_number().over(turn))
    rows = numbered.join(claimed, "outgoing_document_id").join(last, "outgoing_document_id", "left")
    rows = rows.withColumn("attempt_no", (F.coalesce("last", F.lit(0)) + F.col("__turn")).cast("int")).drop("last")
    rows = rows.withColumns({"id": F.concat_ws(":", "outgoing_document_id", "attempt_no"), "reviewed_at": now})
    deciding = rows.groupBy("outgoing_document_id").agg(F.max_by(F.struct("review_result", "review_issues"), "__turn").alias("r"))
    done = deciding.select(
        F.col("outgoing_document_id").alias("__id"), F.col("r.review_issues").alias("__issues"),
        F.when(F.col("r.review_result") == "Failed", F.lit("ReviewFailed")).otherwise(F.lit("PendingApproval")).alias("__status"),
    )
    joined = docs.join(done, F.col("id") == F.col("__id"), "left")
    hit = F.col("__id").isNotNull()
    new_docs = joined.withColumns(
        {
            "status": F.coalesce("__status", "status"),
            "review_issues": F.coalesce("__issues", "review_issues"),
            "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        }
    ).select(*docs.columns)
    return new_docs, history.unionByName(rows.select(*history.columns))


def approval_decided(docs: DataFrame, history: DataFrame, decisions: DataFrame, now: Column, order: str | None = None) -> DataFrame:
    """Decisions (id, leader_id, decision Approve or Return) on documents that wait for approval and whose last review passed.

    Approve sets the approver, Return clears it and reopens editing; ``changed`` says which
    took effect. Of several valid decisions on a document the first by ``order`` does (then
    by all columns): after it the document waits no more.
    """
    passed = history.groupBy(F.col("outgoing_document_id").alias("__id")).agg(F.max_by("review_result", "attempt_no").alias("__result"))
    rank = F.struct(*([F.col(order).alias("__order")] if order else []), "decision", "leader_id")
    first = decisions.filter(F.col("decision").isin("Approve", "Return")).groupBy(F.col("id").alias("__doc")).agg(F.min(rank).alias("__first"))
    side = first.select("__doc", "__first.leader_id", "__first.decision")
    joined = docs.join(side, F.col("id") == F.col("__doc"), "left").join(passed, F.col("id") == F.col("__id"), "left")
    ready = F.col("decision").isNotNull() & (F.col("status") == "PendingApproval") & (F.col("__result") == "Passed")
    yes = F.col("decision") == "Approve"
    out = compare_and_set(
        joined,
        ready,
        {
            "status": F.when(yes, F.lit("Approved")).otherwise(F.lit("Editing")),
            "approved_by_staff_id": F.when(yes, F.col("leader_id")),
            "approved_at": F.when(yes, now),
            "updated_at": now,
        },
    )
    return out.select(*docs.columns, "changed")


def archived(docs: DataFrame, doc_id: str, reference_number: str, issued_date, now: Column) -> DataFrame:
    """An extension: an approved document gets its number and date together; the number must be free."""
    taken = docs.filter(F.col("reference_number") == reference_number).select(F.lit(True).alias("__taken")).limit(1)
    joined = docs.join(F.broadcast(taken), F.lit(True), "left")  # one row at most
    out = compare_and_set(
        joined,
        (F.col("id") == doc_id) & (F.col("status") == "Approved") & F.col("__taken").isNull(),
        {"status": F.lit("Archived"), "reference_number": F.lit(reference_number), "issued_date": F.lit(issued_date), "archived_at": now, "updated_at": now},
    )
    return out.drop("__taken")
