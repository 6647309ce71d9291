"""A document with all that its page shows: references in their roles and attachments with who added them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .listing import ORDERS, Page, page_of
from .relations import children, reference, references

PERSON = ["id", "full_name", "position"]
ATTACHMENT = ["id", "file_name", "extraction_status", "extraction_error", "uploaded_at", "uploaded_by"]
#: What a reminder shows of its document.
DOCUMENT = ["id", "reference_number", "sender_org", "summary", "deadline", "status"]
#: Attachments stand in the order in which they came.
BY_TIME = [("uploaded_at", False), ("id", False)]


def attachments(rows: DataFrame, staff: DataFrame, person: list[str] = PERSON) -> DataFrame:
    """Attachments with a struct of the person who uploaded them."""
    return reference(rows, staff, "uploaded_by_staff_id", person, "uploaded_by")


def _with_attachments(docs: DataFrame, files: DataFrame, staff: DataFrame, parent: str) -> DataFrame:
    mine = files.filter(F.col(parent).isNotNull()).join(docs.select(F.col("id").alias(parent)), parent, "left_semi")
    return children(docs, attachments(mine, staff), parent, BY_TIME, ATTACHMENT, "attachments")


def incoming_details(docs: DataFrame, types: DataFrame, staff: DataFrame, files: DataFrame) -> DataFrame:
    """Incoming documents with type, suggested, assigned and confirming person, and their attachments. Page them first."""
    out = reference(docs, types, "document_type_id", ["id", "code", "name"], "document_type", required=True)
    roles = {"suggested_staff_id": "suggested_staff", "assigned_to_staff_id": "assigned_to", "assignment_confirmed_by_staff_id": "confirmed_by"}
    return _with_attachments(references(out, staff, roles, PERSON), files, staff, "incoming_document_id")


def outgoing_details(docs: DataFrame, templates: DataFrame, types: DataFrame, incoming: DataFrame, members: DataFrame, staff: DataFrame, files: DataFrame) -> DataFrame:
    """Outgoing documents with template and its type, related incoming document and member, drafter, approver, and their attachments. Page them first."""
    out = reference(docs, templates, "template_id", ["id", "name", "document_type_id"], "template", required=True)
    out = reference(out.withColumn("__type", F.col("template.document_type_id")), types, "__type", ["id", "code", "name"], "document_type", required=True).drop("__type")
    out = reference(out, incoming, "related_incoming_document_id", ["id", "reference_number", "summary"], "related_incoming_document")
    out = reference(out, members, "related_member_id", PERSON, "related_member")
    out = references(out, staff, {"drafted_by_staff_id": "drafted_by", "approved_by_staff_id": "approved_by"}, [*PERSON, "department"])
    return _with_attachments(out, files, staff, "outgoing_document_id")


def reminder_page(reminders: DataFrame, incoming: DataFrame, page: int | None = None, page_size: int | None = None) -> Page:
    """A page of reminders (as ``listing.reminders`` filters them), newest first, each with its incoming document."""
    cut = page_of(reminders, ORDERS["reminder_history"], page, page_size)
    with_document = reference(cut.items, incoming, "incoming_document_id", DOCUMENT, "incoming_document", required=True)
    return Page(with_document, cut.page, cut.page_size, cut.total)


def review_page(history: DataFrame, staff: DataFrame, outgoing_document_id, page: int | None = None, page_size: int | None = None) -> Page:
    """A page of a document's reviews, the last first, each with its reviewer; none for a rule's review."""
    mine = history.filter(F.col("outgoing_document_id") == F.lit(outgoing_document_id))
    cut = page_of(mine, ORDERS["review_history"], page, page_size)
    return Page(reference(cut.items, staff, "reviewed_by_staff_id", PERSON, "reviewed_by"), cut.page, cut.page_size, cut.total)
