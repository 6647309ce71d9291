"""Tables of the document-operations model, with explicit types, and the domains of their codes."""

from __future__ import annotations

_ID = "id string NOT NULL"
_TIMES = "created_at timestamp NOT NULL, updated_at timestamp NOT NULL"

TABLES = {
    "members": f"{_ID}, full_name string NOT NULL, date_of_birth date, gender string, address string, phone string, email string, "
    f"position string, join_date date, status string NOT NULL, notes string, {_TIMES}",
    "staff": f"{_ID}, identity_user_id string NOT NULL, full_name string NOT NULL, position string, department string, "
    f"email string NOT NULL, phone string, is_active boolean NOT NULL, {_TIMES}",
    "users": f"{_ID}, must_change_password boolean NOT NULL",
    "roles": f"{_ID}, name string",
    "user_roles": "user_id string NOT NULL, role_id string NOT NULL",
    "document_types": f"{_ID}, code string NOT NULL, name string NOT NULL, description string, is_active boolean NOT NULL, {_TIMES}",
    "document_templates": f"{_ID}, document_type_id string NOT NULL, name string NOT NULL, template_content string NOT NULL, "
    f"format_rules string NOT NULL, is_active boolean NOT NULL, {_TIMES}",
    "incoming_documents": f"{_ID}, reference_number string NOT NULL, sender_org string NOT NULL, summary string NOT NULL, "
    "received_date date NOT NULL, deadline date NOT NULL, document_type_id string NOT NULL, suggested_staff_id string, "
    "assignment_suggestion_reason string, assignment_confidence decimal(5,4), assignment_suggested_at timestamp, "
    "assigned_to_staff_id string, assignment_confirmed_by_staff_id string, assignment_confirmed_at timestamp, "
    f"status string NOT NULL, completed_at timestamp, {_TIMES}",
    "outgoing_documents": f"{_ID}, template_id string NOT NULL, related_incoming_document_id string, related_member_id string, "
    "title string NOT NULL, content string NOT NULL, ai_draft_content string, drafted_by_staff_id string NOT NULL, "
    "status string NOT NULL, review_issues string NOT NULL, approved_by_staff_id string, approved_at timestamp, "
    f"reference_number string, issued_date date, archived_at timestamp, {_TIMES}",
    "attachments": f"{_ID}, incoming_document_id string, outgoing_document_id string, storage_key string NOT NULL, "
    "file_name string NOT NULL, uploaded_by_staff_id string NOT NULL, extraction_status string NOT NULL, extracted_text string, "
    "extraction_error string, extracted_at timestamp, uploaded_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "review_history": f"{_ID}, outgoing_document_id string NOT NULL, attempt_no int NOT NULL, review_source string NOT NULL, "
    "reviewed_by_staff_id string, content_snapshot string NOT NULL, review_result string NOT NULL, review_issues string NOT NULL, "
    "reviewed_at timestamp NOT NULL",
    "reminder_history": f"{_ID}, incoming_document_id string NOT NULL, recipient_staff_id string NOT NULL, reminder_kind string NOT NULL, "
    "reminder_date date NOT NULL, delivery_status string NOT NULL, created_at timestamp NOT NULL, read_at timestamp",
    "knowledge_points": "point_id string NOT NULL, source_type string NOT NULL, source_id string NOT NULL, source_version string NOT NULL, "
    "chunk_id string, content_hash string NOT NULL, content string NOT NULL, document_type_code string, is_active boolean NOT NULL, "
    "access_scope string NOT NULL, embedding array<float> NOT NULL",
}

# The domains of the codes.
INCOMING_STATUS = ("New", "InProgress", "Completed", "Overdue")
OUTGOING_STATUS = ("Editing", "AiDraft", "PendingReview", "ReviewFailed", "PendingApproval", "Approved", "Archived")
MEMBER_STATUS = ("Active", "Inactive")
REMINDER_KIND = ("BeforeDeadline", "DueDate", "Overdue")
DELIVERY_STATUS = ("Unread", "Read")
EXTRACTION_STATUS = ("Pending", "Processing", "Succeeded", "Failed", "Unsupported")
REVIEW_SOURCE = ("Rule", "AI", "Hybrid")
REVIEW_RESULT = ("Failed", "Passed")
ROLES = ("Administrator", "Clerk", "Drafter", "Leader")
GENDERS = ("Male", "Female", "Other")

# Keys that no two rows share; a key with a null in it doesn't count.
UNIQUE_KEYS = {
    "staff": [("identity_user_id",)],
    "document_types": [("code",)],
    "document_templates": [("document_type_id", "name")],
    "outgoing_documents": [("reference_number",)],
    "review_history": [("outgoing_document_id", "attempt_no")],
    "reminder_history": [("incoming_document_id", "recipient_staff_id", "reminder_kind", "reminder_date")],
}


def _in(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


# What every row keeps to: rule name -> SQL that is true or null of a good row.
ROW_RULES = {
    "members": {"status": _in("status", MEMBER_STATUS)},
    "incoming_documents": {
        "status": _in("status", INCOMING_STATUS),
        "received_before_deadline": "received_date <= deadline",
        "confidence_range": "assignment_confidence BETWEEN 0 AND 1",
        "suggestion_tuple": "CASE WHEN suggested_staff_id IS NULL THEN assignment_suggestion_reason IS NULL AND assignment_confidence IS NULL "
        "AND assignment_suggested_at IS NULL ELSE assignment_suggested_at IS NOT NULL END",
        "assignment_tuple": "(assigned_to_staff_id IS NULL) = (assignment_confirmed_by_staff_id IS NULL) "
        "AND (assigned_to_staff_id IS NULL) = (assignment_confirmed_at IS NULL)",
        "completed_at": "(status = 'Completed') = (completed_at IS NOT NULL)",
    },
    "outgoing_documents": {
        "status": _in("status", OUTGOING_STATUS),
        "issues_array": "regexp_like(schema_of_variant(try_parse_json(review_issues)), '^ARRAY')",
        "approved_tuple": "(approved_by_staff_id IS NULL) = (approved_at IS NULL)",
        "reference_tuple": "(reference_number IS NULL) = (issued_date IS NULL)",
        "draft_content": "status <> 'AiDraft' OR ai_draft_content IS NOT NULL",
        "approved_status": "status NOT IN ('Approved', 'Archived') OR approved_at IS NOT NULL",
        "archived_tuple": "CASE WHEN status = 'Archived' THEN archived_at IS NOT NULL AND reference_number IS NOT NULL "
        "AND issued_date IS NOT NULL ELSE archived_at IS NULL END",
    },
    "document_templates": {"rules_object": "regexp_like(schema_of_variant(try_parse_json(format_rules)), '^OBJECT')"},
    "attachments": {
        "extraction_status": _in("extraction_status", EXTRACTION_STATUS),
        "succeeded_at": "extraction_status <> 'Succeeded' OR extracted_at IS NOT NULL",
        "failed_error": "extraction_status <> 'Failed' OR coalesce(length(trim(extraction_error)), 0) > 0",
        "one_parent": "(incoming_document_id IS NULL) <> (outgoing_document_id IS NULL)",
    },
    "review_history": {
        "attempt_no": "attempt_no > 0",
        "review_source": _in("review_source", REVIEW_SOURCE),
        "review_result": _in("review_result", REVIEW_RESULT),
        "issues_array": "regexp_like(schema_of_variant(try_parse_json(review_issues)), '^ARRAY')",
    },
    "reminder_history": {
        "reminder_kind": _in("reminder_kind", REMINDER_KIND),
        "delivery_status": _in("delivery_status", DELIVERY_STATUS),
        "read_at": "(delivery_status = 'Read') = (read_at IS NOT NULL)",
    },
}
