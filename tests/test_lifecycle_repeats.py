"""Repeated reviews, decisions and suggestions leave one row per document; keys, files and pages that were ambiguous."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paperloom.functions import structured
from paperloom.operators import details, lifecycle, listing, review
from paperloom.sources.files import open_by_key, read_files

NOW = dt.datetime(2026, 8, 2)
DOCS = "id string, content string, status string, review_issues string, approved_by_staff_id string, approved_at timestamp, updated_at timestamp"
HISTORY = "id string, outgoing_document_id string, attempt_no int, review_source string, reviewed_by_staff_id string, content_snapshot string, review_result string, review_issues string, reviewed_at timestamp"


def docs(spark, *states):
    return spark.createDataFrame([(i, f"c{i}", s, "[]", None, None, None) for i, s in states], DOCS)


def test_two_reviews_of_a_document(spark):
    history = spark.createDataFrame([("a:3", "a", 3, "AI", None, "old", "Failed", "[]", None)], HISTORY)
    rows = [("a", "AI", "s", "Passed", "[1]", 2), ("a", "AI", "s", "Failed", "[2]", 5), ("a", "AI", "s", "Passed", "[1]", 2), ("b", "Rule", None, "Failed", "[3]", 1), ("c", "AI", "s", "Passed", "[]", 1)]
    reviews = spark.createDataFrame(rows, "outgoing_document_id string, review_source string, reviewed_by_staff_id string, review_result string, review_issues string, at int")
    out, held = lifecycle.review_committed(docs(spark, ("a", "PendingReview"), ("b", "PendingReview"), ("c", "Editing")), history, reviews, F.lit(NOW), order="at")
    assert sorted((r.id, r.status, r.review_issues) for r in out.collect()) == [("a", "ReviewFailed", "[2]"), ("b", "ReviewFailed", "[3]"), ("c", "Editing", "[]")]
    assert sorted((r.id, r.attempt_no, r.review_result) for r in held.collect()) == [("a:3", 3, "Failed"), ("a:4", 4, "Passed"), ("a:5", 5, "Failed"), ("b:1", 1, "Failed")]


def test_two_decisions_on_a_document(spark):
    history = spark.createDataFrame([("a:1", "a", 1, "AI", None, "old", "Passed", "[]", None), ("b:1", "b", 1, "AI", None, "old", "Failed", "[]", None)], HISTORY)
    decisions = spark.createDataFrame([("a", "l1", "Return", 2), ("a", "l2", "Approve", 1), ("a", "l3", "Later", 0), ("b", "l1", "Approve", 1)], "id string, leader_id string, decision string, at int")
    out = lifecycle.approval_decided(docs(spark, ("a", "PendingApproval"), ("b", "PendingApproval"), ("c", "PendingApproval")), history, decisions, F.lit(NOW), order="at")
    assert sorted((r.id, r.status, r.approved_by_staff_id, r.changed) for r in out.collect()) == [("a", "Approved", "l2", True), ("b", "PendingApproval", None, False), ("c", "PendingApproval", None, False)]


def test_two_suggestions_for_a_document(spark):
    schema = "id string, suggested_staff_id string, assignment_suggestion_reason string, assignment_confidence decimal(5,4), assignment_suggested_at timestamp, updated_at timestamp"
    rows = spark.createDataFrame([("a", "old", "r", None, None, None), ("b", "old", "r", None, None, None)], schema)
    said = spark.createDataFrame([("a", "Suggested", "s1", "x", 1), ("a", "Suggested", "s2", "y", 2), ("b", "Suggested", "s1", "x", 1), ("b", "InsufficientEvidence", None, "n", 3)], "id string, decision string, staff_id string, reason string, at int")
    out = lifecycle.assignment_suggested(rows, said, F.lit(NOW), order="at")
    assert sorted((r.id, str(r.suggested_staff_id)) for r in out.collect()) == [("a", "s2"), ("b", "None")]


def test_issues_can_be_read_back(spark):
    texts = spark.createDataFrame([("nothing",)], "content string")
    found = review.review(texts, [r.code for r in review.RULES])
    back = found.select("issues", structured.issues(F.to_json("issues")).alias("again")).first()
    assert [i.ruleCode for i in back.again] == [r.code for r in review.RULES] and back.again == back.issues
    assert found.unionByName(review.review(texts, [])).count() == 2


def test_a_key_names_one_row(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id long, v string")
    assert listing.by_key(rows, 1).collect() == [(1, "a")] and listing.by_key(rows, 9).isEmpty()
    with pytest.raises(Exception, match="several rows"):
        listing.by_key(rows, 2).collect()


def test_files_by_their_whole_path(spark, tmp_path):
    for root in ("data", "other-data", "data/data"):
        (tmp_path / root / "k").mkdir(parents=True)
        (tmp_path / root / "k" / "1.txt").write_text(root)
    files = read_files(spark, f"{tmp_path}/*/k").unionByName(read_files(spark, f"{tmp_path}/data/data/k"))
    assert [bytes(r.content) for r in open_by_key(files, f"{tmp_path}/data", "k/1.txt").collect()] == [b"data"]
    assert open_by_key(files, f"{tmp_path}/data", "1.txt").isEmpty()


def test_pages_with_references(spark):
    reminders = spark.createDataFrame([(f"r{i}", f"d{i % 2}", dt.datetime(2026, 1, 1 + i)) for i in range(5)], "id string, incoming_document_id string, created_at timestamp")
    incoming = spark.createDataFrame([(f"d{i}", f"n{i}", "org", "s", dt.date(2026, 2, 1), "New") for i in range(2)], "id string, reference_number string, sender_org string, summary string, deadline date, status string")
    page = details.reminder_page(reminders, incoming, 2, 2)
    assert sorted((r.id, r.incoming_document.reference_number) for r in page.items.collect()) == [("r1", "n1"), ("r2", "n0")] and page.total_count() == 5
    history = spark.createDataFrame([(f"h{i}", "d", i, dt.datetime(2026, 1, 1), "s" if i % 2 else None) for i in range(3)], "id string, outgoing_document_id string, attempt_no int, reviewed_at timestamp, reviewed_by_staff_id string")
    staff = spark.createDataFrame([("s", "Sam", "Drafter")], "id string, full_name string, position string")
    found = details.review_page(history, staff, "d").items.collect()
    assert sorted((r.attempt_no, r.reviewed_by and r.reviewed_by.full_name) for r in found) == [(0, None), (1, "Sam"), (2, None)]
