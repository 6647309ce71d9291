"""Registered queries of the document workflow: reviews, approvals, suggestions, deadlines as events, pages with their references."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import details, lifecycle
from ..sources.scratch import scratch_folder
from ..sources.tables import sf_table
from ..streaming.deadlines import replay_files
from .queries import query

NOW = dt.datetime(1998, 6, 15, 9)


def _outgoing(spark: SparkSession, d: str, waiting: str) -> DataFrame:
    """Orders as outgoing documents; each second one is in the state that ``waiting`` names."""
    key = F.col("o_orderkey")
    none = F.lit(None)
    return sf_table(spark, d, "orders").select(
        key.alias("id"), F.concat(F.lit("text "), key).alias("content"), F.when(key % 2 == 0, F.lit(waiting)).otherwise(F.lit("Editing")).alias("status"), F.lit("[]").alias("review_issues"),
        none.cast("long").alias("approved_by_staff_id"), none.cast("timestamp").alias("approved_at"), F.col("o_orderdate").cast("timestamp").alias("updated_at"),
    )


def _history(spark: SparkSession, d: str) -> DataFrame:
    """An earlier review of each fourth order."""
    rows = sf_table(spark, d, "orders").filter("o_orderkey % 4 = 0")
    return rows.select(
        F.concat("o_orderkey", F.lit(":1")).alias("id"), F.col("o_orderkey").alias("outgoing_document_id"), F.lit(1).alias("attempt_no"), F.lit("Rule").alias("review_source"), F.lit(None).cast("long").alias("reviewed_by_staff_id"),
        F.lit("old").alias("content_snapshot"), F.when(F.col("o_orderstatus") == "F", F.lit("Failed")).otherwise(F.lit("Passed")).alias("review_result"), F.lit("[]").alias("review_issues"), F.col("o_orderdate").cast("timestamp").alias("reviewed_at"),
    )


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    """Line items as reviews of their order, those of even lines given twice."""
    rows = sf_table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("outgoing_document_id"), F.lit("Hybrid").alias("review_source"), F.col("l_suppkey").alias("reviewed_by_staff_id"),
        F.when(F.col("l_returnflag") == "R", F.lit("Failed")).otherwise(F.lit("Passed")).alias("review_result"), F.concat(F.lit("["), "l_partkey", F.lit("]")).alias("review_issues"), F.col("l_linenumber").alias("seq"),
    )
    return rows.unionByName(rows.filter("seq % 2 = 0"))


_REVIEW_SQL = """
WITH docs AS (SELECT o_orderkey AS id, o_orderkey % 4 = 0 AS old, o_orderstatus = 'F' AS old_failed, o_orderkey % 2 = 0 AS waiting FROM orders),
r AS (SELECT DISTINCT l_orderkey AS id, l_suppkey AS person, CASE WHEN l_returnflag = 'R' THEN 'Failed' ELSE 'Passed' END AS result, '[' || l_partkey || ']' AS issues, l_linenumber AS seq FROM lineitem),
n AS (SELECT r.*, row_number() OVER (PARTITION BY id ORDER BY seq, person, result, issues) AS turn FROM r JOIN docs USING (id) WHERE waiting),
last AS (SELECT id, count(*) AS n, arg_max(result, turn) AS result, arg_max(issues, turn) AS issues FROM n GROUP BY id),
reviewed AS (SELECT id, CASE WHEN n IS NULL AND waiting THEN 'PendingReview' WHEN n IS NULL THEN 'Editing' WHEN result = 'Failed' THEN 'ReviewFailed' ELSE 'PendingApproval' END AS status,
  coalesce(issues, '[]') AS issues, coalesce(n, 0) + CAST(old AS INTEGER) AS attempts FROM docs LEFT JOIN last USING (id))
"""


@query("review_commit", f"{_REVIEW_SQL} SELECT id, status, issues, attempts, attempts AS last_attempt FROM reviewed")
def review_commit(spark: SparkSession, d: str) -> DataFrame:
    """Several reviews of a document at once: numbered attempts, the last of which decides; one row per document."""
    docs, history = lifecycle.review_committed(_outgoing(spark, d, "PendingReview"), _history(spark, d), _reviews(spark, d), F.lit(NOW), order="seq")
    held = history.groupBy(F.col("outgoing_document_id").alias("id")).agg(F.count(F.lit(1)).alias("attempts"), F.max("attempt_no").cast("long").alias("last_attempt"))
    return docs.join(held, "id", "left").select("id", "status", F.col("review_issues").alias("issues"), F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"), F.coalesce("last_attempt", F.lit(0)).cast("long").alias("last_attempt"))


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    """Line items as decisions on their order; some say neither Approve nor Return."""
    said = F.when(F.col("l_returnflag") == "A", F.lit("Later")).when(F.col("l_linestatus") == "O", F.lit("Approve")).otherwise(F.lit("Return"))
    return sf_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("leader_id"), said.alias("decision"), F.col("l_linenumber").alias("seq"))


_DECISIONS_SQL = """
d AS (SELECT l_orderkey AS id, arg_min((CASE WHEN l_linestatus = 'O' THEN 'Approve' ELSE 'Return' END), (l_linenumber, CASE WHEN l_linestatus = 'O' THEN 'Approve' ELSE 'Return' END, l_suppkey)) AS decision,
  arg_min(l_suppkey, (l_linenumber, CASE WHEN l_linestatus = 'O' THEN 'Approve' ELSE 'Return' END, l_suppkey)) AS leader FROM lineitem WHERE l_returnflag <> 'A' GROUP BY l_orderkey)
"""


@query("approval", f"""
WITH {_DECISIONS_SQL},
s AS (SELECT o_orderkey AS id, d.decision, d.leader, o_orderkey % 2 = 0 AND o_orderkey % 4 = 0 AND o_orderstatus <> 'F' AND d.decision IS NOT NULL AS changed, o_orderkey % 2 = 0 AS waiting FROM orders LEFT JOIN d ON d.id = o_orderkey)
SELECT id, CASE WHEN changed AND decision = 'Approve' THEN 'Approved' WHEN changed OR NOT waiting THEN 'Editing' ELSE 'PendingApproval' END AS status,
  CASE WHEN changed AND decision = 'Approve' THEN CAST(leader AS VARCHAR) END AS approved_by, changed FROM s
""")
def approval(spark: SparkSession, d: str) -> DataFrame:
    """Several decisions on a document: the first valid one takes effect, if its last review passed."""
    out = lifecycle.approval_decided(_outgoing(spark, d, "PendingApproval"), _history(spark, d), _decisions(spark, d), F.lit(NOW), order="seq")
    return out.select("id", "status", F.col("approved_by_staff_id").cast("string").alias("approved_by"), "changed")


@query("lifecycle", f"""{_REVIEW_SQL}, {_DECISIONS_SQL}
SELECT id, CASE WHEN status = 'PendingApproval' AND decision = 'Approve' THEN 'Approved' WHEN status = 'PendingApproval' AND decision = 'Return' THEN 'Editing' ELSE status END AS status,
  CASE WHEN status = 'PendingApproval' AND decision = 'Approve' THEN CAST(leader AS VARCHAR) END AS approved_by FROM reviewed LEFT JOIN d USING (id)
""")
def whole_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Reviews, and then decisions on what they left waiting for approval."""
    docs, history = lifecycle.review_committed(_outgoing(spark, d, "PendingReview"), _history(spark, d), _reviews(spark, d), F.lit(NOW), order="seq")
    out = lifecycle.approval_decided(docs, history, _decisions(spark, d), F.lit(NOW), order="seq")
    return out.select("id", "status", F.col("approved_by_staff_id").cast("string").alias("approved_by"))


@query("assignment_suggestions", """
WITH s AS (SELECT l_orderkey AS id, max((l_linenumber, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END)) AS last FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS id, CASE WHEN s.id IS NULL THEN 'before' WHEN last[3] = 1 THEN CAST(last[2] AS VARCHAR) END AS suggested, s.id IS NOT NULL AS touched FROM orders LEFT JOIN s ON s.id = o_orderkey
""")
def assignment_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Line items as suggestions for their order: the last one holds, and one without a person clears what was suggested."""
    docs = sf_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("before").alias("suggested_staff_id"), F.lit("before").alias("assignment_suggestion_reason"), F.lit(None).cast("decimal(5,4)").alias("assignment_confidence"),
        F.lit(None).cast("timestamp").alias("assignment_suggested_at"), F.lit(None).cast("timestamp").alias("updated_at"),
    )
    said = sf_table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") == "R", F.lit("InsufficientEvidence")).otherwise(F.lit("Suggested")).alias("decision"),
        F.col("l_suppkey").cast("string").alias("staff_id"), F.lit("reason").alias("reason"), F.struct("l_linenumber", "l_suppkey").alias("seq"),
    )
    out = lifecycle.assignment_suggested(docs, said, F.lit(NOW), order="seq")
    return out.select("id", F.col("suggested_staff_id").alias("suggested"), F.col("updated_at").isNotNull().alias("touched"))


_CHANGES_FROM, _CHANGES_DAYS = "1998-03-02", 60


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """Customers as documents: opened, given a person, for some with a corrected deadline, and completed; the last row only says how late it is."""
    key = F.col("c_custkey")
    start = F.timestamp_add("DAY", (key % _CHANGES_DAYS).cast("int"), F.lit(f"{_CHANGES_FROM} 00:00:00").cast("timestamp"))
    due = F.date_add(F.to_date(start), (4 + key % 9).cast("int"))
    row = lambda after, deadline, status, staff: F.struct(F.timestamp_add("HOUR", after, start).alias("at"), deadline.alias("deadline"), F.lit(status).alias("status"), staff.alias("assigned_to_staff_id"))
    person, nobody = F.col("c_nationkey").cast("string"), F.lit(None).cast("string")
    steps = F.array(
        row(F.lit(1), due, "New", nobody),
        row(F.lit(26), due, "InProgress", F.when(key % 5 != 0, person)),
        row(F.lit(75), F.when(key % 3 == 0, F.date_add(due, 4)).otherwise(due), "InProgress", F.when(key % 5 != 0, person)),
        row((24 * (6 + key % 16) + 2).cast("int"), due, "Completed", F.when(key % 5 != 0, person)),
    )
    rows = sf_table(spark, d, "customer").select(key.cast("string").alias("id"), F.inline(steps)).select("id", "deadline", "status", "assigned_to_staff_id", "at")
    end = spark.range(1).select(nobody.alias("id"), F.lit(None).cast("date").alias("deadline"), nobody.alias("status"), nobody.alias("assigned_to_staff_id"), F.lit("1998-07-01 00:00:00").cast("timestamp").alias("at"))
    return rows.unionByName(end)


@query("deadline_events", f"""
WITH c AS (SELECT c_custkey AS k, DATE '{_CHANGES_FROM}' + CAST(c_custkey % {_CHANGES_DAYS} AS INTEGER) AS opened, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS person FROM customer),
t AS (SELECT k, person, opened + CAST(4 + k % 9 AS INTEGER) AS due, opened + CAST(4 + k % 9 + CASE WHEN k % 3 = 0 THEN 4 ELSE 0 END AS INTEGER) AS corrected, opened, opened + CAST(6 + k % 16 AS INTEGER) AS done FROM c),
p AS (
  SELECT k, due AS deadline, NULL AS person, opened + 1 AS first, opened + 1 AS last FROM t
  UNION ALL SELECT k, due, person, opened + 2, opened + 3 FROM t
  UNION ALL SELECT k, corrected, person, opened + 4, done FROM t),
d AS (SELECT *, CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS day FROM p)
SELECT CAST(k AS VARCHAR) AS incoming_document_id, 'reminder' AS event, person AS recipient_staff_id, CASE WHEN deadline < day THEN 'Overdue' WHEN deadline = day THEN 'DueDate' ELSE 'BeforeDeadline' END AS reminder_kind, CAST(day AS VARCHAR) AS reminder_date
FROM d WHERE person IS NOT NULL AND (deadline <= day OR deadline = day + 3)
UNION ALL SELECT CAST(k AS VARCHAR), 'overdue', NULL, NULL, CAST(greatest(first, deadline + 1) AS VARCHAR) FROM p WHERE greatest(first, deadline + 1) <= last
""")
def deadline_events(spark: SparkSession, d: str) -> DataFrame:
    """Changes of documents as a stream of files, through state and timers, up to a date after the last of them."""
    root = scratch_folder(spark, "deadlines")
    _changes(spark, d).repartition(2).write.parquet(f"{root}/changes")
    found = replay_files(spark, f"{root}/changes", f"{root}/events", f"{root}/state")
    return found.withColumn("reminder_date", F.col("reminder_date").cast("string"))


@query("review_page", """
WITH r AS (SELECT l_linenumber AS attempt_no, l_shipdate AS reviewed_at, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END AS person FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem))
SELECT attempt_no, s_name AS reviewer FROM (SELECT * FROM r ORDER BY reviewed_at DESC, attempt_no DESC LIMIT 20) LEFT JOIN supplier ON s_suppkey = person
""")
def review_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of one document's reviews with who reviewed it: the line items of the least order."""
    items = sf_table(spark, d, "lineitem")
    first = items.agg(F.min("l_orderkey")).first()[0]
    history = items.select(
        F.col("l_linenumber").alias("id"), F.col("l_orderkey").alias("outgoing_document_id"), F.col("l_linenumber").alias("attempt_no"), F.col("l_shipdate").alias("reviewed_at"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey")).alias("reviewed_by_staff_id"),
    )
    staff = sf_table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("full_name"), F.lit("reviewer").alias("position"))
    return details.review_page(history, staff, first).items.select("attempt_no", F.col("reviewed_by.full_name").alias("reviewer"))


@query("reminder_page", """
SELECT o_orderkey AS id, c_name AS document, n_name AS status FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20)
JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
""")
def reminder_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of reminders with their documents: open orders and their customers."""
    rows = sf_table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("incoming_document_id"), F.col("o_orderdate").alias("created_at"))
    people = sf_table(spark, d, "customer").join(sf_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    docs = people.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("reference_number"), F.col("c_mktsegment").alias("sender_org"), F.lit("").alias("summary"), F.lit(None).cast("date").alias("deadline"), F.col("n_name").alias("status"),
    )
    return details.reminder_page(rows, docs, page=2).items.select("id", F.col("incoming_document.reference_number").alias("document"), F.col("incoming_document.status").alias("status"))
