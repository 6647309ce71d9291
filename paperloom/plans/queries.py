"""Registered queries of the document-operations workload and their SQL twins.

The tables at hand are a business schema, so each query runs an operator of the library on
the table that plays its part: customers as people, orders as documents with dates and
states, nations and regions as types, line items as children, events as timed rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import structured, text
from ..operators import audit, chunking, details, evaluation, imports, index, listing, mutations, relations, reminders, review, search
from ..schemas import ROW_RULES
from ..sources.tables import sf_table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: The business date of the reminder queries: orders span 1995 to 2001.
TODAY = "1998-06-15"


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return register


@query(
    "paged_search",
    """
SELECT o_orderkey, c_name, o_orderstatus, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
WHERE contains(lower(c_name), 'customer#0000001') AND o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '2000-12-31'
ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20
""",
)
def paged_search(spark: SparkSession, d: str) -> DataFrame:
    docs = sf_table(spark, d, "orders").filter(
        listing.every([listing.equals("o_orderstatus", "O"), listing.date_range("o_orderdate", dt.date(1996, 1, 1), dt.date(2000, 12, 31))])
    )
    people = sf_table(spark, d, "customer").filter(listing.searched(["c_name"], "  Customer#0000001 ")).select("c_custkey", "c_name")
    rows = docs.join(people, docs.o_custkey == people.c_custkey)
    keys = (("o_orderdate", True), ("o_orderkey", False))
    return listing.page_of(rows, keys, page=2, page_size=20).items.select("o_orderkey", "c_name", "o_orderstatus", "o_totalprice")


@query("page_totals", "SELECT count(*) AS total_count, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM orders WHERE o_orderstatus = 'F'")
def page_totals(spark: SparkSession, d: str) -> DataFrame:
    return listing.page_totals(sf_table(spark, d, "orders").filter(listing.equals("o_orderstatus", "F")), 20)


@query(
    "lookup_projection",
    "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND contains(lower(c_name), '42') ORDER BY c_name, c_custkey LIMIT 20",
)
def lookup_projection(spark: SparkSession, d: str) -> DataFrame:
    kept = sf_table(spark, d, "customer").filter(listing.every([listing.equals("c_mktsegment", "BUILDING"), listing.searched(["c_name"], "42", collapse=True)]))
    return listing.page_of(kept.select("c_custkey", "c_name"), (("c_name", False), ("c_custkey", False))).items


@query("point_lookup", "SELECT * FROM customer WHERE c_custkey = 77")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return listing.by_key(sf_table(spark, d, "customer"), 77, "c_custkey")


@query("key_set_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def key_set_lookup(spark: SparkSession, d: str) -> DataFrame:
    keys = sf_table(spark, d, "orders").filter("o_totalprice > 400000").select("o_custkey").distinct()
    return listing.in_keys(sf_table(spark, d, "customer"), keys, "c_custkey").select("c_custkey", "c_name")


@query(
    "half_open_day_range",
    "SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08' AND event_type = 'purchase'",
)
def half_open_day_range(spark: SparkSession, d: str) -> DataFrame:
    kept = listing.every([listing.day_range("ts", dt.date(2024, 1, 5), dt.date(2024, 1, 7)), listing.equals("event_type", "purchase")])
    return sf_table(spark, d, "events").filter(kept).select("event_id", "user_id", "event_type")


@query(
    "parent_active_filter",
    """
SELECT r_name AS document_type_code, n_name AS name, n_nationkey AS id FROM nation JOIN region ON n_regionkey = r_regionkey
WHERE n_nationkey % 3 <> 0 AND r_regionkey <> 2 ORDER BY r_name, n_name, n_nationkey LIMIT 100
""",
)
def parent_active_filter(spark: SparkSession, d: str) -> DataFrame:
    types = sf_table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("code"), (F.col("r_regionkey") != 2).alias("is_active"))
    rows = sf_table(spark, d, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("document_type_id"), (F.col("n_nationkey") % 3 != 0).alias("is_active")
    )
    kept = relations.active_under_active_parent(rows, types, "document_type_id")
    named = relations.reference(kept, types, "document_type_id", ["code"], "type", required=True).withColumn("document_type_code", F.col("type.code"))
    return listing.page_of(named, listing.ORDERS["document_templates"], page_size=100).items.select("document_type_code", "name", "id")


@query(
    "role_playing_left_join",
    """
SELECT o_orderkey, a.c_name AS assigned_name, s.c_name AS suggested_name, n_name AS nation_name
FROM orders LEFT JOIN customer a ON o_custkey = a.c_custkey
LEFT JOIN customer s ON CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey + 1 END = s.c_custkey
LEFT JOIN nation ON a.c_nationkey = n_nationkey
""",
)
def role_playing_left_join(spark: SparkSession, d: str) -> DataFrame:
    people = sf_table(spark, d, "customer")
    docs = sf_table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") + 1).alias("suggested_key"))
    out = docs
    for key, name in {"o_custkey": "assigned", "suggested_key": "suggested"}.items():
        out = relations.reference(out, people, key, ["c_name", "c_nationkey"], name, parent_key="c_custkey")
    out = relations.reference(out.withColumn("nation_key", F.col("assigned.c_nationkey")), sf_table(spark, d, "nation"), "nation_key", ["n_name"], "nation", parent_key="n_nationkey")
    return out.select("o_orderkey", F.col("assigned.c_name").alias("assigned_name"), F.col("suggested.c_name").alias("suggested_name"), F.col("nation.n_name").alias("nation_name"))


@query(
    "children_sorted_list",
    """
WITH page AS (SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100)
SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_shipdate DESC, l_linenumber), '') AS items
FROM page LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
""",
)
def children_sorted_list(spark: SparkSession, d: str) -> DataFrame:
    page = listing.page_of(sf_table(spark, d, "orders").select("o_orderkey", "o_orderdate"), (("o_orderdate", True), ("o_orderkey", False)), page_size=100).items
    items = sf_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    items = items.join(F.broadcast(page.select("o_orderkey")), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")  # bounded by the page size
    out = relations.children(page, items, "l_orderkey", [("l_shipdate", True), ("l_linenumber", False)], ["l_linenumber", "l_partkey"], "items", key="o_orderkey")
    return out.select("o_orderkey", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",").alias("items"))


@query("roles_per_user", "SELECT user_id, array_to_string(list_sort(list(DISTINCT trim(event_type))), ',') AS roles FROM events GROUP BY user_id")
def roles_per_user(spark: SparkSession, d: str) -> DataFrame:
    events = sf_table(spark, d, "events")
    held = events.select("user_id", F.col("event_type").alias("role_id"))
    names = events.select(F.col("event_type").alias("id"), F.concat(F.lit(" "), "event_type").alias("name")).distinct()
    return relations.roles_by_user(held, names).select("user_id", F.array_join("roles", ",").alias("roles"))


@query(
    "three_way_distinct_count",
    """
SELECT r_name, count(DISTINCT s_suppkey) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE s_acctbal > 0 GROUP BY r_name
""",
)
def three_way_distinct_count(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as people, and as their role the region of their nation."""
    suppliers = sf_table(spark, d, "supplier")
    staff = suppliers.select(F.col("s_suppkey").alias("identity_user_id"), (F.col("s_acctbal") > 0).alias("is_active"))
    held = suppliers.join(sf_table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("user_id"), F.col("n_regionkey").alias("role_id"))
    roles = sf_table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return relations.people_by_role(staff, held, roles).select(F.col("name").alias("r_name"), F.col("people").alias("suppliers"))


@query(
    "latest_per_key",
    "SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status, count(*) AS attempts FROM orders GROUP BY o_custkey",
)
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    orders = sf_table(spark, d, "orders")
    return relations.latest(orders, "o_custkey", F.struct("o_orderdate", "o_orderkey"), "o_orderstatus", "last_status", count="attempts")


@query(
    "next_attempt",
    "SELECT o_orderkey, coalesce(max(l_linenumber), 0) + 1 AS next FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey",
)
def next_attempt(spark: SparkSession, d: str) -> DataFrame:
    items = sf_table(spark, d, "lineitem").filter("l_returnflag = 'R'")
    return relations.next_number(sf_table(spark, d, "orders").select("o_orderkey"), items, "l_orderkey", "l_linenumber", parent_key="o_orderkey")


@query(
    "null_safe_duplicates",
    """
WITH people AS (SELECT c_custkey, lower(c_mktsegment) AS name, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_nationkey END AS phone FROM customer),
firsts AS (SELECT *, min(c_custkey) OVER (PARTITION BY name, phone) AS first_key FROM people),
suppliers AS (SELECT DISTINCT CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE s_nationkey END AS phone FROM supplier)
SELECT c_custkey, first_key, EXISTS (SELECT 1 FROM suppliers s WHERE s.phone IS NOT DISTINCT FROM firsts.phone) AS known FROM firsts WHERE c_custkey > first_key
""",
)
def null_safe_duplicates(spark: SparkSession, d: str) -> DataFrame:
    hidden = lambda c: F.when(F.col(c) % 5 != 0, F.col(c)).alias("phone")
    people = sf_table(spark, d, "customer").select("c_custkey", F.lower("c_mktsegment").alias("name"), hidden("c_nationkey"))
    firsts = people.withColumn("first_key", F.min("c_custkey").over(Window.partitionBy("name", "phone"))).filter("c_custkey > first_key")
    there = sf_table(spark, d, "supplier").select(hidden("s_nationkey")).distinct().withColumn("hit", F.lit(True)).withColumnRenamed("phone", "s_phone")
    joined = firsts.join(there, F.col("phone").eqNullSafe(F.col("s_phone")), "left")
    return joined.select("c_custkey", "first_key", F.coalesce("hit", F.lit(False)).alias("known"))


_CANDIDATE_SQL = f"""
SELECT o_orderkey AS incoming_document_id, o_custkey AS recipient_staff_id,
  CASE WHEN CAST(o_orderdate AS DATE) < DATE '{TODAY}' THEN 'Overdue' WHEN CAST(o_orderdate AS DATE) = DATE '{TODAY}' THEN 'DueDate' ELSE 'BeforeDeadline' END AS reminder_kind,
  '{TODAY}' AS reminder_date
FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 7 <> 0
  AND (CAST(o_orderdate AS DATE) <= DATE '{TODAY}' OR CAST(o_orderdate AS DATE) = DATE '{TODAY}' + 3)
"""


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents with a deadline, a state and, for most, an assignee."""
    return sf_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.to_date("o_orderdate").alias("deadline"),
        F.when(F.col("o_orderstatus") == "F", F.lit("Completed")).when(F.col("o_orderstatus") == "P", F.lit("New")).otherwise(F.lit("InProgress")).alias("status"),
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("assigned_to_staff_id"),
        F.col("o_orderdate").alias("updated_at"),
    )


@query("reminder_candidates", _CANDIDATE_SQL)
def reminder_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = reminders.candidates(_documents(spark, d), F.lit(dt.date.fromisoformat(TODAY)))
    return found.withColumn("reminder_date", F.col("reminder_date").cast("string"))


@query(
    "reminder_new_vs_existing",
    f"""
WITH asked AS ({_CANDIDATE_SQL}),
late AS (SELECT count(*) AS overdue FROM orders WHERE o_orderstatus <> 'F' AND CAST(o_orderdate AS DATE) < DATE '{TODAY}')
SELECT (SELECT overdue FROM late) AS overdue, count(*) FILTER (incoming_document_id % 4 <> 0) AS created, count(*) FILTER (incoming_document_id % 4 = 0) AS existing FROM asked
""",
)
def reminder_new_vs_existing(spark: SparkSession, d: str) -> DataFrame:
    docs, today = _documents(spark, d), F.lit(dt.date.fromisoformat(TODAY))
    history = reminders.candidates(docs, today).filter("incoming_document_id % 4 = 0")
    history = history.select(F.lit("h").alias("id"), *reminders.KEY, F.lit("Unread").alias("delivery_status"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("read_at"))
    now = F.lit(dt.datetime(1998, 6, 15)).cast("timestamp_ntz")
    return reminders.run_day(docs, history, today, now)[2].select("overdue", "created", "existing")


@query(
    "index_diff",
    """
WITH s AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 1 OR doc_id % 3 = 0),
i AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 3 <> 0)
SELECT coalesce(s.doc_id, i.doc_id) AS doc_id,
  CASE WHEN s.doc_id IS NULL THEN 'stale' WHEN i.doc_id IS NULL THEN 'new' WHEN s.h = i.h THEN 'same' ELSE 'changed' END AS state
FROM s FULL JOIN i ON s.doc_id = i.doc_id
""",
)
def index_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = sf_table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))
    old = docs.filter("doc_id % 3 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 7 == 0, F.lit("old")).otherwise(F.col("content_hash")))
    return index.difference(docs.filter("doc_id % 5 <> 1 OR doc_id % 3 = 0"), old, "doc_id", ["content_hash"])


@query(
    "set_difference",
    """
WITH r AS (SELECT user_id, list_sort(list(DISTINCT event_type) FILTER (event_id % 2 = 0)) AS a, list_sort(list(DISTINCT event_type) FILTER (event_id % 2 = 1)) AS b FROM events GROUP BY user_id)
SELECT user_id, array_to_string(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x)), ',') AS added,
  array_to_string(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x)), ',') AS removed FROM r
""",
)
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    events = sf_table(spark, d, "events")
    held = lambda rest: events.filter(F.col("event_id") % 2 == rest).groupBy("user_id").agg(F.collect_set("event_type").alias("roles"))
    changed = relations.role_change(held(0), held(1))
    return changed.select("user_id", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query(
    "compare_and_set",
    """
SELECT o_orderkey, CASE WHEN hit THEN CASE WHEN o_orderkey % 2 = 0 THEN 'AiDraft' ELSE 'Editing' END ELSE o_orderstatus END AS status,
  CASE WHEN hit AND o_orderkey % 2 = 0 THEN 'draft' WHEN o_orderkey % 2 = 1 THEN 'kept' END AS ai_draft_content, hit AS changed
FROM (SELECT *, o_orderstatus = 'P' AND o_totalprice > 100000 AS hit FROM orders)
""",
)
def compare_and_set(spark: SparkSession, d: str) -> DataFrame:
    docs = sf_table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_totalprice", F.when(F.col("o_orderkey") % 2 == 1, F.lit("kept")).alias("ai_draft_content"))
    first = F.col("ai_draft_content").isNull()
    values = {"status": F.when(first, F.lit("AiDraft")).otherwise(F.lit("Editing")), "ai_draft_content": F.coalesce("ai_draft_content", F.lit("draft"))}
    return mutations.compare_and_set(docs, (F.col("status") == "P") & (F.col("o_totalprice") > 100000), values).drop("o_totalprice")


@query(
    "sparse_patch",
    """
SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'renamed' ELSE c_name END AS c_name,
  CASE WHEN c_custkey % 20 = 0 THEN NULL WHEN c_custkey % 10 = 0 THEN c_mktsegment ELSE c_mktsegment END AS c_mktsegment FROM customer
""",
)
def sparse_patch(spark: SparkSession, d: str) -> DataFrame:
    rows = sf_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment")
    patches = rows.filter("id % 10 = 0").select(
        "id", F.lit("renamed").alias("c_name"), F.lit(True).alias("has_c_name"), F.lit(None).cast("string").alias("c_mktsegment"), (F.col("id") % 20 == 0).alias("has_c_mktsegment")
    )
    return mutations.patched(rows, patches, ["c_name", "c_mktsegment"])


@query(
    "insert_if_absent",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0",
)
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    people = sf_table(spark, d, "customer").select("c_custkey", "c_name")
    return mutations.insert_absent(people.filter("c_custkey % 3 <> 0"), people.filter("c_custkey % 2 = 0 OR c_custkey % 3 = 0").withColumn("c_name", F.lit("new")), ["c_custkey"])


@query(
    "upsert_and_delete",
    """
SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN -1 ELSE label END AS label FROM embeddings WHERE vec_id % 5 <> 0
""",
)
def upsert_and_delete(spark: SparkSession, d: str) -> DataFrame:
    points = sf_table(spark, d, "embeddings").select("vec_id", "label")
    new = points.filter("vec_id % 2 = 0").withColumn("label", F.lit(-1))
    return mutations.deleted(mutations.upserted(points.filter("vec_id % 2 = 1 OR vec_id % 3 = 0"), new, ["vec_id"]), points.filter("vec_id % 5 = 0"), ["vec_id"])


@query(
    "constraint_audit",
    """
SELECT l_orderkey || '-' || l_linenumber AS id, unnest(list_filter([
  CASE WHEN NOT (l_quantity <= 45) THEN 'quantity_range' END, CASE WHEN NOT (l_discount BETWEEN 0 AND 0.09) THEN 'discount_range' END,
  CASE WHEN NOT ((l_returnflag = 'R') <= (l_linestatus = 'F')) THEN 'returned_closed' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem
""",
)
def constraint_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = sf_table(spark, d, "lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    rules = {"quantity_range": "l_quantity <= 45", "discount_range": "l_discount BETWEEN 0 AND 0.09", "returned_closed": "(l_returnflag = 'R') <= (l_linestatus = 'F')"}
    return audit.row_violations(rows, rules)


@query("unique_key_audit", "SELECT o_custkey, o_orderdate, count(*) AS rows FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1")
def unique_key_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.repeated_keys(sf_table(spark, d, "orders"), ["o_custkey", "o_orderdate"])


_BLANK = "[ \\t\\n\\r\\f\\v]"


@query(
    "text_normalize",
    rf"""
SELECT doc_id, md5(lower(regexp_replace(regexp_replace(text, '^{_BLANK}+|{_BLANK}+$', '', 'g'), '{_BLANK}+', ' ', 'g'))) AS folded,
  contains(lower(text), 'the and') AS holds FROM documents
""",
)
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    docs = sf_table(spark, d, "documents")
    return docs.select("doc_id", F.md5(F.lower(text.collapsed(F.col("text"))).cast("binary")).alias("folded"), text.holds(F.col("text"), "THE and").alias("holds"))


_GUID = "||".join("'-'" if g is None else f"substr(h, {2 * g + 1}, 2)" for g in (3, 2, 1, 0, None, 5, 4, None, 7, 6, None, 8, 9, None, 10, 11, 12, 13, 14, 15))


@query(
    "content_hash",
    f"SELECT doc_id, sha256(text) AS content_hash, {_GUID} AS point_id FROM (SELECT *, sha256('template:' || doc_id || ':1') AS h FROM documents)",
)
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("template:"), "doc_id", F.lit(":1"))
    return sf_table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"), text.point_id(name).alias("point_id"))


_WORDS = "regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')"


@query(
    "token_windows",
    f"""
WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(generate_series(0, CAST(greatest(ceil((len(w) - 480) / 416.0), 0) AS BIGINT))) AS i FROM t)
SELECT doc_id, CAST(i AS INTEGER) AS piece, len(list_slice(w, i * 416 + 1, i * 416 + 480)) AS n_tokens,
  md5(array_to_string(list_slice(w, i * 416 + 1, i * 416 + 480), ' ')) AS digest FROM p
""",
)
def token_windows(spark: SparkSession, d: str) -> DataFrame:
    words = sf_table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("words"))
    rows = words.select("doc_id", F.posexplode(chunking.windows(F.col("words"))).alias("piece", "w"))
    return rows.select("doc_id", "piece", F.size("w").cast("long").alias("n_tokens"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


@query(
    "heading_sections",
    r"""
WITH l AS (
  SELECT doc_id, unnest(str_split(t, chr(10))) AS raw, generate_subscripts(str_split(t, chr(10)), 1) AS n
  FROM (SELECT doc_id, regexp_replace(text, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS t FROM documents)
), m AS (SELECT *, regexp_replace(raw, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS line FROM l),
h AS (SELECT *, CASE WHEN n > 1 AND line <> '' AND (regexp_matches(line, '^[IVXLCDM]+\.[ \t\n\r\f\v]') OR (length(line) <= 160 AND regexp_matches(line, '\p{L}') AND upper(line) = line)) THEN 1 ELSE 0 END AS start FROM m),
s AS (SELECT *, sum(start) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM h)
SELECT doc_id, CAST(section AS INTEGER) AS section, length(body) AS n_chars FROM (
  SELECT doc_id, section, regexp_replace(string_agg(line, chr(10) ORDER BY n), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS body FROM s GROUP BY doc_id, section) WHERE body <> ''
""",
)
def heading_sections(spark: SparkSession, d: str) -> DataFrame:
    found = chunking.sections(sf_table(spark, d, "documents"), "doc_id", "text")
    return found.select("doc_id", "section", F.length("body").cast("long").alias("n_chars"))


_TERMS = r"list_distinct(list_filter(str_split(trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g')), ' '), lambda w: length(w) >= 2))"


@query(
    "lexical_overlap",
    f"""
WITH d AS (SELECT doc_id, unnest({_TERMS.format("text")}) AS term FROM documents), b AS (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark)
SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (term)
WHERE term NOT IN ({", ".join(repr(w) for w in text.STOP_WORDS)}) GROUP BY doc_id, item_id HAVING count(*) >= 20
""",
)
def lexical_overlap(spark: SparkSession, d: str) -> DataFrame:
    return search.overlap(sf_table(spark, d, "documents"), sf_table(spark, d, "benchmark"), "doc_id", "item_id", least=20)


_RULES = (
    review.FormatRule("header", "no header", "start", ("THE", "of"), (r"and\s+the",)),
    review.FormatRule("reference", "no reference", "start", (), (r"^The\s",)),
    review.FormatRule("signature", "no signature", "end", ("ing the", "ion")),
)


@query(
    "format_rules",
    r"""
SELECT doc_id, array_to_string(list_filter([
  CASE WHEN NOT (contains(lower(t), 'the') AND contains(lower(t), 'of') AND regexp_matches(t, '(?i)and\s+the')) THEN 'header' END,
  CASE WHEN NOT regexp_matches(t, '(?im)^The\s') THEN 'reference' END,
  CASE WHEN NOT (contains(lower(t), 'ing the') AND contains(lower(t), 'ion')) THEN 'signature' END], lambda x: x IS NOT NULL), ',') AS codes
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
""",
)
def format_rules(spark: SparkSession, d: str) -> DataFrame:
    docs = sf_table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    found = review.review(docs, ["header", "reference", "signature"], rules=_RULES)
    return found.select("doc_id", F.array_join(F.transform("issues", lambda i: i["ruleCode"]), ",").alias("codes"))


@query(
    "json_fields",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_type(props, '$.k') = 'UBIGINT' OR json_type(props, '$.k') = 'BIGINT' AS whole FROM events",
)
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    events = sf_table(spark, d, "events")
    return events.select("event_id", F.from_json("props", "k long")["k"].alias("k"), (structured.kind(F.col("props"), "$.k") == "BIGINT").alias("whole"))


_COSINE = "list_sum(list_transform(range(1, 65), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"
_SCORE = f"{_COSINE.format(a='q.embedding', b='p.embedding')} / (sqrt({_COSINE.format(a='q.embedding', b='q.embedding')}) * sqrt({_COSINE.format(a='p.embedding', b='p.embedding')}))"
_TOP5 = f"""
WITH scored AS (
  SELECT q.vec_id AS query_id, q.label AS want, p.vec_id AS point_id, p.label AS got, {_SCORE} AS score
  FROM embeddings q, embeddings p WHERE q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id
), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM scored WHERE score >= 0.1)
"""


def _top5(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    points = sf_table(spark, d, "embeddings").withColumnsRenamed({"vec_id": "point_id"})
    queries = points.filter("point_id % 50 = 0").select(F.col("point_id").alias("query_id"), F.col("label").alias("want"), F.col("embedding").alias("query"))
    return queries, points, index.search(queries, points, least=0.1, but=F.col("query_id") == F.col("point_id"))


@query("cosine_topk", f"{_TOP5} SELECT query_id, point_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM top WHERE rank <= 5")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _top5(spark, d)[2].select("query_id", "point_id", "rank", F.round("score", 6).alias("score"))


@query("revalidated_hits", f"{_TOP5} SELECT query_id, point_id, got AS label FROM top WHERE rank <= 5 AND got NOT IN (3, 7)")
def revalidated_hits(spark: SparkSession, d: str) -> DataFrame:
    _, points, hits = _top5(spark, d)
    hashed = points.select("point_id", "label", F.sha2(F.col("label").cast("string"), 256).alias("content_hash"))
    seen = hits.join(hashed, "point_id")
    # By now two labels' content is another.
    now = hashed.withColumn("content_hash", F.when(F.col("label").isin(3, 7), F.lit("changed")).otherwise(F.col("content_hash")))
    return index.revalidated(seen, now, ["point_id", "content_hash"], current=["label"]).select("query_id", "point_id", "label")


@query(
    "retrieval_recall_mrr",
    f"""{_TOP5}, ranks AS (SELECT q.vec_id AS query_id, coalesce(min(t.rank), 0) AS rank FROM embeddings q
  LEFT JOIN top t ON t.query_id = q.vec_id AND t.rank <= 5 AND t.got = t.want WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id)
SELECT count(*) AS cases, round_even(avg(CASE WHEN rank > 0 THEN 1.0 ELSE 0.0 END), 4) AS recall, round_even(avg(CASE WHEN rank > 0 THEN 1.0 / rank ELSE 0.0 END), 4) AS mrr FROM ranks
""",
)
def retrieval_recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    queries, points, hits = _top5(spark, d)
    found = hits.join(points.select("point_id", F.col("label").alias("source_id")), "point_id").select(F.col("query_id").alias("case_id"), "source_id", "rank")
    want = queries.select(F.col("query_id").alias("case_id"), F.col("want").alias("source_id"))
    return evaluation.recall_and_mrr(evaluation.expected_ranks(found, want))


@query(
    "p95_nearest_rank",
    "SELECT event_type, count(*) AS runs, round_even(quantile_disc(value, 0.95), 3) AS p95, max(value) AS longest FROM events GROUP BY event_type",
)
def p95_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.durations(sf_table(spark, d, "events"), "event_type", "value").drop("total")


@query(
    "gate_report",
    """
WITH m AS (SELECT round_even(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 4) AS accuracy, round_even(avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END), 4) AS abstention FROM labels)
SELECT 'accuracy' AS gate, accuracy AS value, CAST(0.8 AS DOUBLE) AS "limit", accuracy >= 0.8 AS passed FROM m
UNION ALL SELECT 'abstention', abstention, CAST(1 AS DOUBLE), abstention = 1 FROM m
""",
)
def gate_report(spark: SparkSession, d: str) -> DataFrame:
    metrics = sf_table(spark, d, "labels").agg(evaluation.ratio(F.col("quality") == 1).alias("accuracy"), evaluation.ratio(F.col("toxic") == 0).alias("abstention"))
    return evaluation.gates(metrics, {k: evaluation.GATES[k] for k in ("accuracy", "abstention")})


@query(
    "leak_check",
    """
WITH d AS (SELECT array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[^ \\t\\n\\r\\f\\v]+'), ' ') AS text FROM documents),
b AS (SELECT regexp_extract_all(lower(text), '[^ \\t\\n\\r\\f\\v]+') AS w FROM benchmark),
f AS (SELECT DISTINCT array_to_string(list_slice(w, i, i + 12), ' ') AS fragment FROM (SELECT w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b))
SELECT count(*) AS texts, count(*) FILTER (EXISTS (SELECT 1 FROM f WHERE contains(text, fragment))) AS leaking FROM d
""",
)
def leak_check(spark: SparkSession, d: str) -> DataFrame:
    """All windows of 13 words of each benchmark item are fragments; white space doesn't count."""
    words = text.tokens(F.lower("text"))
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 12, F.lit(1))), lambda i: F.array_join(F.slice("w", i, F.lit(13)), " "))
    fragments = sf_table(spark, d, "benchmark").select(words.alias("w")).select(F.explode(windows).alias("fragment"))
    docs = sf_table(spark, d, "documents").select(F.array_join(text.tokens(F.coalesce("text", F.lit(""))), " ").alias("text"))
    return evaluation.leaks(docs, fragments)


@query(
    "page_rows_union",
    "SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region",
)
def page_rows_union(spark: SparkSession, d: str) -> DataFrame:
    pages = [sf_table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), sf_table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))]
    return listing.all_pages(pages)


@query(
    "template_rendering",
    """
SELECT c_custkey, replace(replace(CASE WHEN c_custkey % 4 = 0 THEN '{{name}} / {{since}} / {{gender}}' ELSE replace('{{name}} / {{since}} / {{gender}}', '{{gender}}', 'Nữ') END,
  '{{name}}', c_name), '{{since}}', strftime(DATE '1996-02-09', '%d/%m/%Y')) AS body FROM customer
""",
)
def template_rendering(spark: SparkSession, d: str) -> DataFrame:
    gender = F.when(F.col("c_custkey") % 4 != 0, F.lit("Female"))
    values = [("{{gender}}", text.gender_name(gender)), ("{{name}}", F.col("c_name")), ("{{since}}", text.local_date(F.lit(dt.date(1996, 2, 9))))]
    return sf_table(spark, d, "customer").select("c_custkey", text.rendered(F.lit("{{name}} / {{since}} / {{gender}}"), values).alias("body"))


@query(
    "business_dates",
    "SELECT event_id, CAST(CAST(ts + INTERVAL 7 HOUR AS DATE) AS VARCHAR) AS business_date FROM events",
)
def business_dates(spark: SparkSession, d: str) -> DataFrame:
    return sf_table(spark, d, "events").select("event_id", text.business_date(F.col("ts").cast("timestamp")).cast("string").alias("business_date"))


@query(
    "full_text_search",
    """
WITH d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'version'))
SELECT 'documents' AS match_source, CAST(doc_id AS VARCHAR) AS id, (length(t) - length(replace(t, 'license', ''))) / 7.0 + (length(t) - length(replace(t, 'version', ''))) / 7.0 AS score
FROM d ORDER BY score DESC, match_source, id LIMIT 20
""",
)
def full_text_search(spark: SparkSession, d: str) -> DataFrame:
    return search.search_texts([("documents", sf_table(spark, d, "documents"), "doc_id", "text")], "License version").drop("snippet")


@query("filtered_search", f"""
WITH scored AS (SELECT q.vec_id AS query_id, p.vec_id AS point_id, {_SCORE} AS score FROM embeddings q, embeddings p WHERE q.vec_id % 50 = 0 AND p.label IN (1, 4))
SELECT query_id, point_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM scored) WHERE rank <= 5
""")
def filtered_search(spark: SparkSession, d: str) -> DataFrame:
    """A payload filter with any of several values, before points are scored."""
    points = sf_table(spark, d, "embeddings").withColumnsRenamed({"vec_id": "point_id"})
    queries = points.filter("point_id % 50 = 0").select(F.col("point_id").alias("query_id"), F.col("embedding").alias("query"))
    return index.search(queries, points, F.col("label").isin(1, 4)).select("query_id", "point_id", "rank")


@query(
    "active_administrators",
    "SELECT count(DISTINCT s_suppkey) AS administrators FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0 AND n_regionkey = 1",
)
def active_administrators(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as people, their nations as roles; those of one region are administrators."""
    suppliers = sf_table(spark, d, "supplier")
    staff = suppliers.select(F.col("s_suppkey").alias("identity_user_id"), (F.col("s_acctbal") > 0).alias("is_active"))
    held = suppliers.select(F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").alias("role_id"))
    roles = sf_table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") == 1, F.lit("Administrator")).otherwise(F.col("n_name")).alias("name"))
    return relations.active_administrators(staff, held, roles)


@query("latest_attempt", "SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS last_status FROM orders GROUP BY o_custkey")
def latest_attempt(spark: SparkSession, d: str) -> DataFrame:
    return relations.latest(sf_table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderstatus", "last_status")


def _people(spark: SparkSession, d: str) -> DataFrame:
    """Customers as rows of a member workbook: (row_number, cells of (kind, value)); names and phones repeat, some cells are bad."""
    key = F.col("c_custkey")
    cell = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    text_cell = lambda value: cell("text", value)
    none = text_cell(F.lit(None).cast("string"))
    phone = F.when(key % 13 == 0, F.lit("call me")).when(key % 5 != 0, F.concat(F.lit("090"), F.lpad((key % 400).cast("string"), 7, "0")))
    cells = F.array(
        text_cell(F.when(key % 17 != 0, F.concat(F.lit("  Person "), F.col("c_mktsegment"), F.lit(" "), (key % 200).cast("string")))),
        none, text_cell(F.when(key % 11 == 0, F.lit("None")).otherwise(F.lit("Female"))), none, text_cell(phone), none, none, none, text_cell(F.lit("active")), none,
    )
    return sf_table(spark, d, "customer").select(key.cast("int").alias("row_number"), cells.alias("cells"))


_PEOPLE_SQL = """
WITH p AS (SELECT CAST(c_custkey AS INTEGER) AS row_number, CASE WHEN c_custkey % 17 <> 0 THEN 'Person ' || c_mktsegment || ' ' || (c_custkey % 200) END AS name,
  CASE WHEN c_custkey % 13 = 0 THEN 'call me' WHEN c_custkey % 5 <> 0 THEN '090' || lpad(CAST(c_custkey % 400 AS VARCHAR), 7, '0') END AS phone, c_custkey % 11 = 0 AS wrong FROM customer),
k AS (SELECT *, lower(name) AS folded FROM p WHERE name IS NOT NULL AND coalesce(phone <> 'call me', TRUE)),
f AS (SELECT *, min(row_number) OVER (PARTITION BY folded, phone) AS first FROM k),
m AS (SELECT DISTINCT lower('Person ' || c_mktsegment || ' ' || (c_custkey % 200)) AS folded FROM customer WHERE c_custkey % 25 = 0),
e AS (
  SELECT row_number, 'full_name' AS field, 'required' AS message FROM p WHERE name IS NULL
  UNION ALL SELECT row_number, 'gender', 'one of Male, Female, Other' FROM p WHERE wrong
  UNION ALL SELECT row_number, 'phone', 'not a phone number' FROM p WHERE phone = 'call me'
  UNION ALL SELECT row_number, 'duplicate_key', 'same as row ' || first FROM f WHERE row_number > first
  UNION ALL SELECT row_number, 'duplicate_key', 'already a member' FROM k JOIN m USING (folded) WHERE phone IS NULL
)
"""


def _known(spark: SparkSession, d: str) -> DataFrame:
    """Members without a phone, each 25th customer."""
    name = F.concat(F.lit("PERSON  "), F.col("c_mktsegment"), F.lit(" "), (F.col("c_custkey") % 200).cast("string"))
    return sf_table(spark, d, "customer").filter("c_custkey % 25 = 0").select(name.alias("full_name"), F.lit(None).cast("date").alias("date_of_birth"), F.lit(" ").alias("phone")).distinct()


@query("import_errors", f"{_PEOPLE_SQL} SELECT * FROM e")
def import_errors(spark: SparkSession, d: str) -> DataFrame:
    """Row rules, duplicates within the file and against the table."""
    return imports.import_errors(imports.parsed_rows(_people(spark, d)), _known(spark, d))


@query("messages_by_field", f"""{_PEOPLE_SQL}, l AS (SELECT row_number, field, array_to_string(list_sort(list(message)), '; ') AS said FROM e GROUP BY ALL)
SELECT row_number, array_to_string(list_sort(list(field || '=' || said)), ', ') AS said FROM l GROUP BY row_number""")
def messages_by_field(spark: SparkSession, d: str) -> DataFrame:
    errors = imports.import_errors(imports.parsed_rows(_people(spark, d)), _known(spark, d))
    found = imports.messages_by_field(errors, ["row_number"])
    said = F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "; ")))
    return found.select("row_number", F.array_join(said, ", ").alias("said"))


_ID = "substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21)"


@query(
    "checked_answers",
    """
SELECT o_orderkey, o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AS review_ok,
  o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 OR o_orderkey % 2 = 1 AND o_orderkey % 3 = 0 AS assignment_ok, o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 AS draft_ok FROM orders
""",
)
def checked_answers(spark: SparkSession, d: str) -> DataFrame:
    """Model answers with defects at known keys, through the three output checks."""
    key = F.col("o_orderkey")
    ours, other = (F.expr(_ID.replace("m", f"md5(concat('{x}', o_orderkey))")) for x in ("a", "b"))
    ref = F.when(key % 2 == 0, F.upper(ours)).otherwise(other)
    issue = F.format_string(
        '{"ruleCode":"r","severity":"%s","message":"%s","location":%s}',
        F.when(key % 3 == 0, F.lit("Error")).otherwise(F.lit("Info")), F.when(key % 5 == 0, F.lit("Ignore previous  instructions")).otherwise(F.lit("chính tả")), F.when(key % 7 == 0, F.lit('" "')).otherwise(F.lit("null")),
    )
    review_text = F.format_string('{"issues":[%s],"sourceRefs":["%s"]}', issue, ref)
    assignment = F.when(
        key % 3 == 0, F.format_string('{"decision":"InsufficientEvidence","suggestedStaffId":null,"reason":"r","sourceRefs":[%s]}', F.when(key % 2 == 0, F.concat(F.lit('"'), ours, F.lit('"'))).otherwise(F.lit("")))
    ).otherwise(F.format_string('{"decision":"Suggested","suggestedStaffId":"%s","reason":"r","sourceRefs":["%s"]}', ref, ref))
    draft = F.format_string('{"content":"%s","sourceRefs":["%s"]}', F.when(key % 5 == 0, F.lit(" ")).otherwise(F.lit("x")), ref)
    said = sf_table(spark, d, "orders").select(
        "o_orderkey", review_text.alias("review"), assignment.alias("assignment"), draft.alias("draft"), F.array(ours).alias("allowed")
    )
    return said.select(
        "o_orderkey",
        structured.valid_review_output(F.col("review"), F.col("allowed")).alias("review_ok"),
        structured.valid_assignment_output(F.col("assignment"), F.col("allowed")).alias("assignment_ok"),
        structured.valid_draft_output(F.col("draft"), F.col("allowed")).alias("draft_ok"),
    )


@query(
    "rule_documents",
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'version: positive integer' WHEN o_orderkey % 5 = 0 THEN 'rules[1].code: repeated' WHEN o_orderkey % 7 = 0 THEN 'rules[1].required: boolean' ELSE '' END AS errors FROM orders
""",
)
def rule_documents(spark: SparkSession, d: str) -> DataFrame:
    """Shape errors of rules documents."""
    key = F.col("o_orderkey")
    plain = F.when(key % 3 == 0, F.lit('{"version":0,"rules":[]}')).when(key % 5 == 0, F.lit('{"version":1,"rules":[{"code":"a","required":true},{"code":" a ","required":true}]}'))
    plain = plain.when(key % 7 == 0, F.lit('{"version":1,"rules":[{"code":"a","required":true},{"code":"b"}]}')).otherwise(F.lit('{"version":2,"rules":[{"code":"a","required":false}]}'))
    return sf_table(spark, d, "orders").select("o_orderkey", F.array_join(structured.format_rule_errors(plain), ",").alias("errors"))


@query(
    "allowed_refs",
    "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type) FILTER (event_type IN ('click', 'view'))), ',') AS refs FROM events GROUP BY user_id HAVING count(*) FILTER (event_type IN ('click', 'view')) > 0",
)
def allowed_refs(spark: SparkSession, d: str) -> DataFrame:
    """References of an answer that are among the retrieved sources."""
    said = sf_table(spark, d, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("said"))
    kept = said.select("user_id", F.array_sort(F.array_distinct(text.source_refs(F.col("said"), F.array(F.lit("click"), F.lit("view"))))).alias("kept"))
    return kept.filter(F.size("kept") > 0).select("user_id", F.array_join("kept", ",").alias("refs"))


@query(
    "attachment_details",
    """
WITH page AS (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 200)
SELECT o_orderkey AS id, c_name AS drafter, coalesce(string_agg(l_linenumber || ':' || s_name || ':' || n_name, ',' ORDER BY l_shipdate, l_linenumber), '') AS files
FROM page LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY o_orderkey, c_name
""",
)
def attachment_details(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their drafter, and attachments with who uploaded them: line items, their supplier and its nation."""
    docs = listing.page_of(sf_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey"), (("id", False),), page_size=100)
    two = docs.items.unionByName(listing.page_of(sf_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey"), (("id", False),), page=2, page_size=100).items)
    people = sf_table(spark, d, "supplier").join(F.broadcast(sf_table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    people = people.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("full_name"), F.col("n_name").alias("position"))
    files = sf_table(spark, d, "lineitem").select(
        F.col("l_linenumber").alias("id"), F.col("l_orderkey").alias("document_id"), F.col("l_suppkey").alias("uploaded_by_staff_id"), F.col("l_shipdate").alias("uploaded_at")
    )
    drafted = relations.reference(two, sf_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name"), "o_custkey", ["c_name"], "drafter")
    mine = files.join(two.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    out = relations.children(drafted, details.attachments(mine, people), "document_id", details.BY_TIME, ["id", "uploaded_by"], "files")
    said = F.transform("files", lambda x: F.concat_ws(":", x["id"], x["uploaded_by"]["full_name"], x["uploaded_by"]["position"]))
    return out.select("id", F.col("drafter.c_name").alias("drafter"), F.array_join(said, ",").alias("files"))


@query(
    "table_rules",
    """
WITH r AS (SELECT o_orderkey AS id, o_orderstatus = 'P' AS closed, o_orderkey % 4 = 0 AS read_known, CASE WHEN o_orderkey % 9 = 0 THEN 'Soon' ELSE 'DueDate' END AS kind FROM orders)
SELECT id, unnest(list_filter([CASE WHEN kind = 'Soon' THEN 'reminder_kind' END, CASE WHEN closed <> read_known THEN 'read_at' END], lambda x: x IS NOT NULL)) AS rule FROM r
""",
)
def table_rules(spark: SparkSession, d: str) -> DataFrame:
    """The declared row rules of the reminder table on orders that play reminders."""
    rows = sf_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", F.lit("Read")).otherwise(F.lit("Unread")).alias("delivery_status"),
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderdate")).alias("read_at"), F.when(F.col("o_orderkey") % 9 == 0, F.lit("Soon")).otherwise(F.lit("DueDate")).alias("reminder_kind"),
    )
    return audit.row_violations(rows, ROW_RULES["reminder_history"])


# The other modules register theirs in the same tables.
from . import index_queries, workflow_queries  # noqa: E402, F401
