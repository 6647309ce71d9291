import datetime as dt

import pytest
from pyspark.sql import functions as F

from paperloom.functions.providers import hashed_embedding
from paperloom.operators import audit, chunking, evaluation, index, lifecycle, listing, mutations, relations, reminders, review, search
from paperloom.schemas import ROW_RULES, UNIQUE_KEYS
from paperloom.sources import catalog
from paperloom.sources.tables import empty_table

NOW = dt.datetime(2026, 8, 2, 9, 0)


def ids(df, column="id"):
    return [r[column] for r in df.select(column).collect()]


# listings


def test_page_limits():
    assert listing.checked_page(None, None) == (1, 20)
    for bad in ((0, 20), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            listing.checked_page(*bad)
    with pytest.raises(ValueError):
        listing.query_text("x" * 201)
    assert listing.query_text("  Nguyễn   An ", collapse=True) == "nguyễn an" and listing.query_text("  ") is None


def members(spark):
    rows = [("m1", "Trần Bình", "0901", "binh@x.vn", "Active"), ("m2", "Nguyễn An", "0902", "an@x.vn", "Active"), ("m3", "Lê 100%", None, None, "Inactive")]
    return spark.createDataFrame(rows, "id string, full_name string, phone string, email string, status string")


def test_member_listing(spark):
    people = members(spark)
    page = listing.members(people, page_size=2)
    assert (ids(page.items), page.total_count(), page.total_pages()) == (["m3", "m2"], 3, 2)
    assert ids(listing.members(people, q=" NGUYỄN   an ").items) == ["m2"]
    assert ids(listing.members(people, q="100%").items) == ["m3"] and ids(listing.members(people, q="_").items) == []
    assert ids(listing.members(people, q="x.vn", status="Active").items) == ["m2", "m1"]
    past = listing.members(people, page=9)
    assert ids(past.items) == [] and past.total_count() == 3
    none = listing.members(people, q="nobody")
    assert (none.total_count(), none.total_pages()) == (0, 0)
    assert listing.member_lookup(people, q="0901").items.columns == ["id", "full_name", "phone"]


def incoming(spark, rows):
    base = empty_table(spark, "incoming_documents")
    full = [
        dict(reference_number=f"R{r['id']}", sender_org="Org", summary="s", received_date=dt.date(2026, 1, 1), document_type_id="t", created_at=NOW, updated_at=NOW, status="New") | r
        for r in rows
    ]
    return spark.createDataFrame([tuple(r.get(c) for c in base.columns) for r in full], base.schema)


def test_incoming_listing(spark):
    day = dt.date
    docs = incoming(spark, [
        {"id": "a", "summary": "Khẩn cấp", "received_date": day(2026, 1, 2), "deadline": day(2026, 2, 1)},
        {"id": "b", "summary": "khẩn", "received_date": day(2026, 1, 3), "deadline": day(2026, 2, 2)},
        {"id": "c", "received_date": day(2026, 1, 3), "deadline": day(2026, 3, 1), "document_type_id": "u"},
    ])
    assert ids(listing.incoming_documents(docs, q="  KHẨN ").items) == ["b", "a"]
    assert ids(listing.incoming_documents(docs, deadline_from=day(2026, 2, 1), deadline_to=day(2026, 2, 2), page_size=1).items) == ["b"]
    assert ids(listing.incoming_documents(docs, document_type_id="u").items) == ["c"]
    with pytest.raises(ValueError):
        listing.incoming_documents(docs, deadline_from=day(2026, 2, 2), deadline_to=day(2026, 2, 1))


def test_access(spark):
    staff = spark.createDataFrame([("s1", "A", True), ("s2", "B", False)], "id string, full_name string, is_active boolean")
    assert ids(listing.staff(staff).items) == ["s1", "s2"] and ids(listing.staff(staff, active=True, roles=("Clerk",)).items) == ["s1"]
    with pytest.raises(PermissionError):
        listing.staff(staff, roles=("Clerk",))
    history = spark.createDataFrame([("r1", "s1", "Unread", NOW), ("r2", "s2", "Read", NOW)], "id string, recipient_staff_id string, delivery_status string, created_at timestamp")
    assert ids(listing.reminders(history, "s1", False).items) == ["r1"] and ids(listing.reminders(history, "s1", True, "s2").items) == ["r2"]
    with pytest.raises(PermissionError):
        listing.reminders(history, "s1", False, "s2")
    with pytest.raises(PermissionError):
        listing.reminders(history, "s1", False, "s1")


def test_navigation(spark):
    entries = spark.createDataFrame([("home", "/a"), ("docs", "/a/docs"), ("other", "/a/do")], "key string, prefix string")
    assert listing.navigation_key(entries, "/a/docs/7").first().key == "docs"


# relations


def test_roles(spark):
    staff = spark.createDataFrame([("s1", "u1", True), ("s2", "u2", True), ("s3", "u3", False)], "id string, identity_user_id string, is_active boolean")
    user_roles = spark.createDataFrame([("u1", "r1"), ("u1", "r2"), ("u3", "r1")], "user_id string, role_id string")
    roles = spark.createDataFrame([("r1", "Administrator"), ("r2", " Clerk "), ("r3", None)], "id string, name string")
    found = {r.id: r.roles for r in relations.with_roles(staff, user_roles, roles).collect()}
    assert found == {"s1": ["Administrator", "Clerk"], "s2": [], "s3": ["Administrator"]}
    assert relations.active_administrators(staff, user_roles, roles).first().administrators == 1
    current = relations.roles_by_user(user_roles, roles)
    wanted = spark.createDataFrame([("u1", ["Clerk", "Leader"])], "user_id string, roles array<string>")
    change = {r.user_id: r for r in relations.may_replace_roles(relations.role_change(current, wanted), 1).collect()}
    assert (change["u1"].added, change["u1"].removed, change["u1"].allowed) == (["Leader"], ["Administrator"], False)


def test_children_are_sorted_and_default_to_none(spark):
    docs = spark.createDataFrame([("d1",), ("d2",)], "id string")
    items = spark.createDataFrame([("d1", "a", 1), ("d1", "b", 2), ("d1", "c", 2)], "doc string, item string, at int")
    got = {r.id: [x.item for x in r["items"]] for r in relations.children(docs, items, "doc", [("at", True), ("item", False)], ["item"], "items").collect()}
    assert got == {"d1": ["b", "c", "a"], "d2": []}


def test_reference_of_a_null_key(spark):
    docs = spark.createDataFrame([("d1", "s1"), ("d2", None), ("d3", "gone")], "id string, staff string")
    staff = spark.createDataFrame([("s1", "An")], "id string, full_name string")
    got = {r.id: r.person and r.person.full_name for r in relations.reference(docs, staff, "staff", ["full_name"], "person").collect()}
    assert got == {"d1": "An", "d2": None, "d3": None}


# mutations


def test_patch_clears_and_keeps(spark):
    rows = spark.createDataFrame([("a", "x", "y", NOW), ("b", "x", "y", NOW)], "id string, p string, q string, updated_at timestamp")
    patches = spark.createDataFrame([("a", None, True, "z", False)], "id string, p string, has_p boolean, q string, has_q boolean")
    later = dt.datetime(2026, 8, 3)
    got = {r.id: (r.p, r.q, r.updated_at) for r in mutations.patched(rows, patches, ["p", "q"], F.lit(later)).collect()}
    assert got == {"a": (None, "y", later), "b": ("x", "y", NOW)}


def test_mark_read_once(spark):
    history = spark.createDataFrame([("r", "s", "Unread", None)], "id string, recipient_staff_id string, delivery_status string, read_at timestamp")
    once = mutations.marked_read(history, "r", "s", F.lit(NOW))
    assert mutations.affected(once).first().affected == 1
    twice = mutations.marked_read(once.drop("changed"), "r", "s", F.lit(dt.datetime(2030, 1, 1)))
    assert (twice.first().read_at, twice.first().changed) == (NOW, False)
    assert mutations.affected(mutations.marked_read(history, "r", "other", F.lit(NOW))).first().affected == 0


def test_seed_is_idempotent(spark):
    types, templates = empty_table(spark, "document_types"), empty_table(spark, "document_templates")
    types, templates, counts = mutations.seed_catalog(types, templates, catalog.definitions(spark), F.lit(NOW))
    assert tuple(counts.first()) == (7, 0, 0) and types.count() == 7
    again = mutations.seed_catalog(types, templates, catalog.definitions(spark), F.lit(NOW))
    assert tuple(again[2].first()) == (0, 7, 0) and again[1].count() == 7
    asleep = types.withColumn("is_active", F.col("code") != "PLAN")
    fresh = mutations.seed_catalog(asleep, empty_table(spark, "document_templates"), catalog.definitions(spark), F.lit(NOW))
    assert tuple(fresh[2].first()) == (6, 0, 1)


# reminders


def test_reminder_scenario(spark):
    today = dt.date(2026, 8, 2)
    day = lambda n: today + dt.timedelta(days=n)
    docs = incoming(spark, [
        {"id": "1", "deadline": day(3), "assigned_to_staff_id": "s"},
        {"id": "2", "deadline": day(0), "assigned_to_staff_id": "s"},
        {"id": "3", "deadline": day(-1), "assigned_to_staff_id": "s"},
        {"id": "4", "deadline": day(-1)},
        {"id": "5", "deadline": day(-1), "assigned_to_staff_id": "s", "status": "Completed"},
    ])
    history = empty_table(spark, "reminder_history")
    docs1, new, counts = reminders.run_day(docs, history, F.lit(today), F.lit(NOW))
    assert tuple(counts.first()) == (2, 3, 0)
    assert {r.incoming_document_id: r.reminder_kind for r in new.collect()} == {"1": "BeforeDeadline", "2": "DueDate", "3": "Overdue"}
    history = history.unionByName(new)
    assert tuple(reminders.run_day(docs1, history, F.lit(today), F.lit(NOW))[2].first()) == (0, 0, 3)
    _, new2, counts2 = reminders.run_day(docs1, history, F.lit(day(1)), F.lit(NOW))
    assert tuple(counts2.first())[:2] == (1, 2) and history.unionByName(new2).count() == 5


# review

HEAD, NUMBER, SIGN = "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM\nĐộc lập - Tự do - Hạnh phúc", "Số: 1/KH", "ĐẠI DIỆN CƠ QUAN\n(Ký, ghi rõ họ tên)"


@pytest.mark.parametrize(
    "content, codes",
    [
        (f"{NUMBER}\n{HEAD}\nNội dung\n{SIGN}", []),
        (f"{NUMBER}\nNội dung\n{SIGN}", ["national_header"]),
        (f"{HEAD}\nNội dung\n{SIGN}", ["reference_number"]),
        (f"{NUMBER}\n{HEAD}\nNội dung", ["signature_block"]),
        ("Nội dung", ["national_header", "reference_number", "signature_block"]),
        (f"{NUMBER}\n{HEAD}\nraw prompt\n{SIGN}", []),
        (f"số :2\n{HEAD.lower()}\n{SIGN.lower()}", []),
        (f"x Số: 1\r{HEAD}\n{SIGN}", ["reference_number"]),
    ],
)
def test_format_review(spark, content, codes):
    docs = spark.createDataFrame([(content,)], "content string")
    row = review.review(docs, [r.code for r in review.RULES]).first()
    assert [i.ruleCode for i in row.issues] == codes
    assert (row.review_source, row.review_result) == (("Rule", "Failed") if codes else ("Hybrid", None))


def test_unknown_rule_and_no_rules(spark):
    docs = spark.createDataFrame([("x",)], "content string")
    with pytest.raises(ValueError):
        review.review(docs, ["other"])
    assert review.review(docs, []).first().review_source == "AI"


# chunks and index


def test_windows(spark):
    for n in (1, 480, 481, 896, 897, 1500):
        words = [str(i) for i in range(n)]
        want, start = [], 0
        while True:
            want.append(words[start : start + 480])
            if start + 480 >= n:
                break
            start += 416
        got = spark.createDataFrame([(words,)], "w array<string>").select(chunking.windows(F.col("w")).alias("o")).first().o
        assert got == want, n


def test_chunks(spark):
    body = " ".join(f"w{i}" for i in range(600))
    texts = spark.createDataFrame([("t", f"  KẾ HOẠCH\r\nmở đầu\n\ntiếp\nI. Mục đích\n{body}\n")], "id string, text string")
    got = [r.chunk for r in chunking.chunks(texts).orderBy("chunk_no").collect()]
    assert got[0] == "KẾ HOẠCH\nmở đầu\n\ntiếp" and len(got) == 3 and got[1].startswith("I. Mục đích w0") and got[2].endswith("w599")
    assert chunking.oversized(chunking.chunks(texts)).isEmpty()


def test_index_synchronisation(spark):
    templates = spark.createDataFrame([("a-b", "Mẫu", "PLAN", "Kế hoạch", "một hai", NOW), ("c-d", "Mẫu 2", "PLAN", "Kế hoạch", "ba bốn", NOW)], "id string, name string, code string, type_name string, template_content string, updated_at timestamp")
    sources = chunking.template_sources(templates).withColumns({"source_type": F.lit("Template")})
    empty = sources.limit(0).withColumn("embedding", F.array().cast("array<float>"))
    calls = spark.sparkContext.accumulator(0)
    compared = ["source_version", "chunk_id", "content_hash"]
    first = index.synchronised(sources, empty, compared, hashed_embedding(16)).cache()
    assert first.count() == 2 and index.wrong_size(first, 16).isEmpty()
    changed = sources.withColumn("content_hash", F.when(F.col("source_id") == "a-b", F.lit("new")).otherwise(F.col("content_hash"))).filter("source_id = 'a-b'")
    states = {r.point_id: r.state for r in index.difference(changed, first, "point_id", compared).collect()}
    assert sorted(states.values()) == ["changed", "stale"] and calls.value == 0
    assert [r.content_hash for r in index.synchronised(changed, first, compared, hashed_embedding(16)).collect()] == ["new"]


def test_search_and_revalidation(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0], "h1"), (2, [1.0, 0.0], "h2"), (3, [0.0, 1.0], "h3"), (4, [0.9, 0.1], "h4")], "point_id int, embedding array<float>, content_hash string")
    queries = spark.createDataFrame([(7, [1.0, 0.0])], "query_id int, query array<float>")
    hits = index.search(queries, points, F.col("point_id") != 4, least=0.5, top=5)
    assert [(r.point_id, r["rank"]) for r in hits.orderBy("rank").collect()] == [(1, 1), (2, 2)]
    now = spark.createDataFrame([(1, "h1", "fresh"), (2, "other", "x")], "point_id int, content_hash string, content string")
    valid = index.revalidated(hits.join(points.select("point_id", "content_hash"), "point_id"), now, ["point_id", "content_hash"], ["content"])
    assert [(r.point_id, r.content) for r in valid.collect()] == [(1, "fresh")]


def test_lexical_candidates(spark):
    queries = spark.createDataFrame([("q1", "Lập dự toán kinh phí năm"), ("q2", "Thời tiết")], "query_id string, query string")
    sources = spark.createDataFrame([("fin", "Phụ trách kinh phí và dự toán"), ("clerk", "Văn thư, dự toán")], "source_id string, content string")
    signals = spark.createDataFrame([("fin", "dự toán"), ("clerk", "văn thư")], "source_id string, phrase string")
    got = search.lexical_candidates(queries, sources, signals).collect()
    assert [(r.query_id, r.source_id) for r in got] == [("q1", "fin")] and "kinh" in got[0].overlap
    decided = evaluation.decide(spark.createDataFrame([("q1", "fin"), ("q2", None), ("q3", "a"), ("q3", "b")], "case_id string, source_id string"))
    assert {r.case_id: r.source_id for r in decided.collect()} == {"q1": "fin", "q2": None, "q3": None}


# evaluation


def test_metrics(spark):
    ranks = spark.createDataFrame([("a", 1), ("b", 2), ("c", 0), ("d", 6)], "case_id string, rank int")
    row = evaluation.recall_and_mrr(ranks).first()
    assert (row.cases, row.recall, row.mrr) == (4, 0.5, 0.375)
    assert evaluation.least_score(spark.createDataFrame([(0.316665,), (0.1,)], "score double")).first().least == 0.316666
    assert evaluation.least_score(spark.createDataFrame([], "score double")).first().least == 1e-6
    for n in (1, 19, 20, 21, 60):
        values = spark.createDataFrame([(float(i),) for i in range(1, n + 1)], "v double")
        assert values.agg(evaluation.p95("v").alias("p")).first().p == float(-(-95 * n // 100))
    assert spark.createDataFrame([], "v double").agg(evaluation.p95("v").alias("p")).first().p is None


def test_gates(spark):
    metrics = spark.createDataFrame([(0.95, None)], "recall double, mrr double")
    report = evaluation.gates(metrics, {k: evaluation.GATES[k] for k in ("recall", "mrr")})
    assert {r.gate: r.passed for r in report.collect()} == {"recall": True, "mrr": False}
    assert evaluation.all_passed(report).first().passed is False


def test_decision_scores(spark):
    decisions = spark.createDataFrame([("a", "Suggested", "s"), ("b", "Suggested", "t"), ("c", "InsufficientEvidence", None)], "case_id string, decision string, source_id string")
    expected = spark.createDataFrame([("a", "Suggested", "s"), ("b", "Suggested", "s"), ("c", "InsufficientEvidence", None)], "case_id string, decision string, source_id string")
    assert tuple(evaluation.decision_scores(decisions, expected).first()) == (0.5, 1.0)


# lifecycle


def test_assignment_and_completion(spark):
    docs = incoming(spark, [{"id": "a", "deadline": dt.date(2026, 2, 1)}])
    suggested = lifecycle.assignment_suggested(docs, spark.createDataFrame([("a", "Suggested", "s1", "why")], "id string, decision string, staff_id string, reason string"), F.lit(NOW))
    assert suggested.first().suggested_staff_id == "s1"
    cleared = lifecycle.assignment_suggested(suggested, spark.createDataFrame([("a", "InsufficientEvidence", None, None)], "id string, decision string, staff_id string, reason string"), F.lit(NOW))
    assert (cleared.first().suggested_staff_id, cleared.first().assignment_suggested_at) == (None, None)
    confirmed = lifecycle.assignment_confirmed(docs, "a", "s1", "s9", F.lit(NOW)).drop("changed")
    assert confirmed.first().status == "InProgress"
    assert lifecycle.completed(confirmed, "a", "other", False, F.lit(NOW)).first().changed is False
    done = lifecycle.completed(confirmed, "a", "s1", False, F.lit(NOW)).drop("changed")
    assert done.first().status == "Completed" and audit.row_violations(done, ROW_RULES["incoming_documents"]).isEmpty()


def outgoing(spark, rows):
    base = empty_table(spark, "outgoing_documents")
    full = [dict(template_id="t", title="T", content="C", drafted_by_staff_id="s", review_issues="[]", created_at=NOW, updated_at=NOW) | r for r in rows]
    return spark.createDataFrame([tuple(r.get(c) for c in base.columns) for r in full], base.schema)


def test_draft_is_kept_once(spark):
    docs = outgoing(spark, [{"id": "a", "status": "Editing"}])
    one = lifecycle.draft_saved(docs, "a", "Editing", F.lit(NOW), "draft 1", F.lit(NOW)).drop("changed")
    assert (one.first().status, one.first().ai_draft_content) == ("AiDraft", "draft 1")
    two = lifecycle.draft_saved(one, "a", "AiDraft", F.lit(NOW), "draft 2", F.lit(NOW))
    assert (two.first().status, two.first().ai_draft_content, two.first().content) == ("Editing", "draft 1", "draft 2")
    late = lifecycle.draft_saved(one, "a", "AiDraft", F.lit(dt.datetime(2020, 1, 1)), "draft 3", F.lit(NOW))
    assert late.first().changed is False


def test_review_and_approval(spark):
    docs = outgoing(spark, [{"id": "a", "status": "Editing"}, {"id": "b", "status": "Editing"}])
    for doc in ("a", "b"):
        docs = lifecycle.review_claimed(docs, doc, F.lit(NOW), F.lit(NOW)).drop("changed")
    history = empty_table(spark, "review_history")
    reviews = spark.createDataFrame([("a", "Rule", None, "Failed", "[{}]"), ("b", "Hybrid", "s", "Passed", "[]")], "outgoing_document_id string, review_source string, reviewed_by_staff_id string, review_result string, review_issues string")
    docs, history = lifecycle.review_committed(docs, history, reviews, F.lit(NOW))
    assert {r.id: r.status for r in docs.collect()} == {"a": "ReviewFailed", "b": "PendingApproval"}
    assert [r.attempt_no for r in history.collect()] == [1, 1] and audit.row_violations(history, ROW_RULES["review_history"]).isEmpty()
    decisions = spark.createDataFrame([("a", "l", "Approve"), ("b", "l", "Approve")], "id string, leader_id string, decision string")
    out = lifecycle.approval_decided(docs, history, decisions, F.lit(NOW))
    assert {r.id: (r.status, r.changed) for r in out.collect()} == {"a": ("ReviewFailed", False), "b": ("Approved", True)}
    archived = lifecycle.archived(out.drop("changed"), "b", "01/KH", dt.date(2026, 8, 2), F.lit(NOW)).drop("changed")
    assert {r.id: r.status for r in archived.collect()}["b"] == "Archived"
    assert audit.row_violations(archived, ROW_RULES["outgoing_documents"]).isEmpty()


def test_audit(spark):
    docs = incoming(spark, [
        {"id": "a", "deadline": dt.date(2025, 1, 1), "status": "Lost"}, {"id": "b", "deadline": dt.date(2026, 2, 1), "status": "Completed"},
        {"id": "c", "deadline": dt.date(2026, 2, 1), "suggested_staff_id": "s"}, {"id": "d", "deadline": dt.date(2026, 2, 1), "assigned_to_staff_id": "s"},
    ])
    got = {(r.id, r.rule) for r in audit.row_violations(docs, ROW_RULES["incoming_documents"]).collect()}
    assert got == {("a", "status"), ("a", "received_before_deadline"), ("b", "completed_at"), ("c", "suggestion_tuple"), ("d", "assignment_tuple")}
    keys = spark.createDataFrame([("1", None), ("2", None), ("3", "x"), ("4", "x")], "id string, reference_number string")
    assert [tuple(r) for r in audit.repeated_keys(keys, list(UNIQUE_KEYS["outgoing_documents"][0])).collect()] == [("x", 2)]


def test_keys_given_twice(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, v string")
    patches = spark.createDataFrame([("a", "1", True, 2), ("a", "2", True, 1)], "id string, v string, has_v boolean, at int")
    assert sorted(tuple(r) for r in mutations.patched(rows, patches, ["v"], order="at").collect()) == [("a", "1"), ("b", "y")]
    assert sorted(tuple(r) for r in mutations.patched(rows, patches, ["v"]).collect()) == [("a", "2"), ("b", "y")]
    new = spark.createDataFrame([("b", "1"), ("b", "2"), ("c", None)], "id string, v string")
    assert sorted(map(str, (tuple(r) for r in mutations.upserted(rows, new, ["id"]).collect()))) == ["('a', 'x')", "('b', '2')", "('c', None)"]


def test_leaks_of_any_length(spark):
    texts = spark.createDataFrame([("The quick brown fox JUMPS over",), ("short words",), (None,), ("quick  brown fox jumps",), ("thequick brown foxes",)], "text string")
    count = lambda *f: tuple(evaluation.leaks(texts, spark.createDataFrame([(x,) for x in f], "fragment string")).first())
    assert count("he quick brown fox j") == (5, 1) and count("ORT") == (5, 1) and count("quick brown fo", "short") == (5, 3)
    assert count("x quick brown fox jumps y") == (5, 0) and count("") == (5, 5) and count() == (5, 0)


def test_search_counts_ties_and_odd_vectors(spark):
    points = spark.createDataFrame([(i, [1.0, 0.0] if i < 8 else [0.0, 0.0] if i == 8 else None) for i in range(10)], "point_id long, embedding array<float>")
    queries = spark.createDataFrame([(3, [2.0, 0.0])], "query_id long, query array<float>")
    got = index.search(queries, points, but=F.col("query_id") == F.col("point_id")).orderBy("rank").collect()
    assert [r.point_id for r in got] == [0, 1, 2, 4, 5]
    assert index.search(queries.limit(0), points).count() == 0
