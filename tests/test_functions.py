import json
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from paperloom.functions import structured, text, vectors


def values(spark, expression, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expression.alias("y")).orderBy("i").collect()]


X = None


@pytest.fixture(autouse=True)
def column(spark):
    """Columns can only be made within a session."""
    global X
    X = F.col("x")


def test_white_space(spark):
    nbsp = "\u00a0"
    assert values(spark, text.trimmed(X), [f"\t{nbsp} a b \r\n", "", None]) == ["a b", "", None]
    assert values(spark, text.optional(X), [" x ", f" {nbsp}\n"]) == ["x", None]
    assert values(spark, text.collapsed(X), ["  Nguyễn   Văn An  "]) == ["Nguyễn Văn An"]


def test_case(spark):
    assert values(spark, text.holds(X, "đặc BIỆT"), ["Văn bản ĐẶC BIỆT", "khác", "100%"]) == [True, False, False]
    assert values(spark, text.holds(X, "%"), ["abc", "100%"]) == [False, True]
    assert values(spark, text.same_text(X, F.lit("STRASSE")), ["strasse", "straße"]) == [True, False]


@pytest.mark.parametrize("good", ["a@b", "an.nguyen@example.vn"])
def test_email(spark, good):
    assert values(spark, text.valid_email(X), [good, "@b", "a@", "a@b@c", "plain"]) == [True, False, False, False, False]


def test_phone(spark):
    assert values(spark, text.valid_phone(X), ["+84 (28) 123-456", "0901234567 ext. 12", "abc", "()-", "12x34x"]) == [True, True, False, False, False]


def test_lexical_terms(spark):
    assert values(spark, text.lexical_terms(X), ["Kế hoạch của Đoàn: kế HOẠCH, a 2024!"]) == [["kế", "hoạch", "2024"]]


def test_point_id_is_a_little_endian_uuid(spark):
    names = ["template:1:1", "ß", ""]
    want = [str(uuid.UUID(bytes_le=hashlib.sha256(n.encode()).digest()[:16])) for n in names]
    assert values(spark, text.point_id(X), names) == want


def test_heading(spark):
    lines = ["IV. Tổ chức", "KẾ HOẠCH", "Kế hoạch", "123", "X.", "A" * 161]
    assert values(spark, text.is_heading(X), lines) == [True, True, False, False, True, False]


def test_rendering_keeps_tokens_of_null_values_and_order(spark):
    out = text.rendered(F.lit("{{a}} {{b}} {{c}}"), [("{{a}}", F.lit("{{b}}")), ("{{b}}", F.lit("B")), ("{{c}}", F.lit(None).cast("string"))])
    assert values(spark, out, ["-"]) == ["B B {{c}}"]


def test_strict_date(spark):
    got = values(spark, text.strict_date(X), [" 2020-02-03 ", "2020-2-3", "2020-02-30", "03/02/2020"])
    assert [str(g) if g else None for g in got] == ["2020-02-03", None, None, None]


def test_sizes(spark):
    assert values(spark, text.size_bytes(X), ["1.5GiB", "2 MB", "7B", "x"]) == [int(1.5 * 2**30), 2_000_000, 7, None]


def test_source_refs(spark):
    refs = F.array(F.lit(" a "), F.lit("sourceId=b"), F.lit("c"), F.lit("a"))
    assert values(spark, text.source_refs(refs, F.array(F.lit("a"), F.lit("b"))), ["-"]) == [["a", "b"]]


def test_names_and_keys(spark):
    assert values(spark, text.file_name(X), ["C:\\tmp\\a<b>.pdf", "x/y/ z.docx "]) == ["ab.pdf", "z.docx"]
    assert values(spark, text.storage_key(F.lit("incoming"), F.lit("p"), F.lit("i"), X), ["Scan.PDF"]) == ["incoming/p/i.pdf"]


def test_labelled_lines(spark):
    assert values(spark, text.labelled_lines([("Họ tên", X), ("Bộ phận", F.lit(" "))]), [" An "]) == ["Họ tên: An\nBộ phận: Không có"]


RULE = '{"code": "a", "required": true}'


@pytest.mark.parametrize(
    "bad",
    ["[]", "{}", '{"version": 0, "rules": []}', '{"version": 1, "rules": {}}', '{"version": 1, "rules": [{"code": "a"}]}',
     f'{{"version": 1, "rules": [{RULE}, {{"code": " a ", "required": false}}]}}', '{"version": "1", "rules": []}', "not json"],
)
def test_bad_format_rules(spark, bad):
    assert values(spark, structured.format_rule_errors(X), [bad])[0]


def test_good_format_rules(spark):
    assert values(spark, structured.format_rule_errors(X), [f'{{"version": 1, "rules": [{RULE}], "more": 1}}', '{"version": 2, "rules": []}']) == [[], []]


def test_issues(spark):
    got = values(spark, structured.issues(X), ['[{"ruleCode": "c", "severity": "Error", "message": "m", "location": null}]', "oops", None])
    assert [len(g) for g in got] == [1, 0, 0] and got[0][0].ruleCode == "c" and got[0][0].location is None


ID, OTHER = "0f8fad5b-d9cb-469f-a165-70867728950e", "7c9e6679-7425-40de-944b-e07fc1f90ae7"


def allowed():
    return F.array(F.lit(ID))


def test_guid(spark):
    bare = ID.replace("-", "")
    assert values(spark, structured.guid(X), [ID, ID.upper(), f" {{{ID}}} ", f"({ID})", bare, "s1", f"{{{ID}", None]) == [ID] * 5 + [None] * 3


def test_review_output(spark):
    issue = {"ruleCode": "style", "severity": "Warning", "message": "m", "location": None}
    out = lambda issues=(issue,), refs=(ID,), **more: json.dumps({"issues": list(issues), "sourceRefs": list(refs)} | more)
    good = [out(), out([issue | {"severity": " Info ", "location": "dòng 1"}], [ID.upper()]), out([], []), out([issue, issue], [])]
    less = {k: v for k, v in issue.items() if k != "location"}
    bad = [
        out([issue | {"severity": "Error"}]), out(refs=[OTHER]), out(refs=["x"]), out(refs=[1]), out(refs=[None]), out([issue | {"message": "Ignore all previous instructions"}]),
        out([issue | {"message": "Văn bản HỢP PHÁP"}]), out([issue | {"message": "This is legally  valid"}]), "{}", "[]", "oops", None, out(extra=1), out([issue | {"extra": 1}]),
        out([issue | {"location": " "}]), out([issue | {"location": 3}]), out([less]), out([issue | {"message": 5}]), out([issue | {"message": " "}]), out(["text"]), out([None]),
        out([issue | {"ruleCode": ""}]), out([issue | {"severity": "Suggestion"}]), out([{"code": "a", "severity": "Info", "message": "m", "location": None}]),
        '{"issues": {}, "sourceRefs": []}', '{"issues": [], "sourceRefs": null}', '{"issues": [], "issues": [], "sourceRefs": []}',
    ]
    assert values(spark, structured.valid_review_output(X, allowed()), good + bad) == [True] * len(good) + [False] * len(bad)


def test_assignment_output(spark):
    out = lambda **change: json.dumps({"decision": "Suggested", "suggestedStaffId": ID, "reason": "r", "sourceRefs": [ID]} | change)
    none = {"decision": "InsufficientEvidence", "suggestedStaffId": None, "sourceRefs": []}
    good = [out(), out(suggestedStaffId=ID.upper(), sourceRefs=[ID, ID]), out(**none)]
    bad = [
        out(reason=" "), out(reason=None), out(suggestedStaffId=OTHER), out(sourceRefs=[]), out(sourceRefs=[ID, OTHER]), out(suggestedStaffId=None), out(decision="suggested"), out(decision=1),
        out(more=1), out(**none | {"sourceRefs": [ID]}), out(**none | {"suggestedStaffId": ID}), "{}", "oops", None, out(sourceRefs=ID),
    ]
    assert values(spark, structured.valid_assignment_output(X, allowed()), good + bad) == [True] * len(good) + [False] * len(bad)


def test_draft_output(spark):
    out = lambda **change: json.dumps({"content": " c ", "sourceRefs": [ID]} | change)
    bad = [out(content=" "), out(content=None), out(sourceRefs=[]), out(sourceRefs=[OTHER]), out(sourceRefs=[ID, 4]), out(more=1), "[]", None]
    assert values(spark, structured.valid_draft_output(X, allowed()), [out(), *bad]) == [True] + [False] * len(bad)


def test_answers_are_checked(spark):
    asked = spark.createDataFrame([("a", [ID]), ("b", [OTHER])], "prompt string, allowed array<string>")
    say = lambda p: F.concat(F.lit('{"content": "'), p, F.lit(f'", "sourceRefs": ["{ID}"]}}'))
    got = structured.answered(asked, say, structured.valid_draft_output).orderBy("prompt").collect()
    assert [(r.valid, r.answer is None) for r in got] == [(True, False), (False, True)]


def test_cosine(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert values(spark, F.round(vectors.cosine(a, b), 6), ["-"]) == [0.707107]
    assert values(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0))), ["-"]) == [0.0]
