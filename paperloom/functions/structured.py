"""JSON shape checks on variants: the types must be right, so nothing is coerced."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import trimmed

REVIEW_ISSUES = "array<struct<ruleCode:string,severity:string,message:string,location:string>>"


def kind(text: Column, path: str = "$") -> Column:
    """The JSON type at a path: OBJECT, ARRAY, STRING, BIGINT, BOOLEAN and so on; null if the text isn't JSON or has none there."""
    schema = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), path, "variant"))
    return F.regexp_extract(schema, r"^(\w+)", 1)


def _type_of(v: Column, path: str) -> Column:
    """The JSON type at a path of a variant."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), r"^(\w+)", 1)


def issues(text: Column) -> Column:
    """Review issues of a JSON array; malformed text gives none."""
    return F.coalesce(F.from_json(text, REVIEW_ISSUES, {"mode": "PERMISSIVE"}), F.from_json(F.lit("[]"), REVIEW_ISSUES))


def has_exactly(text: Column, names: list[str]) -> Column:
    """Whether the text is a JSON object with these properties and no others."""
    keys = F.json_object_keys(text)
    wanted = F.array(*[F.lit(n) for n in sorted(names)])
    return F.coalesce((kind(text) == "OBJECT") & (F.array_sort(keys) == wanted), F.lit(False))


def format_rule_errors(text: Column) -> Column:
    """Errors of a rules document, in order.

    It must be an object with a positive integer ``version`` and an array ``rules`` of
    objects, each with a non-blank ``code`` that is unique after trimming and a boolean
    ``required``.
    """
    v = F.try_parse_json(text)
    rules = F.try_variant_get(v, "$.rules", "array<variant>")
    at = lambda r, path, as_type: F.try_variant_get(r, path, as_type)
    code = lambda r: F.when(_type_of(r, "$.code") == "STRING", F.trim(at(r, "$.code", "string")))
    codes = F.transform(rules, code)
    whole = F.when(kind(text, "$.version") == "BIGINT", F.try_variant_get(v, "$.version", "bigint"))
    no = lambda ok: ~F.coalesce(ok, F.lit(False))

    def of_rule(r: Column, i: Column) -> Column:
        name = F.concat(F.lit("rules["), i.cast("string"), F.lit("]"))
        say = lambda what: F.concat(name, F.lit(what))
        shape = no(_type_of(r, "$") == "OBJECT")
        first = F.array_position(codes, code(r)) == i + 1
        return F.array_compact(
            F.array(
                F.when(shape, say(": object")),
                F.when(~shape & no(code(r) != ""), say(".code: text")),
                F.when(~shape & F.coalesce((code(r) != "") & ~first, F.lit(False)), say(".code: repeated")),
                F.when(~shape & no(_type_of(r, "$.required") == "BOOLEAN"), say(".required: boolean")),
            )
        )

    head = F.array_compact(
        F.array(
            F.when(no((whole > 0) & (whole <= 2147483647)), F.lit("version: positive integer")),
            F.when(no(kind(text, "$.rules") == "ARRAY"), F.lit("rules: array")),
        )
    )
    inner = F.coalesce(F.flatten(F.transform(rules, of_rule)), F.expr("CAST(array() AS array<string>)"))
    return F.when(no(kind(text) == "OBJECT"), F.array(F.lit("object"))).otherwise(F.concat(head, inner))


def guid(text: Column) -> Column:
    """An id in its usual form: hyphens or none, in braces, brackets or bare; null if it is none."""
    bare = F.lower(trimmed(text))
    hyphens = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    shaped = F.rlike(bare, F.lit(rf"^({hyphens}|\{{{hyphens}\}}|\({hyphens}\)|[0-9a-f]{{32}})$"))
    return F.when(shaped, F.regexp_replace(F.regexp_replace(bare, "[^0-9a-f]", ""), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def _all(*conditions: Column) -> Column:
    """Whether all hold; unknown ones don't."""
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def _refs(text: Column) -> Column:
    """Ids of the array ``sourceRefs``, null for what isn't one."""
    found = F.try_variant_get(F.try_parse_json(text), "$.sourceRefs", "array<variant>")
    return F.transform(found, lambda r: F.when(_type_of(r, "$") == "STRING", guid(F.try_variant_get(r, "$", "string"))))


def _known(refs: Column, allowed: Column) -> Column:
    """Whether all ids are among the allowed ones."""
    ids = F.transform(allowed, guid)
    return F.forall(refs, lambda r: r.isNotNull() & F.coalesce(F.array_contains(ids, r), F.lit(False)))


def _string(text: Column, path: str) -> Column:
    """The trimmed string at a path; null for other types and for none."""
    return F.when(kind(text, path) == "STRING", trimmed(F.try_variant_get(F.try_parse_json(text), path, "string")))


def valid_review_output(text: Column, allowed: Column) -> Column:
    """Whether a reviewer's answer may be used.

    The object has ``issues`` and ``sourceRefs`` only. Each issue is an object of ruleCode,
    severity (Warning or Info), message and location only, all strings that aren't blank;
    the location may be null instead. Each reference is an id in ``allowed``. No message
    draws a legal conclusion or carries instructions.
    """
    found = F.try_variant_get(F.try_parse_json(text), "$.issues", "array<variant>")

    def good(issue: Column) -> Column:
        at = lambda name: F.when(_type_of(issue, f"$.{name}") == "STRING", trimmed(F.try_variant_get(issue, f"$.{name}", "string")))
        return _all(
            has_exactly(F.to_json(issue), ["location", "message", "ruleCode", "severity"]),
            at("ruleCode") != "",
            at("severity").isin("Warning", "Info"),
            at("message") != "",
            (_type_of(issue, "$.location") == "VOID") | (at("location") != ""),
            ~F.rlike(at("message"), F.lit(LEGAL_CONCLUSION)) & ~F.rlike(at("message"), F.lit(UNSAFE_INSTRUCTION)),
        )

    return _all(
        has_exactly(text, ["issues", "sourceRefs"]),
        kind(text, "$.issues") == "ARRAY",
        kind(text, "$.sourceRefs") == "ARRAY",
        _known(_refs(text), allowed),
        F.forall(found, good),
    )


def valid_assignment_output(text: Column, allowed: Column) -> Column:
    """Whether an assignment suggestion may be used.

    The object has decision, suggestedStaffId, reason and sourceRefs only, and a reason.
    References are ids in ``allowed``. A decision Suggested names one of them that is among
    the references; InsufficientEvidence has a null person and no references.
    """
    refs, person = _refs(text), F.when(kind(text, "$.suggestedStaffId") == "STRING", guid(_string(text, "$.suggestedStaffId")))
    decision = F.when(kind(text, "$.decision") == "STRING", F.try_variant_get(F.try_parse_json(text), "$.decision", "string"))
    suggested = _all(decision == "Suggested", F.array_contains(refs, person))
    abstained = _all(decision == "InsufficientEvidence", kind(text, "$.suggestedStaffId") == "VOID", F.size(refs) == 0)
    return _all(
        has_exactly(text, ["decision", "reason", "sourceRefs", "suggestedStaffId"]),
        _string(text, "$.reason") != "",
        kind(text, "$.sourceRefs") == "ARRAY",
        _known(refs, allowed),
        suggested | abstained,
    )


def valid_draft_output(text: Column, allowed: Column) -> Column:
    """Whether a draft may be used: content that isn't blank and at least one reference, all in ``allowed``, and nothing else."""
    refs = _refs(text)
    return _all(
        has_exactly(text, ["content", "sourceRefs"]),
        _string(text, "$.content") != "",
        kind(text, "$.sourceRefs") == "ARRAY",
        F.size(refs) > 0,
        _known(refs, allowed),
    )


def answered(prompts: DataFrame, complete: Callable[[Column], Column], valid: Callable[[Column, Column], Column], prompt: str = "prompt", allowed: str = "allowed") -> DataFrame:
    """``prompts`` with ``answer`` and whether it is ``valid``; an answer that isn't is null.

    ``complete`` maps a column of prompts to one of answers: a pandas UDF around a chat
    client in production, any expression in tests. ``valid`` is one of the checks above.
    """
    said = prompts.withColumn("answer", complete(F.col(prompt)))
    checked = said.withColumn("valid", valid(F.col("answer"), F.col(allowed)))
    return checked.withColumn("answer", F.when(F.col("valid"), F.col("answer")))


# What a reviewer must not say.
LEGAL_CONCLUSION = r"(?iuU)hợp pháp|đúng luật|trái luật|kết luận pháp lý|legally\s+valid|legal\s+conclusion|lawful|unlawful"
UNSAFE_INSTRUCTION = r"(?iuU)ignore\s+(all\s+)?(previous\s+)?instructions|system\s+prompt|raw\s+prompt"
