"""Deterministic format review."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.structured import REVIEW_ISSUES
from ..functions.text import holds, matches


@dataclass(frozen=True)
class FormatRule:
    """A text passes if it holds all phrases and matches all patterns, without regard to case."""

    code: str
    message: str
    location: str
    phrases: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()


# The rules that the engine knows.
RULES = (
    FormatRule("national_header", "Thiếu hoặc sai quốc hiệu, tiêu ngữ.", "Đầu văn bản", ("CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM",), (r"Độc lập\s*-\s*Tự do\s*-\s*Hạnh phúc",)),
    FormatRule("reference_number", "Thiếu số hoặc ký hiệu văn bản.", "Đầu văn bản", (), (r"^Số\s*:",)),
    FormatRule("signature_block", "Thiếu khối chữ ký bắt buộc.", "Cuối văn bản", ("ĐẠI DIỆN CƠ QUAN", "Ký, ghi rõ họ tên")),
)


def passes(text: Column, rule: FormatRule) -> Column:
    out = F.lit(True)
    for phrase in rule.phrases:
        out = out & holds(text, phrase)
    for pattern in rule.patterns:
        out = out & matches(text, pattern, lines=True)
    return out


def format_issues(text: Column, codes: list[str], rules: tuple[FormatRule, ...] = RULES) -> Column:
    """Issues of the required rules, in their order; an unknown rule is an error before anything runs."""
    known = {r.code: r for r in rules}
    if unknown := [c for c in codes if c not in known]:
        raise ValueError(f"unsupported rules: {unknown}")
    found = [
        F.when(
            ~passes(text, known[c]),
            F.struct(F.lit(c).alias("ruleCode"), F.lit("Error").alias("severity"), F.lit(known[c].message).alias("message"), F.lit(known[c].location).alias("location")),
        )
        for c in codes
    ]
    return F.array_compact(F.array(*found)) if found else F.from_json(F.lit("[]"), REVIEW_ISSUES)


def review(docs: DataFrame, codes: list[str], text: str = "content", rules: tuple[FormatRule, ...] = RULES) -> DataFrame:
    """``docs`` with issues, result and source.

    An issue ends the review with source Rule. Without one the text goes on to a model: as
    AI where no rule was required, else as Hybrid; ``result`` is null until then.
    """
    found = docs.withColumn("issues", format_issues(F.col(text), codes, rules))
    failed = F.exists("issues", lambda i: i["severity"] == "Error")
    return found.withColumns(
        {
            "review_result": F.when(failed, F.lit("Failed")),
            "review_source": F.when(failed, F.lit("Rule")).otherwise(F.lit("Hybrid" if codes else "AI")),
        }
    )
