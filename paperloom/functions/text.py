"""Text functions with the white-space, case and regex rules of the workload (columns in, columns out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that lexical matching ignores.
STOP_WORDS = (
    "về", "của", "cho", "và", "các", "một", "những", "trong", "tại", "để",
    "theo", "với", "này", "đến", "từ", "có", "là", "yêu", "cầu", "đoàn",
)
# Bytes per unit, decimal and binary.
SIZE_UNITS = {
    "B": 1, "kB": 10**3, "KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12,
    "KiB": 2**10, "MiB": 2**20, "GiB": 2**30, "TiB": 2**40,
}
# Genders as documents name them.
GENDER_NAMES = {"Male": "Nam", "Female": "Nữ", "Other": "Khác"}

MISSING = "Không có"


def trimmed(x: Column) -> Column:
    """Without Unicode white space at both ends (Spark's trim takes spaces only)."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def optional(x: Column) -> Column:
    """Trimmed; blank becomes null."""
    return F.nullif(trimmed(x), F.lit(""))


def collapsed(x: Column) -> Column:
    """Trimmed, with each run of white space made one space."""
    return F.regexp_replace(trimmed(x), r"(?U)\s+", " ")


def email(x: Column) -> Column:
    return F.lower(optional(x))


def same_text(a: Column, b: Column) -> Column:
    """Equal without regard to case; lower, as upper would expand some letters."""
    return F.lower(a) == F.lower(b)


def holds(x: Column, part: str | Column) -> Column:
    """Literal substring test without regard to case; % and _ mean themselves."""
    return F.contains(F.lower(x), F.lower(F.lit(part) if isinstance(part, str) else part))


def matches(x: Column, pattern: str, lines: bool = False) -> Column:
    """Regex test without regard to case for all letters; with ``lines``, ^ follows newlines only."""
    return F.rlike(x, F.lit(f"(?iu{'md' if lines else ''}U){pattern}"))


def valid_email(x: Column) -> Column:
    """One @, neither first nor last."""
    return F.rlike(x, F.lit(r"^[^@\r\n]+@[^@\r\n]+$"))


def valid_phone(x: Column) -> Column:
    """Digits with - . ( ) + and spaces, at least one digit, an extension (ext., ext, x) at the end allowed."""
    bare = F.regexp_replace(x, r"(?i)\s*(?:ext\.?|x)\s*[0-9]+$", "")
    return F.rlike(bare, F.lit(r"^[-+.()\s0-9]*[0-9][-+.()\s0-9]*$"))


def tokens(x: Column) -> Column:
    """Runs of non-white-space, in order."""
    return F.regexp_extract_all(x, F.lit(r"(?U)(\S+)"), F.lit(1))


def lexical_terms(x: Column) -> Column:
    """Lower-cased words of letters and digits with two characters or more, each once, without stop words."""
    words = F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{Nd}]{2,}"), F.lit(0))
    return F.array_except(words, F.array(*[F.lit(w) for w in STOP_WORDS]))


def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def point_id(name: Column) -> Column:
    """A UUID from the first 16 bytes of the name's SHA-256, the first three groups little-endian."""
    h = F.sha2(name, 256)
    pair = lambda i: F.substring(h, 2 * i + 1, 2)
    groups = ((3, 2, 1, 0), (5, 4), (7, 6), (8, 9), (10, 11, 12, 13, 14, 15))
    return F.concat_ws("-", *[F.concat(*[pair(i) for i in group]) for group in groups])


def is_heading(line: Column) -> Column:
    """A Roman numeral with a dot, or at most 160 characters with a letter and none in lower case."""
    numeral = F.rlike(line, F.lit(r"(?U)^[IVXLCDM]+\.\s"))
    return numeral | ((F.length(line) <= 160) & F.rlike(line, F.lit(r"\p{L}")) & (F.upper(line) == line))


def rendered(template: Column, values: list[tuple[str, Column]]) -> Column:
    """Tokens replaced one after the other in the given order; a null value leaves its token."""
    out = template
    for token, value in values:
        out = F.when(value.isNotNull(), F.replace(out, F.lit(token), value)).otherwise(out)
    return out


def local_date(x: Column) -> Column:
    return F.date_format(x, "dd/MM/yyyy")


def gender_name(x: Column) -> Column:
    """Known genders by name, others as they are."""
    names = F.create_map(*[F.lit(v) for pair in GENDER_NAMES.items() for v in pair])
    return F.coalesce(F.try_element_at(names, x), x)


def instant(ts: Column) -> Column:
    """Round-trip text of a UTC time, with seven digits of a second."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z"))


def business_date(ts: Column, zone: str = "Asia/Ho_Chi_Minh") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def strict_date(x: Column) -> Column:
    """The date of text that is exactly yyyy-MM-dd after trimming, else null."""
    t = trimmed(x)
    return F.when(F.rlike(t, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_date(t, "yyyy-MM-dd"))


def size_bytes(x: Column) -> Column:
    """Bytes of a size such as 1.5GiB; null if it isn't one."""
    pattern = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([KMGTPk]?i?B)\s*$"
    units = F.create_map(*[F.lit(v) for pair in SIZE_UNITS.items() for v in pair])
    number = F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")).cast("double")
    return F.floor(number * F.try_element_at(units, F.regexp_extract(x, pattern, 2))).cast("long")


def labelled_lines(pairs: list[tuple[str, Column]]) -> Column:
    """Lines "label: value", a blank value written as missing; joined by newlines."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), F.coalesce(optional(value), F.lit(MISSING))) for label, value in pairs])


def source_refs(refs: Column, allowed: Column) -> Column:
    """References that are allowed, bare or after ``sourceId=``, each once in order."""
    bare = F.transform(refs, trimmed)
    named = F.transform(bare, lambda r: F.when(F.array_contains(allowed, r), r).otherwise(F.regexp_replace(r, r"^sourceId=(.+)$", "$1")))
    return F.array_distinct(F.filter(named, lambda r: F.array_contains(allowed, r)))


def file_name(x: Column) -> Column:
    """The last part of a path, without control characters and those that file systems refuse, trimmed."""
    return trimmed(F.regexp_replace(F.regexp_extract(x, r"([^/\\]*)$", 1), r'[\x00-\x1F<>:"/\\|?*]', ""))


def storage_key(kind: Column, parent: Column, item: Column, name: Column) -> Column:
    return F.concat(F.concat_ws("/", kind, parent, item), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)))
