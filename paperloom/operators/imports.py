"""Member import: row rules, duplicates within the file and against the table, all or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapsed, email, optional, strict_date, valid_email, valid_phone
from ..schemas import GENDERS

SHEET = "Hội viên"
# The headers of the workbook and the fields of its columns, in order.
HEADERS = ("Họ và tên", "Ngày sinh", "Giới tính", "Địa chỉ", "Số điện thoại", "Email", "Chức vụ", "Ngày gia nhập", "Trạng thái", "Ghi chú")
FIELDS = ("full_name", "date_of_birth", "gender", "address", "phone", "email", "position", "join_date", "status", "notes")
DATES = ("date_of_birth", "join_date")
ERROR_ORDER = ("file", *FIELDS, "duplicate_key")
KEY = ("full_name", "date_of_birth", "phone")


def _error(field: str, message: str | Column, when: Column) -> Column:
    said = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(field).alias("field"), said.alias("message")))


def parsed_rows(rows: DataFrame) -> DataFrame:
    """(row_number, fields..., errors, key_valid) of rows with ``cells`` of (kind, value)."""
    cell = lambda f: F.get("cells", F.lit(FIELDS.index(f)))
    kind, value = (lambda f: cell(f)["kind"]), (lambda f: cell(f)["value"])
    errors = []
    for f in FIELDS:
        errors.append(_error(f, "a formula isn't allowed", kind(f) == "formula"))
        wrong = ~kind(f).isin("text", "formula", *(["date"] if f in DATES else []))
        errors.append(_error(f, "a date or yyyy-MM-dd" if f in DATES else "text only", wrong))
    text = lambda f: F.when(kind(f) == "text", value(f))
    cells_bad = {f: F.coalesce((kind(f) == "formula") | ~kind(f).isin("text", "formula", *(["date"] if f in DATES else [])), F.lit(False)) for f in FIELDS}

    out = {
        "full_name": F.nullif(collapsed(text("full_name")), F.lit("")),
        "gender": optional(text("gender")), "address": optional(text("address")), "phone": optional(text("phone")),
        "email": email(text("email")), "position": optional(text("position")), "notes": optional(text("notes")),
    }
    for f in DATES:
        out[f] = F.when(kind(f) == "date", F.try_to_date(value(f), "yyyy-MM-dd")).when(kind(f) == "text", strict_date(value(f)))
        errors.append(_error(f, "a date or yyyy-MM-dd", (kind(f) == "text") & optional(value(f)).isNotNull() & out[f].isNull()))
    status = F.lower(optional(text("status")))
    out["status"] = F.when(status == "inactive", F.lit("Inactive")).otherwise(F.lit("Active"))
    good = {f: ~cells_bad[f] for f in FIELDS}
    name_bad = good["full_name"] & (out["full_name"].isNull() | (F.length(out["full_name"]) > 200))
    phone_bad = good["phone"] & ((F.length(out["phone"]) > 30) | ~valid_phone(out["phone"]))
    errors += [
        _error("full_name", F.when(out["full_name"].isNull(), F.lit("required")).otherwise(F.lit("at most 200 characters")), name_bad),
        _error("gender", "one of Male, Female, Other", good["gender"] & ~out["gender"].isin(*GENDERS)),
        _error("phone", F.when(F.length(out["phone"]) > 30, F.lit("at most 30 characters")).otherwise(F.lit("not a phone number")), phone_bad),
        _error("email", F.when(F.length(out["email"]) > 254, F.lit("at most 254 characters")).otherwise(F.lit("not an e-mail address")), good["email"] & ((F.length(out["email"]) > 254) | ~valid_email(out["email"]))),
        _error("position", "at most 150 characters", good["position"] & (F.length(out["position"]) > 150)),
        _error("status", "Active or Inactive", good["status"] & ~status.isin("active", "inactive")),
    ]
    # An unreadable date of birth counts as a bad cell of the key.
    born_bad = cells_bad["date_of_birth"] | F.coalesce((kind("date_of_birth") == "text") & optional(value("date_of_birth")).isNotNull() & out["date_of_birth"].isNull(), F.lit(False))
    bad = cells_bad["full_name"] | cells_bad["phone"] | born_bad | F.coalesce(name_bad, F.lit(False)) | F.coalesce(phone_bad, F.lit(False))
    return rows.select("row_number", *[out[f].alias(f) for f in FIELDS], F.array_compact(F.array(*errors)).alias("errors"), (~bad).alias("key_valid"))


def _key(prefix: str = "") -> list[Column]:
    return [F.lower(f"{prefix}full_name"), F.col(f"{prefix}date_of_birth"), F.col(f"{prefix}phone")]


def file_duplicates(rows: DataFrame) -> DataFrame:
    """(row_number, first): rows whose key came before; two nulls are equal, names compare without case."""
    same = Window.partitionBy(*_key())
    return rows.filter("key_valid").withColumn("first", F.min("row_number").over(same)).filter("row_number > first").select("row_number", "first")


def known_members(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(row_number) of rows whose key a member has, both normalised and null-safe."""
    there = members.select(F.lower(collapsed(F.col("full_name"))).alias("m_name"), F.col("date_of_birth").alias("m_born"), optional(F.col("phone")).alias("m_phone"))
    name, born, phone = _key()
    met = name.eqNullSafe(F.col("m_name")) & born.eqNullSafe(F.col("m_born")) & phone.eqNullSafe(F.col("m_phone"))
    return rows.filter("key_valid").join(there, met, "left_semi").select("row_number")


def import_errors(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(row_number, field, message) of ``parsed_rows``, by row, field order and message."""
    own = rows.select("row_number", F.inline("errors"))
    duplicate = file_duplicates(rows).select("row_number", F.lit("duplicate_key").alias("field"), F.concat(F.lit("same as row "), "first").alias("message"))
    known = known_members(rows, members).select("row_number", F.lit("duplicate_key").alias("field"), F.lit("already a member").alias("message"))
    rank = F.array_position(F.array(*[F.lit(f) for f in ERROR_ORDER]), F.col("field"))
    return own.unionByName(duplicate).unionByName(known).orderBy("row_number", rank, "message")


def messages_by_field(errors: DataFrame, by: list[str] = (), order: str | None = None) -> DataFrame:
    """(by..., fields): a map from each field to its messages, by ``order`` and then message; one row in all without ``by``.

    ``errors`` has (field, message); null fields count as "".
    """
    item = F.struct(*([F.col(order).alias("at")] if order else []), F.col("message").alias("message"))
    lists = errors.groupBy(*by, F.coalesce("field", F.lit("")).alias("field")).agg(F.sort_array(F.collect_list(item)).alias("said"))
    entry = F.struct("field", F.transform("said", lambda x: x["message"]).alias("messages"))
    return lists.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("fields"))


def import_members(cells: DataFrame, members: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(members after the import, errors): with any error nothing is taken in."""
    problems = cells.filter("problem IS NOT NULL").select(F.lit(0).alias("row_number"), F.lit("file").alias("field"), F.col("problem").alias("message"))
    rows = parsed_rows(cells.filter("problem IS NULL"))
    errors = problems.unionByName(import_errors(rows, members))
    if not errors.isEmpty():
        return members, errors
    new = rows.select(F.concat_ws(":", F.lit("import"), F.sha2(F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("-")) for k in _key()]), 256)).alias("id"), *FIELDS)
    return members.unionByName(new.withColumns({"created_at": now, "updated_at": now}).select(*members.columns)), errors
