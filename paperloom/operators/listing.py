"""Searched, filtered, sorted and paged listings."""

from __future__ import annotations

import datetime as dt
import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import far_page

MOST_PAGE_SIZE = 100
MOST_QUERY_LENGTH = 200
#: Rows before a page that are still sorted and skipped.
FAR = 10_000

#: Sort keys of the listings, each ending in a unique one: (column, descending).
ORDERS = {
    "incoming_documents": (("received_date", True), ("created_at", True), ("id", False)),
    "outgoing_documents": (("updated_at", True), ("id", False)),
    "members": (("full_name", False), ("id", False)),
    "staff": (("full_name", False), ("id", False)),
    "document_types": (("code", False), ("id", False)),
    "document_templates": (("document_type_code", False), ("name", False), ("id", False)),
    "reminder_history": (("created_at", True), ("id", False)),
    "review_history": (("reviewed_at", True), ("attempt_no", True), ("id", False)),
}


@dataclass(frozen=True)
class Page:
    """A page of rows and the size of the whole listing."""

    items: DataFrame
    page: int
    page_size: int
    total: DataFrame

    def total_count(self) -> int:
        return self.total.first()["total_count"]

    def total_pages(self) -> int:
        return math.ceil(self.total_count() / self.page_size)


def query_text(q: str | None, collapse: bool = False) -> str | None:
    """The search text as it is compared: trimmed, for people also with white space collapsed; blank means none."""
    if q is None or not q.strip():
        return None
    if len(q) > MOST_QUERY_LENGTH:
        raise ValueError(f"q takes at most {MOST_QUERY_LENGTH} characters")
    return (re.sub(r"\s+", " ", q.strip()) if collapse else q.strip()).lower()


def checked_page(page: int | None, page_size: int | None) -> tuple[int, int]:
    page, page_size = 1 if page is None else page, 20 if page_size is None else page_size
    if page < 1 or not 1 <= page_size <= MOST_PAGE_SIZE:
        raise ValueError(f"page starts at 1, page_size is 1 to {MOST_PAGE_SIZE}")
    return page, page_size


def every(conditions: list[Column | None]) -> Column:
    """All conditions that are given; true without any."""
    given = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, given) if given else F.lit(True)


def equals(column: str, value) -> Column | None:
    return None if value is None else F.col(column) == F.lit(value)


def searched(columns: list[str], q: str | None, collapse: bool = False) -> Column | None:
    """Whether a column holds the text, without regard to case; % and _ are ordinary, null columns don't match."""
    text = query_text(q, collapse)
    if text is None:
        return None
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(text)), F.lit(False)) for c in columns])


def date_range(column: str, first: dt.date | None, last: dt.date | None) -> Column | None:
    """Dates from first to last, both included."""
    _check_range(first, last)
    parts = [None if first is None else F.col(column) >= F.lit(first), None if last is None else F.col(column) <= F.lit(last)]
    return every(parts) if any(p is not None for p in parts) else None


def day_range(column: str, first: dt.date | None, last: dt.date | None) -> Column | None:
    """Times from the start of the first day up to, but not at, the start of the day after the last."""
    _check_range(first, last)
    start = lambda d: F.lit(dt.datetime.combine(d, dt.time())).cast("timestamp_ntz")
    parts = [
        None if first is None else F.col(column) >= start(first),
        None if last is None else F.col(column) < start(last + dt.timedelta(days=1)),
    ]
    return every(parts) if any(p is not None for p in parts) else None


def _check_range(first: dt.date | None, last: dt.date | None) -> None:
    if first is not None and last is not None and first > last:
        raise ValueError("a range ends before it starts")


def active_only(flag: bool | None, *columns: str) -> Column | None:
    return every([F.col(c) for c in columns]) if flag else None


def sort_columns(keys) -> list[Column]:
    """Nulls last both ways, as the listings have them."""
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in keys]


def page_of(rows: DataFrame, keys, page: int | None = None, page_size: int | None = None) -> Page:
    """One page by stable keys. The count is taken under the same filters and before paging; a page past the end is empty.

    Beyond ``FAR`` rows the page is found by counts over ranges of the keys, so that the
    rows before it are neither kept nor sorted.
    """
    page, page_size = checked_page(page, page_size)
    offset = (page - 1) * page_size
    if offset > FAR:
        items = far_page(rows, keys, offset, page_size)
    else:
        items = rows.orderBy(*sort_columns(keys)).offset(offset).limit(page_size)
    return Page(items, page, page_size, rows.agg(F.count(F.lit(1)).alias("total_count")))


def page_totals(rows: DataFrame, page_size: int) -> DataFrame:
    """(total_count, total_pages): no pages for no rows."""
    total = rows.agg(F.count(F.lit(1)).alias("total_count"))
    return total.select("total_count", F.ceil(F.col("total_count") / F.lit(page_size)).cast("long").alias("total_pages"))


def incoming_documents(docs: DataFrame, q=None, status=None, document_type_id=None, assigned_to=None, deadline_from=None, deadline_to=None, page=None, page_size=None) -> Page:
    kept = docs.filter(
        every([
            searched(["reference_number", "sender_org", "summary"], q),
            equals("status", status),
            equals("document_type_id", document_type_id),
            equals("assigned_to_staff_id", assigned_to),
            date_range("deadline", deadline_from, deadline_to),
        ])
    )
    return page_of(kept, ORDERS["incoming_documents"], page, page_size)


def outgoing_documents(docs: DataFrame, q=None, status=None, template_id=None, drafted_by=None, date_from=None, date_to=None, page=None, page_size=None) -> Page:
    kept = docs.filter(
        every([
            searched(["title", "content", "reference_number"], q),
            equals("status", status),
            equals("template_id", template_id),
            equals("drafted_by_staff_id", drafted_by),
            day_range("updated_at", date_from, date_to),
        ])
    )
    return page_of(kept, ORDERS["outgoing_documents"], page, page_size)


def members(people: DataFrame, q=None, status=None, page=None, page_size=None) -> Page:
    kept = people.filter(every([searched(["full_name", "phone", "email"], q, collapse=True), equals("status", status)]))
    return page_of(kept, ORDERS["members"], page, page_size)


def member_lookup(people: DataFrame, q=None, page=None, page_size=None) -> Page:
    """Active members, three columns only."""
    kept = people.filter(every([equals("status", "Active"), searched(["full_name", "phone", "email"], q, collapse=True)]))
    return page_of(kept.select("id", "full_name", "phone"), ORDERS["members"], page, page_size)


def staff(people: DataFrame, active: bool | None = None, roles: tuple[str, ...] = ("Administrator",), page=None, page_size=None) -> Page:
    """Administrators list all staff, others only the active ones."""
    if "Administrator" not in roles and active is not True:
        raise PermissionError("only active staff may be listed")
    return page_of(people.filter(every([active_only(active, "is_active")])), ORDERS["staff"], page, page_size)


def reminders(history: DataFrame, caller: str, is_administrator: bool, recipient: str | None = None, delivery_status=None, page=None, page_size=None) -> Page:
    """One's own reminders; only administrators may name a recipient, be it themselves."""
    if recipient is not None and not is_administrator:
        raise PermissionError("only administrators may name a recipient")
    kept = history.filter(every([equals("recipient_staff_id", recipient or caller), equals("delivery_status", delivery_status)]))
    return page_of(kept, ORDERS["reminder_history"], page, page_size)


def all_pages(pages: list[DataFrame]) -> DataFrame:
    """The rows of pages that were fetched one by one, by column names; a row on two pages is there twice."""
    return reduce(DataFrame.unionByName, pages)


def by_key(rows: DataFrame, key, column: str = "id") -> DataFrame:
    """The row of a key, or none; it is an error, when the row is read, if there are several."""
    found = rows.filter(F.col(column) == F.lit(key))
    alone = F.assert_true(F.count(F.lit(1)).over(Window.partitionBy(column)) == 1, F.lit(f"several rows have one {column}"))
    return found.withColumn("__alone", alone).filter(F.col("__alone").isNull()).drop("__alone")


def in_keys(rows: DataFrame, keys: DataFrame, column: str = "id") -> DataFrame:
    """The rows whose key is among the keys."""
    return rows.join(keys.select(F.col(keys.columns[0]).alias(column)), column, "left_semi")


def exists(rows: DataFrame) -> bool:
    return not rows.isEmpty()


def navigation_key(entries: DataFrame, path: str) -> DataFrame:
    """The entry (key, prefix) with the longest prefix of the path."""
    fits = (F.lit(path) == F.col("prefix")) | F.startswith(F.lit(path), F.concat("prefix", F.lit("/")))
    return entries.filter(fits).agg(F.max_by("key", F.length("prefix")).alias("key"))
