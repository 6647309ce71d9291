"""Chunks of template texts: sections at headings, long ones in overlapping windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, instant, is_heading, point_id, tokens, trimmed

WINDOW, OVERLAP, MOST = 480, 64, 512


def windows(words: Column, size: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Windows of a token array, each ``overlap`` into the one before; the last ends with the last token."""
    step = size - overlap
    last = F.greatest(F.ceil((F.size(words) - size) / F.lit(float(step))).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(words, i * step + 1, F.lit(size)))


def _sections(text: Column) -> Column:
    """Arrays of lines, a section each, of one text; nothing leaves its row."""
    lines = F.transform(F.split(trimmed(F.replace(text, F.lit("\r\n"), F.lit("\n"))), "\n", -1), trimmed)
    # The line array is bound once, by a transform over a single element.
    return F.get(F.transform(F.array(lines), _cut_at_headings), F.lit(0))


def _cut_at_headings(lines: Column) -> Column:
    marked = F.transform(lines, lambda x, i: F.when((i == 0) | ((x != "") & is_heading(x)), i + 1))
    begins = F.transform(F.array(F.array_compact(marked)), lambda at: F.transform(at, lambda x, i: F.slice(lines, x, F.coalesce(F.get(at, i + 1), F.size(lines) + 1) - x)))
    return F.get(begins, F.lit(0))


def _body(lines: Column) -> Column:
    return trimmed(F.array_join(lines, "\n"))


def sections(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, section, body): a section starts at a heading that follows other lines; lines are trimmed, blank ones inside kept.

    Each text is cut inside its row, so no line is moved.
    """
    found = texts.select(key, F.posexplode(_sections(F.col(text))).alias("section", "lines"))
    return found.select(key, "section", _body(F.col("lines")).alias("body")).filter("body <> ''")


def chunks(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, chunk_no, chunk): sections that fit as they are, longer ones as windows joined by spaces; numbers from 1."""

    def pieces(body: Column) -> Column:
        words = F.transform(F.array(tokens(body)), lambda w: F.when(F.size(w) <= WINDOW, F.array(body)).otherwise(F.transform(windows(w), lambda x: F.array_join(x, " "))))
        return F.get(words, F.lit(0))

    bodies = F.filter(F.transform(_sections(F.col(text)), _body), lambda b: b != "")
    return texts.select(key, F.posexplode(F.flatten(F.transform(bodies, pieces))).alias("n", "chunk")).select(key, (F.col("n") + 1).alias("chunk_no"), "chunk")


def oversized(rows: DataFrame, most: int = MOST) -> DataFrame:
    """Chunks beyond the limit; there should be none."""
    return rows.filter(F.size(tokens(F.col("chunk"))) > most)


def template_sources(templates: DataFrame) -> DataFrame:
    """Index sources of (id, name, code, type_name, template_content, updated_at)."""
    parts = chunks(templates, "id", "template_content")
    joined = parts.join(templates.drop("template_content"), "id")
    content = F.concat_ws("\n", F.concat(F.lit("Loại văn bản: "), "code", F.lit(" — "), "type_name"), F.concat(F.lit("Mẫu: "), "name"), "chunk")
    chunk_id = F.concat(F.lit("template:"), F.replace("id", F.lit("-"), F.lit("")), F.lit(":"), "chunk_no")
    named = joined.select(
        F.col("id").alias("source_id"), F.col("code").alias("document_type_code"), F.concat(F.lit("template-v1:"), instant(F.col("updated_at"))).alias("source_version"),
        chunk_id.alias("chunk_id"), content.alias("content"),
    )
    return named.withColumns({"point_id": point_id(F.col("chunk_id")), "content_hash": content_hash(F.col("content"))})
