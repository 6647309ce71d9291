"""Substring dedup by hashing lines or paragraphs.

Every unit (line or paragraph) of every text is normalised and digested. The digests are
grouped globally; of each, the occurrence ranked first stays and the others are removed,
with their offsets in the original text retained.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXT_KEY, WORD, broadcast_if_small, stored, text_keys

#: Unit breaks by kind, and what joins units again.
BREAKS = {"line": "\n", "paragraph": "\n\n"}


def normalised(unit: Column) -> Column:
    """Lower-cased, runs of white space made one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(unit), r"[\x20\x09-\x0D]+", " "))


def _keyed(docs: DataFrame, bits: int = 64) -> DataFrame:
    slim = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return slim.select("doc_id", "text", *text_keys(bits))


def unit_digests(keyed: DataFrame, kind: str = "line", least_words: int = 1) -> DataFrame:
    """(key, other, doc_id, place, digest) of the units that have enough words; place counts units of the text from 0."""
    units = keyed.select(*TEXT_KEY, "doc_id", F.posexplode(F.split("text", f"\\Q{BREAKS[kind]}\\E", -1)).alias("place", "unit"))
    clean = units.select(*TEXT_KEY, "doc_id", "place", normalised(F.col("unit")).alias("unit")).filter(F.regexp_count("unit", F.lit(WORD)) >= least_words)
    # Two independent hashes: a digest of 128 bits.
    return clean.select(*TEXT_KEY, "doc_id", "place", F.xxhash64("unit").alias("d1"), F.xxhash64(F.lit(6), F.reverse("unit")).alias("d2"))


def later_occurrences(keyed: DataFrame, kind: str = "line", least_words: int = 1) -> DataFrame:
    """(key, other, place) of all occurrences but the first by (doc_id with null last, key, place)."""
    units = stored(unit_digests(keyed, kind, least_words), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", *TEXT_KEY, "place")
    groups = units.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first")).filter("n > 1")
    # Stored, so that the join may split the rows of a hot digest.
    firsts = [F.col(f"first.{c}").alias(f"first_{c}") for c in (*TEXT_KEY, "place")]
    groups = stored(groups.select("d1", "d2", *firsts), "groups")
    met = units.join(groups, ["d1", "d2"])
    return met.filter("key <> first_key OR other <> first_other OR place <> first_place").select(*TEXT_KEY, "place")


def remove_units(docs: DataFrame, kind: str = "line", least_words: int = 1, bits: int = 64) -> DataFrame:
    """(doc_id, n_units, removed, text): per input row, the text without its later occurrences.

    ``removed`` is an array of (start, end) of the removed units in the original text, in
    code points, without the break; ``text`` joins what is left by the break. Units of
    fewer than ``least_words`` words stay; by default only blank ones do. Documents
    rank by doc_id, null last, then by a hash; within one text the earlier unit comes
    first. Rows that repeat both id and text are one document: they share its fate. Null
    texts are empty, and empty texts have one empty unit, which stays; a text all of whose
    units go becomes empty. An empty table gives no rows; other columns are not read. Documents are told apart by 128 bits, of whose first
    half ``bits`` are used.
    """
    keyed = _keyed(docs, bits)
    later = later_occurrences(keyed, kind, least_words)
    gone = stored(later.groupBy(*TEXT_KEY).agg(F.collect_set("place").alias("gone")), "gone")
    brk = BREAKS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, texts = [], [], []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                units, places = text.split(brk), set(places)
                ends = np.cumsum([len(u) + len(brk) for u in units]) - len(brk)
                counts.append(len(units))
                removed.append([{"start": int(ends[i]) - len(units[i]), "end": int(ends[i])} for i in sorted(places)])
                texts.append(brk.join(u for i, u in enumerate(units) if i not in places))
            spans = pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), spans, pa.array(texts, pa.string())], names=["doc_id", "n_units", "removed", "text"])

    spans = "array<struct<start:bigint,end:bigint>>"
    ids = broadcast_if_small(gone.select(*TEXT_KEY))
    touched = keyed.join(ids, TEXT_KEY, "left_semi").join(gone.hint("shuffle_hash"), TEXT_KEY).select("doc_id", "text", "gone")
    changed = touched.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_units long, removed {spans}, text string")
    same = keyed.join(ids, TEXT_KEY, "left_anti").select(
        "doc_id", F.size(F.split("text", f"\\Q{brk}\\E", -1)).cast("long").alias("n_units"), F.expr(f"CAST(array() AS {spans})").alias("removed"), "text"
    )
    return changed.unionByName(same)
