"""Token counts: pieces are counted once for each distinct pre-token, and summed by document.

How many pieces a text has is the sum over its pre-tokens, and how many a pre-token has
depends on it alone. Where a tokenizer drops white space, which is tried out when it is
loaded, no piece crosses it, and the pre-tokens are what stands between it; otherwise they
are those of the tokenizer's own pre-tokenizer.

1. Each document becomes its pre-tokens with their frequencies.
2. The distinct pre-tokens of all documents are counted in pieces by the library, once each.
3. Frequencies meet pieces in a join, and n * pieces is summed by document. Ids are never kept.

The pre-tokens that most documents share are broadcast, as many as fit into a fixed number
of bytes (found by a histogram of their document counts); only rows of the rarer ones are
shuffled to meet the table of pieces.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import ROW_BYTES, stored

#: Bytes of text that are counted at once; a longer text is counted alone.
SLICE_BYTES = 1 << 20
#: Slices whose pre-tokens are merged before they leave a task.
SLICES = 4
#: Bytes of pre-tokens and pieces that are broadcast, at most.
KNOWN_BYTES = 64 << 20
SPACE = r"[\x20\x09-\x0D]+"

_loaded: dict[str, PreTokens] = {}


class PreTokens:
    """The library's tokenizer, loaded once in each worker process from its JSON text."""

    def __init__(self, source: str):
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        alone = self._own("a1,") + self._own("b's")
        self.spaced = self._own(" a1, \n\t b's ") == alone and self._own("a1,\x0b\x0c\rb's") == alone

    @classmethod
    def of(cls, source: str) -> PreTokens:
        # Tasks run side by side already, and each thread of the library keeps memory of its own. Set in the
        # task: set at import, it was missing in workers whose JVM had started without it.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if source not in _loaded:
            _loaded.clear()
            _loaded[source] = cls(source)
        return _loaded[source]

    def _own(self, text: str) -> list[str]:
        """The tokenizer's pre-tokens, marked; a text with a special string is one of its own."""
        t = self.tokenizer
        clean = t.normalizer.normalize_str(text) if t.normalizer else text
        if any(m in text or m in clean for m in self.marks):
            return ["\1" + text]
        pieces = [p for p, _ in t.pre_tokenizer.pre_tokenize_str(clean)] if t.pre_tokenizer else [clean]
        return ["\2" + p for p in pieces if p]

    def pieces(self, pretokens: list[str]) -> list[int]:
        t = self.tokenizer
        if self.spaced:
            return [len(e.ids) for e in t.encode_batch_fast(pretokens, add_special_tokens=False)]
        return [len(t.encode(p[1:], add_special_tokens=False).ids if p[0] == "\1" else t.model.tokenize(p[1:])) for p in pretokens]

    def parts(self, texts: pa.Array) -> pa.ListArray:
        """The pre-tokens of each text."""
        if self.spaced:
            return pc.split_pattern_regex(texts, SPACE)
        return pa.array([self._own(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    def frequencies(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(offsets of the rows, pre-tokens, counts): each row's distinct pre-tokens, and an empty one with count 1."""
        parts = self.parts(texts)
        held = parts.flatten().dictionary_encode()
        names = pa.concat_arrays([pa.array([""]), held.dictionary])
        sizes, code = np.diff(parts.offsets.to_numpy()), held.indices.to_numpy().astype(np.int64) + 1
        row = np.repeat(np.arange(len(texts)), sizes)
        real = pc.not_equal(names, "").to_numpy(zero_copy_only=False)[code]  # splitting leaves empty ends
        token = np.concatenate([row[real] * len(names) + code[real], np.arange(len(texts)) * len(names)])
        token, counts = np.unique(token, return_counts=True)
        row, token = np.divmod(token, len(names))
        return np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32), names.take(pa.array(token)), counts.astype(np.int64)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    row = 0
    while row < len(texts):
        before = ends[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield row, end
        row = end


def pretoken_frequencies(keyed: DataFrame, source) -> DataFrame:
    """(doc_id, text_key, n_bytes, pretoken, n) of all rows of (doc_id, text_key, n_bytes, text); each has one row with an empty pre-token.

    ``source`` is a broadcast variable of the tokenizer's JSON.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = PreTokens.of(source.value)
        for batch in batches:
            texts = batch.column("text")
            for row, end in _slices(texts):
                offsets, tokens, counts = cutter.frequencies(texts.slice(row, end - row))
                held = [pa.ListArray.from_arrays(pa.array(offsets), x) for x in (tokens, pa.array(counts))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, end - row) for c in ("doc_id", "text_key", "n_bytes")), *held], names=["doc_id", "text_key", "n_bytes", "pretokens", "counts"])
            pa.default_memory_pool().release_unused()

    rows = keyed.select("doc_id", "text_key", "n_bytes", "text").mapInArrow(run, "doc_id long, text_key long, n_bytes long, pretokens array<string>, counts array<long>")
    zipped = F.arrays_zip(F.col("pretokens").alias("pretoken"), F.col("counts").alias("n"))
    return rows.select("doc_id", "text_key", "n_bytes", F.inline(zipped).alias("pretoken", "n"))


def pretoken_documents(keyed: DataFrame, source) -> DataFrame:
    """(pretoken, docs): the distinct pre-tokens of some texts at a time, and how many of these rows have each."""

    def summed(held: list[pa.Table]) -> list[pa.RecordBatch]:
        # One thread: several keep their tables apart, and what they have used.
        whole = pa.concat_tables(held).group_by("pretoken", use_threads=False).aggregate([("docs", "sum")])
        return whole.rename_columns(["pretoken", "docs"]).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, held = PreTokens.of(source.value), []
        for batch in batches:
            texts = batch.column("text")
            for row, end in _slices(texts):
                found = cutter.frequencies(texts.slice(row, end - row))[1].value_counts()
                held.append(pa.table({"pretoken": found.field("values"), "docs": found.field("counts")}))
                if len(held) == SLICES:
                    yield from summed(held)
                    held = []
                    pa.default_memory_pool().release_unused()
        if held:
            yield from summed(held)

    return keyed.select("text").mapInArrow(run, "pretoken string, docs long").filter("pretoken <> ''")


def pretoken_pieces(documents: DataFrame, source) -> DataFrame:
    """(pretoken, docs, pieces) of the distinct pre-tokens; docs: in how many rows each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = PreTokens.of(source.value)
        for batch in batches:
            pieces = cutter.pieces(batch.column("pretoken").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int64())], names=["pretoken", "docs", "pieces"])

    # They come merged from the tasks, so they are dealt by pre-token first and summed once, there.
    distinct = documents.repartition("pretoken").groupBy("pretoken").agg(F.sum("docs").alias("docs"))
    return distinct.mapInArrow(run, "pretoken string, docs long, pieces long")


def widespread(pieces: DataFrame, most_bytes: int) -> DataFrame:
    """The pre-tokens of the largest document counts, down to the power of two from which they fit into ``most_bytes``."""
    size = F.octet_length("pretoken") + 8 + ROW_BYTES
    # 64 rows at most: a row for each power of two.
    steps = sorted(((r.step, r.size) for r in pieces.groupBy(F.floor(F.log2("docs")).cast("int").alias("step")).agg(F.sum(size).alias("size")).collect()), reverse=True)
    least, total = 62, 0
    for step, held in steps:
        if (total := total + held) > most_bytes:
            break
        least = step
    return pieces.filter(F.col("docs") >= F.lit(1 << least))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, most_bytes: int = KNOWN_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): per input row, the tokens of its whole text by the tokenizer file at ``path``.

    ``path`` is a JSON file of the ``tokenizers`` library, read by the driver and sent to the
    tasks. Counts are those of ``encode(text, add_special_tokens=False)``: special strings
    inside texts are what the library makes of them by default, nothing is truncated or
    padded. ``over_limit`` is n_tokens > ``limit``. Null texts are empty: 0 bytes and 0
    tokens. Null ids are kept, repeated rows are counted each; an empty table gives no rows;
    other columns are not read. Rows are told apart by doc_id, length and a 64-bit hash of the text.
    """
    spark = docs.sparkSession
    source = spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    rows = pretoken_frequencies(keyed, source)
    pieces = stored(pretoken_pieces(pretoken_documents(keyed, source), source), "pieces")
    known = widespread(pieces, most_bytes).select("pretoken", "pieces")
    met = rows.join(F.broadcast(known), "pretoken", "left")  # at most most_bytes
    key = ["doc_id", "text_key", "n_bytes"]
    mark = F.col("pretoken") == ""
    rare = F.when(F.col("pieces").isNull() & ~mark, F.col("pretoken"))
    part = met.groupBy(*key, rare.alias("rare")).agg(
        F.coalesce(F.sum(F.col("n") * F.col("pieces")), F.lit(0)).alias("tokens"), F.sum("n").alias("n"), F.sum(F.when(mark, F.col("n")).otherwise(0)).alias("copies")
    )
    part = stored(part, "frequencies")
    rest = part.filter("rare IS NOT NULL").join(pieces, F.col("rare") == F.col("pretoken")).select(*key, (F.col("n") * F.col("pieces")).alias("tokens"), F.lit(0).cast("long").alias("copies"))
    whole = part.filter("rare IS NULL").select(*key, "tokens", "copies").unionByName(rest).groupBy(*key).agg(F.sum("tokens").alias("tokens"), F.sum("copies").alias("copies"))
    # A row that is there several times was counted several times.
    once = whole.select("doc_id", "n_bytes", F.expr("tokens div copies").alias("n_tokens"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return once.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
