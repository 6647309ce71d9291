"""Removal of byte strings that start at two places, by a cover sample and suffix buckets.

Two equal strings of ``length`` bytes must be told from all others without comparing
suffixes byte by byte. As in difference-cover suffix sorting, a sample of positions covers
every pair of equal strings at one common offset, the sample's own strings get ranks
first, and all other suffixes are put into buckets and settled one bucket at a time by
these ranks.

The cover is content-defined: of the ``gap`` + 1 first positions of a string, the one whose
``length - gap`` bytes hash lowest. Equal strings have it at one offset, so any two equal
suffixes share a sample position, as with a fixed difference set modulo v, but one position
in 64 is enough for a gap of 128 where a fixed set takes one in eleven, and a suffix is in
one bucket instead of twelve. Only equality matters here, so a rank is a name and no place:
a 64-bit hash that brings candidates together. What is equal is decided by BLAKE2b digests of
128 bits over the bytes themselves, so that colliding ranks cost work and remove nothing.

1. Consecutive suffixes with one sample position form a run. A bucket is a rank; buckets
   with one run hold no repeat and end here.
2. Runs of a bucket whose whole strings are equal are tied throughout: all their suffixes
   repeat, without looking at any of them.
3. The suffixes of what is left, one run for each different string, are ranked over their
   full length; those with one digest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored, text_keys
from .hashing import BLOCK_BYTES, mixed, running_sum, text_blocks

LENGTH = 400
GAP = 128

#: The two halves of a digest, as columns.
DIGEST = ["whole", "other"]


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(start, bytes, offsets) of a block, a very long text cut into pieces that overlap by length - 1."""
    if len(data) <= 2 * BLOCK_BYTES:
        yield 0, data, offsets
        return
    for start in range(0, max(1, len(data) - length + 1), BLOCK_BYTES):
        piece = data[start : start + BLOCK_BYTES + length - 1]
        yield start, piece, np.array([0, len(piece)])


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the digest of the bytes from each start to its end."""
    view = memoryview(np.ascontiguousarray(data))
    found = b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    halves = np.frombuffer(found, np.int64).reshape(-1, 2)
    return halves[:, 0].copy(), halves[:, 1].copy()


def _all_hashes(sums: tuple[np.ndarray, np.ndarray], length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from every position."""
    total, inverse = sums
    n = len(total) - length
    return mixed((total[length:] - total[:n]) * inverse[:n] + np.uint64(length))


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    n = len(keys)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = keys
    rows = full.reshape(-1, width)
    up = np.minimum.accumulate(rows, axis=1).ravel()
    down = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[: n - width + 1], up[width - 1 : n])


def block_runs(data: np.ndarray, offsets: np.ndarray, length: int, gap: int, bits: int = 64) -> tuple[np.ndarray, ...]:
    """Runs of a block: row, rank of the sample position, first and last start (in the row), digest of the whole string in halves."""
    sizes = np.diff(offsets) - length + 1
    rows = np.flatnonzero(sizes > 0)
    if not len(rows):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    sums = running_sum(data)
    ranks = _all_hashes(sums, length - gap) & np.uint64((1 << 64) - (1 << (64 - bits)))
    keys = (ranks & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(ranks), dtype=np.uint64)
    sample = (_sliding_least(keys, gap + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.repeat(offsets[rows] - np.concatenate([[0], np.cumsum(sizes[rows])[:-1]]), sizes[rows]) + np.arange(sizes[rows].sum())
    at = sample[starts]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    low, high, at = starts[first], starts[last], at[first]
    row = np.searchsorted(offsets, low, side="right") - 1
    return row, ranks[at], low - offsets[row], high - offsets[row], *_digests(data, low, high + length)


def cover_runs(keyed: DataFrame, length: int, gap: int, bits: int = 64) -> DataFrame:
    """(rank, whole, other, key, low, high) of all runs of the texts of (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for first, _, data, offsets in text_blocks(batch.column("text")):
                for start, piece, cuts in _pieces(data, offsets, length):
                    row, rank, low, high, whole, other = block_runs(piece, cuts, length, gap, bits)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (rank.view(np.int64), whole, other, keys[first + row], low + start, high + start)],
                        names=["rank", *DIGEST, "key", "low", "high"],
                    )

    return keyed.mapInArrow(run, "rank long, whole long, other long, key long, low long, high long")


def suffix_ranks(texts: DataFrame, length: int) -> DataFrame:
    """(whole, other, key, at, open) of the suffixes of chosen runs; ``texts`` has (key, text, runs of (low, high, open))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, runs = batch.column("key").to_numpy(), batch.column("runs")
            for first, end, data, offsets in text_blocks(batch.column("text")):
                chosen = runs.slice(first, end - first).flatten()
                low, high, single = (chosen.field(k).to_numpy(zero_copy_only=False) for k in ("low", "high", "open"))
                row = np.repeat(np.arange(end - first), np.diff(runs.offsets.to_numpy()[first : end + 1]))
                for start, piece, cuts in _pieces(data, offsets, length):
                    if len(piece) < length:
                        continue
                    ours = cuts[row] if len(cuts) > 2 else 0  # where the run's text begins in the piece
                    base = low + ours - start
                    stop = np.minimum(high + ours - start, len(piece) - length)
                    if start + len(piece) < len(data):
                        stop = np.minimum(stop, BLOCK_BYTES - 1)
                    begin = np.maximum(base, 0)
                    n = np.maximum(0, stop - begin + 1)
                    which = np.repeat(np.arange(len(n)), n)
                    at = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    whole, other = _digests(piece, at, at + length)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (whole, other, keys[first + row[which]], at - base[which] + low[which], single[which])],
                        names=[*DIGEST, "key", "at", "open"],
                    )

    return texts.select("key", "text", "runs").mapInArrow(run, "whole long, other long, key long, at long, open boolean")


def _keyed(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, text, key): different rows have different keys.

    Rows of the runs carry the key, so it has 64 bits. Documents that share one, told by 128
    bits, get another of 64 bits, until none does.
    """
    keyed = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = keyed.select("doc_id", "text", *text_keys(bits))
    for salt in range(1, 10):
        shared = keyed.groupBy("key").agg(F.min("other").alias("least"), F.max("other").alias("most")).filter("least <> most").select("key", F.lit(True).alias("shared"))
        shared = stored(shared, "keys")
        if shared.isEmpty():
            return keyed.select("doc_id", "text", "key")
        keyed = keyed.join(broadcast_if_small(shared), "key", "left")
        keyed = keyed.withColumn("key", F.when(F.col("shared"), F.xxhash64(F.lit(salt), "other", "key")).otherwise(F.col("key"))).drop("shared")
    raise RuntimeError("documents of one key can't be told apart")


def repeated_starts(keyed: DataFrame, length: int = LENGTH, gap: int = GAP, bits: int = 64) -> DataFrame:
    """(key, low, high): every start from low to high has its ``length`` bytes elsewhere, too."""
    runs = stored(cover_runs(keyed.select("key", "text"), length, gap, bits), "runs")
    # Halves one by one: a struct or binary buffer would have to be sorted.
    bounds = [f(c).alias(f"{f.__name__}_{c}") for c in DIGEST for f in (F.min, F.max)]
    buckets = runs.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), *bounds).filter("n > 1")
    # Stored, so that the join may split the rows of a hot rank.
    buckets = stored(buckets.selectExpr("rank", "min_whole <> max_whole OR min_other <> max_other AS open"), "buckets")
    tied = stored(runs.join(buckets.hint("shuffle_hash"), "rank"), "tied")
    strings = stored(
        tied.filter("open").groupBy("rank", *DIGEST).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("key", "low", "high"), F.struct("key", "low")).alias("one")),
        "strings",
    )
    closed = tied.filter("open").join(strings.filter("n > 1").select("rank", *DIGEST), ["rank", *DIGEST], "left_semi")
    spans = tied.filter("NOT open").unionByName(closed).select("key", "low", "high")

    unsettled = strings.filter("n = 1").select("rank").distinct()
    asked = strings.join(unsettled, "rank", "left_semi").select("one.*", (F.col("n") == 1).alias("open"))
    asked = stored(asked.groupBy("key").agg(F.collect_list(F.struct("low", "high", "open")).alias("runs")), "asked")
    held = keyed.select("key", "text").join(broadcast_if_small(asked.select("key")), "key", "left_semi").dropDuplicates(["key"])
    suffixes = stored(suffix_ranks(held.join(asked, "key"), length), "suffixes")
    # Equal suffixes have one sample string, so the digest names their bucket, too.
    # Stored, so that the join may split the rows of a hot digest.
    shared = stored(suffixes.groupBy(*DIGEST).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*DIGEST), "shared")
    found = suffixes.filter("open").join(shared, DIGEST, "left_semi")
    return spans.unionByName(found.select("key", F.col("at").alias("low"), F.col("at").alias("high")))


def merged(starts: DataFrame, length: int) -> DataFrame:
    """(key, low, high) with ranges joined whose strings of ``length`` bytes touch or overlap, so that a text has a row for each removed run."""
    before = Window.partitionBy("key").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("key").orderBy("low", "high")
    apart = F.coalesce(F.col("low") > F.max("high").over(before) + length, F.lit(True))
    marked = starts.select("key", "low", "high", apart.cast("int").alias("apart"))
    run = marked.select("key", "low", "high", F.sum("apart").over(upto).alias("run"))
    return run.groupBy("key", "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).select("key", "low", "high")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gap: int = GAP, bits: int = 64, key_bits: int = 64) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): per input row, the removed byte runs (start, end) and the bytes left.

    A byte goes if it is within ``length`` bytes that also start at another place of any
    text, its own included; overlaps count, and the input decides, not what is left.
    Matches never cross texts. Null texts are empty; texts under ``length`` bytes stay
    whole; repeated rows are different places, so they go if long enough; null ids are
    kept; an empty table gives no rows; other columns are not read. ``kept`` is binary, as
    a cut may fall inside a character. Strings are equal if their 128-bit BLAKE2b
    digests are; a collision of ranks, which have ``bits`` bits,
    removes nothing, nor does one of document keys, which have ``key_bits`` at first.
    """
    keyed = _keyed(docs, key_bits)
    starts = repeated_starts(keyed, length, gap, bits)
    cuts = stored(merged(starts, length).groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("starts")), "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                text = np.frombuffer(one.column("text")[0].as_buffer(), np.uint8)
                found = one.column("starts").flatten()
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, found.field("low").to_numpy(), 1)
                np.add.at(edge, found.field("high").to_numpy() + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                spans = pa.array([[{"start": int(a), "end": int(b)} for a, b in turns.reshape(-1, 2)]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([one.column("doc_id"), pa.array([len(text)], pa.int64()), spans, pa.array([text[~gone].tobytes()], pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    kind = dict(docs.dtypes)["doc_id"]
    ids = broadcast_if_small(cuts.select("key"))
    touched = keyed.join(ids, "key", "left_semi").join(cuts, "key").select("doc_id", "text", "starts")
    touched = touched.mapInArrow(run, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    whole = keyed.join(ids, "key", "left_anti").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)").alias("spans"), F.col("text").cast("binary").alias("kept")
    )
    return touched.unionByName(whole)
