"""N-gram Jaccard join: rare-first prefix filtering, then one verification per pair.

A document is the set of its word shingles. If two sets of similarity t are ordered alike,
they share a shingle within their first ``n - ceil(t * n) + 1``. The order here is by exact
frequency, rare ones first. Counting all shingles of all documents would move each of them
twice, so documents that can't have a partner leave first:

1. In any order, longer prefixes of a similar pair share more shingles: with m more than
   the prefix needs, m + 1. In the order of the hashes, the first third of each set is
   counted; documents with too few shingles there that any other document has are out.
2. The sets of what is left are kept, their shingles counted exactly, and each set's prefix
   in rare-first order taken.
3. Prefixes join by shingle. Where they meet, a pair passes a length and a positional
   filter and one of bitmaps (each set's shingles by 256 hash slots, odd or even; slots that
   differ bound how much the sets differ), or no row is made of it. Pairs then pass a suffix
   filter (how many shingles fall into each of 64 hash ranges; the smaller counts bound the
   overlap) before their sets are compared, once for each pair.

Documents of one set are one node from the start. A large group of near copies would meet
in all pairs, so each shared shingle names a leader, the document whose prefix meets most
others, and each document first tries the best of its leaders; after that, just the pairs
whose documents aren't yet connected are left to be tried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored
from .graph import components
from .hashing import shingle_sets

#: Hash ranges of the suffix filter.
PARTS = 64
#: The bitmap filter's slots, 64 to a column.
SLOTS = 256
BITS = [f"bits{i}" for i in range(SLOTS // 64)]
#: The longer prefix has a shingle more for each so many of the set.
LONGER = 12
#: Shingles that a task counts before it passes them on.
FLUSH = 1 << 18


def _least_common(n, percent: int):
    """How many shingles a set of n shares with any similar one: ceil(t * n)."""
    return -(-percent * n // 100)


def _asked(n, percent: int):
    """Common shingles within the longer prefix."""
    return np.minimum(_least_common(n, percent), 1 - (-n // LONGER))


def _node(hashes: np.ndarray) -> int:
    """The key of a set: 64 bits of a digest of its shingles."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def text_key() -> Column:
    return F.xxhash64("text")


def set_summaries(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, n, node) of all rows of (doc_id, text_key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for i, hashes in shingle_sets(batch.column("text"), width):
                n[i], node[i] = len(hashes), _node(hashes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n), pa.array(node)], names=["doc_id", "text_key", "n", "node"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, "doc_id long, text_key long, n long, node long")


def shared_counts(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """(node, surplus): the shingles of the longer prefix that another set may have, less those that a similar one would have."""

    def flushed(nodes: list[int], tokens: list[np.ndarray], asked: list[int]) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in tokens])
        every, of = np.concatenate(tokens), np.repeat(np.arange(len(nodes)), sizes)
        values, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
        common = counts[inverse] > 1
        # What this task knows to be shared is counted here, and one row stands for it: a hot shingle is a row for each flush.
        surplus = np.bincount(of[common], minlength=len(nodes)) - np.array(asked)
        keys, alone, hot = np.array(nodes, np.int64), ~common, values[counts > 1]
        token = np.concatenate([every[alone], hot]).view(np.int64)
        node = pa.array(np.concatenate([keys[of[alone]], np.zeros(len(hot), np.int64)]), mask=np.arange(len(token)) >= alone.sum())
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(token), pa.array(keys)]),
                pa.concat_arrays([node, pa.array(keys)]),
                pa.concat_arrays([pa.nulls(len(token), pa.int64()), pa.array(surplus)]),
            ],
            names=["token", "node", "surplus"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, tokens, asked, held, seen = [], [], [], 0, set()
        for batch in batches:
            for _, hashes in shingle_sets(batch.column("text"), width):
                if not (n := len(hashes)) or (node := _node(hashes)) in seen:
                    continue
                seen.add(node)
                prefix = hashes[: min(n, n - _least_common(n, percent) + int(_asked(n, percent)))]
                nodes.append(node)
                tokens.append(prefix)
                asked.append(int(_asked(_least_common(n, percent), percent)))
                held += len(prefix)
                if held > FLUSH:
                    yield flushed(nodes, tokens, asked)
                    nodes, tokens, asked, held, seen = [], [], [], 0, set()
        if nodes:
            yield flushed(nodes, tokens, asked)

    rows = docs.filter("doc_id IS NOT NULL").select("text").mapInArrow(run, "token long, node long, surplus long")
    # Rows with a surplus have their node as the token; they count as they are.
    known = F.col("surplus").isNotNull()
    met = F.count(F.lit(1)).over(Window.partitionBy("token", known)) > 1
    one = F.when(known, F.col("surplus")).when(met, F.lit(1)).otherwise(F.lit(0))
    # A set that several tasks have seen is shared in whole, so its sum is never below 0.
    counted = rows.select("node", one.alias("surplus"), known.alias("known")).filter("node IS NOT NULL AND (known OR surplus > 0)")
    return counted.groupBy("node").agg(F.sum("surplus").alias("surplus"))


def open_sets(docs: DataFrame, summaries: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, n, parts, bits, hashes) of the sets in ``nodes``; hashes: the sorted shingles, 8 bytes each; parts: how many fall into each of 64 ranges; bits: which slots hold an odd number."""
    first = summaries.filter("n > 0 AND doc_id IS NOT NULL").join(broadcast_if_small(nodes.select("node")), "node", "left_semi")
    first = stored(first.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("one")).select("one.*"), "firsts")
    texts = docs.join(broadcast_if_small(first), ["doc_id", "text_key"], "left_semi").select("doc_id", "text_key", "text").dropDuplicates(["doc_id", "text_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, rows = 0, []
            for i, hashes in shingle_sets(batch.column("text"), width):
                parts = np.bincount((hashes >> np.uint64(58)).astype(np.int64), minlength=PARTS).astype(np.int32)
                odd = np.bincount((hashes % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS) % 2
                rows.append((_node(hashes), len(hashes), parts, np.packbits(odd.astype(np.uint8)).view(np.int64), hashes.tobytes()))
                held += len(hashes)
                if held > FLUSH or i == len(batch) - 1:
                    node, n, parts, bits, sets = zip(*rows, strict=True)
                    bits = [pa.array(b) for b in np.array(bits).T]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(parts, pa.list_(pa.int32())), *bits, pa.array(sets, pa.binary())], names=["node", "n", "parts", *BITS, "hashes"]
                    )
                    held, rows = 0, []

    return texts.select("text").mapInArrow(run, f"node long, n int, parts array<int>, {', '.join(f'{b} long' for b in BITS)}, hashes binary")


def rare_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(token, node, n, place, weight, bits) of each set's prefix, rarest shingle first, ties by hash; shingles of one set only are left out.

    ``weight`` is how often the prefix's shingles occur in all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes = batch.column("n").to_numpy(), batch.column("node").to_numpy()
            row = 0
            while row < len(batch):
                end = max(row + 1, int(np.searchsorted(np.cumsum(sizes[row:]), FLUSH)) + row)
                tokens = np.frombuffer(b"".join(x.as_py() for x in batch.column("hashes").slice(row, end - row)), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens), pa.array(np.repeat(nodes[row:end], sizes[row:end])), pa.array(np.repeat(sizes[row:end], sizes[row:end]))], names=["token", "node", "n"]
                )
                row = end

    rows = sets.select("node", "n", "hashes").mapInArrow(run, "token long, node long, n int")
    counts = stored(rows.groupBy("token").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"), "counts")
    met = rows.join(counts.hint("shuffle_hash"), "token")
    own = Window.partitionBy("node")
    # Shingles of one set only come first in it: they take places, but meet nothing.
    place = (F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("held", "token")) - 1).cast("int")
    least = F.ceil(F.col("n") * percent / 100 - F.lit(1e-9))
    prefix = met.select("token", "node", "n", "held", place.alias("place")).filter(F.col("place") <= F.col("n") - least)
    weighed = prefix.select("token", "node", "n", "place", F.sum("held").over(own).alias("weight"))
    # Rows are dealt by node for the windows, so only a row for each set moves here.
    return weighed.join(sets.select("node", *BITS), "node")


def _least_overlap(a: str, b: str, percent: int) -> Column:
    """The overlap that two sizes need: ceil(t / (1 + t) * (a + b))."""
    return F.ceil((F.col(a) + F.col(b)) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))


def meetings(left: DataFrame, right: DataFrame, percent: int, apart: str) -> DataFrame:
    """``left`` (as a) and ``right`` (as b) where they share a prefix token, differ in ``apart`` and pass the length, positional and bitmap filters."""
    a, b = left.alias("a"), right.alias("b")
    small, large = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    after = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    least = _least_overlap("a.n", "b.n", percent)
    # A shingle of one set only turns one slot, so that many slots differ at most as shingles do.
    differ = sum((F.bit_count(F.col(f"a.{b}").bitwiseXOR(F.col(f"b.{b}"))) for b in BITS), F.lit(0))
    # This bounds the overlap if the token is the first common one, which every similar pair has within both prefixes.
    met = (
        (F.col("a.token") == F.col("b.token"))
        & (F.col(f"a.{apart}") != F.col(f"b.{apart}"))
        & (small * 100 >= large * percent)
        & (after >= least)
        & (differ <= F.col("a.n") + F.col("b.n") - 2 * least)
    )
    return a.join(b, met)


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; each is tested once, and only sets of pairs that pass the suffix filter are moved."""
    nodes = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "paired")
    held = sets.join(broadcast_if_small(nodes), "node", "left_semi")
    side = lambda x, *columns: held.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    met = pairs.join(side("a", "n", "parts"), "a").join(side("b", "n", "parts"), "b")
    common = F.aggregate(F.zip_with("parts_a", "parts_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    kept = stored(met.filter(common >= _least_overlap("n_a", "n_b", percent)).select("a", "b"), "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column("hashes_a"), batch.column("hashes_b"), strict=True)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                passed[i] = both * 100 >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(passed)) for c in (batch.column("a"), batch.column("b"))], names=["a", "b"])

    full = kept.join(side("a", "hashes"), "a").join(side("b", "hashes"), "b")
    return full.select("a", "b", "hashes_a", "hashes_b").mapInArrow(run, "a long, b long")


def similar_pairs(docs: DataFrame, summaries: DataFrame, percent: int, width: int) -> DataFrame:
    """(a, b): links between nodes that connect what is similar; in a large group only as many as that takes."""
    nodes = stored(shared_counts(docs, percent, width).filter("surplus >= 0").select("node"), "open")
    sets = stored(open_sets(docs, summaries, nodes, width), "sets")
    met = stored(rare_prefixes(sets, percent), "prefixes")

    best = F.struct((-F.col("weight")).alias("order"), "node", "n", "place", *BITS)
    leaders = met.groupBy("token").agg(F.min(best).alias("first"), F.count(F.lit(1)).alias("held")).filter("held > 1")
    leaders = stored(leaders.select("token", "first.*"), "leaders")
    led = meetings(met, leaders, percent, "node").groupBy("a.node").agg(F.min(F.struct("b.order", "b.node")).alias("best"))
    stars = stored(led.select(*_pair("node", "best.node")).distinct(), "stars")
    near = stored(verified(stars, sets, percent), "near")
    grouped = stored(components(near), "groups")

    # Pairs across groups: of each token, the documents outside its largest group against all.
    placed = met.join(grouped, "node", "left").select("token", "node", "n", "place", *BITS, F.coalesce("component", "node").alias("part"))
    placed = stored(placed, "placed")
    by_part = placed.groupBy("token", "part").agg(F.count(F.lit(1)).alias("held"))
    largest = by_part.groupBy("token").agg(F.max_by("part", F.struct("held", "part")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    mixed = stored(placed.join(stored(largest, "mixed").hint("shuffle_hash"), "token").drop("parts"), "across")
    rest = meetings(mixed.filter("part <> main"), mixed, percent, "part").select(*_pair("a.node", "b.node")).distinct()
    rest = stored(rest.join(stars, ["a", "b"], "left_anti"), "rest")
    return near.unionByName(stored(verified(rest, sets, percent), "far"))


def _members(found: DataFrame) -> DataFrame:
    """(node, component) of all nodes that have links, the least of each component too."""
    found = stored(found, "joined")
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def _prepared(docs: DataFrame) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return slim.withColumn("text_key", text_key())


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id): per input row, the least doc_id that links lead to.

    Documents link when their sets of ``width``-word shingles (A-Z lower-cased, split at
    ASCII white space) have 100 * intersection >= ``percent`` * union; shingles and sets
    are compared by 64-bit hashes. Fewer words than ``width`` form one shingle. Null, empty
    and blank texts have empty sets and link with nothing. A null doc_id links with nothing
    and has a null component_id. Rows of one doc_id are one document, linked through each of
    its texts. An empty table gives no rows; other columns are not read.
    """
    docs = _prepared(docs)
    summaries = stored(set_summaries(docs, width), "summaries")
    links = similar_pairs(docs, summaries, percent, width)
    linkable = summaries.filter("n > 0 AND doc_id IS NOT NULL")
    # The sets of one doc_id hang together, too.
    of_id = linkable.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).filter("a <> most")
    own = linkable.select("doc_id", "node").join(of_id, "doc_id").filter("a <> node").select("a", F.col("node").alias("b")).distinct()
    joined = _members(components(links.unionByName(own)))
    classes = linkable.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    placed = stored(classes.join(joined, "node", "left").filter("copies > 1 OR component IS NOT NULL").select("node", "first", F.coalesce("component", "node").alias("component")), "placed")
    least = placed.groupBy("component").agg(F.min("first").alias("least"))
    found = placed.join(least, "component").select("node", "least")
    reached = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    return summaries.join(found, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), reached.alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """The rows of ``docs`` with one of each group of similar texts, as they are.

    The row of least doc_id stays, of one doc_id's texts the one of least hash. Rows that
    repeat both id and text keep the one whose other columns hash lowest. A group goes by
    the texts alone: another, unrelated text under the same doc_id stays. Rows without an
    id or without words stay.
    """
    slim = _prepared(docs)
    summaries = stored(set_summaries(slim, width), "summaries")
    joined = _members(components(similar_pairs(slim, summaries, percent, width)))
    rows = summaries.filter("n > 0 AND doc_id IS NOT NULL").groupBy("node", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows"))
    rows = stored(rows.join(joined, "node", "left").select("doc_id", "text_key", "rows", F.coalesce("component", "node").alias("component")), "fates")
    chosen = rows.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    gone = rows.join(chosen, "component").filter(F.struct("doc_id", "text_key") != F.col("first")).select("doc_id", "text_key")
    keys = [F.col("doc_id").cast("long").alias("__id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__key")]
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *keys)
    named = lambda df: df.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    kept = kept.join(broadcast_if_small(named(stored(gone, "gone"))), ["__id", "__key"], "left_anti")
    repeated = named(rows.filter("rows > 1"))
    if not repeated.isEmpty():
        again = kept.join(repeated, ["__id", "__key"], "left_semi")
        again = again.groupBy("__id", "__key").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row"))
        kept = kept.join(repeated, ["__id", "__key"], "left_anti").select("__row").unionByName(again.select("__row"))
    return kept.select("__row.*")
