"""Spelling variants: words at edit distance one, by a self-join of a trie with active nodes.

The vocabulary is cut by what two near words must share. If the shorter one has l code
points, their common prefix and suffix have at least l - 1 together, so one of them has
half of that: near words meet among the words of one prefix, or of one suffix, of that
length. Each word of length L goes to both its halves for l = L and l = L - 1. Groups that
are still large are cut again by halves of what is not fixed yet, until they are small or a
single code point is left, so that no hot prefix gathers the vocabulary in one task.

A task makes a trie of the free parts of a group and walks down it. Each node has its active
nodes, those whose strings are at most one edit away; a child's are made from its parent's.
Two terminal nodes that are active for each other at distance one are a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .hashing import text_blocks

LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A form has so many times the occurrences of its variant.
TIMES = 5
#: One run of so many loses a code point, by its hash; 0: none.
SLIP = 199
#: Words that a task counts before it passes them on.
FLUSH = 1 << 17
#: Words of a group that one trie holds; larger groups are cut further.
GROUP_WORDS = 5000

_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: The first byte of U+00C0 to U+00FF, and of nothing else.
_LATIN = 0xC3


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Row and lower-cased UTF-8 of all maximal runs of A-Z, a-z and U+00C0 to U+00FF in a block of texts."""
    inside = _LETTER[data] | (data == _LATIN)
    inside[1:] |= data[:-1] == _LATIN
    cuts = np.zeros(len(data) + 1, bool)
    cuts[offsets] = True
    first = np.flatnonzero(inside & (cuts[:-1] | ~np.concatenate([[False], inside[:-1]])))
    last = np.flatnonzero(inside & (cuts[1:] | ~np.concatenate([inside[1:], [False]])))
    ends = np.cumsum(last - first + 1)
    held = pa.py_buffer(_LOWER[data[inside]])
    runs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), held])
    return np.searchsorted(offsets, first, side="right") - 1, runs


def _slipped(word: bytes, h: int) -> str:
    text = word.decode()
    at = h % len(text)
    return text[:at] + text[at + 1 :]


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n) of the words of all texts that are long and frequent enough."""

    def block_counts(ids: list, data: np.ndarray, offsets: np.ndarray) -> dict[str, int]:
        row, runs = letter_runs(data, offsets)
        if not len(runs):
            return {}
        runs = runs.dictionary_encode()
        words = runs.dictionary.to_pylist()
        pairs, n = np.unique(row * len(words) + runs.indices.to_numpy(), return_counts=True)
        row, code = np.divmod(pairs, len(words))
        total = np.bincount(code, n, len(words)).astype(np.int64)
        moved: dict[str, int] = {}
        if slip:
            starts = [crc32(f"{'' if x is None else x}:".encode()) for x in ids]
            hashes = np.array([crc32(words[c], starts[r]) for r, c in zip(row.tolist(), code.tolist(), strict=True)], np.int64)
            for i in np.flatnonzero(hashes % slip == 0).tolist():
                total[code[i]] -= n[i]
                word = _slipped(words[code[i]], int(hashes[i]))
                moved[word] = moved.get(word, 0) + int(n[i])
        found = {w.decode(): int(t) for w, t in zip(words, total.tolist(), strict=True) if t and len(w) >= least_letters}
        for word, t in moved.items():
            found[word] = found.get(word, 0) + t
        return {w: t for w, t in found.items() if len(w) >= least_letters}

    def sent(held: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for begin, end, data, offsets in text_blocks(batch.column("text")):
                for word, t in block_counts(ids[begin:end], data, offsets).items():
                    held[word] = held.get(word, 0) + t
                if len(held) > FLUSH:
                    yield sent(held)
                    held = {}
        if held:
            yield sent(held)

    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _halved(rows: DataFrame) -> DataFrame:
    """Each row of (word, n, low, pre, post) twice, with half of its free part fixed at the front or at the back; ``part`` is what is fixed."""
    half = F.ceil((F.col("low") - F.col("pre") - F.col("post") - 1) / 2).cast("int")
    cut = rows.withColumn("half", half).withColumn("front", F.explode(F.array(F.lit(True), F.lit(False))))
    cut = cut.select("word", "n", "low", (F.col("pre") + F.when(F.col("front"), F.col("half")).otherwise(0)).alias("pre"), (F.col("post") + F.when(F.col("front"), 0).otherwise(F.col("half"))).alias("post"))
    fixed = F.concat(F.substring("word", F.lit(1), F.col("pre")), F.right("word", F.col("post")))
    return cut.withColumn("part", F.concat_ws(".", "low", "pre", "post", fixed))


def trie_groups(words: DataFrame, least_letters: int = LEAST_LETTERS, most: int = GROUP_WORDS) -> DataFrame:
    """(part, word, n, pre, post) of all groups of at most ``most`` words, or with one free code point, in which near words meet."""
    letters = F.char_length("word")
    low = F.explode(F.array(letters, letters - 1))
    rows = _halved(words.select("word", "n", low.alias("low"), F.lit(0).alias("pre"), F.lit(0).alias("post")).filter(F.col("low") >= least_letters))
    done = None
    while True:
        rows = stored(rows, "halves")
        held = stored(rows.groupBy("part").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"), "groups")
        met = rows.join(held.hint("shuffle_hash"), "part")
        large = (F.col("held") > most) & (F.col("low") - F.col("pre") - F.col("post") > 1)
        small = met.filter(~large).select("part", "word", "n", "pre", "post")
        done = small if done is None else done.unionByName(small)
        if held.filter(F.col("held") > most).isEmpty() or (hot := met.filter(large).select("word", "n", "low", "pre", "post")).isEmpty():
            return done
        rows = _halved(hot)


def trie_pairs(strings: list[str]) -> Iterator[tuple[int, int]]:
    """(i, j), both ways, of all strings one edit apart; the strings are distinct."""
    children: list[dict[str, int]] = [{}]
    ends: dict[int, int] = {}
    for i, s in enumerate(strings):
        node = 0
        for c in s:
            below = children[node].get(c)
            if below is None:
                below = children[node][c] = len(children)
                children.append({})
            node = below
        ends[node] = i
    # Of a node: the other nodes whose strings are one edit away. Only the node itself is at distance 0.
    walk = [(0, set(children[0].values()))]
    while walk:
        node, active = walk.pop()
        if node in ends:
            yield from ((ends[node], ends[v]) for v in active if v in ends)
        own = children[node]
        for c, child in own.items():
            near = {below for v in active if (below := children[v].get(c)) is not None}  # c matched
            near.update(own.values())  # c for another letter
            near.add(node)  # c left out
            near.update(children[child].values())  # a letter more
            near.discard(child)
            walk.append((child, near))


def near_words(groups: DataFrame) -> DataFrame:
    """(word, near, near_n): all ordered pairs of words one edit apart."""

    def pairs(held: list[tuple[str, int, str]]) -> tuple[list, list, list]:
        found = list(trie_pairs([x[2] for x in held]))
        return [held[i][0] for i, _ in found], [held[j][0] for _, j in found], [held[j][1] for _, j in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, out = None, [], ([], [], [])

        def batch_of(columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["word", "near", "near_n"])

        for batch in batches:
            for here, word, n, pre, post in zip(*(batch.column(c).to_pylist() for c in ("part", "word", "n", "pre", "post")), strict=True):
                if here != part:
                    for column, more in zip(out, pairs(held), strict=True):
                        column += more
                    part, held = here, []
                    if len(out[0]) > FLUSH:
                        yield batch_of(out)
                        out = ([], [], [])
                held.append((word, n, word[pre : len(word) - post]))
        for column, more in zip(out, pairs(held), strict=True):
            column += more
        yield batch_of(out)

    rows = groups.repartition("part").sortWithinPartitions("part").mapInArrow(run, "word string, near string, near_n long")
    return rows.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where following forms ends. Each round doubles the steps taken."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        later = now.select(F.col("word").alias("root"), F.col("root").alias("later"))
        if now.join(later, "root", "left_semi").isEmpty():
            return now
        now = stored(now.join(later, "root", "left").select("word", F.coalesce("later", "root").alias("root")), "roots")


def group_variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = TIMES, slip: int = SLIP, most: int = GROUP_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a row per word of the vocabulary.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, of at least
    ``least_letters`` code points and ``least_count`` occurrences in all texts. ``n_near``
    counts the words one inserted, deleted or replaced code point away. ``form`` is the one
    of largest n (ties: the least in code-point order), if that is at least ``times`` the
    word's own; ``root`` is where forms lead to, the word itself without one. As n grows
    with each step, there are no cycles. With ``slip`` > 0 the run of a document loses a
    code point if the CRC-32 of ``doc_id:run`` is a multiple of it; a null doc_id is empty there.

    Null and empty texts have no words; repeated rows count again; an empty table gives no
    rows; other columns are not read. ``least_letters`` is at least 2.
    """
    words = stored(word_counts(docs, least_letters, least_count, slip), "vocabulary")
    near = near_words(trie_groups(words, least_letters, most))
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    best = best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.order")).alias("near_n"))
    known = words.join(best, "word", "left")
    formed = F.col("near_n") >= F.col("n") * times
    known = stored(
        known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")), "forms"
    )
    ended = roots(known.filter("form IS NOT NULL"))
    return known.join(ended, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
