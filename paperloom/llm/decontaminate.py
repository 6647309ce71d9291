"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words: the hash of a window takes the words under
the mask's ones and ignores the rest, so a substituted word spoils only the windows that
have it under a one. Windows of the training texts join those of the benchmark. The hits
of a document and an item on one diagonal (equal distance of their places) are verified
together, by comparing the two texts word by word along it.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored

# Masks of weight 5. Whatever words are substituted, a stretch of 8 to 20 words
# that meets the default criterion has a hit of one of them (enumerated in the tests).
MASKS = ("11111", "111011", "11001011")
#: Items of fewer words than MASKS are sure for have masks of their own, as long as the item;
#: those of one or two words have none: as plain phrases they are in any text.
SHORT_ITEM, LEAST_ITEM = 8, 3


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def whole_masks(n: int, least_equal: float) -> tuple[str, ...]:
    """Masks as long as an item of ``n`` words that leave out as many words as may differ, in every choice."""
    differ = min(n - math.ceil(n * least_equal - 1e-9), n - 1)
    return tuple("".join("0" if i in out else "1" for i in range(n)) for out in combinations(range(n), differ))


def seed_windows(texts: DataFrame, keep: list[str], masks: tuple[str, ...] = MASKS, whole: tuple[str, ...] = (), item: bool = False) -> DataFrame:
    """(seed, at, *keep): the window hashes of all masks over ``words``; none for fewer words than a mask spans.

    Masks of ``whole`` are for short items: an item of as many words as one spans has only
    those windows, a document has them besides the others. The words under each place of
    the window are zipped, so that a window is a row of a few numbers from there on and the
    document itself isn't carried along.
    """
    every = [*masks, *whole]
    used = [i for i in range(max(map(len, every))) if any(mask[i : i + 1] == "1" for mask in every)]
    count = F.greatest(F.size("words") - (min(map(len, every)) - 1), F.lit(0))
    shifted = F.arrays_zip(*[F.slice("words", F.lit(i + 1), count).alias(f"w{i}") for i in used])
    rows = texts.select(*keep, F.size("words").alias("n_words"), F.posexplode(shifted).alias("at", "w"))

    def seed(n: int, mask: str) -> Column:
        fits = F.col("at") <= F.col("n_words") - len(mask)
        if item:
            fits &= (F.col("n_words") == len(mask)) if n >= len(masks) else ~F.col("n_words").isin(sorted({len(m) for m in whole}))
        return F.when(fits, F.xxhash64(F.lit(n), *[F.col(f"w.w{i}") for i in used if mask[i : i + 1] == "1"]))

    return rows.select(*keep, "at", F.explode(F.array(*[seed(n, mask) for n, mask in enumerate(every)])).alias("seed")).filter("seed IS NOT NULL")


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    masks: tuple[str, ...] = MASKS,
    least_words: int = 20,
    least_equal: float = 0.8,
) -> DataFrame:
    """Verified overlaps: (key, doc_id, item_id, seeds, first_word, equal).

    A diagonal with hits counts if some window of ``least_words`` aligned words (or of the
    whole item, if that is shorter) has a share of equal words of at least
    ``least_equal``. ``seeds`` is the number of hits on such diagonals, ``equal`` the best
    share, ``first_word`` the first such diagonal's place in the document, ``key`` a hash
    of doc_id and text. With the default masks and criterion no such diagonal is without a
    hit; items of under ``SHORT_ITEM`` words have masks of their own, those of under
    ``LEAST_ITEM`` words no overlaps. Null texts are empty; null ids are kept; repeated
    rows give one row; other columns are not read.
    """
    items = stored(benchmark.select("item_id", word_hashes(F.col("text")).alias("words")).distinct(), "items")
    item_key = F.xxhash64("item_id", "words").alias("item_key")
    lengths = items.select(F.size("words").alias("n")).filter(F.col("n").between(LEAST_ITEM, SHORT_ITEM - 1)).distinct().collect()  # a few numbers
    whole = tuple(mask for r in sorted(lengths) for mask in whole_masks(r.n, least_equal))
    seeds = stored(
        seed_windows(items.select(item_key, "words"), ["item_key"], masks, whole, item=True).select("seed", "item_key", F.col("at").alias("item_at")).distinct(),
        "seeds",
    )
    key = F.xxhash64("doc_id", "text").alias("key")
    texts = docs.select(key, "doc_id", "text")
    windows = seed_windows(texts.select("key", word_hashes(F.col("text")).alias("words")), ["key"], masks, whole)
    met = windows.join(broadcast_if_small(seeds), "seed")
    diagonals = stored(
        met.groupBy("key", "item_key", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.count_distinct("at", "seed").alias("seeds")), "diagonals"
    )

    hit = texts.join(broadcast_if_small(diagonals.select("key").distinct()), "key", "left_semi").dropDuplicates(["key"])
    aimed = items.select(item_key, "item_id", F.col("words").alias("item_words"))
    # Items first: a document's words are cut to the diagonal right where they are joined, and move no further.
    pairs = diagonals.join(broadcast_if_small(aimed), "item_key").join(hit.select("key", "doc_id", word_hashes(F.col("text")).alias("doc_words")), "key")
    start = F.greatest("shift", F.lit(0))
    length = F.least(F.size("doc_words") - start, F.size("item_words") + F.least("shift", F.lit(0)))
    flags = F.zip_with(
        F.slice("doc_words", start + 1, length),
        F.slice("item_words", F.greatest(-F.col("shift"), F.lit(0)) + 1, length),
        lambda a, b: F.when(a == b, F.lit(1)).otherwise(F.lit(0)),
    )
    aligned = pairs.select(
        "key", "doc_id", "item_id", "seeds", start.alias("first_word"), F.least(F.size("item_words"), F.lit(least_words)).alias("need"), flags.alias("flags")
    ).filter(F.size("flags") >= F.col("need"))
    shares = F.transform(
        F.sequence(F.lit(1), F.size("flags") - F.col("need") + 1),
        lambda s: F.aggregate(F.slice("flags", s, F.col("need")), F.lit(0), lambda acc, x: acc + x) / F.col("need"),
    )
    return (
        aligned.withColumn("best", F.array_max(shares))
        .filter(F.col("best") >= least_equal)
        .groupBy("key", "doc_id", "item_id")
        .agg(F.sum("seeds").alias("seeds"), F.min("first_word").alias("first_word"), F.max("best").alias("equal"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without an overlap, as they are."""
    found = stored(find_overlaps(docs, benchmark, **how).select("key").distinct(), "contaminated")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    return keyed.join(broadcast_if_small(found), "key", "left_anti").select("row.*")
