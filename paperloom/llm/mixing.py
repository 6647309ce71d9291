"""Mixing sources to target weights by hash-threshold histograms.

Each document gets a uniform hash. Sizes are summed by source and hash bucket; the
bucket where a source's running total crosses its budget is the only one refined
further, by the next bits of the hash. The result is one threshold per source and
budget, and the mix is a filter ``hash < threshold``: no sort of documents, no state
that grows with them. Budgets share the hash, so a smaller mix is part of a larger one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, stored

HASH_BITS = 60
LEVEL_BITS = 12


def document_size(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Targets per source by filling up: (source, source_size, target).

    ``totals`` has a row per source (source, source_size). Sources by code point, null
    last, take the repeating ``weights`` of ``share`` times all sizes. No target exceeds
    ``cap`` times its source's size: what is above goes to the others by weight, until
    none is above. That fixed point has one level ``x`` with target = min(cap, x * weight),
    found here from running sums over the sources in the order in which they fill up.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1))
    rows = totals.withColumn("w", w).withColumn("most", F.col("source_size") * float(cap))
    everything = Window.partitionBy()
    fills = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / weight_left).withColumn("place", F.row_number().over(fills))
    fits = F.when(F.col("level") <= F.col("most") / F.col("w"), F.struct("place", "level"))
    level = F.min(fits).over(everything)["level"]
    return rows.withColumn("x", level).select(
        "source", "source_size", F.coalesce(F.least("most", F.col("x") * F.col("w")), F.col("most")).alias("target")
    )


def hash_thresholds(slim: DataFrame, targets: DataFrame, budgets: Sequence[float]) -> DataFrame:
    """(source, budget, copies, cut, shift): documents take ``copies``, and one more if hash >> shift < cut.

    ``slim`` has (source, size, h) per document. ``targets`` as of ``source_targets``.
    """
    asked = targets.select(
        "source", "source_size", F.explode(F.array(*[F.struct(F.lit(i).alias("budget"), (F.col("target") * float(b)).alias("aim")) for i, b in enumerate(budgets)])).alias("b")
    ).select("source", "source_size", "b.*")
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("aim") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    edge = asked.withColumn("copies", copies).select(
        "source", "budget", "copies", (F.col("aim") - F.col("copies") * F.col("source_size")).alias("room"), F.lit(0).cast("long").alias("prefix")
    )
    shift = HASH_BITS
    while True:
        shift -= LEVEL_BITS
        inside = slim.alias("d").join(
            broadcast_if_small(edge).alias("e"),
            F.col("d.source").eqNullSafe(F.col("e.source")) & (F.shiftright("d.h", shift + LEVEL_BITS) == F.col("e.prefix")),
        )
        bucket = (
            inside.groupBy("e.source", "e.budget", "e.copies", "e.room", F.shiftright("d.h", shift).alias("bucket"))
            .agg(F.sum("d.size").alias("held"), F.count(F.lit(1)).alias("n"))
        )
        run = Window.partitionBy("source", "budget").orderBy("bucket")
        bucket = bucket.withColumn("upto", F.sum("held").over(run))
        crossed = bucket.filter(F.col("upto") > F.col("room"))
        first = Window.partitionBy("source", "budget").orderBy("bucket")
        crossed = crossed.withColumn("place", F.row_number().over(first)).filter("place = 1")
        edge = stored(
            crossed.select("source", "budget", "copies", (F.col("room") - (F.col("upto") - F.col("held"))).alias("room"), F.col("bucket").alias("prefix"), "held", "n"),
            f"edges-{shift}",
        )
        if shift == 0 or (edge.agg(F.max("n")).first()[0] or 0) <= 1:
            break
    # What is left in the boundary bucket is one document, or several of one hash: take it if that comes nearer.
    return edge.select("source", "budget", "copies", (F.col("prefix") + (F.col("room") * 2 >= F.col("held")).cast("long")).alias("cut"), F.lit(shift).alias("shift"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    budgets: Sequence[float] = (1.0,),
    seed: int = 20,
) -> DataFrame:
    """How many words of each document the mix takes.

    Returns doc_id, source, size, source_size, target, taken, and ``copies`` (an array
    with a count per budget, the last one the mix itself; a document in a smaller budget
    is in each larger one). A row per input row. Null or empty text: size 0, nothing
    taken. Null sources form one source, last in order. Repeated rows have one hash and
    so one fate. An empty table gives no rows. Other columns are not read. Runs agree,
    as the hash depends on ``seed``, doc_id and text only.
    """
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 64 - HASH_BITS)
    slim = stored(docs.select("doc_id", "source", document_size().alias("size"), h.alias("h")), "sizes")
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(totals, weights, share, cap), "targets")
    cuts = hash_thresholds(slim.select("source", "size", "h"), targets, budgets)
    by_source = cuts.groupBy("source").agg(
        F.map_from_entries(F.collect_list(F.struct("budget", F.struct("copies", "cut", "shift")))).alias("cuts")
    )
    plan = stored(
        targets.alias("t").join(by_source.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left").select("t.source", "source_size", "target", "cuts"),
        "thresholds",
    )
    joined = slim.alias("d").join(broadcast_if_small(plan).alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))

    def count(i: int, b: float):
        cut = F.col("cuts")[i]
        # A budget that is never crossed takes its whole number of copies of every document.
        none = F.when(F.col("source_size") > 0, F.floor(F.col("target") * float(b) / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
        return F.coalesce(cut["copies"] + (F.expr(f"shiftright(h, cuts[{i}].shift)") < cut["cut"]).cast("long"), none)

    counts = F.array(*[count(i, b) for i, b in enumerate(budgets)])
    return joined.select("doc_id", "d.source", "size", "source_size", "target", counts.alias("copies")).withColumn(
        "taken", F.col("size") * F.element_at("copies", -1)
    )
