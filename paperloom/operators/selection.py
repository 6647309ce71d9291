"""Ranks without sorting everything: percentiles of groups, and pages far into a listing, by counts over ranges.

Both count how many rows fall into each of some ranges, and go on in the range that holds
the rank they look for, until few rows are left to sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that are counted at once.
RANGES = 64
#: Rows that are sorted in the end, at most, if their keys differ.
FEW = 20_000
#: Narrowing ends after so many rounds; by then equal values are left.
ROUNDS = 12


def nearest_rank(rows: DataFrame, by: list[str], value: str, percent: int, name: str = "percentile", few: int = FEW, ranges: int = RANGES) -> DataFrame:
    """(by.., name): the least value of each group that at least ``percent`` of its values don't exceed.

    Exact, of any number of values: a group is narrowed to the range of values that holds
    the rank, by counts, until at most ``few`` rows or one value are left. Null values
    don't count; a group without values has null. Values are numbers that aren't NaN. Without
    ``by`` the whole table is one group, and an empty one gives no row.
    """
    if not by:
        return nearest_rank(rows.withColumn("__all", F.lit(1)), ["__all"], value, percent, name, few, ranges).select(name)
    known = rows.select(*by, F.col(value).cast("double").alias("__v"), F.col(value).alias("__x"))
    real = known.filter("__v IS NOT NULL")
    bounds = [F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")]
    rank = F.expr(f"(count(1) * {int(percent)} + 99) div 100")
    state = real.groupBy(*by).agg(*bounds, F.greatest(rank, F.lit(1)).alias("__rank"))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    side = lambda s: s.select(*[F.col(c).alias(f"__{c}") for c in by], "__n", "__lo", "__hi", "__rank")
    inside = (F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi"))
    for _ in range(ROUNDS):
        if (state.agg(F.max(F.when(F.col("__lo") < F.col("__hi"), F.col("__n")).otherwise(0))).first()[0] or 0) <= few:
            break
        wide = (F.col("__hi") - F.col("__lo")) / ranges
        place = F.when(wide > 0, F.least(F.floor((F.col("__v") - F.col("__lo")) / wide), F.lit(ranges - 1))).otherwise(0)
        counted = real.join(side(state), on).filter(inside).withColumn("__at", place)
        parts = counted.groupBy(*by, "__rank", "__at").agg(*bounds)
        upto = Window.partitionBy(*by).orderBy("__at")
        parts = parts.withColumn("__upto", F.sum("__n").over(upto))
        state = parts.filter((F.col("__upto") >= F.col("__rank")) & (F.col("__upto") - F.col("__n") < F.col("__rank"))).select(*by, "__n", "__lo", "__hi", (F.col("__rank") - F.col("__upto") + F.col("__n")).alias("__rank"))
    left = real.join(side(state), on).filter(inside)
    order = Window.partitionBy(*by).orderBy("__v")
    # Where one value is left there is nothing to sort.
    one = left.filter("__lo = __hi").groupBy(*by).agg(F.min("__x").alias(name))
    many = left.filter("__lo < __hi").withColumn("__place", F.row_number().over(order)).filter("__place = __rank").select(*by, F.col("__x").alias(name))
    found = one.unionByName(many)
    groups = known.select(*by).distinct()
    joined = groups.join(found.select(*[F.col(c).alias(f"__{c}") for c in by], name), on, "left")
    return joined.select(*by, name)


def _after(keys, row) -> Column:
    """Whether a row comes after, or is, the given one in the order of the keys (column, descending), nulls last."""
    out = F.lit(True)
    for c, down in reversed(list(keys)):
        mark = row[c]
        if mark is None:
            later, same = F.lit(False), F.col(c).isNull()
        else:
            beyond = F.col(c) < F.lit(mark) if down else F.col(c) > F.lit(mark)
            later, same = F.coalesce(beyond, F.lit(True)), F.coalesce(F.col(c) == F.lit(mark), F.lit(False))
        out = later | (same & out)
    return out


def far_page(rows: DataFrame, keys, offset: int, size: int, few: int = FEW, ranges: int = RANGES) -> DataFrame:
    """The rows from ``offset`` on in the order of the keys, ``size`` of them, without keeping those before.

    ``ranges`` - 1 rows, those whose keys hash least, mark ranges; their counts say in which
    ranges the page is, and only these are gone on with. ``keys`` end in a unique one.
    """
    order = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in keys]
    names = [c for c, _ in keys]
    for _ in range(ROUNDS):
        marks = rows.select(*names).orderBy(F.xxhash64(*names), *names).limit(ranges - 1).orderBy(*order).collect()  # ranges - 1 rows
        # A row's range is the number of marks that it comes after: the last such mark is looked for by halves.
        place = _place(keys, marks, 0, len(marks))
        counts = {r.place: r.n for r in rows.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()}  # ranges rows at most
        total = sum(counts.values())
        before, first, last, held = 0, None, 0, 0
        for p in sorted(counts):
            if before + counts[p] > offset and before < offset + size:
                if first is None:
                    first, skipped = p, before
                last, held = p, held + counts[p]
            before += counts[p]
        if first is None:
            return rows.limit(0)
        rows = rows.filter((place >= first) & (place <= last))
        offset -= skipped
        if held <= few or held == total:
            break
    return rows.orderBy(*order).offset(offset).limit(size)


def _place(keys, marks: list, low: int, high: int) -> Column:
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(_after(keys, marks[middle]), _place(keys, marks, middle + 1, high)).otherwise(_place(keys, marks, low, middle))
