"""Differences of large tables by digests: a tree of bucket digests says which buckets changed, and only these are read and joined.

A row falls into a bucket by its key's hash; a bucket's digest sums and folds the hashes of
its rows, so the order of rows doesn't matter. Parents fold the digests of ``FAN`` children
up to a single root. A table written by ``written`` lies in a folder for each bucket, with
its tree beside it, so comparing with it starts at the root and ends where digests agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .index import difference

#: Buckets of a table; a power of ``FAN``.
BUCKETS = 256
#: Children of a node of the tree.
FAN = 16


def bucketed(rows: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with their ``bucket``."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int"))


def levels(buckets: int, fan: int = FAN) -> list[int]:
    """The number of nodes of each level, from the leaves to the root."""
    out = [buckets]
    while out[-1] > 1:
        out.append(-(-out[-1] // fan))
    return out


def tree(rows: DataFrame, key: str, compared: list[str], buckets: int = BUCKETS, fan: int = FAN) -> DataFrame:
    """(level, node, n, total, folded): digests of all nodes that have rows; level 0 are the buckets.

    A digest has 128 bits, of the sum and the exclusive or of two hashes of each row, and a count.
    """
    nulls = [F.col(c).isNull() for c in compared]
    hashed = bucketed(rows, key, buckets).select("bucket", F.xxhash64(key, *compared, *nulls).alias("a"), F.xxhash64(F.lit(1), *nulls, *compared, key).alias("b"))
    fold = [F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"), F.bit_xor("folded").alias("folded")]
    leaves = hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a").cast("decimal(20,0)")).cast("decimal(38,0)").alias("total"), F.bit_xor("b").alias("folded"))
    nodes = leaves.select(F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.floor(F.col("bucket") / fan**i).cast("int").alias("node")) for i in range(len(levels(buckets, fan)))])).alias("at"), "n", "total", "folded")
    return nodes.select("at.*", "n", "total", "folded").groupBy("level", "node").agg(*fold)


def changed_buckets(old: DataFrame, new: DataFrame, buckets: int = BUCKETS, fan: int = FAN) -> list[int]:
    """The buckets whose digests differ, found from the root down: of each level only children of nodes that differ are compared.

    The list has ``buckets`` numbers at most.
    """
    digest = ["n", "total", "folded"]
    open_nodes = [0]
    for level in range(len(levels(buckets, fan)) - 1, -1, -1):
        here = F.col("level") == level
        sides = [t.filter(here & F.col("node").isin(open_nodes)).select("node", *digest) for t in (old, new)]
        a, b = sides[0], sides[1].select(F.col("node").alias("other"), *[F.col(c).alias(f"new_{c}") for c in digest])
        same = F.lit(True)
        for c in digest:
            same = same & F.col(c).eqNullSafe(F.col(f"new_{c}"))
        differ = a.join(b, F.col("node") == F.col("other"), "full_outer").filter(~same).select(F.coalesce("node", "other").alias("node"))
        open_nodes = sorted(r.node for r in differ.collect())  # FAN children of each node that differs
        if not open_nodes or level == 0:
            return open_nodes
        open_nodes = [n * fan + i for n in open_nodes for i in range(fan) if n * fan + i < levels(buckets, fan)[level - 1]]
    return []


def written(rows: DataFrame, path: str, key: str, compared: list[str], buckets: int = BUCKETS, fan: int = FAN) -> None:
    """Write a new version of the table and its tree under ``path``."""
    bucketed(rows, key, buckets).repartition("bucket").write.partitionBy("bucket").mode("errorifexists").parquet(f"{path}/rows")
    stored = rows.sparkSession.read.parquet(f"{path}/rows")
    tree(stored, key, compared, buckets, fan).coalesce(1).sortWithinPartitions("level", "node").write.mode("errorifexists").parquet(f"{path}/digests")


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


def stored_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/digests")


def changes(sources: DataFrame, stored: DataFrame, digests: DataFrame, key: str, compared: list[str], buckets: int = BUCKETS, fan: int = FAN) -> DataFrame:
    """(key, state) of the rows that are new, changed or stale; rows that stayed the same aren't listed.

    ``stored`` has a ``bucket`` and ``digests`` is its tree. The sources are read once for
    their own digests; then only the buckets that differ are read, and joined bucket by bucket.
    """
    found = changed_buckets(digests, tree(sources, key, compared, buckets, fan), buckets, fan)
    mine = bucketed(sources, key, buckets).filter(F.col("bucket").isin(found)).drop("bucket")
    return difference(mine, stored.filter(F.col("bucket").isin(found)), key, compared).filter("state <> 'same'")
