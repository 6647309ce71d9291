"""A vector index as a table: difference, synchronisation, filtered search and revalidation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 5
#: Queries and points that meet in one task, about; there are as many blocks of either as it takes.
QUERY_BLOCK, POINT_BLOCK = 2_000, 100_000
#: Centers of clusters, at most.
CENTERS = 64
#: Scores of a matrix product that are so near count as ties.
NEAR = 1e-9


def difference(sources: DataFrame, index: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """(key, state): new, changed (any compared column differs), same, or stale (not among the sources)."""
    old = index.select(F.col(key).alias("__key"), F.lit(True).alias("__in"), *[F.col(c).alias(f"__{c}") for c in compared])
    both = sources.select(key, F.lit(True).alias("__out"), *compared).join(old, F.col(key) == F.col("__key"), "full_outer")
    same = F.lit(True)
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    state = F.when(F.col("__out").isNull(), F.lit("stale")).when(F.col("__in").isNull(), F.lit("new")).when(same, F.lit("same")).otherwise(F.lit("changed"))
    return both.select(F.coalesce(key, "__key").alias(key), state.alias("state"))


def synchronised(sources: DataFrame, index: DataFrame, compared: list[str], embed, key: str = "point_id") -> DataFrame:
    """The index after a run. Only new and changed sources are embedded; ``embed`` maps a content column to vectors."""
    states = difference(sources, index, key, compared)
    fresh = sources.join(states.filter("state IN ('new', 'changed')").select(key), key, "left_semi")
    kept = index.join(states.filter("state = 'same'").select(key), key, "left_semi")
    return kept.unionByName(fresh.withColumn("embedding", embed(F.col("content"))).select(*index.columns))


def wrong_size(index: DataFrame, size: int, vector: str = "embedding") -> DataFrame:
    """Points whose vector hasn't the agreed size."""
    return index.filter(F.coalesce(F.size(vector), F.lit(-1)) != size)


@dataclass(frozen=True)
class Clusters:
    """Points in groups: some points of the index as centers, and how far the points of each group are from its center.

    ``ids`` are the centers' points, ``centers`` their unit vectors; of each group ``sizes``
    counts the points and ``nearest`` has the least cosine of one with the center.
    """

    ids: list
    centers: np.ndarray
    sizes: np.ndarray
    nearest: np.ndarray


def _slim(index: DataFrame, point: str, size: int) -> DataFrame:
    return index.filter((F.size("embedding") == size) & F.col(point).isNotNull()).select(F.col(point).alias("point"), "embedding")


def clustered(index: DataFrame, point: str = "point_id", size: int | None = None, centers: int = CENTERS) -> tuple[DataFrame, Clusters]:
    """The points (point, embedding, cluster) and their clusters; each point goes to the center of greatest cosine.

    Centers are the ``centers`` points of least hash: a sample of bounded size, which only
    decides how much a search can leave out. Write the points, partitioned by cluster, to
    search them again and again.
    """
    if size is None:
        size = (index.agg(F.max(F.size("embedding"))).first()[0]) or 0
    slim = _slim(index, point, size)
    found = slim.orderBy(F.xxhash64("point"), "point").limit(centers).collect()  # CENTERS rows at most
    matrix = _unit([r.embedding for r in found]) if found else np.zeros((1, size))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _unit(_matrix(batch.column("embedding"), size)) @ matrix.T
            best = scores.argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32)), pa.array(scores[np.arange(len(best)), best])], names=["point", "embedding", "cluster", "cosine"])

    placed = slim.mapInArrow(place, f"point {dict(slim.dtypes)['point']}, embedding {dict(slim.dtypes)['embedding']}, cluster int, cosine double")
    sizes, nearest = np.zeros(len(matrix), np.int64), np.ones(len(matrix))
    for r in placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("cosine")).collect():  # CENTERS rows at most
        sizes[r.cluster], nearest[r.cluster] = r.n, r.cosine
    return placed.select("point", "embedding", "cluster"), Clusters([r.point for r in found], matrix, sizes, nearest)


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), size)


def _unit(vectors) -> np.ndarray:
    x = np.array(vectors, np.float64)
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _reachable(clusters: Clusters, queries: np.ndarray, spare: int, bounded: bool, least: float | None) -> np.ndarray:
    """Which clusters may hold one of a query's best points.

    A point of a cluster is within its angle of the center, so its angle to the query is at
    least the center's less that. What the centers themselves score, being points, is the
    least that the best points have.
    """
    scores = queries @ clusters.centers.T
    away = np.arccos(np.clip(scores, -1, 1)) - np.arccos(np.clip(clusters.nearest, -1, 1))
    most = np.cos(np.maximum(0, away)) + NEAR
    floor = np.full(len(queries), -1.0 if least is None else least)
    if bounded and scores.shape[1] >= spare:
        floor = np.maximum(floor, np.partition(scores, scores.shape[1] - spare, axis=1)[:, scores.shape[1] - spare])
    return (most >= floor[:, None] - NEAR) & (clusters.sizes > 0)


def search(
    queries: DataFrame, index: DataFrame, keep: Column | None = None, least: float | None = None, top: int = TOP, query_id: str = "query_id", point: str = "point_id", but: Column | None = None,
    clusters: Clusters | None = None,
) -> DataFrame:
    """(query_id, point, score, rank): the best points of each query, exactly, by cosine and then id.

    ``queries`` has (query_id, query), ``index`` an ``embedding``; ids are unique. Points
    are filtered by ``keep`` before they are scored; ``but`` leaves out pairs, at most one
    for each query. Points stand in clusters (``clustered``; ``index`` may be its points, if
    its ``clusters`` are given). A query is sent to the clusters that may hold one of its
    best points, by a bound on each cluster's radius. There blocks of queries meet blocks of
    points inside tasks, the points passing by in batches: a matrix product finds the pairs
    that may be among the best, and just these are scored in the order of the dimensions.
    """
    asked = queries.select(F.col(query_id).alias("asked"), "query")
    seen = asked.agg(F.count(F.lit(1)).alias("n"), F.count("query").alias("held"), F.min(F.size("query")).alias("size"), F.max(F.size("query")).alias("most")).first()
    if seen.n != seen.held or (seen.n and seen.size != seen.most):
        raise ValueError("queries have vectors of one size")
    size = seen.size or 0
    bounded = clusters is None or keep is None
    points = index if keep is None else index.filter(keep)
    if clusters is None:
        placed, clusters = clustered(points, point, size)
    else:
        placed = points.filter(F.size("embedding") == size).select("point", "embedding", "cluster")
    # A pair that ``but`` leaves out takes no place of another one.
    spare = top if but is None else top + 1
    parts = np.maximum(1, -(-clusters.sizes // POINT_BLOCK))
    blocks = max(1, -(-seen.n // QUERY_BLOCK))

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query, cluster = np.nonzero(_reachable(clusters, _unit(_matrix(batch.column("query"), size)), spare, bounded, least))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(query)) for c in batch.columns), pa.array(cluster.astype(np.int32)), pa.array(parts[cluster].astype(np.int32))], names=["asked", "vector", "cluster", "parts"])

    ids, wide = dict(asked.dtypes)["asked"], dict(asked.dtypes)["query"]
    aimed = asked.mapInArrow(aim, f"asked {ids}, vector {wide}, cluster int, parts int")
    # A hot cluster is dealt to as many tasks as it has blocks of points; a query goes to each of them.
    split = F.element_at(F.array(*[F.lit(int(n)) for n in parts]), F.col("cluster") + 1)
    by_query = aimed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("block", F.pmod(F.xxhash64("asked"), F.lit(blocks)).cast("int"))
    by_point = placed.withColumn("part", F.pmod(F.xxhash64("point"), split).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kind = dict(placed.dtypes)["point"]
    both = by_query.select("cluster", "part", "block", "asked", F.lit(None).cast(kind).alias("point"), F.col("vector").cast("array<double>").alias("vector")).unionByName(
        by_point.select("cluster", "part", "block", F.lit(None).cast(ids).alias("asked"), "point", F.col("embedding").cast("array<double>").alias("vector"))
    )
    key = ["cluster", "part", "block"]
    met = both.repartition(*key).sortWithinPartitions(*key, F.col("point").asc_nulls_first())  # a block's queries, then its points
    scored = met.mapInArrow(_scored(size, spare), f"asked {ids}, point {kind}, score double")
    scored = scored.select(F.col("asked").alias(query_id), F.col("point").alias(point), "score")
    if but is not None:
        scored = scored.filter(~but)
    if least is not None:
        scored = scored.filter(F.col("score") >= least)
    best = Window.partitionBy(query_id).orderBy(F.col("score").desc(), F.col(point))
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines row by row, summed in the order of the dimensions as ``vectors.cosine`` does; 0 if one has no length."""
    dot, left, right = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for i in range(a.shape[1]):
        dot += a[:, i] * b[:, i]
        left += a[:, i] * a[:, i]
        right += b[:, i] * b[:, i]
    length = np.sqrt(left) * np.sqrt(right)
    return np.divide(dot, length, out=np.zeros_like(dot), where=length > 0)


def _scored(size: int, top: int):
    """A function over sorted batches of blocks, queries first: the pairs that may be among a query's best ``top`` of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, asked, vectors, unit, floor = None, [], [], None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("cluster", "part", "block")])
            point = batch.column("point").is_valid().to_numpy(zero_copy_only=False)
            # Runs of one block and of one kind.
            turns = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0) | (point[1:] != point[:-1])) + 1
            for start, end in zip([0, *turns], [*turns, len(point)], strict=True):
                if block != (here := tuple(keys[:, start])):
                    block, asked, vectors, unit, floor = here, [], [], None, None
                part = batch.slice(start, end - start)
                rows = _matrix(part.column("vector"), size)
                if not point[start]:
                    asked += part.column("asked").to_pylist()
                    vectors.append(rows)
                elif asked:
                    if unit is None:
                        whole = np.concatenate(vectors)
                        unit, floor = _unit(whole), np.full((len(whole), top), -np.inf)
                        ids = pa.array(asked, batch.schema.field("asked").type)
                    scores = unit @ _unit(rows).T
                    # The best scores so far, of this batch too; what is below the last of them can't be among the best.
                    floor = -np.partition(-np.concatenate([floor, scores], axis=1), top - 1, axis=1)[:, :top]
                    query, at = np.nonzero(scores >= floor.min(1)[:, None] - NEAR)
                    exact = _cosines(whole[query], rows[at])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), part.column("point").take(pa.array(at)), pa.array(exact)], names=["asked", "point", "score"])

    return run


def revalidated(hits: DataFrame, sources: DataFrame, columns: list[str], current: list[str] = ()) -> DataFrame:
    """Hits whose columns all equal those of a present source; ``current`` columns are taken from it."""
    return hits.drop(*current).join(sources.select(*columns, *current), columns, "inner")
