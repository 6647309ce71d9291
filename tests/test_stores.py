"""Versions of several tables, and the index on disk."""

import pytest
from pyspark.sql import functions as F

from paperloom.sources import points, snapshots
from paperloom.sources.tables import empty_table


def values(df):
    return sorted(r.v for r in df.collect())


def test_a_failure_between_two_writes(spark, tmp_path):
    root = str(tmp_path)
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    assert snapshots.version(spark, root) == 0 and snapshots.recovered(spark, root) == []
    assert snapshots.commit(spark, root, {"documents": one(1), "history": one(10)}) == 1
    broken = one(2).select(F.raise_error(F.lit("no disk")).cast("int").alias("v"))
    with pytest.raises(Exception, match="no disk"):
        snapshots.commit(spark, root, {"documents": one(2), "history": broken})
    # The first table was written; nobody sees it.
    assert snapshots.version(spark, root) == 1 and values(snapshots.read(spark, root, "documents")) == [1] and values(snapshots.read(spark, root, "history")) == [10]
    gone = snapshots.recovered(spark, root)
    assert [g.split("/")[1] for g in gone] in (["documents"], ["documents", "history"]) and values(snapshots.read(spark, root, "documents")) == [1]
    assert snapshots.commit(spark, root, {"history": one(10, 11)}, since=1) == 2
    assert values(snapshots.read(spark, root, "documents")) == [1] and values(snapshots.read(spark, root, "history")) == [10, 11]
    assert values(snapshots.read(spark, root, "history", at=1)) == [10]
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, root, {"documents": one(3)}, since=1)
    assert values(snapshots.read(spark, root, "documents")) == [1] and len(snapshots.recovered(spark, root)) == 1


def test_index_on_disk(spark, tmp_path):
    path = str(tmp_path / "index")
    assert points.ensure_index(spark, path, 3) and not points.ensure_index(spark, path, 3)
    with pytest.raises(ValueError, match="not of 4"):
        points.ensure_index(spark, path, 4)
    assert points.points_of(spark, path).count() == 0
    base = empty_table(spark, "knowledge_points")
    make = lambda i, kind, size=3: tuple({"point_id": f"p{i}", "source_type": kind, "source_id": f"s{i}", "source_version": "1", "content_hash": f"h{i}", "content": "c", "is_active": True, "access_scope": "Internal", "embedding": [float(i)] * size}.get(c) for c in base.columns)
    points.add_points(spark.createDataFrame([make(1, "Staff"), make(2, "Template"), make(3, "Staff")], base.schema), path)
    found = points.hashes_of(spark, path, "Staff")
    assert sorted(map(tuple, found.collect())) == [("s1", "h1"), ("s3", "h3")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source_type" in plan and "embedding" not in plan
    assert points.points_of(spark, path).columns == base.columns or set(points.points_of(spark, path).columns) == set(base.columns)
    with pytest.raises(Exception, match="isn't of 3"):
        points.add_points(spark.createDataFrame([make(4, "Staff", 2)], base.schema), path)
