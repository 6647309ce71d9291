"""A vector index on disk: a folder for each source type, and the contract of its vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import empty_table, read_table

CONTRACT = "size int, distance string"


def ensure_index(spark: SparkSession, path: str, size: int, distance: str = "Cosine") -> bool:
    """Make the index if it is missing; whether it was. One with another size or distance is an error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/contract/_SUCCESS")
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        held = spark.read.schema(CONTRACT).json(f"{path}/contract").first()
        if (held.size, held.distance) != (size, distance):
            raise ValueError(f"the index has vectors of {held.size} by {held.distance}, not of {size} by {distance}")
        return False
    empty_table(spark, "knowledge_points").write.mode("overwrite").partitionBy("source_type").parquet(f"{path}/points")
    # The contract comes last: without it the index isn't there.
    spark.createDataFrame([(size, distance)], CONTRACT).coalesce(1).write.mode("overwrite").json(f"{path}/contract")
    return True


def add_points(points: DataFrame, path: str) -> None:
    """Append points; all must have the agreed size."""
    size = points.sparkSession.read.schema(CONTRACT).json(f"{path}/contract").first().size
    right = F.assert_true(F.coalesce(F.size("embedding"), F.lit(-1)) == size, F.lit(f"a vector isn't of {size}"))
    points.withColumn("__right", right).filter(F.col("__right").isNull()).drop("__right").write.mode("append").partitionBy("source_type").parquet(f"{path}/points")


def points_of(spark: SparkSession, path: str, source_type: str | None = None) -> DataFrame:
    """The points of a source type, or all; other types' folders aren't read."""
    points = read_table(spark, f"{path}/points", "knowledge_points")
    return points if source_type is None else points.filter(F.col("source_type") == source_type)


def hashes_of(spark: SparkSession, path: str, source_type: str) -> DataFrame:
    """(source_id, content_hash) of the points of a source type; vectors aren't read."""
    return points_of(spark, path, source_type).select("source_id", "content_hash")
