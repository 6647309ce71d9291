"""Tables with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A Parquet table by its declared schema; nothing is inferred."""
    return spark.read.schema(TABLES[name].replace(" NOT NULL", "")).parquet(path)


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name].replace(" NOT NULL", ""))


def read_fixture(spark: SparkSession, path: str, field: str) -> DataFrame:
    """The records of an array field of a JSON document."""
    return spark.read.json(path, multiLine=True).select(F.inline(field))


def sf_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
