"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word: a run of characters other than space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: A side is broadcast up to so many bytes, measured; beyond, the join shuffles.
BROADCAST_BYTES = 16 << 20
#: What a row of a broadcast table takes besides its values, about.
ROW_BYTES = 32

#: Rows in an Arrow batch while a table is stored, at most: rows hold whole texts or sets, and a batch is held whole on both sides.
BATCH_ROWS = 1000
#: Bytes of such a batch, about.
BATCH_BYTES = 1 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_scratch: list[str] = []


#: The two halves of ``text_keys``, as columns.
TEXT_KEY = ["key", "other"]


def text_keys(bits: int = 64) -> list[Column]:
    """A row's name by doc_id and text, 128 bits in two columns; the first has ``bits`` bits."""
    whole = F.xxhash64("doc_id", "text")
    first = whole if bits >= 64 else F.shiftleft(whole, 64 - bits) if bits else F.lit(0).cast("long")
    return [first.alias(TEXT_KEY[0]), F.xxhash64(F.lit(128), "text", "doc_id").alias(TEXT_KEY[1])]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table. It is made by way of Arrow: a list of rows would be copied by Python workers of its own on each executor, and these stay."""
    names = StructType.fromDDL(schema).names
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return spark.createDataFrame(pa.table([pa.array(c) for c in columns], names=names), schema)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where it is unset, a folder of our own on a local master, an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="paperloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    The table is a plain Parquet folder, so a lost executor costs nothing and later
    readers take only the columns they need. It goes with the application, or earlier
    with ``settled``. The shuffle files behind it go as soon as it is written. The session's
    settings are as they were afterwards.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/paperloom-{name}-{uuid.uuid4().hex}"
    before = {name: spark.conf.get(name) for name in (_CLEANUP, _BATCH, _BYTES)}
    rows = int(before[_BATCH])
    spark.conf.set(_CLEANUP, "true")
    spark.conf.set(_BATCH, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
    spark.conf.set(_BYTES, str(BATCH_BYTES))
    try:
        df.write.parquet(path, compression=compression)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    _scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``make()`` as a stored table; the tables that were stored on the way to it are deleted."""
    first = len(_scratch)
    out = stored(make(), name)
    for path in _scratch[first:-1]:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    del _scratch[first:-1]
    return out


def _bytes(df: DataFrame) -> Column:
    """About what a row takes in memory."""
    total = F.lit(ROW_BYTES)
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(column), F.lit(0))
        elif kind.startswith("array") and "<" not in kind[6:] and "string" not in kind:
            total = total + 8 * F.greatest(F.size(column), F.lit(0))
        elif "<" in kind:
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
        else:
            total = total + 8
    return total.cast("long")


def broadcast_if_small(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows take at most ``most_bytes``, else as it is.

    ``df`` should be cheap to read (a stored table or a small aggregate). Without the
    hint the join shuffles both sides, and adaptive execution splits its hot keys.
    """
    return F.broadcast(df) if (df.agg(F.sum(_bytes(df))).first()[0] or 0) <= most_bytes else df
