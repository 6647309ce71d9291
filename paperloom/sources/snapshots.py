"""Several tables that change together: versions of all of them, committed by one file.

Each commit writes its tables into new folders and then one manifest that names them, with
the other tables as they were. A reader goes by the last manifest, so a run that ends between
two writes leaves the old state, and ``recovered`` takes away what it left. A single writer
is assumed as elsewhere; two that meet are told apart by the version they started from.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another commit came first."""


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    target, fs = _files(spark, folder)
    return [f.getPath().getName() for f in fs.listStatus(target)] if fs.exists(target) else []


def version(spark: SparkSession, root: str) -> int:
    """The last version that was committed; 0 before the first."""
    return max((int(n[:-5]) for n in _names(spark, f"{root}/manifests") if n.endswith(".json")), default=0)


def manifest(spark: SparkSession, root: str, at: int | None = None) -> dict[str, str]:
    """table -> folder under ``root``."""
    at = version(spark, root) if at is None else at
    if at == 0:
        return {}
    target, fs = _files(spark, f"{root}/manifests/{at:012}.json")
    stream = fs.open(target)
    try:
        said = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(said)


def read(spark: SparkSession, root: str, table: str, at: int | None = None) -> DataFrame:
    """A table as of a version, by default the last."""
    return spark.read.parquet(f"{root}/{manifest(spark, root, at)[table]}")


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], since: int | None = None) -> int:
    """Write the tables, then make them the next version; the number of it.

    ``since`` is the version that the tables were made from, by default the last; it is a
    ``Conflict`` if there is a later one by now. Nothing can be seen before the manifest is there.
    """
    since = version(spark, root) if since is None else since
    made = {name: f"data/{name}/{uuid.uuid4().hex}" for name in tables}
    for name, df in tables.items():
        df.write.parquet(f"{root}/{made[name]}")
    held = manifest(spark, root, since) | made
    final, fs = _files(spark, f"{root}/manifests/{since + 1:012}.json")
    draft, _ = _files(spark, f"{root}/manifests/.{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(json.dumps(held, sort_keys=True).encode()))
    finally:
        stream.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise Conflict(f"version {since + 1} is there already")
    return since + 1


def recovered(spark: SparkSession, root: str) -> list[str]:
    """Take away the folders that no version names and unfinished manifests; what was taken away. Not while a commit runs."""
    named = {f for at in range(1, version(spark, root) + 1) for f in manifest(spark, root, at).values()}
    found = [f"data/{t}/{n}" for t in _names(spark, f"{root}/data") for n in _names(spark, f"{root}/data/{t}")]
    gone = sorted(f for f in found if f not in named) + [f"manifests/{n}" for n in _names(spark, f"{root}/manifests") if not n.endswith(".json") and not n.endswith(".crc")]
    for name in gone:
        target, fs = _files(spark, f"{root}/{name}")
        fs.delete(target, True)
    return gone
