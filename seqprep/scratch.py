"""Written intermediate tables.

Some steps (dense positions, global ranks) need the same sorted rows twice. Recomputing a sampled range sort may cut
it elsewhere, so the rows are written once to the shared folder that the cluster names in ``spark.checkpoint.dir`` and
read back: the lineage is cut, a lost executor only re-reads files, and later jobs prune columns from parquet. ``scratch_scope`` deletes the tables of a
finished piece of work, ``release`` a single one earlier.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

# a reader decodes up to 4,096 rows at once, but never beyond a row group: small groups bound it where rows are long
ROW_GROUP = 8 << 20
# Spark deletes the shuffle files of a query at its end, not when the driver happens to collect its garbage
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_folders: dict[str, str] = {}
_paths: WeakKeyDictionary = WeakKeyDictionary()
_scopes: list[list[str]] = []


def scratch_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="seqprep-")
    return _local_folders[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder's name in the shared folder; an open ``scratch_scope`` deletes it at its end."""
    path = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def written(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back; ``compression`` replaces the session's codec.

    What the write shuffled is deleted when it has ended: the table stands for it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    out = df.write.option("parquet.block.size", ROW_GROUP)
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        (out.option("compression", compression) if compression else out).parquet(path)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def release(table: DataFrame) -> None:
    """Delete a ``written`` table that nothing will read again: what came from it must have been written itself."""
    path = _paths.pop(table, None)
    if path is not None:
        _delete(table.sparkSession, path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables of a block at its end; the block writes or collects its result.

    ``with scratch_scope(spark): operator(df).write.parquet(out)``
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    # by the file system of the path, which the driver's own file calls may not reach
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
