"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
#: Paths written since each open ``temporary`` block began.
_open: list[list[str]] = []
#: Where the frames that ``materialise`` returned are stored.
_stored: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def scratch_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one of our own only in local mode where that is unset, as in tests."""
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="gridloom-")
    return f"file://{_own_dirs[app]}"


def _delete(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table; at interpreter exit the JVM may be gone, which leaves nothing to do."""
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001
        pass


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to a scratch Parquet table and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    if _open:
        _open[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _stored[out] = path
    return out


def release(df: DataFrame) -> None:
    """Frees the table of a frame that ``materialise`` returned, before its block ends: nothing that depends on it may run afterwards."""
    _delete(df.sparkSession, _stored.pop(df))


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Within the block, scratch tables are freed at its end, save what the yielded function writes.

    That function takes a frame and a label like ``materialise``; what it returns depends on no other scratch table.
    """
    _open.append([])
    kept: list[str] = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        out = materialise(df, label)
        kept.append(_open[-1].pop())
        return out

    try:
        yield keep
    finally:
        for path in _open.pop():
            _delete(spark, path)
        if _open:
            _open[-1].extend(kept)
