"""Session settings and shared storage the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Runtime settings only; all can be changed on a live session.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even when that costs one more shuffle: a hot person or claim
    # key must never be joined by a single task.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# Cached tables and stage folders of the innermost ``lifetime``; None outside of one.
_OWNED: ContextVar[list[DataFrame | str] | None] = ContextVar("_OWNED", default=None)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="claimweave-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable on this session."""
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)


def stage_path(spark: SparkSession, name: str) -> str:
    """Fresh path for a named stage table below the shared folder; a ``lifetime`` around it removes it."""
    return _owned(f"{shared_dir(spark).rstrip('/')}/stages/{name}-{uuid.uuid4().hex}")


def held(df: DataFrame) -> DataFrame:
    """Cache a per-value table that later steps read several times; a ``lifetime`` around it releases it.

    Such a table is an aggregate over persons. Lost blocks are recomputed from its lineage.
    """
    return _owned(df.persist(StorageLevel.MEMORY_AND_DISK))


def _owned(item):
    owned = _OWNED.get()
    if owned is not None:
        owned.append(item)
    return item


@contextmanager
def lifetime(spark: SparkSession) -> Iterator[None]:
    """Release what operators cache and remove the stage tables they write inside the block, also after an error.

    Operators return lazy DataFrames that read these tables, so collect or write results inside the block. Blocks may
    be nested; each releases its own. Only folders that the block itself named are removed; checkpoints of Spark's own are left to
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    token = _OWNED.set([])
    try:
        yield
    finally:
        owned = _OWNED.get() or []
        _OWNED.reset(token)
        for item in owned:
            if isinstance(item, DataFrame):
                item.unpersist()
            else:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(item)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
