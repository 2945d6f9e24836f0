"""Tables written once to the shared folder and read again, so that lost executors recompute nothing before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.session import shared_dir, stage_path

# Rows in one Arrow batch: texts and shingle sets are long, so batches stay small.
BATCH_ROWS = 1000
ID_CELLS = 18  # log2 of the cells of 64 bits (2 MB) that say which rows are read on


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold few rows on this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder below ``spark.checkpoint.dir`` and read it back."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def posix_dir(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder as a plain file-system path, for files that workers map into memory.

    The shared folder must be mounted on all machines (NFS, Lustre, a FUSE mount); other schemes are refused.
    """
    path = stage_path(spark, name)
    if path.startswith("file:"):
        return "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {shared_dir(spark)}")
    return path


def perhaps_among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose id is not in ``ids(id)``, dropped at the scan.

    The filter has ``1 << ID_CELLS`` cells of 64 bits, whatever the number of ids; what it lets through is not exact.
    """
    cell = F.shiftrightunsigned(F.xxhash64("id"), 64 - ID_CELLS).alias("cell")
    bit = F.expr("shiftleft(1L, CAST(xxhash64(id) & 63 AS INT))")
    cells = ids.groupBy(cell).agg(F.bit_or(bit).alias("bits"))
    return rows.withColumn("cell", cell).join(F.broadcast(cells), "cell").where(F.col("bits").bitwiseAND(bit) != 0).drop("cell", "bits")
