"""Column-pruned Parquet, delimited text with or without a preamble, and stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from claimweave.session import stage_path


def read_columns(
    spark: SparkSession, path: str, columns: list[str], schema: T.StructType | str | None = None
) -> DataFrame:
    """Read a Parquet table, scanning only ``columns``."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path).select(*columns)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    """Read delimited UTF-8 text whose first line is the header."""
    return spark.read.csv(path, schema=schema, header=True, sep=sep, encoding="UTF-8")


def parse_lines(
    lines: DataFrame,
    schema: str,
    header: str,
    preamble: list[str] | None = None,
    value: str = "value",
    sep: str = ",",
) -> DataFrame:
    """Turn text lines into typed columns, dropping the header and preamble lines by content.

    Lines are recognised by what they say, not by where they stand, so the input may be split and
    read in any order.
    """
    drop = [header, *(preamble or [])]
    text = F.regexp_replace(F.col(value), r"^\uFEFF|\r$", "")
    parsed = lines.select(text.alias(value)).filter((F.trim(value) != "") & ~F.col(value).isin(drop))
    options = {"sep": sep, "mode": "PERMISSIVE"}
    return parsed.select(F.from_csv(F.col(value), schema, options).alias("r")).select("r.*")


def read_delimited_with_preamble(
    spark: SparkSession,
    path: str,
    schema: str,
    header: str,
    preamble: list[str],
    sep: str = ",",
) -> DataFrame:
    """Read delimited text that has known explanatory lines above its header."""
    return parse_lines(spark.read.text(path), schema, header, preamble, sep=sep)


def write_stage(df: DataFrame, path: str, codec: str = "zstd") -> None:
    """Store a stage table as compressed Parquet."""
    df.write.mode("overwrite").option("compression", codec).parquet(path)


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Store ``df`` and return the stored copy: the next stage starts from files, not from lineage."""
    spark = df.sparkSession
    target = path or stage_path(spark, name)
    write_stage(df, target)
    return spark.read.schema(df.schema).parquet(target)
