"""A corpus pipeline: each stage works on all that the stage before it kept."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm import gam, line_dedup, minhash, packing, quality_rules
from claimweave.session import stage_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed limits or the robust outlier test reject go.

    Every row is judged by its own text and carried along: rows with a null id or with an id that repeats are kept or
    go like others, whatever becomes of the rows they share an id with.
    """
    judged = quality_rules.judge(docs.select(F.struct(*COLUMNS).alias("row"), "text", "lang", "source"), id_col="row", stored=False)
    return judged.where("kept").select("row.*")


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a quality score below 0.3 go, each by its own text; learnt from the labelled ones among ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0
    return gam.classify(docs, labels, learn, carry=COLUMNS).where("score >= 0.3").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of lines go from the texts, and documents of which no line is left; rows with a null id stay as they are."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    left = (F.col("_n_copies") + F.col("_n_near") == 0) | F.col("text").rlike(r"[^ \t\n\x0B\f\r]")
    return out.where(left).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the smallest id stays.

    Rows that repeat an id are one document, which stays or goes as a whole; rows with a null id are in no group and stay.
    """
    gone = minhash.near_duplicates(docs, k=5).where("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens, with their ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rule_stage),
    ("quality_classifier", classifier_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("packing", packing_stage),
]

# Robust estimates, a boosted model, edit distances and a tokenizer are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = stage_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
