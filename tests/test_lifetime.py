"""Cached tables and stage folders go with the block that made them."""

import os

import pytest
from pyspark.sql import functions as F

from claimweave.operators import describe, survival
from claimweave.session import lifetime, shared_dir, stage_path


@pytest.fixture
def persons(spark):
    return spark.range(300).select(
        "id", (F.col("id") % 37 + 1).alias("t"), (F.col("id") % 3 == 0).cast("int").alias("e"), (F.col("id") % 11).cast("double").alias("x"),
        (F.col("id") % 2).alias("g"),
    )


def cached(spark):
    return set(spark.sparkContext._jsc.sc().getPersistentRDDs().keySet().mkString(",").split(",")) - {""}


def folders(spark):
    path = f"{shared_dir(spark)}/stages"
    return set(os.listdir(path)) if os.path.isdir(path) else set()


def test_operators_leave_nothing_behind(spark, persons):
    before = cached(spark), folders(spark)
    with lifetime(spark):
        curve = survival.kaplan_meier(persons, "t", "e", ["g"]).orderBy("g", "time").collect()
        summary = describe.six_number(persons, ["x"], ["g"]).orderBy("g").collect()
        share = survival.concordance(persons, "t", "e", "x").first()
        persons.write.parquet(stage_path(spark, "kept-here"))
        assert cached(spark) > before[0] and folders(spark) > before[1]
    assert (cached(spark), folders(spark)) == before
    with lifetime(spark):  # and results do not depend on the block before
        assert survival.kaplan_meier(persons, "t", "e", ["g"]).orderBy("g", "time").collect() == curve
        assert describe.six_number(persons, ["x"], ["g"]).orderBy("g").collect() == summary
        assert survival.concordance(persons, "t", "e", "x").first() == share


def test_blocks_nest_and_end_after_errors(spark, persons):
    before = cached(spark), folders(spark)
    with lifetime(spark):
        persons.write.parquet(outer := stage_path(spark, "outer"))
        with pytest.raises(RuntimeError), lifetime(spark):
            persons.write.parquet(inner := stage_path(spark, "inner"))
            survival.kaplan_meier(persons, "t", "e").count()
            raise RuntimeError
        assert not os.path.isdir(inner) and spark.read.parquet(outer).count() == 300
        assert cached(spark) == before[0]
    assert (cached(spark), folders(spark)) == before


def test_without_a_block_tables_stay(spark, persons):
    persons.write.parquet(path := stage_path(spark, "stays"))
    assert spark.read.parquet(path).count() == 300
