"""Plans of the quality rules' estimate: each is planned, described and kept by the driver once a step, so they stay small."""

import re

import numpy as np

from claimweave.llm import quality_rules


def test_steps_have_one_join_and_few_exchanges(spark, monkeypatch):
    """A step reads rows written once: no join with the groups' levels again, none to put a start's parts together."""
    plans, before = [], quality_rules.staged

    def staged(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return before(df, name)

    monkeypatch.setattr(quality_rules, "staged", staged)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 300, 60 + i % 40)), f"l{i % 2}", f"s{i % 9}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    out = quality_rules.judge(docs).collect()
    assert len(out) == len(rows) and sum(r.kept for r in out) > 800
    steps = [plan for name, plan in plans if name == "half"]
    assert steps
    for plan in steps:
        assert len(re.findall(r"\w+Join\b", plan)) == 1
        assert len(re.findall(r"Exchange\b", plan)) <= 4 and "Window" not in plan


def test_pipeline_writes_no_texts_beside_its_result(spark, monkeypatch):
    """The rules' stage stores statistics, not the rows it carries, and judges rows without a shuffle of them."""
    import corpus_pipeline

    stored, before = [], quality_rules.staged
    monkeypatch.setattr(quality_rules, "staged", lambda df, name: stored.append(df.schema.simpleString()) or before(df, name))
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 300, 60 + i % 40)), "l", "s", 1) for i in range(300)]
    docs = spark.createDataFrame(rows + [(None, "short", None, None, 1), (7, rows[9][1], "l", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.quality_rule_stage(spark, docs, "")
    assert stored and not any("text" in schema for schema in stored)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {r.doc_id for r in kept.collect()} <= {i for i, *_ in rows} and kept.count() > 250
