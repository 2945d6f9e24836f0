"""Searches in bounded blocks against stored graphs, compared with brute force."""

import numpy as np
import pytest

from claimweave.llm import graph_ann


def brute(rows, asked, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, v in asked:
        far = np.sqrt(((x - np.array(v)) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, far)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(far[j])) for j in order]
    return out


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(graph_ann, "SHARD", 60)
    monkeypatch.setattr(graph_ann, "QUERIES", 25)
    monkeypatch.setattr(graph_ann, "RUN", 4)


def test_many_shards_and_blocks(spark, small_parts):
    """With shards no larger than the beam every answer is exact, whichever shard and block it comes from."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.integers(0, 4, 6) + 1]) for i in range(400)]  # many equal vectors and ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    asked = [r for r in rows if r[0] % 4 == 0]
    got = {}
    for r in graph_ann.nearest(df, df.where("vec_id % 4 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows, asked, 10)
    assert {i: [v for v, _ in a] for i, a in got.items()} == {i: [v for v, _ in a] for i, a in want.items()}
    assert all(np.allclose([s for _, s in got[i]], [s for _, s in want[i]]) for i in want)


def test_tasks_hold_one_shard_and_one_block(spark, small_parts, monkeypatch):
    """Files hold at most about ``SHARD`` vectors and ``QUERIES`` queries, also where all rows are queries."""
    folder = {}
    monkeypatch.setattr(graph_ann, "posix_dir", lambda s, name, old=graph_ann.posix_dir: folder.setdefault("path", old(s, name)))
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(500)], "vec_id long, embedding array<double>")
    assert graph_ann.nearest(df, df, k=3).count() == 1500
    import pathlib

    shards = [np.load(p) for p in pathlib.Path(folder["path"], "shards").glob("*/*.npz")]
    blocks = [np.load(p) for p in pathlib.Path(folder["path"], "queries").glob("*/*.npz")]
    assert sum(len(s["vectors"]) for s in shards) == sum(len(b["ids"]) for b in blocks) == 500
    assert max(len(s["vectors"]) for s in shards) < 2 * 60 and max(len(b["ids"]) for b in blocks) < 2 * 25 + 25


def test_queries_that_repeat_an_id_and_two_lengths(spark, small_parts):
    """Rows with one id and different vectors are all asked; vectors of another length are not candidates."""
    rows = [(i, [float(i), 1.0]) for i in range(30)] + [(100 + i, [1.0, float(i), 2.0]) for i in range(8)] + [(5, [5.2, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = graph_ann.nearest(df, df.where("vec_id in (5, 101)"), k=4)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 3)))
    assert got[101] == [(100, 1.0), (102, 1.0), (103, 2.0), (104, 3.0)]
    assert got[5] == [(6, 0.8), (4, 1.0), (6, 1.0), (4, 1.2)]


def test_recall_in_one_large_shard():
    """Recall of the beam against brute force, on even and on tightly clustered vectors."""
    rng = np.random.default_rng(5)
    tight = rng.normal(size=(60, 32))[rng.integers(0, 60, 4000)] * 5 + rng.normal(size=(4000, 32)) * 0.1
    for x in (rng.normal(size=(4000, 32)), tight):
        x = x.astype(np.float32)
        graph, start = graph_ann.build(x)
        norms = (x**2).sum(1)
        ids = graph_ann._beam(x, norms, graph, start, x[:100], graph_ann.BEAM)[0]
        far = norms[None] + norms[:100, None] - 2 * x[:100] @ x.T
        true = np.argsort(far, 1)[:, :11]
        assert np.mean([len(set(t) & set(f)) / 11 for t, f in zip(true, ids)]) > 0.95
