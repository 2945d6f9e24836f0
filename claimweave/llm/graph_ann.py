"""Approximate nearest neighbours on robust-pruned directed graphs, one for each shard of the vectors.

Equal vectors form one class: only the k + 1 smallest ids of a class can ever be among k nearest with ties to the
smaller id, so these stand for it and the graph holds the vector once. Classes are dealt by hash to shards of about
``SHARD`` vectors (fewer where vectors are long, see ``CELLS``). In a shard the graph starts from random edges; two passes
search every vector greedily from the medoid and a fixed number of other entries and prune what the search has visited: a
neighbour stays unless a nearer one that stayed is closer to it by the factor alpha (1 in the first pass, ``ALPHA`` in the
second). Reverse edges are added and pruned alike. All vectors of a shard move through their searches together, as array
operations.

Each shard's graph is built once and written to the shared folder, as are the queries in blocks of about ``QUERIES``. A
search task gets pairs of names (block, shard), no vectors: it opens both files, runs a beam search and merges the
answers of a block's shards as it goes, so it holds one shard and one block whatever the size of the table.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.stages import posix_dir, small_batches, staged

SHARD = 20_000
CELLS = 1 << 24  # components of vectors that a shard, a query block or one array operation holds
DEGREE = 32
BEAM_BUILD = 64
BEAM = 128
ENTRIES = 48  # vectors beside the medoid at which searches start, so that separate clusters are reached
ALPHA = 1.2
BLOCK = 512  # queries searched together
QUERIES = 2048  # queries in one file
RUN = 64  # (block, shard) pairs searched by one task, at most


def _beam(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, start: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, squared distances, expanded) of the ``width`` best found for each query from the entries ``start``, of which
    there are at most ``width``; -1 and infinity pad."""
    m, s = len(q), len(start)
    own = (q**2).sum(1)
    ids = np.full((m, width), -1, np.int64)
    far = np.full((m, width), np.inf, np.float32)
    done = np.zeros((m, width), bool)
    seen = np.zeros((m, len(x)), bool)
    ids[:, :s], seen[:, start] = start, True
    far[:, :s] = norms[start] + own[:, None] - 2 * (q @ x[start].T)
    live = np.arange(m)
    while len(live):
        open_ = np.where(done[live] | (ids[live] < 0), np.inf, far[live])
        best = open_.argmin(1)
        on = np.isfinite(open_[np.arange(len(live)), best])
        live, best = live[on], best[on]
        if not len(live):
            break
        done[live, best] = True
        near = graph[ids[live, best]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        row, column = np.nonzero(fresh)
        node = near[row, column]
        seen[live[row], node] = True
        d = np.full(near.shape, np.inf, np.float32)
        d[row, column] = norms[node] + own[live[row]] - 2 * np.einsum("ij,ij->i", x[node], q[live[row]])
        all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], 1)
        all_far = np.concatenate([far[live], d], 1)
        all_done = np.concatenate([done[live], np.zeros(near.shape, bool)], 1)
        order = np.argpartition(all_far, width - 1, 1)[:, :width]
        ids[live], far[live] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_far, order, 1)
        done[live] = np.take_along_axis(all_done, order, 1)
    return ids, far, done


def _prune(x: np.ndarray, node: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node at most ``degree`` of its pool (ids, -1 pads): nearest first, dropping what a kept one is near to."""
    m = len(node)
    out = np.full((m, degree), -1, np.int32)
    step = max(1, min(BLOCK, CELLS // (pool.shape[1] * x.shape[1])))
    for start in range(0, m, step):
        rows, own = pool[start : start + step], node[start : start + step]
        rows = np.sort(np.where(rows == own[:, None], -1, rows), 1)
        rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = -1
        v = x[rows]
        size = (v**2).sum(2)
        d = ((v - x[own][:, None]) ** 2).sum(2)
        d[rows < 0] = np.inf
        each = np.arange(len(rows))
        for k in range(degree):
            best = d.argmin(1)
            on = np.isfinite(d[each, best])
            if not on.any():
                break
            out[start : start + step][on, k] = rows[each, best][on]
            between = size + size[each, best][:, None] - 2 * (v @ v[each, best][:, :, None])[:, :, 0]
            d[on[:, None] & (alpha**2 * between <= d)] = np.inf
            d[each, best] = np.inf
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM_BUILD, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(graph, entries: the medoid and ``ENTRIES`` others). A vector has up to half as many edges again as ``degree``: reverse
    edges are appended while there is room and pruned to ``degree`` where there is not."""
    n = len(x)
    rng = np.random.default_rng(7)
    width = degree + degree // 2
    graph = np.full((n, width), -1, np.int32)
    graph[:, : min(degree, 8)] = rng.integers(0, n, (n, min(degree, 8)))
    medoid = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    start = np.unique(np.append(rng.choice(n, min(n, ENTRIES), replace=False), medoid))
    norms = (x**2).sum(1)
    for a in (1.0, alpha):
        for block in np.array_split(rng.permutation(n), max(1, n // BLOCK)):
            found = _beam(x, norms, graph, start, x[block], beam)[0]
            edges = _prune(x, block, np.concatenate([found, graph[block]], 1), degree, a)
            graph[block] = -1
            graph[block, :degree] = edges
            source, target = np.repeat(block, degree), edges.ravel()
            source, target = source[target >= 0], target[target >= 0]
            if not len(target):  # a single vector
                continue
            order = np.argsort(target, kind="stable")
            source, target = source[order], target[order]
            nodes, first, count = np.unique(target, return_index=True, return_counts=True)
            pool = np.full((len(nodes), width + int(count.max())), -1, np.int32)
            pool[:, :width] = graph[nodes]
            pool[np.repeat(np.arange(len(nodes)), count), width + np.arange(len(target)) - np.repeat(first, count)] = source
            pool.sort(1)
            pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
            pool = -np.sort(-pool, 1)
            full = pool[:, width] >= 0
            graph[nodes[~full]] = pool[~full, :width]
            edges = _prune(x, nodes[full], pool[full], degree, a)
            graph[nodes[full]] = -1
            graph[nodes[full], :degree] = edges
    return graph, start


def _saved(path: str, **arrays: np.ndarray) -> None:
    """One file of arrays, there as a whole or not at all; a task that runs twice writes the same again."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    draft = f"{path}-{uuid.uuid4().hex}"
    with open(draft, "wb") as out:
        np.savez(out, **arrays)
    os.replace(draft, path)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def _store_shard(folder: str):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        ids = shard["ids"].to_numpy()
        exact = _matrix(shard["vector"])
        order = np.lexsort((*exact.T, np.array([i[0] for i in ids])))  # the same graph in whatever order rows arrive
        exact, ids = exact[order], ids[order]
        graph, start = build(exact.astype(np.float32))
        at = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
        dim, part = int(shard["dim"].iloc[0]), int(shard["part"].iloc[0])
        _saved(f"{folder}/shards/{dim}/{part}.npz", vectors=exact, graph=graph, start=start, ids=np.concatenate(ids).astype(np.int64), at=at)
        return pd.DataFrame({"dim": [dim], "part": [part], "n": [len(shard)]})

    return run


def _store_queries(folder: str):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        dim, part = int(block["dim"].iloc[0]), int(block["part"].iloc[0])
        _saved(f"{folder}/queries/{dim}/{part}.npz", ids=block["id"].to_numpy(np.int64), vectors=_matrix(block["vector"]))
        return pd.DataFrame({"dim": [dim], "part": [part], "n": [len(block)]})

    return run


def _answers(path: str, q: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, vec_id, score) rows from one shard: the k + 1 nearest classes found for each of ``q``, ties to the smallest ids."""
    with np.load(path) as held:
        exact, graph, start, ids, at = (held[c] for c in ("vectors", "graph", "start", "ids", "at"))
    x = exact.astype(np.float32)
    norms, smallest, size = (x**2).sum(1), ids[at[:-1]], np.diff(at)
    out = []
    for first in range(0, len(q), BLOCK):
        part = q[first : first + BLOCK]
        found = _beam(x, norms, graph, start, part.astype(np.float32), max(BEAM, k + 1))[0]
        for row, (vector, near) in enumerate(zip(part, found)):
            near = near[near >= 0]
            score = np.sqrt(((exact[near] - vector) ** 2).sum(1))
            # Of classes at one distance those with the smallest ids come first, over all that the beam holds.
            order = np.lexsort((smallest[near], score))[: k + 1]
            near, score = near[order], score[order]
            members = np.concatenate([ids[at[i] : at[i + 1]] for i in near])
            out.append((np.full(len(members), first + row), members, np.repeat(score, size[near])))
    return tuple(np.concatenate(c) for c in zip(*out))


def _merged(parts: list[tuple[np.ndarray, ...]], own: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k nearest of each query among the rows of several shards, ties to the smaller id, its own id left out."""
    row, vec, score = (np.concatenate(c) for c in zip(*parts))
    other = vec != own[row]
    row, vec, score = row[other], vec[other], score[other]
    order = np.lexsort((vec, score, row))
    row, vec, score = row[order], vec[order], score[order]
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    place = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0)) if len(row) else row
    keep = place < k
    return row[keep], vec[keep], score[keep]


def _search(folder: str, dim: int, shards: int, k: int):
    """Rows ``id`` name a block (id div shards) and a shard (id mod shards); a part without rows has no file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = np.sort(batch["id"].to_numpy())
            for block in np.unique(pairs // shards):
                path = f"{folder}/queries/{dim}/{block}.npz"
                if not os.path.exists(path):
                    continue
                with np.load(path) as held:
                    own, q = held["ids"], held["vectors"]
                best: list[tuple[np.ndarray, ...]] = []
                for shard in pairs[pairs // shards == block] % shards:
                    path = f"{folder}/shards/{dim}/{shard}.npz"
                    if os.path.exists(path):
                        best = [_merged([*best, _answers(path, q, k)], own, k)]
                for row, vec, score in best:
                    yield pd.DataFrame({"query_id": own[row], "vec_id": vec, "score": score})

    return run


def _stored(rows: DataFrame, store, name: str) -> None:
    """Write each (dim, part) of ``rows`` as a file and make sure that every row went into one."""
    done = staged(rows.groupBy("dim", "part").applyInPandas(store, "dim int, part long, n long"), name)
    wanted, got = rows.count(), done.agg(F.sum("n")).first()[0] or 0
    if wanted != got:
        raise RuntimeError(f"{name}: {got} of {wanted} rows written")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, ties to the smaller id, the query's own id left out.

    ``queries`` has the columns of ``vectors``. Score is the Euclidean distance in double precision on the original
    vectors. Null vectors, zero vectors and those with a null or non-finite component take no part, nor do rows with
    a null id; vectors whose length differs from a query's are not its candidates. Rows that repeat id and vector
    count once. With at most k candidates all are returned; no candidates, no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)

    def usable(rows: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0)
        rows = rows.where(F.col(id_col).isNotNull() & fine)
        # -0 and 0 are one value
        return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda c: c + F.lit(0.0)).alias("vector")).distinct()

    rank = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    classes = usable(vectors).withColumn("r", rank).where(F.col("r") <= k + 1)
    classes = staged(classes.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vector_classes")
    ask = staged(usable(queries), "vector_queries")
    schema = "query_id long, rank int, vec_id long, score double"

    def parts(rows: DataFrame, most: int) -> dict[int, int]:
        """Number of parts for each length of vector; one row for each length reaches the driver."""
        size = rows.groupBy(F.size("vector").alias("dim")).count().collect()
        return {r.dim: -(-r["count"] // max(1, min(most, CELLS // r.dim))) for r in size}

    shards, blocks = parts(classes, SHARD), parts(ask, QUERIES)
    shared = sorted(set(shards) & set(blocks))
    if not shared:
        return spark.createDataFrame([], schema)
    folder = posix_dir(spark, "vector_graphs")

    def placed(rows: DataFrame, count: dict[int, int], *columns: str) -> DataFrame:
        dim = F.size("vector")
        number = F.create_map(*(F.lit(x) for d in shared for x in (d, count[d])))[dim].cast("long")
        return rows.where(dim.isin(shared)).select(dim.alias("dim"), F.pmod(F.xxhash64(*columns), number).alias("part"), *rows.columns)

    _stored(placed(classes, shards, "vector"), _store_shard(folder), "vector_shards")
    _stored(placed(ask, blocks, "id", "vector"), _store_queries(folder), "query_blocks")
    found = None
    for dim in shared:
        pairs = shards[dim] * blocks[dim]
        tasks = max(-(-pairs // RUN), min(pairs, 2 * spark.sparkContext.defaultParallelism))
        rows = spark.range(0, pairs, 1, tasks).mapInPandas(_search(folder, dim, shards[dim], k), "query_id long, vec_id long, score double")
        found = rows if found is None else found.union(rows)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    rows = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return rows.select("query_id", "rank", "vec_id", "score")
