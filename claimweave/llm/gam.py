"""Quality classifier: a generalised additive model with pairwise interactions over ratios of the text.

Each ratio is cut into bins at quantiles of the training rows. Boosting goes round the features: at every turn a tree
of depth two is fitted to the gradient in one feature's bins and added, shrunk, to that feature's lookup table. Then
the strongest pairs are boosted likewise on coarser grids. A score is the sum of one table entry for each feature and
pair, passed through the logistic function. Fitting uses a bounded sample of labelled rows (``SAMPLE`` rows, chosen by a
hash of their id); everything else runs over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.stages import small_batches, staged
from claimweave.llm.text_stats import RATIOS, Stats
from claimweave.llm.words import slices

SAMPLE = 40_000
BINS = 32
COARSE = 8
ROUNDS = 120
PAIRS = 6
PAIR_ROUNDS = 40
RATE = 0.1
RIDGE = 2.0


@dataclass
class Model:
    cuts: list[np.ndarray]
    coarse: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of ratios."""
        total = np.full(len(x), self.intercept)
        for f, (cut, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cut, x[:, f], "right")]
        for (i, j), grid in zip(self.pairs, self.grids):
            total += grid[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-total))


def _value(g: np.ndarray, h: np.ndarray) -> float:
    return g.sum() / (h.sum() + RIDGE)


def _best_split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, place) of the best cut of a row of bins."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    if not len(gain):
        return 0.0, 0
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values of a tree over one row of bins."""
    gain, at = _best_split(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), _value(g, h))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _grid_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values of a tree over a grid, cut along either side."""
    if depth:
        rows, columns = _best_split(g.sum(1), h.sum(1)), _best_split(g.sum(0), h.sum(0))
        gain, at = max(rows, columns)
        if gain > 1e-9:
            axis = 0 if rows >= columns else 1
            parts = zip(np.split(g, [at], axis), np.split(h, [at], axis))
            return np.concatenate([_grid_tree(a, b, depth - 1) for a, b in parts], axis)
    return np.full(g.shape, _value(g, h))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit on rows of ratios with labels 0 or 1. Without rows every score is one half."""
    n, width = x.shape
    level = np.arange(1, BINS) / BINS
    cuts = [np.unique(np.quantile(x[:, f], level)) if n else np.zeros(0) for f in range(width)]
    coarse = [np.unique(np.quantile(x[:, f], np.arange(1, COARSE) / COARSE)) if n else np.zeros(0) for f in range(width)]
    rate = (y.sum() + 0.5) / (n + 1)
    model = Model(cuts, coarse, float(np.log(rate / (1 - rate))), [np.zeros(len(c) + 1) for c in cuts], [], [])
    if not n:
        return model
    bins = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]
    total = np.full(n, model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(width):
            g, h = slopes()
            size = len(model.tables[f])
            step = RATE * _tree(np.bincount(bins[f], g, size), np.bincount(bins[f], h, size))
            model.tables[f] += step
            total += step[bins[f]]
    few = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(coarse)]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        cell = few[i] * shape[1] + few[j]
        g, h = slopes()
        return tuple(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    def strength(pair: tuple[int, int]) -> float:
        g, h = grid(*pair)
        value = _grid_tree(g, h)
        return float((value * g - 0.5 * value**2 * h).sum())

    model.pairs = sorted(combinations(range(width), 2), key=strength, reverse=True)[:PAIRS]
    model.grids = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            step = RATE * _grid_tree(*grid(i, j))
            model.grids[k] += step
            total += step[few[i], few[j]]
    return model


def _ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            x = Stats(part.column("text")).ratios()
            carried = [c for c in part.schema.names if c == "row"]
            columns = [part.column("id"), *(pa.array(np.ascontiguousarray(c)) for c in x.T), *(part.column(c) for c in carried)]
            yield pa.RecordBatch.from_arrays(columns, ["id", *RATIOS, *carried])


def ratios(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """(id, ratios) of whole texts; null is empty. With ``carry`` also row, a struct of these columns."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.struct(*carry).alias("row")] if carry else []))
    kinds = dict(rows.dtypes)
    schema = [f"id {kinds['id']}", *(f"{r} double" for r in RATIOS), *([f"row {kinds['row']}"] if carry else [])]
    return rows.mapInArrow(_ratios, ", ".join(schema))


def labelled_sample(rows: DataFrame, labels: DataFrame, id_col: str, label: str, learn: Column, most: int) -> DataFrame:
    """At most ``most`` of ``rows(id, ..)`` with a label y, those with the least hash of their id.

    ``learn`` is a condition on column id. Null labels are ignored; of differing labels of one id the larger holds.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    known = known.where(learn).groupBy("id").agg(F.max("y").alias("y"))
    chosen = known.join(rows.select("id").distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(most)
    return rows.join(F.broadcast(chosen), "id").dropDuplicates(["id"])  # ``most`` ids and labels


def classify(
    docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample: int = SAMPLE,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(id, score) for every row of ``docs``: the model's probability of label 1.

    Null and empty texts have all ratios 0 and the score that follows from them. Repeated rows score alike; rows
    with a null id are scored but never learnt from. Without usable labels all scores are one half.
    """
    small_batches(docs.sparkSession)
    rows = staged(ratios(docs, id_col, text_col, carry), "ratios")
    train = labelled_sample(rows.drop("row"), labels, id_col, label, learn, sample).orderBy("id").toPandas()  # bounded by ``sample``
    model = fit(train[list(RATIOS)].to_numpy(float), train["y"].to_numpy(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy() for c in RATIOS], 1)
            carried = [c for c in batch.schema.names if c == "row"]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.scores(x)), *(batch.column(c) for c in carried)], ["id", "score", *carried])

    kinds = dict(rows.dtypes)
    schema = f"id {kinds['id']}, score double" + (f", row {kinds['row']}" if carry else "")
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
