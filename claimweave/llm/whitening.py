"""Embedding whitening from exact integer cross-products, by bit-sliced scatter.

Vectors become integers x = floor(64 * c) + 1000000. A task takes its vectors in blocks; in a block each dimension is
shifted by its least value there, and every bit plane of the shifted values is packed across the rows into 64-bit
words. The cross-product of two dimensions is the sum over pairs of planes of 2^(i+j) times the popcount of the AND of
their words; the shifts are put back by integer arithmetic. Spark adds the blocks as integers. Only then, on exact
sums, is the covariance centred (still in integers) and handed to ``eigh``. The driver holds dim x dim numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.stages import small_batches

SCALE, OFFSET = 64.0, 1_000_000
BIGGEST = 2.0**62  # floor(64 * c) beyond this is cut to it: it would not fit a long
BLOCK_WORDS = 1 << 21  # 64-bit words of all planes of a block: 16 MB
LIMB = 40  # exact sums travel as limbs of so many bits
CONSTANT = 1e-13  # an eigenvalue below this share of the largest is 0


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite entries; false for null and empty ones."""
    fine = F.forall(vector.cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def integers(batch: pa.Array, dim: int) -> np.ndarray:
    """x of a list array whose lists all have ``dim`` entries."""
    c = batch.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    return np.clip(np.floor(SCALE * c), -BIGGEST, BIGGEST).astype(np.int64) + OFFSET


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact (column sums, cross-products) of an integer block, as Python integers."""
    n, dim = x.shape
    low = x.min(0)
    shifted = (x - low).astype(np.uint64) if (x.max(0).astype(object) - low).max() < 1 << 63 else None
    if shifted is None:  # the range itself needs 64 bits
        shifted = (x.astype(np.uint64) - low.astype(np.uint64)).astype(np.uint64)
    widths = [int(w).bit_length() for w in shifted.max(0)]
    owner = np.repeat(np.arange(dim), widths)
    bit = np.concatenate([np.arange(w) for w in widths]).astype(np.uint64) if owner.size else np.zeros(0, np.uint64)
    words = -(-n // 64)
    planes = np.zeros((len(owner), words * 8), np.uint8)
    for row, (d, b) in enumerate(zip(owner, bit)):
        packed = np.packbits(((shifted[:, d] >> b) & np.uint64(1)).astype(np.uint8))
        planes[row, : len(packed)] = packed
    planes = planes.view(np.uint64)
    common = np.zeros((len(owner), len(owner)), np.int64)
    for row in range(len(owner)):
        common[row, row:] = np.bitwise_count(planes[row] & planes[row:]).sum(1, dtype=np.int64)
    common = common + np.triu(common, 1).T
    # Weights of up to 2^(i+j) times n: in 64 bits where they fit, else as Python integers.
    kind = np.int64 if 2 * max(widths, default=0) + n.bit_length() + 1 < 63 else object
    weight = np.zeros((dim, len(owner)), kind)
    weight[owner, np.arange(len(owner))] = [1 << int(b) for b in bit]
    product = ((weight @ common.astype(kind)) @ weight.T).astype(object)
    sums = (weight @ np.diag(common).astype(kind)).astype(object) if len(owner) else np.zeros(dim, object)
    low = low.astype(object)
    whole = product + np.outer(sums, low) + np.outer(low, sums) + n * np.outer(low, low)
    return sums + n * low, whole


def _limbs(i: int, j: int, value: int) -> Iterator[tuple[int, int, int, int]]:
    """(i, j, limb, part) with value = sum of part << (LIMB * limb); the last part carries the sign."""
    limb = 0
    while not -(1 << LIMB) < value < 1 << LIMB:
        yield i, j, limb, value & ((1 << LIMB) - 1)
        value >>= LIMB
        limb += 1
    yield i, j, limb, value


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Integer blocks of vectors of one length, gathered over batches up to BLOCK_WORDS words of planes."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        lengths = batch.column("dim").to_numpy()
        for dim in np.unique(lengths).tolist():
            x = integers(batch.column("vector").filter(pa.array(lengths == dim)), dim)
            rows = max(64, BLOCK_WORDS // (8 * dim) * 64)  # eight planes a dimension are usual
            for start in range(0, len(x), rows):
                held.setdefault(dim, []).append(x[start : start + rows])
                if sum(map(len, held[dim])) >= rows:
                    yield dim, np.concatenate(held.pop(dim))
    for dim, parts in held.items():
        yield dim, np.concatenate(parts)


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, list] = {}
    for dim, x in _blocks(batches):
        sums, product = cross_products(x)
        if dim in totals:
            totals[dim] = [totals[dim][0] + len(x), totals[dim][1] + sums, totals[dim][2] + product]
        else:
            totals[dim] = [len(x), sums, product]
    for dim, (n, sums, product) in totals.items():
        cells = [*_limbs(-1, -1, n)]
        for i in range(dim):
            cells += [*_limbs(i, -1, int(sums[i]))]
            for j in range(i, dim):
                cells += _limbs(i, j, int(product[i, j]))
        columns = [pa.array(np.full(len(cells), dim, np.int32)), *(pa.array([c[k] for c in cells], pa.int32() if k < 3 else pa.int64()) for k in range(4))]
        yield pa.RecordBatch.from_arrays(columns, ["dim", "i", "j", "limb", "part"])


@dataclass
class Whitening:
    """Exact sums of the fit list of one length of vectors, and what follows from them."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues of the covariance, falling, those of constant directions 0
    axes: np.ndarray  # columns: unit eigenvectors in that order
    trace: float
    identity_error: float | None = None

    def weights(self, count: int) -> np.ndarray:
        """dim x count: eigenvectors over the root of their eigenvalues; not-a-number where that is 0."""
        count = min(count, len(self.values))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values[:count] > 0, self.axes[:, :count] / np.sqrt(self.values[:count]), np.nan)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in double precision: the whole part of S/n goes off as integers, its fraction afterwards."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(float) - part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None where it does not fit a long."""
        worst = max(max(abs(self.n * int(a) - s), abs(self.n * int(b) - s)) for a, b, s in zip(x.min(0), x.max(0), self.sums)) if len(x) else 0
        # n * x and S may leave 64 bits although their difference does not: the difference is right modulo 2^64.
        if worst * worst * x.shape[1] < 1 << 62:
            base = np.array([s & ((1 << 64) - 1) for s in self.sums], np.uint64)
            gap = (x.astype(np.uint64) * np.uint64(self.n) - base).astype(np.int64)
            return (gap**2).sum(1).tolist()
        gap = x.astype(object) * self.n - np.array(self.sums, object)
        exact = (gap**2).sum(1)
        return [int(e) if e < 1 << 63 else None for e in exact]


def _solved(n: int, sums: list[int], product: np.ndarray) -> Whitening:
    sums_ = np.array(sums, object)
    centred = n * product - np.outer(sums_, sums_)  # n^2 times the covariance, exact
    cov = np.array([[int(v) / (n * n) for v in row] for row in centred], float)  # each quotient is rounded once
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1].copy(), axes[:, ::-1].copy()
    values[values <= CONSTANT * max(values[0], 0.0)] = 0.0
    # Either sign is right; the entry of largest size is made positive so that reruns agree.
    top = axes[np.abs(axes).argmax(0), np.arange(len(axes))]
    return Whitening(n, sums, values, axes * np.where(top < 0, -1.0, 1.0), float(np.trace(cov)))


def _rows(df: DataFrame, id_col: str | None, vector_col: str) -> DataFrame:
    vector = F.col(vector_col).cast("array<double>")
    columns = [F.size(vector).alias("dim"), vector.alias("vector")]
    return df.where(usable(F.col(vector_col))).select(*([F.col(id_col).alias("id")] if id_col else []), *columns)


def _whitened_moments(models: dict[int, Whitening], count: int):
    """Sums of whitened values and of their products, one row a task for each length of vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[np.ndarray]] = {}
        for dim, x in _blocks(batches):
            w = models[dim].centred(x) @ np.nan_to_num(models[dim].weights(count))
            first, second = totals.setdefault(dim, [np.zeros(w.shape[1]), np.zeros((w.shape[1], w.shape[1]))])
            first += w.sum(0)
            second += w.T @ w
        for dim, (first, second) in totals.items():
            flat = np.concatenate([first, second.ravel()])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(flat), dim, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["dim", "at", "v"]
            )

    return run


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = 32) -> dict[int, Whitening]:
    """A ``Whitening`` for each length of usable vector; no usable vectors, an empty dict.

    Two passes: the bit-sliced scatter, and the covariance of the whitened values themselves for ``identity_error``
    (None where all vectors are equal). Repeated rows count as often as they occur.
    """
    small_batches(vectors.sparkSession)
    rows = _rows(vectors, None, vector_col)
    cells = rows.mapInArrow(_scatter, "dim int, i int, j int, limb int, part long")
    found: dict[int, dict[tuple[int, int], int]] = {}
    # dim * (dim + 1) / 2 sums, whatever the number of rows.
    for r in cells.groupBy("dim", "i", "j", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect():
        own = found.setdefault(r.dim, {})
        own[r.i, r.j] = own.get((r.i, r.j), 0) + (int(r.part) << (LIMB * r.limb))
    models = {}
    for dim, own in found.items():
        product = np.zeros((dim, dim), object)
        for i in range(dim):
            for j in range(i, dim):
                product[i, j] = product[j, i] = own[i, j]
        models[dim] = _solved(own[-1, -1], [own[i, -1] for i in range(dim)], product)
    if not models:
        return models
    moments = rows.mapInArrow(_whitened_moments(models, components), "dim int, at int, v double").groupBy("dim", "at").agg(F.sum("v").alias("v")).collect()
    for dim, model in models.items():
        on = model.values[:components] > 0
        flat = np.array([v for _, v in sorted((r.at, r.v) for r in moments if r.dim == dim)]) / model.n
        first, second = flat[: len(on)], flat[len(on) :].reshape(len(on), len(on))
        if on.any():
            model.identity_error = float(np.abs(second - np.outer(first, first) - np.eye(len(on)))[np.ix_(on, on)].max())
    return models


def whiten(vectors: DataFrame, models: dict[int, Whitening], id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error) of each usable vector; the last but one two are arrays.

    The arrays hold the first ``components`` components (all, if there are fewer). Rows whose vector is null, empty or
    holds a null or non-finite entry have no result, nor do those of a length without a model. Null ids are kept, as
    are repeated rows. Entries whose floor(64 c) is beyond 2^62 are cut to that. Deviations beyond a long are null, and
    so are whitened values along a component of variance 0, explained shares where all vectors are equal, and then
    the identity error.
    """
    kind = dict(vectors.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("dim").to_numpy()
            for dim in np.unique(lengths).tolist():
                model = models.get(dim)
                if model is None:
                    continue
                own = batch.filter(pa.array(lengths == dim))
                x = integers(own.column("vector"), dim)
                weights = model.weights(components)
                w = model.centred(x) @ np.nan_to_num(weights)
                w[:, np.isnan(weights).any(0)] = np.nan
                count = w.shape[1]
                ends = pa.array(np.arange(0, len(x) * count + 1, count, dtype=np.int32))
                share = model.values[:count] / model.trace if model.trace > 0 else np.full(count, np.nan)
                lists = [pa.ListArray.from_arrays(ends, pa.array(a, from_pandas=True)) for a in (w.ravel(), np.tile(share, len(x)))]
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("id"), pa.array(np.full(len(x), model.n, np.int64)), pa.array(model.deviations(x), pa.int64()), *lists,
                        pa.array([model.identity_error] * len(x), pa.float64()),
                    ],
                    ["id", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    small_batches(vectors.sparkSession)
    schema = f"id {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    return _rows(vectors, id_col, vector_col).mapInArrow(run, schema)
