"""Toxicity classifier: a small convolutional network over hashed word embeddings, trained in numpy.

A word's embedding is the sum of three rows of one table, found by hashes of the word, of its first four and of
its first six bytes, so that rare words share what their beginnings have in common. Filters of widths 1, 2 and 3 slide
over the words; the greatest response of each filter in the text feeds a logistic output. Whole texts are scored.
Training takes all labelled rows, dealt by a hash of the id over blocks of about ``BLOCK`` texts, each stored as a row; the
first dimension starts from how much more often a row occurs in all texts of label 1. In every round each block goes on from the same
network, and the changes that blocks make are averaged, those of a table row over the blocks that touched it. A seventh
of the labelled rows takes no part in this and sets a threshold for each language. The score itself never sees the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.stages import perhaps_among, small_batches, staged
from claimweave.llm.words import mix, range_hashes, slices, stream, words_of

BLOCK = 4_000
WORDS = 1 << 22  # after so many (32 MB) a task begins another block, so that long texts do not fill its memory
ROWS = 1 << 18  # of the embedding table
DIM = 6
FILTERS = 4  # of each width
WIDTHS = (1, 2, 3)
ROUNDS = 4
STEPS = 120  # of one block in one round
RATE = 0.05
BATCH = 64
PREFIXES = (4, 6)
SHIFTS = np.array([0, 18, 36])  # of a word's table rows in one number
PART = 1 << 14  # rows of sums in one Arrow batch
FINE = 100  # thresholds lie between steps of 1 / FINE of the log odds, from -MOST / FINE to MOST / FINE
MOST = 3_000
_U = np.uint64


def word_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words, 3) rows of the embedding table, and the n + 1 places where texts begin. A-Z count as a-z."""
    w = words_of(column)
    hashes = [w.hashes()]
    for size, salt in zip(PREFIXES, stream(len(PREFIXES), 31)):
        hashes.append(range_hashes(w.data, w.starts, np.minimum(w.ends, w.starts + size)) + salt)
    return np.stack([(mix(h) >> _U(46)).astype(np.int32) for h in hashes], 1) if len(w.starts) else np.zeros((0, 3), np.int32), w.bounds


@dataclass
class Net:
    table: np.ndarray
    filters: list[np.ndarray]  # by width: (width, DIM, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray
    intercept: float

    def responses(self, rows: np.ndarray, doc: np.ndarray) -> Iterator[np.ndarray]:
        """Each filter's response at each word, minus infinity where its window leaves the text."""
        x = self.table[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            x += self.table[rows[:, k]]
        n = len(x)
        for width, kernel, bias in zip(WIDTHS, self.filters, self.biases):
            z = np.full((n, FILTERS), -np.inf, np.float32)
            if n >= width:
                z[: n - width + 1] = bias
                for k in range(width):
                    z[: n - width + 1] += x[k : n - width + 1 + k] @ kernel[k]
                z[: n - width + 1][doc[width - 1 :] != doc[: n - width + 1]] = -np.inf
            yield z

    def pooled(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(n, filters of all widths): each filter's greatest response in each text, 0 at least."""
        n = len(bounds) - 1
        out = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            doc = np.repeat(np.arange(n), np.diff(bounds))
            for i, z in enumerate(self.responses(rows, doc)):
                out[full, i * FILTERS : (i + 1) * FILTERS] = np.maximum(np.maximum.reduceat(z, bounds[:-1][full]), 0)
        return out

    def logits(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log odds of label 1 for each text."""
        return self.pooled(rows, bounds).astype(float) @ self.out + self.intercept

    def small(self) -> np.ndarray:
        """All numbers but the table's, one after the other."""
        return np.concatenate([*(k.ravel() for k in self.filters), *self.biases, self.out, [self.intercept]]).astype(float)

    def moved(self, table: np.ndarray, small: np.ndarray) -> Net:
        """The network with other numbers, those of ``small`` in its order."""
        parts = np.split(small, np.cumsum([*(k.size for k in self.filters), *(b.size for b in self.biases), len(self.out)]))
        n = len(WIDTHS)
        filters = [p.reshape(k.shape).astype(np.float32) for p, k in zip(parts, self.filters)]
        return Net(table, filters, [p.astype(np.float32) for p in parts[n : 2 * n]], parts[2 * n].copy(), float(parts[-1][0]))


def _start(seen: np.ndarray, ones: np.ndarray, n: int, total: float) -> Net:
    """From the texts each table row occurs in, those of label 1 among them, and the numbers of texts and of label 1."""
    rng = np.random.default_rng(5)
    table = rng.normal(0, 0.02, (ROWS, DIM)).astype(np.float32)
    rate = (total + 0.5) / (n + 1)
    surplus = (ones - seen * rate) / np.sqrt(seen * rate + 1)
    table[:, 0] += 0.4 * np.sign(surplus) * np.log1p(np.abs(surplus))
    filters, biases = [], []
    for width in WIDTHS:
        kernel = rng.normal(0, 0.1, (width, DIM, FILTERS)).astype(np.float32)
        kernel[width // 2, 0] += 1
        filters.append(kernel)
        biases.append(np.full(FILTERS, -0.5, np.float32))
    size = FILTERS * len(WIDTHS)
    return Net(table, filters, biases, np.full(size, 2.0 / size), float(np.log(rate / (1 - rate))) - 1 if n else 0.0)


def train(net: Net, texts: list[np.ndarray], y: np.ndarray, seed: list[int]) -> tuple[Net, np.ndarray]:
    """``net`` after ``STEPS`` steps over one block, and the table rows that they touched.

    ``texts`` hold a number for each word and are unpacked as they are used. Adagrad on the logistic loss; with max pooling a
    text's gradient reaches one window for each filter.
    """
    net = net.moved(net.table.copy(), net.small())
    seen = np.zeros(ROWS, bool)
    squares = [np.full_like(net.table, 1e-2), *(np.full_like(k, 1e-2) for k in net.filters), *(np.full_like(b, 1e-2) for b in net.biases)]
    out_squares = np.full(len(net.out) + 1, 1e-2)
    rng = np.random.default_rng(seed)
    done = 0
    while done < STEPS:
        order = rng.permutation(len(y))
        for start in range(0, len(y), BATCH):
            if done == STEPS:
                break
            chosen = order[start : start + BATCH]
            done += 1
            rows = _unpacked(np.concatenate([texts[i] for i in chosen]))
            bounds = np.concatenate([[0], np.cumsum([len(texts[i]) for i in chosen])])
            doc = np.repeat(np.arange(len(chosen)), np.diff(bounds))
            pooled = np.zeros((len(chosen), len(net.out)))
            places = np.zeros(pooled.shape, np.int64)
            for i, z in enumerate(net.responses(rows, doc)):
                for d in np.flatnonzero(np.diff(bounds)):
                    own = z[bounds[d] : bounds[d + 1]]
                    at = own.argmax(0)
                    pooled[d, i * FILTERS : (i + 1) * FILTERS] = own[at, np.arange(FILTERS)]
                    places[d, i * FILTERS : (i + 1) * FILTERS] = bounds[d] + at
            pooled = np.maximum(np.where(np.isfinite(pooled), pooled, 0), 0)
            p = 1 / (1 + np.exp(-(pooled @ net.out + net.intercept)))
            error = (p - y[chosen]) / len(chosen)
            back = error[:, None] * net.out * (pooled > 0)
            slope = np.append(error @ pooled, error.sum())
            out_squares += slope**2
            slope *= RATE / np.sqrt(out_squares)
            net.out -= slope[:-1]
            net.intercept -= slope[-1]
            touched, pulls = [], []
            for i, width in enumerate(WIDTHS):
                g, at = back[:, i * FILTERS : (i + 1) * FILTERS], places[:, i * FILTERS : (i + 1) * FILTERS]
                d, f = np.nonzero(g)
                if not len(d):
                    continue
                value, at = g[d, f].astype(np.float32), at[d, f]
                kernel_slope = np.zeros_like(net.filters[i])
                for k in range(width):
                    own = rows[at + k]
                    np.add.at(kernel_slope[k].T, f, value[:, None] * net.table[own].sum(1))
                    pull = value[:, None] * net.filters[i][k][:, f].T
                    touched.append(own.ravel())
                    pulls.append(np.repeat(pull, own.shape[1], 0))
                squares[1 + i] += kernel_slope**2
                net.filters[i] -= RATE * kernel_slope / np.sqrt(squares[1 + i])
                bias_slope = np.bincount(f, value, FILTERS).astype(np.float32)
                squares[1 + len(WIDTHS) + i] += bias_slope**2
                net.biases[i] -= RATE * bias_slope / np.sqrt(squares[1 + len(WIDTHS) + i])
            if touched:
                own, which = np.unique(np.concatenate(touched), return_inverse=True)
                slope = np.zeros((len(own), DIM), np.float32)
                np.add.at(slope, which, np.concatenate(pulls))
                squares[0][own] += slope**2
                net.table[own] -= RATE * slope / np.sqrt(squares[0][own])
                seen[own] = True
    return net, np.flatnonzero(seen)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, words, y) of each labelled text; words are its words' table rows, 18 bits each in one number."""
    for batch in batches:
        for part in slices(batch, "text"):
            rows, bounds = word_rows(part.column("text"))
            data = (rows.astype(np.int64) << SHIFTS).sum(1).astype("<i8")
            places = pa.py_buffer((bounds * 8).astype(np.int64))
            words = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, places, pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("block"), words, part.column("y")], ["block", "words", "y"])


def _unpacked(words: np.ndarray) -> np.ndarray:
    """(words, 3) table rows."""
    return ((words[:, None] >> SHIFTS) & (ROWS - 1)).astype(np.int32)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(number, packed words of each text, labels) of blocks, whose texts follow each other; the words stay where Arrow has them.

    A block of more than ``WORDS`` words, or whose file has several row groups, goes on as another one: texts are never cut or lost.
    """
    number, texts, y, size = 0, [], [], 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column("words").cast(pa.large_binary())
        _, places, data = column.buffers()
        at = np.frombuffer(places, np.int64, len(column) + 1, column.offset * 8) // 8
        words = np.frombuffer(data, "<i8", at[-1]) if at[-1] else np.zeros(0, "<i8")
        for i, (block, label) in enumerate(zip(batch.column("block").to_pylist(), batch.column("y").to_pylist())):
            if texts and (block != number or size >= WORDS):
                yield number, texts, np.array(y)
                texts, y, size = [], [], 0
            number = block
            texts.append(words[at[i] : at[i + 1]])
            y.append(label)
            size += len(texts[-1])
    if texts:
        yield number, texts, np.array(y)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, n, s): texts of this task that a table row occurs in, those of label 1; at ``ROWS`` all texts."""
    seen, ones = np.zeros(ROWS + 1), np.zeros(ROWS + 1)
    for _, texts, y in _blocks(batches):
        for words, label in zip(texts, y):
            own = np.append(np.unique(_unpacked(words)), ROWS)
            seen[own] += 1
            ones[own] += label
    yield from _sums(np.flatnonzero(seen), seen, ones[:, None])


def _sums(rows: np.ndarray, n: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    for first in range(0, len(rows), PART):
        own = rows[first : first + PART]
        columns = [pa.array(own), pa.array(n[own]), *(pa.array(np.ascontiguousarray(c)) for c in sums[own].T)]
        yield pa.RecordBatch.from_arrays(columns, ["row", "n", *(f"s{k}" for k in range(sums.shape[1]))])


def _gathered(blocks: DataFrame, run, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all blocks of (n, s0, ..) by row: of one size whatever the number of blocks."""
    names = [f"s{k}" for k in range(width)]
    rows = blocks.mapInArrow(run, ", ".join(["row long", "n double", *(f"{c} double" for c in names)]))
    found = rows.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n", *names))).toPandas()
    n, sums = np.zeros(2 * ROWS), np.zeros((2 * ROWS, width))
    n[found["row"]], sums[found["row"]] = found["n"], found[names]
    return n, sums


def _round(shared, number: int):
    """Changes that blocks make, times their texts: (row, texts, sums); numbers besides the table follow at ``ROWS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        small = net.small()
        n, sums = np.zeros(ROWS + len(small)), np.zeros((ROWS + len(small), DIM))
        for block, texts, y in _blocks(batches):
            after, own = train(net, texts, y, [6, block, number])
            n[own] += len(y)
            sums[own] += len(y) * (after.table[own] - net.table[own]).astype(float)
            n[ROWS:] += len(y)
            sums[ROWS:, 0] += len(y) * (after.small() - small)
        yield from _sums(np.flatnonzero(n), n, sums)

    return run


def fit(texts: DataFrame, known: DataFrame) -> Net:
    """Trained on all of ``texts(id, text)`` with a label in ``known(id, y)``; of rows that repeat an id, the least text counts."""
    spark = texts.sparkSession
    rows = perhaps_among(texts, known).groupBy("id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).join(known, "id")
    size = known.join(texts.select("id"), "id", "left_semi").count()
    n = max(1, -(-size // BLOCK))
    deal = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n)).alias("block")
    dealt = rows.select("id", "text", "y", deal).repartitionById(n, F.col("block").cast("int")).sortWithinPartitions("id")  # a block is one file
    blocks = staged(dealt.mapInArrow(_packed, "block long, words binary, y double"), "blocks")
    seen, ones = _gathered(blocks, _occurrences, 1)
    net = _start(seen[:ROWS], ones[:ROWS, 0], seen[ROWS], ones[ROWS, 0])
    for number in range(ROUNDS if size else 0):
        shared = spark.sparkContext.broadcast(net)  # fixed size: ROWS * DIM numbers and the filters
        n, sums = _gathered(blocks, _round(shared, number), DIM)
        step = sums / np.maximum(n, 1)[:, None]
        end = ROWS + len(net.small())
        net = net.moved(net.table + step[:ROWS].astype(np.float32), net.small() + step[ROWS:end, 0])
        shared.destroy()
    return net


def thresholds(scored: DataFrame, least: int = 10) -> DataFrame:
    """(lang, threshold) from ``scored(lang, fine, y)``: the middle of the gap at which F1 is greatest.

    ``fine`` is the log odds in whole steps, so a language has a bounded number of them, whatever the number of rows.
    Languages with fewer than ``least`` labels of either kind, and null, are left out.
    """
    steps = scored.where("lang IS NOT NULL").groupBy("lang", "fine").agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
    whole, down = Window.partitionBy("lang"), Window.partitionBy("lang").orderBy(F.desc("fine"))
    steps = steps.select(
        "lang", "fine", F.sum("ones").over(whole).alias("all_ones"), F.sum("n").over(whole).alias("all"), F.lead("fine").over(down).alias("low"),
        F.sum("ones").over(down).alias("hits"), F.sum("n").over(down).alias("taken"),
    ).where(f"all_ones >= {least} AND all - all_ones >= {least}")
    chance = lambda c: 1 / (1 + F.exp(-F.col(f"at.{c}") / FINE))
    best = steps.groupBy("lang").agg(F.max_by(F.struct("fine", "low"), F.struct(2 * F.col("hits") / (F.col("taken") + F.col("all_ones")), "fine")).alias("at"))
    return best.select("lang", ((chance("fine") + F.coalesce(chance("low"), F.lit(0.0))) / 2).alias("threshold"))


def classify(
    docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    label: str = "toxic", common: float = 0.3,
) -> DataFrame:
    """(id, score, threshold) for every row of ``docs``: probability of label 1 and the threshold of its language.

    All rows with a label and an id on which ``learn``, a condition on column id, holds are learnt from. Null labels are ignored;
    of differing labels of one id the larger holds. Languages with too few labels, and null, have the threshold ``common``. Null and
    empty texts have no word and the score that follows from that. Repeated rows score alike; rows with a null id are
    scored but never learnt from. Without usable labels all scores are one half.
    """
    small_batches(docs.sparkSession)
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    known = staged(known.where(learn).groupBy("id").agg(F.max("y").alias("y")), "labels")
    aside = F.pmod(F.xxhash64("id"), F.lit(7)) == 3
    shared = spark.sparkContext.broadcast(fit(rows.select("id", "text"), known.where(~aside)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                odds = shared.value.logits(*word_rows(part.column("text")))
                fine = np.clip(np.rint(odds * FINE), -MOST, MOST).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("lang"), pa.array(1 / (1 + np.exp(-odds))), pa.array(fine)], ["id", "lang", "score", "fine"])

    scored = staged(rows.mapInArrow(run, f"id {kind}, lang string, score double, fine int"), "scored")
    judged = scored.join(known.where(aside), "id").groupBy("id").agg(F.min(F.struct("fine", "lang")).alias("row"), F.first("y").alias("y"))
    limits = thresholds(judged.select("row.lang", "row.fine", "y"))
    out = scored.join(F.broadcast(limits), "lang", "left")  # a row for each language with enough labels
    return out.select(F.col("id").alias(id_col), "score", F.coalesce("threshold", F.lit(float(common))).alias("threshold"))
