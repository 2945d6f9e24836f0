"""Interpolated modified Kneser-Ney language model, counted in Spark and mapped into memory by the workers that score.

The model is a bigram model (order 2) over words of the text and an end mark. With ``least=1``, as in the registered
query, every bigram is stored; by default those seen once are pruned and their mass goes to the back-off weight, so
that the model stays a proper distribution. Pairs are dealt by ranges of their hashes once, summed, sorted and written.
Unigram probabilities come from the number
of distinct words before a word, interpolated with the uniform distribution over the vocabulary and one unknown word.
All tables are sorted arrays of 64-bit hashes with their values, written by executors to the shared folder, one file
for each range of hashes. A worker maps the files and looks up sorted hashes, so its memory does not grow with the model.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.stages import posix_dir, small_batches, staged
from claimweave.llm.words import BASE, mix, slices, stream, words_of

HELD_ROWS = 1 << 21  # distinct n-grams that a task counts before it hands them on
_U = np.uint64
END_WORD, START_WORD, TOTAL = (int(v) for v in stream(3, 41))


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens: words and an end mark for each text; the n + 1 places where texts begin)."""
    w = words_of(column)
    n = len(w.at) - 1
    at = w.bounds + np.arange(n + 1)
    out = np.full(len(w.starts) + n, END_WORD, _U)
    keep = np.ones(len(out), bool)
    keep[at[1:] - 1] = False
    out[keep] = w.hashes()
    return out, at


def bigrams_of(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, hash of context and token) of every token."""
    context = np.empty_like(tokens)
    context[1:] = tokens[:-1]
    context[at[:-1]] = START_WORD
    with np.errstate(over="ignore"):
        return context, mix(context * BASE + tokens)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    keys, where = np.unique(keys, return_inverse=True)
    return keys, *(np.bincount(where, v, len(keys)) for v in values)


class _Sums:
    """Sums by key over a task's rows, handed on whenever there are many keys."""

    def __init__(self, names: list[str]):
        self.names, self.held, self.size = names, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(columns)
        self.size += len(columns[0])
        if self.size >= HELD_ROWS:
            self.held = [_summed(*map(np.concatenate, zip(*self.held)))]
            self.size = len(self.held[0][0])
            if self.size >= HELD_ROWS // 2:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            keys, *values = _summed(*map(np.concatenate, zip(*self.held)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, values)], self.names)
        self.held, self.size = [], 0


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, n): bigrams with their counts, and the number of all tokens under the key ``TOTAL``."""
    sums = _Sums(["g", "n"])
    for batch in batches:
        for part in slices(batch, "text"):
            tokens, at = tokens_of(part.column("text"))
            _, pair = bigrams_of(tokens, at)
            g, n = np.unique(pair, return_counts=True)
            yield from sums.add(np.append(g, _U(TOTAL)), np.append(n, len(tokens)).astype(float))
    yield from sums.rest()


def _word_counts(folder: str, files: list[dict], d2: tuple[float, float, float]):
    """(g, n, types, kept) for words: occurrences; distinct contexts; discounted counts of kept bigrams it begins.

    A bigram that was kept adds 1 / n to its word's contexts at each of its n occurrences, a pruned one was seen once and adds 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = Table(folder, files, ["n"])
        sums = _Sums(["g", "n", "types", "kept"])
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, at = tokens_of(part.column("text"))
                context, pair = bigrams_of(tokens, at)
                keys, where = _ordered(pair)
                n = pairs.get(keys)[0][where]
                left = np.where(n > 0, (n - _discounted(n, d2)) / np.maximum(n, 1), 0)
                zero, one = np.zeros(len(tokens)), np.ones(len(tokens))
                yield from sums.add(*_summed(
                    np.concatenate([tokens, context]), np.concatenate([one, zero]), np.concatenate([1 / np.maximum(n, 1), zero]), np.concatenate([zero, left])
                ))
        yield from sums.rest()

    return run


def _write(folder: str, names: list[str]):
    """Write rows sorted by unsigned hash to one file a column; returns (first, last, rows, file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = uuid.uuid4().hex
        files = {c: open(f"{folder}/{token}.{c}", "wb") for c in ("g", *names)}
        first = last = None
        rows = 0
        for batch in batches:
            if batch.num_rows:
                g = batch.column("g").to_numpy().view(_U) ^ _U(1 << 63)
                first, last, rows = int(g[0]) if first is None else first, int(g[-1]), rows + len(g)
                g.tofile(files["g"])
                for c in names:
                    batch.column(c).to_numpy().astype(np.float64).tofile(files[c])
        for f in files.values():
            f.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([str(first)]), pa.array([str(last)]), pa.array([rows]), pa.array([token])], ["first", "last", "rows", "file"])
        else:
            for f in files.values():
                os.remove(f.name)

    return run


def _write_counts(folder: str, least: int):
    """As ``_write`` for (g, n) with n of ``least`` or more; also (all tokens; pairs seen 1 to 4 times) as seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(5)

        def kept() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, pair = batch.column("n").to_numpy(), batch.column("g").to_numpy() != _signed(TOTAL)
                seen[0] += n[~pair].sum()
                seen[1:] += np.bincount(np.minimum(n[pair], 5).astype(np.int64), minlength=6)[1:5]
                yield batch.filter(pa.array(pair & (n >= least)))

        names = ["first", "last", "rows", "file"]
        found = list(_write(folder, ["n"])(kept()))
        columns = found[0].columns if found else [pa.array([None], t) for t in (pa.string(), pa.string(), pa.int64(), pa.string())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([seen.tolist()])], [*names, "seen"])

    return run


def _files(found: list) -> list[dict]:
    return sorted(({"first": int(r["first"]), "last": int(r["last"]), "rows": r["rows"], "file": r["file"]} for r in found), key=lambda f: f["first"])


def _store_counts(rows: DataFrame, folder: str, least: int) -> tuple[list[dict], np.ndarray]:
    """Sum ``rows(g, n)`` and write them sorted by hash; the files in order of hashes, and what was seen in all."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal ranges of hashes are equal shares of the pairs: one shuffle, without a sample
    part = F.expr(f"CAST(((shiftright(g, 32) + 2147483648) * {parts}) DIV 4294967296 AS INT)")
    dealt = rows.withColumn("part", part).repartitionById(parts, "part").groupBy("part", "g").agg(F.sum("n").alias("n"))
    dealt = dealt.select("g", "n").sortWithinPartitions("g")
    found = dealt.mapInArrow(_write_counts(folder, least), "first string, last string, rows long, file string, seen array<double>").collect()  # one row a file
    return _files([r for r in found if r["file"]]), sum((np.array(r["seen"]) for r in found), np.zeros(5))


def _store(rows: DataFrame, folder: str, names: list[str]) -> list[dict]:
    """Write ``rows(g, names)`` sorted by hash; one entry for each file, in order of its hashes."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "g").sortWithinPartitions("g")
    found = ordered.mapInArrow(_write(folder, names), "first string, last string, rows long, file string").collect()  # one row a file
    return _files(found)


@dataclass
class Table:
    """Sorted hashes with values in memory-mapped files."""

    folder: str
    files: list[dict]
    names: list[str]

    def __post_init__(self) -> None:
        self.firsts = np.array([f["first"] for f in self.files], _U)
        self.maps = [
            (np.memmap(f"{self.folder}/{f['file']}.g", _U, "r"), [np.memmap(f"{self.folder}/{f['file']}.{c}", np.float64, "r") for c in self.names])
            for f in self.files
        ]

    def get(self, hashes: np.ndarray) -> list[np.ndarray]:
        """Values of sorted distinct hashes, 0 where unknown."""
        keys = hashes
        out = [np.zeros(len(keys)) for _ in self.names]
        cuts = np.append(np.searchsorted(keys, self.firsts[1:]) if len(self.firsts) > 1 else [], len(keys)).astype(int)
        start = 0
        for (own, values), stop in zip(self.maps, cuts):
            if stop > start:
                at = np.minimum(np.searchsorted(own, keys[start:stop]), len(own) - 1)
                hit = np.flatnonzero(own[at] == keys[start:stop])
                for o, v in zip(out, values):
                    o[start + hit] = v[at[hit]]
            start = stop
        return out


@lru_cache(maxsize=2)
def _opened(path: str):
    with open(path) as file:
        model = json.load(file)
    folder = os.path.dirname(path)
    return model, Table(folder, model["words"], ["n", "p", "back"]), Table(folder, model["pairs"], ["n"])


def _discounts(histogram: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and more, from the numbers of n-grams seen 1 to 4 times."""
    n = [histogram.get(i, 0) for i in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    found = []
    for i in range(3):
        d = (i + 1) - (i + 2) * y * n[i + 1] / n[i] if n[i] else 0.5 * (i + 1)
        found.append(float(min(max(d, 0.05), i + 0.95)))
    return tuple(found)


def _histogram(rows: DataFrame, column: str) -> dict[int, int]:
    return {int(r[column]): r["_types"] for r in rows.where(F.col(column) <= 4).groupBy(column).agg(F.count("*").alias("_types")).collect()}


def _discount(column: str, d: tuple[float, float, float]) -> Column:
    c = F.col(column)
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def _discounted(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(n == 1, d[0], np.where(n == 2, d[1], d[2]))


def fit(docs: DataFrame, least: int = 2) -> str:
    """Count and store the model of ``docs(text)``; the path of its description. Null texts are empty texts.

    Bigrams seen fewer than ``least`` times (1 or 2) are pruned; 1 keeps all and gives the full model.
    """
    if least not in (1, 2):
        raise ValueError("only bigrams seen once can be pruned")
    spark = docs.sparkSession
    small_batches(spark)
    folder = posix_dir(spark, "kneser-ney")
    os.makedirs(folder)
    pairs, seen = _store_counts(docs.mapInArrow(_pair_counts, "g long, n double"), folder, least)
    d2 = _discounts(dict(enumerate(seen.tolist())))
    model = {"n": int(seen[0]), "v": 0, "d2": d2, "pairs": pairs, "words": []}
    words = docs.mapInArrow(_word_counts(folder, model["pairs"], d2), "g long, n double, types double, kept double")
    words = words.groupBy("g").agg(F.sum("n").alias("n"), F.round(F.sum("types")).alias("c"), F.sum("kept").alias("kept"))
    words = staged(words, "words")
    mark = words.where(F.col("g") == _signed(START_WORD)).first()
    texts = words.where(F.col("g") == _signed(END_WORD)).first()
    vocabulary = words.where(F.col("g") != _signed(START_WORD))
    if texts:
        d1 = _discounts(_histogram(vocabulary, "c"))
        sums = vocabulary.agg(F.count("*").alias("v"), F.sum("c").alias("c"), F.sum(_discount("c", d1)).alias("d")).first()
        uniform = sums["d"] / sums["c"] / (sums["v"] + 1)
        model |= {"v": sums["v"], "d1": d1, "unknown": uniform, "texts": texts["n"], "start_back": 1 - mark["kept"] / texts["n"]}
        p = (F.col("c") - _discount("c", d1)) / sums["c"] + uniform
        # a word is a context as often as it is a token
        model["words"] = _store(vocabulary.select("g", "n", p.alias("p"), (1 - F.col("kept") / F.col("n")).alias("back")), folder, ["n", "p", "back"])
    path = f"{folder}/model.json"
    with open(path, "w") as file:
        json.dump(model, file)
    return path


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _ordered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes in the order of the files, place of each hash among them); files are in signed order."""
    keys, where = np.unique(hashes ^ _U(1 << 63), return_inverse=True)
    return keys, where


def _score(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words, pairs = _opened(path)
        n, v = model["n"], model["v"]
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, at = tokens_of(part.column("text"))
                context, pair = bigrams_of(tokens, at)
                count, p, back = np.zeros(len(tokens)), np.full(len(tokens), 1.0 / (v + 1)), np.ones(len(tokens))
                u = np.zeros(len(tokens))
                if v:
                    keys, where = _ordered(tokens)
                    count, chance, weight = (x[where] for x in words.get(keys))
                    p = np.where(count > 0, chance, model["unknown"])
                    back[1:] = np.where(count > 0, weight, 1.0)[:-1]
                    back[at[:-1]] = model["start_back"]
                    before = np.ones(len(tokens))
                    before[1:] = np.maximum(count, 1)[:-1]
                    before[at[:-1]] = model["texts"]
                    keys, where = _ordered(pair)
                    seen = pairs.get(keys)[0][where]
                    u = np.where(seen > 0, seen - _discounted(seen, model["d2"]), 0) / before
                values = np.log10(u + back * p)
                base = np.log10((count + 1) / (n + 1.0 * (v + 1)))
                sums = [np.add.reduceat(x, at[:-1]) for x in (values, base, (count > 0).astype(np.int64))]
                columns = [np.diff(at), sums[2], np.full(part.num_rows, n), sums[1], sums[0]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *map(pa.array, columns)], ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
                )

    return run


def score(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    score is the model's log10 probability of the text and its end; base_score that of add-one unigrams; perplexity
    is 10 ** (-score / n_tokens). Null and empty texts have one token, the end. Repeated rows score alike. A model
    of no text knows no word and gives every token the uniform probability.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(docs.dtypes)[id_col]}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.mapInArrow(_score(model), schema).withColumnRenamed("id", id_col)
