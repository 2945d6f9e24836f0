"""Line deduplication by a deletion neighbourhood.

Lines are compared by their words (A-Z lower-cased). Equal lines fall together first. Lines of at least
``MIN_WORDS`` words are also the same if inserting, deleting or replacing one word turns one into the other.

Variants are made in two steps, so that a long line costs a few keys. First, a line of n words is cut at the
places i * m / WINDOWS and one window at a time is deleted, for m = n and for m = n - 1 (a partner with one word
less). A single edit lies in one window, so two lines within the bound have a key of what is left in common. Only
windows whose key several lines share go on, with one word deleted at a time. Two lines share such a variant
exactly if they are within the bound: both lack the word at the same place, or one lacks it and the other is complete.
The earliest line of a variant is an aggregate: no pairs are formed, however many lines share it. A line's earliest
partner is then verified on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.stages import small_batches, staged
from claimweave.llm.words import BASE, Words, line_ranges, mix, slices, stream, words_of

MIN_WORDS = 5
WINDOWS = 3
FILTER_BITS = 26  # of a filter of fixed size (8 MB) for keys that several lines share; what it lets through is tested again
COMBINE_KEYS = 1 << 21
_U = np.uint64
_SUB, _CUT, _WHOLE, _TEXT = 0, 1, 2, 3


class Lines:
    """Lines of a batch of texts: owner, number, words (first, last + 1) and position-wise word hashes."""

    def __init__(self, column: pa.Array):
        self.words: Words = words_of(column)
        self.owner, self.number, self.start, self.end = line_ranges(self.words.data, self.words.at)
        self.low = np.searchsorted(self.words.starts, self.start)
        self.high = np.searchsorted(self.words.starts, self.end)
        keep = np.flatnonzero(self.high > self.low)
        for name in ("owner", "start", "end", "number", "low", "high"):
            setattr(self, name, getattr(self, name)[keep])
        self.n = self.high - self.low
        hashes = self.words.hashes()
        place = np.arange(len(hashes)) - np.repeat(self.low, self.n) if len(keep) else np.zeros(0, np.int64)
        salt = stream(int(self.n.max()) + 2 if len(keep) else 2, 21)
        self.salt = salt
        # running sums of the words' values at their own place and one place further left
        self.sums = [self._running(mix(hashes ^ salt[place] ^ seed)) for seed in (_U(0), BASE)]
        self.moved = [self._running(mix(hashes ^ salt[np.maximum(place - 1, 0)] ^ seed)) for seed in (_U(0), BASE)]
        self.a, self.b = (s[self.high] - s[self.low] for s in self.sums)

    @staticmethod
    def _running(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values) + 1, _U)
        np.cumsum(values, out=out[1:])
        return out

    def without(self, line: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Hash of each line without the given word (place in the line), as if it were a line of its own."""
        at = self.low[line] + word
        return self.sums[0][at] - self.sums[0][self.low[line]] + self.moved[0][self.high[line]] - self.moved[0][at + 1]

    def windows(self, shorter: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lines, keys, first and last + 1 word) for one window, sized for partners of n - ``shorter`` words."""
        line = np.flatnonzero(self.n >= MIN_WORDS + shorter)
        low, high, m = self.low[line], self.high[line], self.n[line] - shorter
        cut = window * m // WINDOWS
        rest = m - (window + 1) * m // WINDOWS
        # what follows is hashed by places counted from the partner's start: the same for either line
        source = self.moved[0] if shorter else self.sums[0]
        head = self.sums[0][low + cut] - self.sums[0][low]
        tail = source[high] - source[high - rest]
        key = mix(mix(head + BASE) + tail + self.salt[1] * (m * WINDOWS + window + 1).astype(_U))
        return line, key, cut, self.n[line] - rest


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            x = Lines(part.column("text"))
            doc = part.column("id").to_numpy()[x.owner]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (doc, x.number, x.a.view(np.int64), x.b.view(np.int64))], ["doc", "line", "a", "b"])


def _coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, a, several): one row for each key among this task's lines; several if lines differ."""

    def flush(held):
        key, a = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((a, key))
        key, a = key[order], a[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(new)
        several = a[at] != a[np.append(at[1:], len(a)) - 1]
        return pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(a[at].view(np.int64)), pa.array(several)], ["key", "a", "several"])

    held, size = [], 0
    for batch in batches:
        for part in slices(batch, "text"):
            x = Lines(part.column("text"))
            for shorter in (0, 1):
                for window in range(WINDOWS):
                    line, key, _, _ = x.windows(shorter, window)
                    held.append((key, x.a[line]))
                    size += len(line)
            if size >= COMBINE_KEYS:
                yield flush(held)
                held, size = [], 0
    if size:
        yield flush(held)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bit = batch.column("key").to_numpy().view(_U) >> _U(64 - FILTER_BITS)
        cells, which = np.unique(bit >> _U(6), return_inverse=True)
        value = np.zeros(len(cells), _U)
        np.bitwise_or.at(value, which, _U(1) << (bit & _U(63)))
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(value.view(np.int64))], ["cell", "bits"])


def _fine(shared):
    """Variants with one word less, of windows whose key passes the filter; and each such line's text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, _U)
        for batch in batches:
            for part in slices(batch, "text"):
                x = Lines(part.column("text"))
                ids = part.column("id").to_numpy()
                lines, kinds, keys = [], [], []
                for shorter in (0, 1):
                    for window in range(WINDOWS):
                        line, key, low, high = x.windows(shorter, window)
                        bit = key >> _U(64 - FILTER_BITS)
                        on = np.flatnonzero((bits[bit >> _U(6)] >> (bit & _U(63))) & _U(1))
                        line, low, high = line[on], low[on], high[on]
                        row = np.repeat(np.arange(len(line)), high - low)
                        word = np.arange(len(row)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[row]
                        rest = x.without(line[row], word)
                        if shorter:
                            lines.append(line[row])
                            kinds.append(np.full(len(row), _CUT))
                            keys.append(mix(rest + BASE))
                        else:
                            lines += [line[row], line]
                            kinds += [np.full(len(row), _SUB), np.full(len(line), _WHOLE)]
                            keys += [mix(mix(rest) + x.salt[0] * (word + 1).astype(_U)), mix(x.a[line] + BASE)]
                line, kind, key = (np.concatenate(c) for c in (lines, kinds, keys))
                own = np.unique(line)
                line, kind, key = np.append(line, own), np.append(kind, np.full(len(own), _TEXT)), np.append(key, x.a[own])
                rank = np.empty(len(x.a), np.int64)
                rank[np.lexsort((x.number, ids[x.owner]))] = np.arange(len(rank))
                if np.any(rank[1:] < rank[:-1]):  # rows need not ascend by id; of a line's copies the earliest is kept
                    order = np.argsort(rank[line], kind="stable")
                    line, kind, key = line[order], kind[order], key[order]
                with np.errstate(over="ignore"):
                    _, first = np.unique(mix(key + mix(x.a[line] * BASE + kind.astype(_U))), return_index=True)
                line, kind, key = line[first], kind[first], key[first]
                text = [
                    x.words.data[x.start[i] : x.end[i]].tobytes() if k == _TEXT else None for i, k in zip(line, kind)
                ]
                columns = [key.view(np.int64), kind, ids[x.owner[line]], x.number[line], x.a[line].view(np.int64), x.b[line].view(np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(text, pa.binary())], ["key", "kind", "doc", "line", "a", "b", "text"])

    return run


def within_one_edit(a: list, b: list) -> bool:
    """Whether one insertion, deletion or replacement at most turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[same + 1 :] == b[same + 1 :] or a[same:] == b[same + 1 :] or a[same + 1 :] == b[same:]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fine = [within_one_edit(s.as_py().split(), t.as_py().split()) for s, t in zip(batch.column("text"), batch.column("other"))]
        keep = pa.array(fine, pa.bool_())
        yield batch.select(["a", "b", "first"]).filter(keep)


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys, in sorted rows, that several lines share."""
    last, a = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, own, several = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "a", "several"))
        differs = several.copy()
        differs[1:] |= (key[1:] == key[:-1]) & (own[1:] != own[:-1])
        differs[0] |= last is not None and key[0] == last and own[0] != a
        last, a = key[-1], own[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(key[differs]))], ["key"])


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """(doc, line, near) of every line of ``docs(id, text)`` that has an earlier line within the bound.

    Earlier is by document id, then by place. ``near`` is false for a copy of an earlier equal line.
    """
    spark = docs.sparkSession
    lines = staged(docs.mapInArrow(_occurrences, "doc long, line long, a long, b long"), "lines")
    coarse = docs.mapInArrow(_coarse, "key long, a long, several boolean")
    keys = staged(coarse.repartition("key").sortWithinPartitions("key", "a").mapInArrow(_several, "key long"), "keys")
    cells = keys.mapInArrow(_bits, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(bits.tobytes())  # 8 MB at any size of the input
    fine = docs.mapInArrow(_fine(shared), "key long, kind long, doc long, line long, a long, b long, text binary")
    fine = staged(fine, "variants")
    place = F.struct("doc", "line", "a", "b")
    variants = fine.where(F.col("kind") != _TEXT).groupBy("key", "kind", "a", "b").agg(F.min(F.struct("doc", "line")).alias("own"))
    variants = staged(variants.select("key", "kind", "own.doc", "own.line", "a", "b"), "distinct_variants")
    least = variants.groupBy("key").agg(
        F.min(F.when(F.col("kind") == _SUB, place)).alias("sub"), F.min(F.when(F.col("kind") == _CUT, place)).alias("cut"),
        F.min(F.when(F.col("kind") == _WHOLE, place)).alias("whole"), F.count("*").alias("n"),
    )
    found = variants.join(least.where("n > 1").drop("n"), "key")
    partner = F.when(F.col("kind") == _SUB, F.col("sub")).when(F.col("kind") == _CUT, F.col("whole")).otherwise(F.col("cut"))
    found = found.withColumn("other", partner).where("other.a <> a OR other.b <> b").groupBy("a", "b").agg(F.min("other").alias("other"))
    texts = fine.where(F.col("kind") == _TEXT).groupBy("a", "b").agg(F.min("text").alias("text"))
    firsts = lines.groupBy("a", "b").agg(F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("n"))
    firsts = staged(firsts, "firsts")
    near = found.join(firsts.drop("n"), ["a", "b"]).where("struct(other.doc, other.line) < first").join(texts, ["a", "b"])
    others = texts.select(F.col("a").alias("oa"), F.col("b").alias("ob"), F.col("text").alias("other_text"))
    near = near.select("a", "b", "first", "text", F.col("other.a").alias("oa"), F.col("other.b").alias("ob")).join(others, ["oa", "ob"])
    near = near.select("a", "b", "first", "text", F.col("other_text").alias("other"))
    near = near.mapInArrow(_verify, "a long, b long, first struct<doc: long, line: long>").select("a", "b", F.lit(True).alias("near"))
    verdict = firsts.join(staged(near, "near"), ["a", "b"], "left").where("n > 1 OR near").drop("n")
    out = lines.join(verdict, ["a", "b"]).withColumn("copy", F.expr("struct(doc, line) <> first"))
    return out.where("copy OR near").select("doc", "line", F.expr("NOT copy").alias("near"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the later copies of lines taken out of the text; adds _n_lines, _n_copies and _n_near.

    Lines lie between line feeds; those without words are kept and never compared. Of a line and its copies the
    earliest stays (smallest id, then place). A document all of whose lines go has an empty text. Null texts stay
    null with 0 lines; empty texts have one line. Rows that repeat an id count as one document: equal lines at the
    same place are one line. Rows with a null id are returned as they are. All other columns are kept, but for those
    called like the three that are added, which give way to them.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    dropped = duplicate_lines(rows).distinct()
    lists = dropped.groupBy("doc").agg(
        F.collect_set("line").alias("_gone"), F.count_if(~F.col("near")).alias("_n_copies"), F.count_if("near").alias("_n_near")
    )
    # Both sides are named, so columns of ``docs`` may be called like those of the list.
    out = docs.alias("d").join(lists.alias("l"), F.col(f"d.`{id_col}`").cast("long") == F.col("l.doc"), "left")
    given, gone = F.col(f"d.`{text_col}`"), F.col("l._gone")
    lines = F.split(given, "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.array_contains(gone, i.cast("long")))
    text = F.when(gone.isNull(), given).otherwise(F.array_join(kept, "\n"))
    count = F.when(given.isNull(), 0).otherwise(F.size(lines)).cast("long")
    counts = {"_n_lines": count} | {c: F.coalesce(F.col(f"l.{c}"), F.lit(0)) for c in ("_n_copies", "_n_near")}
    own = [(text if c == text_col else F.col(f"d.`{c}`")).alias(c) for c in docs.columns if c not in counts]
    return out.select(*own, *(v.alias(c) for c, v in counts.items()))
