"""Counts and ratios of whole texts, computed on their bytes for a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from claimweave.llm.words import BASE, line_ranges, mix, range_hashes, words_of

_U = np.uint64


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


SYMBOLS = _class("#*$%&|<>")
UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGITS = _class("0123456789")
FIRST = np.array([b & 0xC0 != 0x80 for b in range(256)])  # begins a character

#: Ratios for the classifier, in this order.
RATIOS = (
    "log_words", "word_length", "word_length_spread", "symbols", "bars", "bangs", "upper", "digits", "stops", "commas",
    "other_punctuation", "dup_lines", "repeat_words", "distinct_words", "same_as_before", "words_per_line", "line_spread", "long_words",
)


class Stats:
    """Per text of a batch: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; ratios() for more."""

    def __init__(self, column: pa.Array):
        w = self.words = words_of(column, lower=False)
        self.n = len(w.at) - 1
        self.n_words = w.counts
        self.hashes = w.hashes()
        lengths = self._count(FIRST)  # running counts of characters
        self.lengths = lengths[w.ends] - lengths[w.starts]
        self.word_chars = self._by_doc(self.lengths)
        self.chars = lengths[w.at[1:]] - lengths[w.at[:-1]]
        self.n_symbols = self._in_text(SYMBOLS)
        self._lines()
        self._repeats()

    def _count(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.words.data) + 1, np.int64)
        np.cumsum(table[self.words.data], out=out[1:])
        return out

    def _in_text(self, table: np.ndarray) -> np.ndarray:
        c = self._count(table)
        return c[self.words.at[1:]] - c[self.words.at[:-1]]

    def _by_doc(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
        np.cumsum(values, out=out[1:])
        return out[self.words.bounds[1:]] - out[self.words.bounds[:-1]]

    def _lines(self) -> None:
        w = self.words
        owner, _, start, end = line_ranges(w.data, w.at)
        words = np.searchsorted(w.starts, end) - np.searchsorted(w.starts, start)
        full = np.flatnonzero(words)
        owner, words = owner[full], words[full]
        with np.errstate(over="ignore"):
            key = range_hashes(w.data, start[full], end[full]) + mix(owner.astype(_U) + BASE)
        _, first = np.unique(key, return_index=True)
        again = np.ones(len(key), bool)
        again[first] = False
        self.n_lines = np.bincount(owner, minlength=self.n)
        self.n_dup_lines = np.bincount(owner[again], minlength=self.n)
        self.line_squares = np.bincount(owner, weights=words.astype(float) ** 2, minlength=self.n)

    def _repeats(self) -> None:
        w, h = self.words, self.hashes
        n = len(h)
        covered = np.zeros(n, bool)
        if n > 2:
            inside = np.flatnonzero(w.doc[2:] == w.doc[:-2])
            with np.errstate(over="ignore"):
                key = mix((h[:-2] * BASE + h[1:-1]) * BASE + h[2:] + mix(w.doc[:-2].astype(_U)))[inside]
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            same = ordered[1:] == ordered[:-1]
            twice = np.zeros(len(key), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            at = inside[twice]
            for i in range(3):
                covered[at + i] = True
        self.n_repeat_words = self._by_doc(covered)

    def ratios(self) -> np.ndarray:
        """(n, len(RATIOS)) ratios of each text; 0 where there is no word."""
        w, n = self.words, self.n
        words, chars, lines = np.maximum(self.n_words, 1), np.maximum(self.chars, 1), np.maximum(self.n_lines, 1)
        mean = self.word_chars / words
        spread = self._by_doc(self.lengths.astype(float) ** 2) / words - mean**2
        with np.errstate(over="ignore"):
            distinct = np.unique(self.hashes + mix(w.doc.astype(_U) + BASE), return_index=True)[1]
        before = np.zeros(len(self.hashes), bool)
        before[1:] = (self.hashes[1:] == self.hashes[:-1]) & (w.doc[1:] == w.doc[:-1])
        per_line = self.n_words / lines
        punctuation = self._in_text(_class("\"'();:?-_/\\[]{}@+=~^`"))
        columns = [
            np.log1p(self.n_words), mean, np.sqrt(np.maximum(spread, 0)), self.n_symbols / chars, self._in_text(_class("|")) / words,
            self._in_text(_class("!")) / words, self._in_text(UPPER) / chars, self._in_text(DIGITS) / chars, self._in_text(_class(".")) / words,
            self._in_text(_class(",")) / words, punctuation / chars, self.n_dup_lines / lines, self.n_repeat_words / words,
            np.bincount(w.doc[distinct], minlength=n) / np.sqrt(words), self._by_doc(before) / words, np.log1p(per_line),
            np.sqrt(np.maximum(self.line_squares / lines - per_line**2, 0)) / np.maximum(per_line, 1), self._by_doc(self.lengths > 20) / words,
        ]
        out = np.stack(columns, 1) if n else np.zeros((0, len(RATIOS)))
        out[self.n_words == 0] = 0
        return out
