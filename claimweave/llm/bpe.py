"""Byte-pair encoding by speculation and verification, many words at once.

A word's greedy longest-match tokens are proposed. A sequence of tokens is what the merges produce exactly if every
adjacent pair is, on its own, left as these two tokens by the merges. All adjacent pairs of a batch of words are
tested at once against a table of pairs known so far; new pairs are merged once. Only words with a failing pair are
merged exactly: they lie in the rows of a grid, words of like length together, and each step applies the first merge of
every row; long ones are merged one by one with a heap. Words repeat, so each worker keeps those it has seen.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.stages import small_batches

CACHED_WORDS = 400_000
CACHED_PAIRS = 1 << 20
GRID_CELLS = 1 << 19  # symbols merged together, rows times width
LONG_WORD = 256  # symbols; longer words are merged one by one with a heap
_NEVER = 1 << 40
_SYMBOLS = 513  # bytes inside words and at their ends, and one after all words
_SPECIAL = " "  # begins a chunk that is a special string; no other chunk holds a space


def _byte_alphabet() -> list[str]:
    """Printable stand-in of each byte: the byte's own character if visible in Latin-1, else 256 and onwards."""
    table, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            table.append(chr(b))
        else:
            table.append(chr(extra))
            extra += 1
    return table


class Vocabulary:
    """Tokens, ids and merge ranks of a tokenizer file with word ends; encodes words with a memory for repeats."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        self.end = model["end_of_word_suffix"]
        self.id_of: dict[str, int] = model["vocab"]
        self.text_of = {i: t for t, i in self.id_of.items()}
        self.spaced = pa.array([self.text_of.get(i, "") + " " for i in range(max(self.text_of) + 1)])
        alphabet = _byte_alphabet()
        plain = {c: self.id_of[c] for c in alphabet}
        ending = {c: self.id_of[c + self.end] for c in alphabet}
        self.byte_ids = np.array([[t[c] for c in alphabet] for t in (plain, ending)], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        codes = np.array([self.id_of[a] << 32 | self.id_of[b] for a, b in pairs], np.int64)
        order = np.argsort(codes)
        self.merge_code, self.merge_rank = codes[order], order.astype(np.int64)
        self.rank_of = dict(zip(codes.tolist(), range(len(codes))))
        self.merge_id = np.array([self.id_of[a + b] for a, b in pairs], np.int64)
        self.spell([(self.id_of[a], self.id_of[b]) for a, b in pairs])
        self.grow()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.pieces = regex.compile(data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.known: dict[str, bytes] = {}
        self.decoded: dict[str, str] = {}
        self.met_again: set[str] = set()
        self.pairs = np.zeros(0, np.int64)
        self.pair_fine = np.zeros(0, bool)

    def spell(self, pairs: list[tuple[int, int]]) -> None:
        """The symbols of each token, in one array, those of token i from ``spelt_at[i]`` on."""
        spelt = {i: (i,) for i in self.byte_ids.ravel().tolist()}
        for i, (a, b) in zip(self.merge_id.tolist(), pairs):
            spelt[i] = spelt[a] + spelt[b]
        own = [spelt.get(i, ()) for i in range(max(self.text_of) + 1)]
        self.spelt = np.fromiter(chain.from_iterable(own), np.int64)
        self.spelt_at = np.concatenate([[0], np.cumsum(list(map(len, own)))])

    def spelling(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the tokens one after another, and where each token's begin."""
        sizes = self.spelt_at[ids + 1] - self.spelt_at[ids]
        at = np.concatenate([[0], np.cumsum(sizes)])
        return self.spelt[np.repeat(self.spelt_at[ids] - at[:-1], sizes) + np.arange(at[-1])], at

    def grow(self) -> None:
        """A trie over symbols of the tokens that their own symbols merge into.

        ``edges`` has a sorted code of node and symbol for each node but the root, in order of nodes; ``token_at`` the token
        of each node, -1 for none; ``near`` the node by code for the root and its children, 0 for none.
        """
        symbols = self.byte_ids.ravel()
        self.number = np.full(len(self.spelt_at), -1, np.int64)
        self.number[symbols] = np.arange(len(symbols))
        ids = np.unique(np.concatenate([symbols, self.merge_id]))
        flat, at = self.spelling(ids)
        merged, cut = self.merged_flat(flat, at)
        own = np.flatnonzero(np.diff(cut) == 1)
        own = own[merged[cut[own]] == ids[own]]
        ids, first, sizes, flat = ids[own], at[own], np.diff(at)[own], self.number[flat]
        depth, nodes, node = 0, 1, np.zeros(len(ids), np.int64)
        codes, tokens = [], [np.full(1, -1, np.int64)]
        while len(ids):
            found, where = np.unique(node * _SYMBOLS + flat[first + depth], return_inverse=True)
            codes.append(found)
            tokens.append(np.full(len(found), -1, np.int64))
            depth, node, nodes = depth + 1, nodes + where, nodes + len(found)
            tokens[-1][where[sizes == depth]] = ids[sizes == depth]
            on = sizes > depth
            ids, first, sizes, node = ids[on], first[on], sizes[on], node[on]
        self.edges, self.token_at = np.concatenate(codes), np.concatenate(tokens)
        self.near = np.zeros((1 + len(codes[0])) * _SYMBOLS, np.int64)
        near = self.edges[: np.searchsorted(self.edges, len(self.near))]
        self.near[near] = np.arange(1, len(near) + 1)

    def proposed(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match over the symbols of the words that begin at ``at`` in ``flat``: tokens, and where each word's begin.

        Only a word's last symbol is an ending one, which only ends tokens, so no match reaches into the next word.
        """
        end = len(flat)
        token, stop = flat.copy(), np.arange(1, end + 1)
        symbol = np.append(self.number[flat], _SYMBOLS - 1)
        for a in range(0, end, GRID_CELLS):  # the longest match from every place
            here = np.arange(a, min(a + GRID_CELLS, end))
            node, depth = np.zeros(len(here), np.int64), 0
            while len(here):
                code = node * _SYMBOLS + symbol[here + depth]
                if depth < 2:
                    node = self.near[code]
                else:
                    edge = np.minimum(np.searchsorted(self.edges, code), len(self.edges) - 1)
                    node = np.where(self.edges[edge] == code, edge + 1, 0)
                on = np.flatnonzero(node)
                here, node, depth = here[on], node[on], depth + 1
                found = self.token_at[node]
                is_token = np.flatnonzero(found >= 0)
                token[here[is_token]], stop[here[is_token]] = found[is_token], here[is_token] + depth
        begins, chosen, heads = np.zeros(end + 1, bool), np.zeros(end, bool), at[:-1]
        begins[at] = True
        while len(heads):  # the first tokens of all words, then the second ones
            chosen[heads] = True
            heads = stop[heads]
            heads = heads[~begins[heads]]
        places = np.flatnonzero(chosen)
        return token[places], np.searchsorted(places, at)

    def compatible(self, codes: np.ndarray) -> np.ndarray:
        """Whether each pair of ids (first << 32 | second) stays as it is under the merges."""
        wanted, where = np.unique(codes, return_inverse=True)
        place = np.searchsorted(self.pairs, wanted)
        known = np.zeros(len(wanted), bool)
        inside = place < len(self.pairs)
        known[inside] = self.pairs[place[inside]] == wanted[inside]
        fine = np.zeros(len(wanted), bool)
        fine[known] = self.pair_fine[place[known]]
        fresh = wanted[~known]
        if len(fresh):
            ids = np.stack([fresh >> 32, fresh & 0xFFFFFFFF], 1)
            spelt, at = self.spelling(ids.ravel())
            merged, cut = self.merged_flat(spelt, at[::2])
            two = np.flatnonzero(np.diff(cut) == 2)
            same = np.zeros(len(fresh), bool)
            same[two] = (merged[cut[two]] == ids[two, 0]) & (merged[cut[two] + 1] == ids[two, 1])
            fine[~known] = same
            if len(self.pairs) + len(fresh) > CACHED_PAIRS:
                self.pairs, self.pair_fine = wanted, fine
            else:
                self.pairs, self.pair_fine = np.insert(self.pairs, place[~known], fresh), np.insert(self.pair_fine, place[~known], same)
        return fine[where]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of ids; _NEVER where there is none."""
        code = (left << 32) | right
        at = np.minimum(np.searchsorted(self.merge_code, code), len(self.merge_code) - 1)
        return np.where((self.merge_code[at] == code) & (left >= 0) & (right >= 0), self.merge_rank[at], _NEVER)

    def merged(self, words: list[np.ndarray]) -> list[np.ndarray]:
        """``merged_flat`` for symbol sequences in a list."""
        at = np.concatenate([[0], np.cumsum(list(map(len, words)), dtype=np.int64)])
        flat, at = self.merged_flat(np.concatenate([np.zeros(0, np.int64), *words]), at)
        return [flat[a:b] for a, b in zip(at, at[1:])]

    def merged_flat(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Apply the merges to the symbol sequences that begin at ``at`` in ``flat``, in order of rank, the leftmost first among equals."""
        sizes, first = np.diff(at), at[:-1]
        order = np.argsort(sizes, kind="stable")
        out, start, stop = [], 0, int((sizes <= LONG_WORD).sum())
        left = np.zeros(len(sizes), np.int64)  # symbols of each sequence after the merges
        while start < stop:  # words of like length together
            rows = order[start : min(start + 4096, stop)]
            cells = np.arange(1, len(rows) + 1) * (sizes[rows] + 1)
            rows = rows[: np.searchsorted(cells, GRID_CELLS, "right")]
            start += len(rows)
            width = int(sizes[rows].max())
            column = np.arange(width + 1)
            inside = column < sizes[rows][:, None]
            grid = np.full((len(rows), width + 1), -1, np.int64)
            grid[inside] = flat[(first[rows][:, None] + column)[inside]]
            rank = self.ranks(grid[:, :-1], grid[:, 1:])
            live = np.arange(len(rows))
            g, k = grid, rank
            while len(live):
                place = k.argmin(1)
                best = k[np.arange(len(live)), place]
                on = best < _NEVER
                grid[live[~on]] = g[~on]
                live, g, k, place, best = live[on], g[on], k[on], place[on], best[on]
                if not len(live):
                    break
                source = np.minimum(column + (column > place[:, None]), width)
                g, k = np.take_along_axis(g, source, 1), np.take_along_axis(k, np.minimum(source[:, :-1], width - 1), 1)
                g[:, width] = -1
                each = np.arange(len(live))
                g[each, place] = self.merge_id[best]
                k[each, place] = self.ranks(g[each, place], g[each, np.minimum(place + 1, width)])
                before = np.flatnonzero(place)
                k[before, place[before] - 1] = self.ranks(g[before, place[before] - 1], g[before, place[before]])
            inside = grid >= 0
            out.append(grid[inside])
            left[rows] = inside.sum(1)
        for r in order[stop:]:
            out.append(self.merged_long(flat[at[r] : at[r + 1]]))
            left[r] = len(out[-1])
        ends, found = np.cumsum(left), np.cumsum(left[order])
        shift = np.empty(len(left), np.int64)
        shift[order] = found - left[order]  # where a sequence begins in order of length
        where = np.repeat(shift - (ends - left), left) + np.arange(int(left.sum()))
        return np.concatenate([np.zeros(0, np.int64), *out])[where], np.concatenate([[0], ends])

    def merged_long(self, word: np.ndarray) -> np.ndarray:
        """As ``merged_flat`` for one sequence, in n log n steps: a heap of pairs over a linked list of symbols."""
        ids, end = word.tolist(), len(word)
        after, ahead = list(range(1, end + 1)), list(range(-1, end - 1))
        rank = self.ranks(word[:-1], word[1:])
        heap = [(int(rank[i]), i, ids[i], ids[i + 1]) for i in np.flatnonzero(rank < _NEVER).tolist()]
        heapify(heap)
        while heap:
            best, i, left, right = heappop(heap)
            j = after[i]
            if ids[i] != left or j == end or ids[j] != right:
                continue  # one of the two has been merged since
            ids[i], ids[j], after[i] = int(self.merge_id[best]), -1, after[j]
            if after[i] != end:
                ahead[after[i]] = i
            for a, b in ((ahead[i], i), (i, after[i])):
                if a >= 0 and b != end:
                    found = self.rank_of.get(ids[a] << 32 | ids[b])
                    if found is not None:
                        heappush(heap, (found, a, ids[a], ids[b]))
        return np.array([x for x in ids if x >= 0], np.int64)

    def encode_pieces(self, pieces: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids, and decoded text with a space after each token, of the pieces of text between split points."""
        raw = [p.encode("utf-8") for p in pieces]
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])
        symbols = np.frombuffer(b"".join(raw), np.uint8)
        last = np.zeros(len(symbols), np.int64)
        last[at[1:] - 1] = 1
        spelt = self.byte_ids[last, symbols]
        flat, cut = self.proposed(spelt, at)
        sizes = np.diff(cut)
        owner = np.repeat(np.arange(len(raw)), sizes)
        joint = np.flatnonzero(owner[1:] == owner[:-1])
        failing = np.zeros(len(raw), bool)
        failing[owner[joint[~self.compatible((flat[joint] << 32) | flat[joint + 1])]]] = True
        lengths = np.diff(at)
        merged, found = self.merged_flat(spelt[np.repeat(failing, lengths)], np.concatenate([[0], np.cumsum(lengths[failing])]))
        kept = flat[~failing[owner]]
        sizes[failing] = np.diff(found)
        other = np.repeat(failing, sizes)
        flat = np.empty(len(other), np.int64)
        flat[other], flat[~other] = merged, kept
        return self.pieces_out(flat, np.concatenate([[0], np.cumsum(sizes)]))

    def pieces_out(self, flat: np.ndarray, at: np.ndarray) -> tuple[list[bytes], list[str]]:
        """Ids as bytes, and texts with a space after each token, of the pieces that begin at ``at`` in ``flat``."""
        blob, cut = flat.astype("<u4").tobytes(), (4 * at).tolist()
        texts = pa.ListArray.from_arrays(pa.array(at, pa.int32()), self.spaced.take(pa.array(flat)))
        return [blob[a:b] for a, b in zip(cut, cut[1:])], pc.binary_join(texts, "").to_pylist()

    def normal(self, chunk: str) -> list[str]:
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
        chunk = chunk.lower() if "Σ" not in chunk else "".join(c.lower() for c in chunk)
        if chunk.isalpha():
            return [chunk]
        if chunk[-1:] in (",", ".") and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.pieces.findall(chunk)

    def learn(self, chunks: set[str]) -> None:
        """Remember the encoding of chunks between spaces, and of the pieces that they fall into."""
        known, decoded = self.known, self.decoded
        special = {c for c in chunks if c.startswith(_SPECIAL) and c[len(_SPECIAL) :] in self.special}
        for chunk in special:
            text = chunk[len(_SPECIAL) :]
            known[chunk], decoded[chunk] = array("I", [self.special[text]]).tobytes(), text + " "
        chunks = list(chunks - special)
        parts = [self.normal(c) for c in chunks]
        fresh = list(set(chain.from_iterable(parts)) - known.keys())
        ids, texts = self.encode_pieces(fresh)
        known.update(zip(fresh, ids))
        decoded.update(zip(fresh, texts))
        for chunk, pieces in zip(chunks, parts):
            if len(pieces) == 1:
                known[chunk], decoded[chunk] = known[pieces[0]], decoded[pieces[0]]
            else:
                known[chunk] = b"".join([known[p] for p in pieces])
                decoded[chunk] = "".join([decoded[p] for p in pieces])

    def make_room(self, wanted: set[str]) -> None:
        """Forget what was met once only; all, if that is not enough."""
        keep = self.met_again & self.known.keys()
        if len(keep) + len(wanted) > CACHED_WORDS // 2:
            keep = set()
        self.known, self.decoded = {w: self.known[w] for w in keep}, {w: self.decoded[w] for w in keep}
        self.met_again = set()

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded text) of each text.

        Neither normalisation nor split points reach across a space, so chunks between spaces are independent.
        Special strings stand alone, before normalisation.
        """
        cut = []
        for text in texts:
            if "<|" in text:
                own = []
                for i, part in enumerate(self.special_split.split(text)):
                    own.extend([_SPECIAL + part] if i % 2 else part.split(" "))
            else:
                own = text.split(" ")
            cut.append(own)
        for start in range(0, len(cut), 500):
            some = cut[start : start + 500]
            wanted = set(chain.from_iterable(some))
            missing = wanted - self.known.keys()
            self.met_again |= wanted - missing
            if len(self.known) + len(missing) > CACHED_WORDS:
                self.make_room(wanted)
                missing = wanted - self.known.keys()
            self.learn(missing)
            ids, decoded = self.known.__getitem__, self.decoded.__getitem__
            for own in some:
                yield b"".join(map(ids, own)), "".join(map(decoded, own))[:-1]


@lru_cache(maxsize=1)
def vocabulary_at(path: str) -> Vocabulary:
    """One vocabulary for all tasks of a worker process, so that words known stay known."""
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, decoded string): ids of whole texts as little-endian 32-bit integers and their decoded form.

    Equal to the tokenizer's own encoding without special tokens added, and its decoding with them kept. Null and
    empty texts have no ids and an empty decoded text. One row per input row, in any number of repeats.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_at(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for start in range(0, len(texts), 500):
                rows = list(vocabulary.encode_texts(texts[start : start + 500]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(start, 500), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())],
                    ["id", "ids", "decoded"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)


def digest(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_tokens and SHA-256 of the ids and of the decoded text."""
    return encoded.select(
        id_col, F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
