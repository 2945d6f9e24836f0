"""Proposals of byte-pair encoding: made for every word, verified pair by pair, merged only where that fails."""

import numpy as np
import pytest

from claimweave.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def spelled(n, seed, sizes=(1, 14)):
    rng = np.random.default_rng(seed)
    return list(dict.fromkeys("".join(map(chr, rng.integers(97, 123, int(k)))) for k in rng.integers(*sizes, n)))


def greedy(word, vocabulary):
    ids, at = [], 0
    while at < len(word):
        ends = [j for j in range(at + 1, len(word) + 1) if word[at:j] + "</w>" * (j == len(word)) in vocabulary]
        ids.append(vocabulary[word[at : ends[-1]] + "</w>" * (ends[-1] == len(word))])
        at = ends[-1]
    return ids


def test_only_words_with_a_failing_pair_are_merged_exactly(monkeypatch):
    """Once its pairs are known, a word whose proposal is right is not merged; all others are."""
    tokenizer, v = tokenizers.Tokenizer.from_file(PATH), bpe.Vocabulary(PATH)
    vocabulary = tokenizer.get_vocab()
    words = spelled(2500, 8) + ["tokenization", "misunderstanding", "aaaaaaa", "thethethe"]
    want = [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    right = [greedy(w, vocabulary) == ids for w, ids in zip(words, want)]
    assert 200 < sum(right) < len(words) - 200
    v.encode_pieces(words)
    merged, before = [], v.merged_flat
    monkeypatch.setattr(v, "merged_flat", lambda flat, at: merged.append(len(at) - 1) or before(flat, at))
    ids, texts = v.encode_pieces(words)
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == want
    assert texts == ["".join(tokenizer.id_to_token(i) + " " for i in own) for own in want]
    assert sum(merged) == len(words) - sum(right)


def test_proposals_are_the_longest_matches(monkeypatch):
    """From every word's start on, over blocks that cut words, and for a single letter and a long run."""
    monkeypatch.setattr(bpe, "GRID_CELLS", 97)
    v = bpe.Vocabulary(PATH)
    words = [*spelled(300, 9), "a", "z" * 700, *spelled(5, 10, (300, 500))]
    raw = [w.encode() for w in words]
    symbols = np.concatenate([v.byte_ids[(np.arange(len(r)) == len(r) - 1).astype(int), np.frombuffer(r, np.uint8)] for r in raw])
    tokens, at = v.proposed(symbols, np.concatenate([[0], np.cumsum(list(map(len, raw)))]))
    assert [tokens[a:b].tolist() for a, b in zip(at, at[1:])] == [greedy(w, v.id_of) for w in words]


def test_a_full_table_of_pairs_changes_no_ids(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 50)
    tokenizer, v, words = tokenizers.Tokenizer.from_file(PATH), bpe.Vocabulary(PATH), spelled(600, 11) + ["é中文", "ßé", "x"]
    for own in (words[:20], words[10:300], words, []):
        ids, _ = v.encode_pieces(own)
        assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [tokenizer.encode(w, add_special_tokens=False).ids for w in own]
        assert (np.diff(v.pairs) > 0).all() and len(v.pairs) == len(v.pair_fine)
