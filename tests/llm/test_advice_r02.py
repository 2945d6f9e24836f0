"""What the second review found missing, each against brute force on a case where the earlier code fell short."""

import collections
import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from claimweave.llm import bpe, kneser_ney, line_dedup, quality_rules, queries
from test_llm_operators import brute_lines, public, tokenizers

SF = "/root/testdata/sf0.001"


def words(text):
    return [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)} | {i: 32 for i in range(9, 14)}).split(" ") if w]


def test_language_model_keeps_bigrams_seen_once(spark):
    """The registered query scores like full interpolated Kneser-Ney over all bigrams of the training texts."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    tokens = {i: [*words(t), 1] for i, t in texts.items()}
    pairs = collections.Counter(p for i, w in tokens.items() if i not in held for p in zip([0, *w[:-1]], w))
    types, begun, left = collections.Counter(x for _, x in pairs), collections.Counter(), collections.Counter()
    d = lambda counts: kneser_ney._discounts({k: sum(v == k for v in counts.values()) for k in range(1, 5)})
    d1, d2, total = d(types), d(pairs), sum(types.values())
    for (h, _), n in pairs.items():
        begun[h] += n
        left[h] += d2[min(n, 3) - 1]
    unknown = sum(d1[min(n, 3) - 1] for n in types.values()) / total / (len(types) + 1)

    def chance(h, x):
        low = (types[x] - d1[min(types[x], 3) - 1]) / total + unknown if x in types else unknown
        n = pairs[h, x]
        return (n - d2[min(n, 3) - 1] + left[h] * low) / begun[h] if n else (left[h] / begun[h] if h in begun else 1) * low

    got = {r.doc_id: r for r in queries.op5_kneser_ney(spark, SF).collect()}
    assert got.keys() == texts.keys() and {i for i, r in got.items() if r.held_out} == held
    for i, w in tokens.items():
        assert np.isclose(got[i].score, sum(np.log10(chance(*p)) for p in zip([0, *w[:-1]], w)))
    assert np.isclose(sum(chance("the", x) for x in types) + chance("the", "?"), 1)


def test_lines_of_rows_in_descending_order(spark):
    """The earliest copy of a line stands for it, in whatever order the rows of a file are."""
    line = "alpha beta gamma delta epsilon zeta"
    rows = [(9, f"nine\n{line}"), (5, "alpha beta gamma other epsilon zeta"), (3, f"three\n{line}"), (2, "two"), (1, "alpha beta gamma delta zeta\none")]
    for some in (rows, rows[:-1]):
        docs = spark.createDataFrame(some, "doc_id long, text string").coalesce(1)
        assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == brute_lines(some)
    mixed = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select(F.col("doc_id"), "text").orderBy(F.desc("doc_id")).coalesce(1)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(mixed).collect()} == brute_lines([(r.doc_id, r.text) for r in mixed.collect()])


def test_moderate_outliers_are_rejected(spark):
    """A tenth of symbols, or repeated lines in most places, is far from ordinary texts; ordinary texts stay."""
    rng = np.random.default_rng(3)
    size = lambda: int(rng.integers(60, 260))
    plain = [(i, " ".join(f"word{w}" for w in rng.integers(0, 5000, size())), "en", "s") for i in range(600)]
    signs = [(1000 + i, " ".join(f"word{w}$" for w in rng.integers(0, 5000, 150)), "en", "s") for i in range(8)]
    lines = [(2000 + i, "\n".join(["same"] * 14 + [" ".join(f"word{w}" for w in rng.integers(0, 5000, 30)) for _ in range(6)]), "en", "s") for i in range(8)]
    rows = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(plain + signs + lines, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in rows.values())
    assert {i for i, r in rows.items() if i >= 1000 and r.kept} == set()
    assert sum(not rows[i].kept for i in range(600)) <= 6


def test_long_runs_among_failing_words():
    """A run of 20,000 letters costs no wide grid for the other words, and merges as the tokenizer does."""
    path = public.path("word_bpe_49k.json")
    tokenizer, v, rng = tokenizers.Tokenizer.from_file(path), bpe.Vocabulary(path), np.random.default_rng(5)
    spell = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    words = [spell(20_000), "a" * 9_999, *(spell(int(n)) for n in rng.integers(5, 700, 300))]
    ids, _ = next(iter(v.encode_texts([" ".join(words)])))
    assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(" ".join(words), add_special_tokens=False).ids
    symbols = [v.byte_ids[0, np.frombuffer(w.encode(), np.uint8)] for w in [words[0], *(spell(20) for _ in range(3000))]]
    tracemalloc.start()
    v.merged(symbols)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_line_dedup_with_clashing_names(spark):
    rows = [(2, "a b c d e f\nx", 1, 2, 3, 4, 5), (1, "a b c d e f", 1, 2, 3, 4, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone int, _doc int, _n_lines int, doc int, near int")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "_gone", "_doc", "doc", "near", "_n_lines", "_n_copies", "_n_near"]
    assert {r.doc_id: (r.text, r["_gone"], r["_n_lines"], r["_n_copies"]) for r in out.collect()} == {1: ("a b c d e f", 1, 1, 0), 2: ("x", 1, 2, 1)}
