"""What the third review found, each on a case where the earlier code fell short."""

import cProfile
import pstats

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
from pyspark.sql import functions as F

from claimweave.llm import bpe, minhash, text_cnn


def test_toxicity_learns_from_every_labelled_row(spark):
    """A word that only the labelled rows last by hash show, beyond any 8,000, raises scores; so do rows of every block."""
    rng = np.random.default_rng(2)
    ids = [r.id for r in spark.range(10_000).orderBy(F.xxhash64("id"), "id").collect()]
    texts = {i: " ".join(f"w{k}" for k in rng.integers(0, 300, 5)) for i in ids}
    for k, i in enumerate(ids[9_000:]):
        texts[i] += " zebra" if k % 2 else " heron"
    rows = [*texts.items(), (20_000, "w1 w2 w3 zebra"), (20_001, "w1 w2 w3 heron"), (20_002, "w1 w2 w3 w4")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(4)
    labels = docs.where("doc_id < 20000").select("doc_id", F.col("text").contains("zebra").cast("int").alias("toxic"))
    score = {r.doc_id: r.score for r in text_cnn.classify(docs, labels, F.lit(True)).where("doc_id >= 20000").collect()}
    assert score[20_000] > 0.9 and score[20_001] < 0.1 and score[20_002] < 0.1


def test_toxicity_stores_each_text_as_a_row(spark, monkeypatch):
    """No stored row grows with the number of texts in a block, no labelled text is left out, and a block is one file."""
    kept, before = {}, text_cnn.staged

    def staged(df, name):
        kept[name] = before(df, name)
        return kept[name]

    monkeypatch.setattr(text_cnn, "staged", staged)
    monkeypatch.setattr(text_cnn, "BLOCK", 60)
    texts = [(i, " ".join(f"w{i * k % 97}" for k in range(i % 40)) if i % 9 else None, "en") for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(3)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    assert text_cnn.classify(docs, labels, F.lit(True)).count() == 600
    stored = kept["blocks"].select("*", sum(F.octet_length(c) for c, kind in kept["blocks"].dtypes if kind == "binary").alias("bytes"))
    learnt = {r.id for r in kept["labels"].where(F.pmod(F.xxhash64("id"), F.lit(7)) != 3).collect()}
    assert stored.agg(F.max("bytes"), F.count("*")).first() == (8 * 39, len(learnt))
    assert stored.agg(F.sum("bytes")).first()[0] == 8 * sum(len(t.split()) for i, t, _ in texts if t and i in learnt)
    files = {(r.block, r.name) for r in stored.select("block", F.input_file_name().alias("name")).collect()}
    assert len(files) == len({b for b, _ in files}) == len({f for _, f in files}) == -(-len(learnt) // 60)


def test_toxicity_blocks_are_views_and_bounded(monkeypatch):
    """Blocks follow the stored rows, end with their number or after so many words, and copy no words."""
    monkeypatch.setattr(text_cnn, "WORDS", 50)
    texts = ["", None, "a b c", "Toxic words follow", *(" ".join(f"w{k}" for k in range(i)) for i in range(30)), "", "x" * 99]
    numbers = [0] * 2 + [1] * (len(texts) - 5) + [2] * 3
    source = pa.table({"id": list(range(len(texts))), "text": pa.array(texts, pa.string()), "block": numbers, "y": [float(i % 2) for i in range(len(texts))]})
    packed = pa.Table.from_batches(text_cnn._packed(iter(source.to_batches(max_chunksize=7)))).combine_chunks()
    batches = [*packed.slice(0, 2).to_batches(), packed.to_batches()[0].slice(0, 0), *packed.slice(2, 9).to_batches(), *packed.slice(11).to_batches()]
    blocks = list(text_cnn._blocks(iter(batches)))
    assert [n for n, own, _ in blocks for _ in own] == numbers and np.concatenate([y for *_, y in blocks]).tolist() == source["y"].to_pylist()
    assert len(blocks) > 3 and all(sum(map(len, own[:-1])) < 50 for _, own, _ in blocks)
    for text, words in zip(texts, [w for _, own, _ in blocks for w in own], strict=True):
        assert not words.flags.owndata
        assert text_cnn._unpacked(words).tolist() == text_cnn.word_rows(pa.array([text], pa.string()))[0].tolist()
    assert list(text_cnn._blocks(iter([]))) == []


def test_thresholds_of_languages(spark):
    """The best F1 over all rows of a language; too few labels, or no language, have none."""
    rng = np.random.default_rng(3)
    rows = [(lang, int(x), float(rng.random() < 1 / (1 + np.exp(-x / 60)))) for lang in ("a", "b") for x in rng.integers(-300, 300, 400)]
    rows += [("few", 5, 1.0), ("few", 4, 0.0), *((None, k, float(k % 2)) for k in range(60))]
    got = {r.lang: r.threshold for r in text_cnn.thresholds(spark.createDataFrame(rows, "lang string, fine int, y double")).collect()}
    assert got.keys() == {"a", "b"}
    for lang in got:
        fine, y = np.array([(x, v) for name, x, v in rows if name == lang]).T
        levels = np.unique(fine)
        f1 = [2 * y[fine >= x].sum() / ((fine >= x).sum() + y.sum()) for x in levels]
        at = len(f1) - 1 - int(np.argmax(f1[::-1]))
        low = 1 / (1 + np.exp(-levels[at - 1] / text_cnn.FINE)) if at else 0
        assert got[lang] == pytest.approx((1 / (1 + np.exp(-levels[at] / text_cnn.FINE)) + low) / 2)


def variants(n, common, changes, seed):
    """Texts of ``common`` words, some changed; all texts are long enough for bitmaps to tell them apart."""
    rng = np.random.default_rng(seed)
    texts = {}
    for i in range(n):
        own = [f"w{k}" for k in range(common)]
        for j in rng.choice(common, int(rng.integers(*changes)), replace=False):
            own[j] = f"v{i}_{j}"
        texts[i] = " ".join(own)
    return texts


@pytest.mark.parametrize("changes", [(1, 4), (8, 14)])
def test_near_copies_are_compared_in_few_pairs(spark, monkeypatch, changes):
    """Pairs compared on full sets grow with the texts of a group, not with its square; links are those of all pairs."""
    texts, compared, before = variants(240, 120, changes, 5), [], minhash._verified

    def verified(sets, pairs, *rest):
        compared.append(pairs.count())
        return before(sets, pairs, *rest)

    monkeypatch.setattr(minhash, "_verified", verified)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    out = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, k=2).collect()}
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in texts.items()}
    name = {i: i for i in sets}
    for a in sets:
        for b in range(a):
            if name[a] != name[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(name[a], name[b]), min(name[a], name[b])
                name = {i: new if c == old else c for i, c in name.items()}
    assert out == name
    assert sum(compared) <= 16 * len(texts)


def test_words_are_merged_without_a_loop_over_each():
    """Words never seen before take few calls each, and have the tokenizer's ids."""
    path = public_tokenizers.path("word_bpe_49k.json")
    rng, v = np.random.default_rng(6), bpe.Vocabulary(path)
    text = " ".join("".join(map(chr, rng.integers(97, 123, int(n)))) for n in rng.integers(3, 14, 20_000))
    profile = cProfile.Profile()
    (ids, _), *_ = profile.runcall(lambda: list(v.encode_texts([text])))
    assert np.frombuffer(ids, "<u4").tolist() == tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert pstats.Stats(profile).total_calls < 12 * 20_000
