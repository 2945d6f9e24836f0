"""Each stage of the pipeline against what a plain computation keeps of the rows that the stage before it kept."""

import collections
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from claimweave.llm import gam, quality_rules

from test_llm_operators import SF, brute_components, brute_lines, tokenizers, public, words


def shuffled(text, seed):
    """The same words in another order: as ordinary as the text, but no copy of it."""
    w = words(text)
    random.Random(seed).shuffle(w)
    return " ".join(w)


def content(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


@pytest.fixture(scope="module")
def chain(spark):
    """The rows given, then those after each stage."""
    given = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND toxic = 0")
    like = given.where("n_chars > 900").join(good, "doc_id", "left_semi").orderBy("doc_id").first()
    extra = [
        (None, shuffled(like.text, 1), like.lang, like.source, 1),  # clean, without an id
        (900001, "too short", like.lang, like.source, 9),  # goes, and must not take the next along
        (900001, shuffled(like.text, 2), like.lang, like.source, 1),
        (900002, None, None, None, None), (900003, "", like.lang, like.source, 0),
        (900004, like.text + " more", like.lang, like.source, 1),  # a near copy
    ]
    out = [given.union(spark.createDataFrame(extra, given.schema))]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_quality_rules_stage(spark, chain):
    """Every row is kept or goes by its own text, whatever its id."""
    rows = chain[0].collect()
    numbered = spark.createDataFrame([(n, r.text, r.lang, r.source) for n, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality_rules.judge(numbered).where("kept").collect()}
    assert content(chain[1]) == collections.Counter((r.doc_id, r.text) for n, r in enumerate(rows) if n in kept)
    assert all(len(words(r.text)) >= 50 for r in chain[1].collect())
    texts = {r.doc_id: r.text for r in chain[1].collect()}
    assert None in texts and len(words(texts[900001])) > 50 and not {900002, 900003} & set(texts)
    assert chain[1].columns == corpus_pipeline.COLUMNS


def test_classifier_stage(spark, chain):
    """Scores of a model fitted in one process on the labelled rows that the stage before kept."""
    table = gam.ratios(chain[1].selectExpr("doc_id", "text", "struct(doc_id, text) AS key"), "key", "text").toPandas()
    ids, texts = [k["doc_id"] for k in table["id"]], [k["text"] for k in table["id"]]
    labels = {r.doc_id: float(r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None}
    learn = sorted((i, n) for n, i in enumerate(ids) if i in labels and zlib.crc32(str(i).encode()) % 5 != 0)
    x = table[list(gam.RATIOS)].to_numpy(float)
    model = gam.fit(x[[n for _, n in learn]], np.array([labels[i] for i, _ in learn]))
    want = collections.Counter((i, t) for i, t, s in zip(ids, texts, model.scores(x)) if s >= 0.3)
    assert content(chain[2]) == want and chain[2].columns == corpus_pipeline.COLUMNS


def test_line_stage(chain):
    rows = [(r.doc_id, r.text) for r in chain[2].collect()]
    kept = brute_lines([r for r in rows if r[0] is not None])
    want = {i: kept[i] for i, t in rows if i is not None and (kept[i] == t or words(kept[i]))}
    assert content(chain[3]) == collections.Counter([*want.items(), *(r for r in rows if r[0] is None)])


def test_near_duplicate_stage(chain):
    rows = [(r.doc_id, r.text) for r in chain[3].collect()]
    found = brute_components({i: t for i, t in rows if i is not None}, 5)
    assert content(chain[4]) == collections.Counter(r for r in rows if r[0] is None or found[r[0]][2])


def test_packing_stage(chain):
    tokenizer = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in chain[4].collect()}
    got = collections.Counter()
    for r in chain[5].collect():
        got[r.doc_id] += r.length
    assert dict(got) == want


def test_stages_of_an_empty_table(spark, chain):
    docs = chain[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
