"""Each operator against brute force, and on nulls, empty and long texts, repeated rows and empty tables."""

import collections
import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.llm import bpe, chat, components, gam, graph_ann, kneser_ney, line_dedup, minhash, packing, quality_rules, text_cnn

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, grp string, key string"
LONG = "word another third, " * 20_000 + "end"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def odd(spark):
    texts = [
        (1, "One two three four five six\nOne two three four five six\nshort"), (2, None), (3, ""), (4, "  \n\t "), (5, LONG), (6, LONG),
        (7, "one two three four FIVE six\r\nother line with five words"), (8, "one two three four six\nsmall"), (9, "é中文 ß x <|endoftext|> it's"),
        (None, "no id here at all, none"), (1, "One two three four five six\nOne two three four five six\nshort"), (10, "one"), (11, "one"),
    ]
    return spark.createDataFrame([(i, t, "en" if i != 7 else None, "s", 1, 5, "g", "k") for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_components(spark):
    edges = [(9, 8), (8, 7), (3, 4), (3, 3), (4, 3), (5, None)] + [(100 + i, 101 + i) for i in range(30)]
    out = components.components(spark.createDataFrame(edges, "a long, b long"))
    want = {9: 7, 8: 7, 7: 7, 3: 3, 4: 3} | {100 + i: 100 for i in range(31)}
    assert {r.node: r.component for r in out.collect()} == want


def brute_components(texts, k):
    sets = {}
    for i, t in texts.items():
        w = words(low(t))
        sets[i] = set(zip(*(w[j:] for j in range(k)))) if len(w) >= k else ({tuple(w)} if w else set())
    name = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            old, new = sorted((name[a], name[b]), reverse=True)
            name = {i: new if c == old else c for i, c in name.items()}
    return {i: (len(sets[i]), name[i], name[i] == i) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, k):
    out = minhash.near_duplicates(docs, k=k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == brute_components({r.doc_id: r.text for r in docs.collect()}, k)


def test_near_duplicates_odd(spark, odd):
    out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd, k=2).collect()}
    assert out == brute_components({r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}, 2)
    assert minhash.near_duplicates(odd.limit(0)).collect() == []


def test_links_beyond_the_first_of_a_bucket(spark):
    """Many variants around one text, some only linked to others than their bucket's smallest id."""
    rng, base = np.random.default_rng(1), [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(150):
        own = list(base)
        for j in rng.choice(60, rng.integers(1, 7), replace=False):
            own[j] = f"v{rng.integers(40)}"
        texts[i] = " ".join(own)
    out = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), k=2).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: c for i, (_, c, _) in brute_components(texts, 2).items()}


def brute_lines(rows):
    earlier, kept = {}, {}
    for i, text in sorted(rows):
        out = []
        for line in text.split("\n"):
            w = tuple(words(low(line)))
            if w and (w in earlier or len(w) >= 5 and any(len(x) >= 5 and line_dedup.within_one_edit(list(w), list(x)) for x in earlier)):
                earlier.setdefault(w, i)
                continue
            if w:
                earlier[w] = i
            out.append(line)
        kept[i] = "\n".join(out)
    return kept


def test_line_dedup(spark, docs, odd):
    some = docs.limit(60).cache()
    want = brute_lines([(r.doc_id, r.text) for r in some.collect()])
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(some).collect()} == want
    out = line_dedup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "_n_lines", "_n_copies", "_n_near"] and out.count() == odd.count()
    got = {r.doc_id: r.text for r in out.where("doc_id is not null").collect()}
    want = brute_lines({(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None and r.text is not None}) | {2: None}
    assert got == want and got[8] == "small" and got[1] == "One two three four five six\nshort"
    assert line_dedup.dedup_lines(odd.limit(0)).collect() == []


def test_packing(spark, odd):
    args = public.path("byte_bpe_50k.tiktoken"), public.PATTERN
    tokenizer = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    pieces = packing.pack(odd, *args).collect()
    by_doc = collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append((p.start, np.frombuffer(p.ids, "<u2").tolist()))
    for r in odd.where("doc_id <> 1").collect():
        ids = [t for _, part in sorted(by_doc[r.doc_id]) for t in part]
        assert ids == tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
    places = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    assert places[0][:2] == (0, 0)
    assert all(b[:2] == ((a[0], a[1] + a[2]) if a[1] + a[2] < 1024 else (a[0] + 1, 0)) for a, b in zip(places, places[1:]))
    assert packing.pack(odd.limit(0), *args).collect() == []


def test_bpe(spark, odd):
    path = public.path("word_bpe_49k.json")
    tokenizer = tokenizers.Tokenizer.from_file(path)
    for r in bpe.encode(odd, path).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.encode(odd.limit(0), path).collect() == []
    v = bpe.Vocabulary(path)
    for text in ("\x1ca\x1f b", "ΑΣ ΣΑΣ", "é <|startoftext|>x", "</w> a</w>", "0123 l'été 'SHO", "a  b   c "):
        ids, decoded = next(iter(v.encode_texts([text])))
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and decoded == tokenizer.decode(want, skip_special_tokens=False)


def test_chat_layouts(spark):
    rows = [
        ('{"messages": [{"role": "user", "content": "a"}, {"content": null, "role": "assistant"}]}', "messages", [("user", "a"), ("assistant", "")]),
        ('{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}', "conversations", [("user", "q"), ("assistant", "r")]),
        ('{"instruction": "do", "input": "this", "output": "done"}', "instruction with input", [("user", "do\n\nthis"), ("assistant", "done")]),
        ('{"prompt": "p", "completion": "c"}', "prompt", [("user", "p"), ("assistant", "c")]),
        ('{"system": "", "prompt": "p", "response": "c"}', "system", [("user", "p"), ("assistant", "c")]),
        ('{"messages": []}', "no messages", []), ('{"what": 1}', None, None), ("3", None, None), (None, None, None),
    ]
    records = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "k long, j string").select("k", F.parse_json("j").alias("record"))
    for r in chat.canonical(records).drop("record").collect():
        assert (r.layout, None if r.turns is None else [tuple(t) for t in r.turns]) == rows[r.k][1:]
    written = {r.k: r for r in chat.formatted(chat.canonical(records), "k").collect()}
    assert len(written) == len(rows) and written[5].formatted == "" and written[8].loss == []


def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", "####\\#\\/</turn></turn>\n", "", None, "é😀 <\\/turn> # ## \\", "a: b\n### x: y</turn>\n"]
    rows = [(1, i, r, t, 0) for i, t in enumerate(texts) for r in ("user", "assistant")] + [(None, 0, None, "x", 0), (2, None, "a: b/+", "t", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record long")
    out = {r.conv_id: r for r in chat.digests(chat.formatted(chat.canonical(chat.from_rows(df)), "conv_id")).collect()}
    for key in (1, 2, None):
        own = sorted([(-1 if t is None else t, r or "", x or "") for c, t, r, x, _ in rows if c == key])
        spoken, learnt = "".join(f"{r}\n{x}\n" for _, r, x in own), "".join(x for _, r, x in own if r == "assistant")
        got = out[key]
        assert got.n_turns == len(own) and got.turns_sha256 == hashlib.sha256(spoken.encode()).hexdigest()
        assert got.loss_chars == len(learnt) and got.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    assert chat.digests(chat.formatted(chat.canonical(chat.from_rows(df.limit(0))), "conv_id")).collect() == []


def test_language_model(spark, docs, odd):
    texts = [r.text for r in docs.limit(40).collect()]
    tokens = [[*words(low(t)), 1] for t in texts]
    model = kneser_ney.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    c, pairs = collections.Counter(x for w in tokens for x in w), collections.Counter(p for w in tokens for p in zip([0, *w[:-1]], w))
    types = collections.Counter(x for _, x in pairs)
    d = lambda counts: kneser_ney._discounts({i: sum(v == i for v in counts.values()) for i in range(1, 5)})
    d1, d2, cut = d(types), d(pairs), lambda n, e: e[min(n, 3) - 1]
    total = sum(types.values())
    unknown = sum(cut(n, d1) for n in types.values()) / total / (len(c) + 1)
    begun, kept = collections.Counter(), collections.Counter()
    for (h, _), n in pairs.items():
        begun[h] += n
        kept[h] += n - cut(n, d2) if n > 1 else 0

    def chance(h, x):
        n = pairs[h, x]
        low_order = (types[x] - cut(types[x], d1)) / total + unknown if x in types else unknown
        return ((n - cut(n, d2)) / begun[h] if n > 1 else 0) + (1 - kept[h] / begun[h] if h in begun else 1) * low_order

    n, v = sum(c.values()), len(c)
    for r in kneser_ney.score(odd, model).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        own = [*words(low(r.text)), 1]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(c[x] > 0 for x in own), n)
        assert np.isclose(r.base_score, sum(np.log10((c[x] + 1) / (n + v + 1)) for x in own))
        assert np.isclose(r.score, sum(np.log10(chance(*p)) for p in zip([0, *own[:-1]], own)))
    assert np.isclose(sum(chance("the", x) for x in c) + chance("the", "?"), 1)
    empty = kneser_ney.fit(odd.limit(0).select("text"))
    assert all(r.score == 0 for r in kneser_ney.score(odd, empty).collect())
    assert kneser_ney.score(odd.limit(0), model).collect() == []


def test_graph_search(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = vectors.collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    hits = total = 0
    found = collections.defaultdict(list)
    for r in graph_ann.nearest(vectors, vectors.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    for q in ids[ids % 20 == 0]:
        far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        far[ids == q] = np.inf
        order = np.lexsort((ids, far))[:10]
        hits += len({*ids[order]} & {i for i, _ in found[q]})
        total += 10
        assert all(np.isclose(s, far[ids == i][0]) for i, s in found[q])
    assert hits >= 0.9 * total


def test_graph_search_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(30)] + [(40, [1.0, 3.0]), (41, None), (42, [0.0, 0.0]), (43, [nan, 1.0]), (44, [1.0, inf]), (45, [None, 1.0]), (40, [1.0, 3.0]), (None, [1.0, 1.0]), (46, [1.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, ids long")
    out = graph_ann.nearest(df, df.where("vec_id in (5, 40, 41, 46)")).orderBy("query_id", "rank").collect()
    assert [(r.vec_id, r.score) for r in out if r.query_id == 5] == [(i, 0.0) for i in (0, 1, 2, 3, 4, 6, 7, 8, 9, 10)]
    assert [(r.vec_id, r.score) for r in out if r.query_id == 40] == [(i, 1.0) for i in range(10)]
    assert {r.query_id for r in out} == {5, 40}
    assert graph_ann.nearest(df.limit(0), df.limit(0)).collect() == []


def test_graph_search_ties_and_clusters(spark):
    """Thirty vectors at one distance: the smallest ids win. Tight clusters: recall of at least 0.9."""
    rows = [(99, [0.0] * 32 + [1.0])] + [(int(i), [3.0 * (j == n) for j in range(32)] + [1.0]) for n, i in enumerate(np.random.default_rng(6).permutation(30))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = graph_ann.nearest(df, df.where("vec_id = 99")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in out] == [(i, 3.0) for i in range(10)]
    rng = np.random.default_rng(9)
    x = (rng.normal(0, 1, (25, 1, 16)) + rng.normal(0, 0.02, (25, 100, 16))).reshape(-1, 16).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    for r in graph_ann.nearest(df, df.where("vec_id % 25 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, len(x), 25):
        far = ((x.astype(float) - x[q]) ** 2).sum(1)
        far[q] = np.inf
        hits += len(set(np.argsort(far)[:10].tolist()) & got[q])
    assert hits >= 0.9 * len(x) / 25 * 10


@pytest.mark.parametrize(("classify", "label"), [(gam.classify, "quality"), (text_cnn.classify, "toxic")])
def test_classifiers(spark, odd, classify, label):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scored = classify(docs, labels, F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    rows = scored.join(labels, "doc_id").where(held).collect()
    good, bad = ([r.score for r in rows if r[label] == y] for y in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.93
    out = classify(odd, labels.where("doc_id < 0"), F.lit(True)).collect()
    assert len(out) == odd.count() and all(abs(r.score - 0.5) < 1e-9 for r in out)
    assert all(0 <= r.score <= 1 for r in classify(odd, spark.createDataFrame([(1, 1, 1), (5, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int"), F.lit(True)).collect())
    assert classify(odd.limit(0), labels, F.lit(True)).collect() == []


def test_quality_rules(spark, odd, docs):
    rows = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for r in docs.collect():
        w, text = words(r.text), r.text
        count, covered, seen, again = collections.Counter(zip(w, w[1:], w[2:])), set(), set(), 0
        for i in range(len(w) - 2):
            if count[tuple(w[i : i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        for line in text.split("\n"):
            if words(line):
                again += line in seen
                seen.add(line)
        got = rows[r.doc_id]
        assert (got.n_words, got.word_chars, got.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (got.n_dup_lines, got.n_repeat_words) == (again, len(covered))
        assert got.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (got.base_failed and got.kept)
    out = quality_rules.judge(odd)
    assert out.count() == odd.count() and {r.n_words for r in out.where("doc_id in (2, 3, 4)").collect()} == {0}
    assert quality_rules.judge(odd.limit(0)).collect() == []


def test_outliers_of_a_group(spark):
    """Texts full of symbols among ordinary ones are rejected, also where a third of all rows share one group."""
    plain = [(i, " ".join(f"word{(i * 7 + j) % 900}" for j in range(60 + i % 200)), "en", f"s{i % 3}") for i in range(900)]
    odd = [(1000 + i, " ".join(f"w{i * j % 999}$$$$" for j in range(80)), "en", "s1") for i in range(9)]
    out = quality_rules.judge(spark.createDataFrame(plain + odd, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in out if not r.kept} == {1000 + i for i in range(9)}


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    assert [s[0] for s in corpus_pipeline.STAGES][2] == "line_dedup"
