"""The prefix trie, whitening and source mixing against brute force, and on odd rows."""

import collections
import hashlib
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.llm import mixing, prefix_trie, queries, whitening

SF = "/root/testdata/sf0.001"


def sequences(rows):
    """Rebuilt conversations: first h turns of c - c % 5, then the own ones after h."""
    own = collections.defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        if c is not None:
            own[c].append((role or "", text or ""))
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    return out


def brute_trie(convs):
    members, children = collections.defaultdict(list), collections.defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[x] for x in children[node])
    out = set()
    for node, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if convs[c] == node)))
        out.add((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_rows(spark, rows, block, parts=3):
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, depth long").repartition(parts)
    got = [tuple(r) for r in prefix_trie.conversation_trie(df, block=block).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("block", [1, 400, 8 << 20])
def test_trie(spark, block):
    rng = np.random.default_rng(block)
    rows = []
    for c in range(400):
        same = c % 3 == 0  # a third of all conversations are copies of one
        for t in range(3 if same else rng.integers(0, 12)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "é" * t if same else f"t{rng.integers(3)}"))
    rows += [(1000, t, "user", f"long {t}") for t in range(300)] + [(1001, t, "user", f"long {t}") for t in range(250)]
    assert trie_rows(spark, rows, block) == brute_trie(sequences(rows))


def test_trie_odd(spark):
    rows = [(5, None, None, None), (5, 0, "user", ""), (5, 0, "user", ""), (6, 1, "a", "bc"), (7, 1, "ab", "c"), (None, 0, "user", "x"), (-7, 0, "u", "😀"), (-7, -3, "u", "first")]
    rows += [(8, 2, "u", "x" * 200_000), (11, 3, "u", None), (11, 3, None, "u"), (12, 1, "1:", "2"), (12, 0, None, None)]
    for block in (1, 8 << 20):
        got = trie_rows(spark, rows, block)
        # A negative id has its remainder's sign in SQL: -7 - (-2) = -5 does not occur here.
        convs = sequences([r for r in rows if r[0] != -7])
        own = [("u", "first"), ("u", "😀")]
        convs[-7] = tuple(own[zlib.crc32(b"-7") % 9 :])
        assert got == brute_trie(convs)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.conversation_trie(empty).collect() == []


def test_registered_trie(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert {tuple(r) for r in queries.op11_prefix_trie(spark, SF).collect()} == brute_trie(sequences(rows))


def test_radix_tree_layouts():
    """Fan-outs through all four layouts, keys that are prefixes of others, and keys in any order."""
    keys = [bytes([b]) + bytes([a]) * n for b in range(256) for a, n in ((1, 0), (1, 3), (2, 3))] + [b""]
    tree = prefix_trie.RadixTree()
    for i in np.random.default_rng(3).permutation(len(keys)):
        tree.insert(keys[i], int(i))
    assert tree.root.size == 256
    found, stack = {}, [(tree.root, b"")]
    while stack:
        node, above = stack.pop()
        here = above + node.path
        if node.entry >= 0:
            found[here] = node.entry
        if isinstance(node, prefix_trie._Inner):
            assert len(node.each()) + (node.entry >= 0) > 1
            stack += [(child, here) for child in node.each()]
    assert found == {k: i for i, k in enumerate(keys)}
    node = prefix_trie._Inner(b"")
    for n, byte in enumerate(np.random.default_rng(5).permutation(256), 1):
        node.put(int(byte), prefix_trie._Leaf(bytes([byte]), n))
        assert node.size == min(s for s in (4, 16, 48, 256) if s >= n) and [c.path for c in node.each()] == sorted(c.path for c in node.each())
        assert node.get(int(byte)).entry == n


@pytest.mark.parametrize("high", [1, 2, 100, 2**40, 2**61])
def test_cross_products(high):
    rng = np.random.default_rng(high % 97)
    for n in (1, 63, 64, 65, 500):
        x = rng.integers(-high, high, (n, 5))
        x[:, 3] = 7
        x[:, 4] = x[:, 0]
        sums, product = whitening.cross_products(x)
        exact = x.astype(object)
        assert (sums == exact.sum(0)).all() and (product == exact.T @ exact).all()
    x = np.array([[-(2**63)], [2**63 - 1], [5]])
    sums, product = whitening.cross_products(x)
    assert sums[0] == 4 and product[0, 0] == 2**126 + (2**63 - 1) ** 2 + 25


def brute_whitening(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(0)
    cov = np.cov((x - x[0]).T.astype(float), bias=True)
    values, axes = np.linalg.eigh(np.atleast_2d(cov))
    return n, x, total, values[::-1], axes[:, ::-1]


def test_whitening_registered(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    n, x, total, values, axes = brute_whitening(list(rows.values()))
    at = {v: i for i, v in enumerate(rows)}
    exact = ((n * x - total) ** 2).sum(1)
    out = queries.op12_whitening(spark, SF).collect()
    assert len(out) == 32 * n
    table = np.zeros((n, 32))
    for r in out:
        assert r.n == n and r.deviation == exact[at[r.vec_id]] and r.identity_error < 1e-9
        assert np.isclose(r.explained, values[r.component - 1] / values.sum(), rtol=1e-9)
        table[at[r.vec_id], r.component - 1] = r.whitened
    want = (x - total / n) @ axes[:, :32] / np.sqrt(values[:32])
    sign = np.sign((table * want).sum(0))
    assert np.allclose(table * sign, want, atol=1e-8)
    assert np.allclose(np.cov(table.T, bias=True), np.eye(32), atol=1e-9)


def test_whitening_odd(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (101, [nan, 1.0, 2.0]), (102, [inf, 1.0, 2.0]), (103, [None, 1.0, 2.0]), (104, [])]
    rng = np.random.default_rng(2)
    good = [(i, [float(a), float(b), 3.0]) for i, (a, b) in enumerate(rng.normal(0, 50, (40, 2)))] + [(None, [1.0, 2.0, 3.0]), (0, [9.0, 9.0, 3.0])]
    other = [(200, [5.0]), (201, [5.0])]
    huge = [(300, [1e300, 0.0]), (301, [-1e300, 1.0]), (302, [0.0, 5.0])]
    df = spark.createDataFrame([(*r, 0, 0.5) for r in bad + good + other + huge], "vec_id long, embedding array<double>, n long, whitened double").repartition(4)
    models = whitening.fit(df)
    assert sorted(models) == [1, 2, 3]
    out = whitening.whiten(df, models).collect()
    n, x, total, values, axes = brute_whitening([v for _, v in good])
    three = [r for r in out if len(r.whitened) == 3]
    assert sorted((r.id is None, r.id or 0) for r in three) == sorted((i is None, i or 0) for i, _ in good)
    assert sorted(r.deviation for r in three) == sorted(((n * x - total) ** 2).sum(1)) and all(r.whitened[2] is None and r.explained[2] == 0 for r in three)
    assert all(r.identity_error < 1e-9 for r in three)
    one = [r for r in out if r.id in (200, 201)]
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(2, 0, [None], [None], None)] * 2
    assert all(r.deviation is None and r.n == 3 for r in out if r.id in (300, 301))
    assert whitening.fit(df.limit(0)) == {} and whitening.whiten(df, {}).collect() == []


def test_blocks_are_bounded_and_whole(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(whitening, "BLOCK_WORDS", 64)
    rng = np.random.default_rng(0)
    lists = [rng.normal(0, 1, d).tolist() for d in rng.integers(1, 4, 1000)]
    batches = [
        pa.RecordBatch.from_arrays([pa.array([len(v) for v in part], pa.int32()), pa.array(part, pa.list_(pa.float64()))], ["dim", "vector"])
        for part in (lists[:10], lists[10:900], lists[900:])
    ]
    seen = collections.Counter()
    for dim, x in whitening._blocks(iter(batches)):
        assert x.shape[1] == dim and len(x) < 2 * max(64, 8 // dim * 64)
        seen.update((dim, *row) for row in x.tolist())
    assert seen == collections.Counter((len(v), *(int(np.floor(64 * c)) + 1_000_000 for c in v)) for v in lists)


def brute_targets(sizes):
    """Water filling by rounds of proportional shares."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    words, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = words - sum(2 * sizes[s] for s in capped)
        target = {s: 2 * sizes[s] if s in capped else left * weight[s] / sum(weight[f] for f in free) for s in order}
        above = {s for s in free if target[s] > 2 * sizes[s]}
        if not above:
            return target
        capped |= above


def test_mixing(spark):
    rng = np.random.default_rng(4)
    names = ["a", "b", "é", "Z", None, "😀", "￿", "empty"]
    rows = []
    for i in range(3000):
        s = names[0] if i % 3 == 0 else names[rng.integers(1, 7)]  # one source holds over a third
        rows.append((i, "w " * int(rng.integers(0, 60)), s))
    rows += [(5000, None, "empty"), (5001, " \n", "empty"), (None, "one two", "a"), (8000, "again", "b"), (8000, "again", "b"), (6000, "long " * 50_000, "Z")]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, rank long, words double").repartition(5)
    out = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(2)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again)) and len(out) == len(rows)
    size = collections.Counter()
    for _, text, s in rows:
        size[s] += len((text or "").split())
    want = brute_targets(size)
    taken, source = collections.Counter(), {i: s for i, _, s in rows}
    cut = collections.Counter()
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == size[s] and np.isclose(r.target, want[s], rtol=1e-12) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
        cut[s] += r.size > 0 and r.taken % r.size != 0
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in size) and max(cut.values()) <= 1
    assert mixing.mix(df.limit(0)).collect() == []
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix(df.where("source = 'empty'")).collect())


def test_buckets_take_the_seeded_order(spark, monkeypatch):
    """Small buckets choose the same documents as one sorted list of the source."""
    monkeypatch.setattr(mixing, "BUCKET", 7)
    rows = [(i, f"x{i} " * (i % 13), "ab"[i % 2]) for i in range(500)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    got = {r.doc_id: r.taken for r in out}
    for s in "ab":
        own = sorted((hashlib.md5(f"13:{i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest(), i, len(t.split())) for i, t, x in rows if x == s)
        mass, take = sum(o[2] for o in own), int(np.floor([r.target for r in out if r.doc_id == own[0][1]][0] + 0.5))
        left = take % mass
        for _, i, n in own:
            assert got[i] == n * (take // mass) + min(n, left)
            left -= min(n, left)


def test_overlapping_sources(spark):
    """Documents of two sources go where words are missing; copies are a last resort."""
    rows = [(0, "w " * 100, ["a"]), (1, "w " * 100, ["a", "b"]), (2, "w " * 40, ["b", "c", "c"]), (3, "w " * 10, []), (4, "w " * 10, None), (5, "w " * 30, ["d", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    out = {r.doc_id: r for r in mixing.mix(df, weights=(1.0,), share=1.0).collect()}
    assert out[2].source_size == [140, 40] and out[5].source_size == [30, 30] and out[3].target == [] and out[3].taken == out[4].taken == 0
    patterns = df.where("size(source) > 0").select(F.array_sort(F.array_distinct("source")).alias("members"), mixing.word_count(F.col("text")).alias("mass"))
    wanted = mixing.targets(patterns.withColumn("n", F.lit(1)), (1.0,), 1.0)
    sent = collections.Counter()
    for r in mixing.flows(patterns, wanted).collect():
        sent[r.source] += r.words
    assert all(sent[r.source] <= round(r.target) for r in wanted.collect())


def test_cheapest_flow():
    """Against all whole-number flows of small cases: largest amount first, then least cost (copy k costs k)."""
    rng = np.random.default_rng(8)
    for _ in range(40):
        masses = rng.integers(0, 3, 3).tolist()
        members = [sorted(rng.choice(3, rng.integers(1, 3), replace=False).tolist()) for _ in masses]
        quotas = {s: int(rng.integers(0, 4)) for s in range(3)}
        sent = mixing.cheapest_flow(masses, members, quotas, 2)
        arcs = list(sent)
        best = None
        for flow in itertools.product(*(range(min(2 * masses[i], quotas[s]) + 1) for i, s in arcs)):
            out, into = collections.Counter(), collections.Counter()
            for (i, s), v in zip(arcs, flow):
                out[i] += v
                into[s] += v
            if all(out[i] <= 2 * m for i, m in enumerate(masses)) and all(into[s] <= q for s, q in quotas.items()):
                score = (-sum(flow), sum(v + max(0, v - masses[i]) for i, v in out.items()))
                best = score if best is None else min(best, score)
        out = collections.Counter()
        for (i, _), v in sent.items():
            out[i] += v
        assert (-sum(sent.values()), sum(v + max(0, v - masses[i]) for i, v in out.items())) == best
        assert all(v >= 0 for v in sent.values())


def test_near_duplicates_of_repeated_ids_and_mixed_sizes(spark):
    """Of rows that repeat an id the largest set counts; buckets of very different sizes lose no link."""
    from claimweave.llm import minhash

    rng = np.random.default_rng(17)
    base = [f"w{i}" for i in range(400)]
    texts = {}
    for i in range(120):
        n = int(rng.choice([20, 60, 200, 400]))
        own = list(base[:n])
        for j in rng.choice(n, max(1, n // 60), replace=False):
            own[j] = f"v{rng.integers(50)}"
        texts[i] = " ".join(own)
    rows = list(texts.items()) + [(i, "tiny text") for i in range(0, 120, 3)]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k=2).collect()}
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in texts.items()}
    name = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            old, new = max(name[a], name[b]), min(name[a], name[b])
            name = {i: new if c == old else c for i, c in name.items()}
    assert out == {i: (len(sets[i]), name[i]) for i in sets}
