"""Near-duplicate documents by tensored MinHash tables.

A document's set holds its distinct shingles of k words. Two collections of m keys each (every key joins r
minhashes) are computed; a table exists for each *pair* of keys, one from either collection. That gives m * m
tables of 2r minhashes for the price of 2 * m * r minhashes instead of 2 * m * m * r.

Equal sets form one class before anything else, so copies of a text cost one row. In a table's bucket every
member is linked to the bucket's smallest id over a tree: first within a task, then among the tasks' smallest.
Of each member's tree edges the one that most tables hold is verified first, then all others between members that are still
apart, on full sets where sizes and bitmaps of the sets do not rule a link out. Where a bucket of three or more still spans
several components, its members are compared by an exact prefix filter whose join itself refuses pairs by sizes, places and
bitmaps, so that the result has every link its tables can see. A pair of
similarity s is missed with probability 1 - (1 - (1 - s^r)^m)^2; with m = 10, r = 2 that is 7e-5 at s = 0.8 and 1e-6 at s = 0.87.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.components import components
from claimweave.llm.stages import perhaps_among, small_batches, staged
from claimweave.llm.words import BASE, distinct_sets, mix, shingles, slices, stream, words_of

KEYS = 10
ROWS = 2
COMBINE_KEYS = 1 << 21
SKETCH_BITS = 16  # cells of the counts that order shingles from rare to frequent; any order is exact
WORDS = 16  # of 64 bits in the bitmaps that the prefix join compares
FILTER_BITS = 26  # of the filter (8 MB) for keys whose buckets are compared again; what it lets through is tested exactly
_U = np.uint64


def _sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    words = words_of(batch.column("text"))
    doc, values = shingles(words, words.hashes(), k)
    return distinct_sets(doc, values, batch.num_rows)


def _signatures(k: int, m: int, r: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = stream(2 * m * r, 11) | _U(1)
        shifts = stream(2 * m * r, 12)
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                flat, at = _sets(part, k)
                size = np.diff(at)
                full = np.flatnonzero(size)
                keys = np.zeros((2 * m, n), _U)
                one, two = np.zeros(n, _U), np.zeros(n, _U)
                if len(full):
                    first = at[:-1][full]
                    one[full], two[full] = _names(flat, first)
                    for f in range(2 * m * r):
                        least = np.minimum.reduceat((flat ^ shifts[f]) * factors[f], first)
                        keys[f // r, full] = mix(keys[f // r, full] * BASE + least + _U(f))
                arrays = pa.FixedSizeListArray.from_arrays(pa.array(keys.T.ravel().view(np.int64)), 2 * m).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), arrays],
                    ["id", "n_shingles", "set_a", "set_b", "keys"],
                )

    return run


def signatures(docs: DataFrame, k: int, m: int = KEYS, r: int = ROWS) -> DataFrame:
    """(id, n_shingles, set_a, set_b, keys) of ``docs(id, text)``; set_a and set_b name the set in 128 bits."""
    return docs.mapInArrow(_signatures(k, m, r), "id long, n_shingles long, set_a long, set_b long, keys array<long>")


def _largest(sig: DataFrame) -> DataFrame:
    """One row per id: that of the largest set (ties by the set's name)."""
    row = F.struct("n_shingles", "set_a", "set_b", "keys")
    return sig.groupBy("id").agg(F.max(row).alias("row")).select("id", "row.*")


def _table_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Table keys and ids of a batch of class representatives, m * m for each."""
    ids = batch.column("id").to_numpy()
    keys = batch.column("keys").flatten().to_numpy().view(_U).reshape(len(ids), -1)
    m = keys.shape[1] // 2
    tables = keys[:, :m, None] * BASE + mix(keys[:, None, m:]) + np.arange(m * m, dtype=_U).reshape(1, m, m)
    return mix(tables).reshape(-1).view(np.int64), np.repeat(ids, m * m)


def _tree(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Groups of equal keys: (keys, smallest ids) and the edges (keys, ids, smallest ids) below them."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    least = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
    rest = ids != least
    return keys[new], ids[new], keys[rest], ids[rest], least[rest]


def _rows(key, x, y) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(x), pa.array(y)], ["key", "x", "y"])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, id) for a key's smallest id in this task's rows, (key, id, smallest) for the others."""

    def flush(held):
        keys, ids, below, x, y = _tree(*map(np.concatenate, zip(*held)))
        yield _rows(keys, ids, ids)
        yield _rows(below, x, y)

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(_table_keys(batch))
            size += len(held[-1][0])
        if size >= COMBINE_KEYS:
            yield from flush(held)
            held, size = [], 0
    if held:
        yield from flush(held)


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and id; the first row of a key with x = y is its smallest id, whom later ones join."""
    last_key, last_id = None, None
    for batch in batches:
        key, x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "x", "y"))
        done = x != y
        yield _rows(key[done], x[done], y[done])
        key, x = key[~done], x[~done]
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        new[0] = last_key is None or key[0] != last_key
        heads = np.where(new, x, 0)
        if not new[0]:
            heads[0] = last_id
        place = np.maximum.accumulate(np.where(new | (np.arange(len(key)) == 0), np.arange(len(key)), 0))
        least = heads[place]
        last_key, last_id = key[-1], least[-1]
        rest = x != least
        yield _rows(key[rest], x[rest], least[rest])


def _names(flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set of shingles, whatever their order."""
    return np.add.reduceat(mix(flat), first), np.add.reduceat(mix(flat ^ BASE), first)


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                flat, at = _sets(part, k)
                full = np.flatnonzero(np.diff(at))
                if len(full):
                    one, two = _names(flat, at[:-1][full])
                    blobs = [flat[a:b].tobytes() for a, b in zip(at[:-1][full], at[1:][full])]
                    bits = [_bitmap(flat[a:b]) for a, b in zip(at[:-1][full], at[1:][full])]
                    columns = [part.column("id").take(pa.array(full)), pa.array(blobs, pa.binary()), pa.array(bits, pa.binary())]
                    columns += [pa.array(c) for c in (np.diff(at)[full], one.view(np.int64), two.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "set", "bits", "n", "set_a", "set_b"])

    return run


def _bitmap(shingles_: np.ndarray) -> bytes:
    """Bits of a set, 4 to 8 for each shingle; a width is a power of two, so wide ones fold onto narrow ones."""
    width = max(64, 1 << ((8 * len(shingles_)).bit_length() - 1))
    on = np.zeros(width, bool)
    on[(mix(shingles_) & _U(width - 1)).astype(np.int64)] = True
    return np.packbits(on, bitorder="little").tobytes()


def _possible(percent: int):
    """Pairs that their bitmaps do not refuse.

    A set's shingles in common have common bits, and each bit stands for one shingle but for at most as many more as the set
    has shingles beyond its bits; so common bits and that excess bound the common shingles from above.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, a, b in zip(*(batch.column(c).to_pylist() for c in ("n_x", "n_y", "bits_x", "bits_y"))):
                a, b = np.frombuffer(a, _U), np.frombuffer(b, _U)
                narrow = min(len(a), len(b))
                a, b = (np.bitwise_or.reduce(v.reshape(-1, narrow), 0) for v in (a, b))
                both, one, two = (int(np.bitwise_count(v).sum()) for v in (a & b, a, b))
                common = both + min(n - one, m - two)
                keep.append(100 * common >= percent * (n + m - common))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], ["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_x"), batch.column("set_y")):
                a, b = np.frombuffer(a.as_py(), _U), np.frombuffer(b.as_py(), _U)
                small, large = min(len(a), len(b)), max(len(a), len(b))
                if 100 * small < percent * large:
                    keep.append(False)
                    continue
                both = np.concatenate([a, b])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(keep, pa.bool_())], ["x", "y", "linked"])

    return run


def _sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, set, bits, n) for the documents named by ``ids(id)``; of rows that repeat an id, the one ``_largest`` takes.

    Texts are not shuffled: a filter of fixed size drops most other rows at the scan, and only the sets of what is left
    are joined with the ids.
    """
    ids = ids.distinct()
    near = perhaps_among(docs.select("id", "text"), ids)
    sets = near.mapInArrow(_set_rows(k), "id long, set binary, bits binary, n long, set_a long, set_b long").join(ids, "id", "left_semi")
    row = F.max_by(F.struct("set", "bits", "n"), F.struct("n", "set_a", "set_b"))
    return staged(sets.groupBy("id").agg(row.alias("row")).select("id", "row.*"), "sets")


def _sets_of_pairs(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    return _sets_of(docs, pairs.select(F.col("x").alias("id")).union(pairs.select("y")), k)


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of distinct ``pairs(x, y)`` of ids that are linked: bitmaps refuse most of the others, full sets decide."""
    side = lambda c, what: sets.select(F.col("id").alias(c), *(F.col(w).alias(f"{w}_{c}") for w in what))
    rough = pairs.join(side("x", ("n", "bits")), "x").join(side("y", ("n", "bits")), "y").where(_like_size("n_x", "n_y", percent))
    rough = rough.mapInArrow(_possible(percent), "x long, y long")
    rows = rough.join(side("x", ("set",)), "x").join(side("y", ("set",)), "y")
    linked = rows.select("x", "y", "set_x", "set_y").mapInArrow(_confirm(percent), "x long, y long, linked boolean")
    return staged(linked.where("linked").select("x", "y"), "links")


def _across(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """``pairs(x, y)`` between different components."""
    left, right = (named.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in ("x", "y"))
    both = pairs.join(left, "x", "left").join(right, "y", "left")
    return both.where("coalesce(cx, x) <> coalesce(cy, y)").select("x", "y")


def _tree_links(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links that join all whom linked ``pairs(x, y, tables)`` join.

    A member of a large group has an edge to the smallest id of every bucket it lies in. The one that most tables hold is
    nearly always a link and joins it to the group, so that few of the others are left to look at.
    """
    sets = _sets_of_pairs(docs, pairs, k)
    first = staged(pairs.groupBy("x").agg(F.max_by("y", F.struct("tables", -F.col("y"))).alias("y")), "first")
    linked = _verified(sets, first, percent)
    rest = staged(_across(pairs.select("x", "y").join(first, ["x", "y"], "left_anti"), components(linked)), "rest")
    return linked if rest.isEmpty() else linked.union(_verified(sets, rest, percent))


def _like_size(x: str, y: str, percent: int) -> str:
    """SQL text: sets of these sizes can be linked at all."""
    return f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})"


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bit = batch.column("key").to_numpy().view(_U) >> _U(64 - FILTER_BITS)
        cells, which = np.unique(bit >> _U(6), return_inverse=True)
        value = np.zeros(len(cells), _U)
        np.bitwise_or.at(value, which, _U(1) << (bit & _U(63)))
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(value.view(np.int64))], ["cell", "bits"])


def _key_filter(keys: DataFrame):
    """Broadcast bits of the keys, of one size whatever their number."""
    cells = keys.mapInArrow(_bits, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(bits.tobytes())


def _exploded(shared):
    """(key, id, n, c) for the keys of class representatives that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, _U)
        for batch in batches:
            if batch.num_rows:
                keys, ids = _table_keys(batch)
                size, group = (np.repeat(batch.column(c).to_numpy(), len(ids) // batch.num_rows) for c in ("n_shingles", "c"))
                bit = keys.view(_U) >> _U(64 - FILTER_BITS)
                on = np.flatnonzero((bits[bit >> _U(6)] >> (bit & _U(63))) & _U(1))
                yield pa.RecordBatch.from_arrays([pa.array(keys[on]), pa.array(ids[on]), pa.array(size[on]), pa.array(group[on])], ["key", "id", "n", "c"])

    return run


def _by_size(members: DataFrame, percent: int) -> DataFrame:
    """Members under (key, group of sizes): sets that can be linked lie in one size band or in neighbouring ones, and
    each group holds a band and the next."""
    band = F.floor(F.ln("n") / float(np.log(100 / percent) + 1e-9)).cast("long")
    group = F.explode(F.array(band, band + 1)).alias("g")
    return members.select("key", "id", "n", "c", group).select(F.xxhash64("key", "g").alias("key"), "id", "n", "c")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, n): how often shingles of each cell occur in this task's sets, for cells well above the mean."""
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        for blob in batch.column("set"):
            total += np.bincount((np.frombuffer(blob.as_py(), _U) >> _U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
    cells = np.flatnonzero(total > 4 * total.mean())
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])


def _prefixes(often: np.ndarray, percent: int):
    """(t, id, c, n, p, more, b0, ..): the p-th rarest shingles t of each set, as far as a link's rarest common one can lie.

    b0, .. are a bitmap of the whole set, ``more`` is how many more shingles than bits it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, maps = [], np.zeros((batch.num_rows, 64 * WORDS), bool)
            for row, blob in enumerate(batch.column("set")):
                t = np.frombuffer(blob.as_py(), _U)
                maps[row, (mix(t) & _U(64 * WORDS - 1)).astype(np.int64)] = True
                keep = len(t) - -(-percent * len(t) // 100) + 1
                cell = often[(t >> _U(64 - SKETCH_BITS)).astype(np.int64)]
                first = np.lexsort((t, cell))[:keep]
                found.append((t[first].view(np.int64), np.full(len(first), row), np.arange(1, len(first) + 1)))
            if found:
                t, row, place = (np.concatenate(c) for c in zip(*found))
                bits = np.packbits(maps, axis=1, bitorder="little").view(np.int64)
                more = batch.column("n").to_numpy() - maps.sum(1)
                own = [*(batch.column(c).take(pa.array(row)) for c in ("id", "c", "n")), pa.array(place), pa.array(more[row])]
                own += [pa.array(bits[row, k]) for k in range(WORDS)]
                yield pa.RecordBatch.from_arrays([pa.array(t), *own], ["t", "id", "c", "n", "p", "more", *(f"b{k}" for k in range(WORDS))])

    return run


def _relabelled(rows: DataFrame, named: DataFrame, column: str = "id") -> DataFrame:
    """``rows`` with c, the component of ``column`` (itself where it has no link)."""
    named = named.select(F.col("node").alias(column), F.col("component").alias("_c"))
    return rows.join(named, column, "left").withColumn("c", F.coalesce("_c", column)).drop("_c")


def _split(members: DataFrame) -> DataFrame:
    """Members (key, id, n, c) of the keys that hold several components."""
    several = members.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    return members.join(several.select("key"), "key", "left_semi")


def _prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``sets(id, set, c, n)`` in different components that can be linked at all.

    Shingles are ordered from rare to frequent by counts of a fixed number of cells. Sets of sizes n and m that are linked have
    at least a = percent * (n + m) / (100 + percent) shingles in common, so the rarest of these is among the first
    n - a + 1 of one and m - a + 1 of the other; only as many of a set's shingles are shuffled as a may leave. Common bits of
    the bitmaps and the fewer shingles beyond bits bound the common shingles from above (see ``_possible``).
    """
    counts = sets.select("set").mapInArrow(_frequencies, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(1 << SKETCH_BITS, np.int64)
    often[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    words = [f"b{k}" for k in range(WORDS)]
    schema = ", ".join(f"{c} long" for c in ("t", "id", "c", "n", "p", "more", *words))
    first = staged(sets.mapInArrow(_prefixes(often, percent), schema), "first")
    other = first.select(*(F.col(c).alias(f"o{c}") for c in first.columns))
    common = f"{percent} * (n + on) / {100 + percent}"
    shared = " + ".join(f"bit_count({w} & o{w})" for w in words)
    near = f"id > oid AND c <> oc AND n - p + 1 >= {common} AND on - op + 1 >= {common} AND {_like_size('n', 'on', percent)}"
    near += f" AND {100 + percent} * ({shared} + least(more, omore)) >= {percent} * (n + on)"
    return first.join(other, F.expr(f"t = ot AND {near}")).select(F.col("id").alias("x"), F.col("oid").alias("y")).distinct()


def _all_links(docs: DataFrame, edges: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Links that join all that the tables see into components: tree edges first, then what a bucket still holds apart."""
    pairs = staged(edges.groupBy("x", "y").agg(F.count("*").alias("tables")), "pairs")
    linked = _tree_links(docs, pairs, k, percent)
    named = components(linked)
    # A bucket of two has one edge, which is settled; larger ones whose edges all lie within components are one component.
    known = edges.join(_across(pairs, named).withColumn("across", F.lit(1)), ["x", "y"], "left")
    apart = known.groupBy("key").agg(F.count("*").alias("edges"), F.count("across").alias("across")).where("edges > 1 AND across > 0")
    members = _relabelled(reps.select("id", "n_shingles", "keys"), named)  # one row a class, before its keys are rows
    members = members.mapInArrow(_exploded(_key_filter(apart.select("key"))), "key long, id long, n long, c long")
    left = _split(_by_size(members, percent)).groupBy("id").agg(F.first("c").alias("c"), F.first("n").alias("n"))
    left = staged(left, "left")
    if left.isEmpty():
        return linked
    sets = _sets_of(docs, left.select("id"), k)
    pairs = staged(_prefix_pairs(sets.select("id", "set").join(left, "id"), percent), "cross")
    return linked if pairs.isEmpty() else linked.union(_verified(sets, pairs, percent))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, m: int = KEYS, r: int = ROWS
) -> DataFrame:
    """One row per id: id, n_shingles, component_id (smallest id reachable over links) and kept (the smallest itself).

    Two texts are linked if 100 * |common shingles| >= percent * |all shingles| (A-Z lower-cased, distinct windows of
    k words, fewer words: the whole sequence). Null, empty and blank texts have no shingle and no link. Rows that
    repeat an id stand for one document, that with the largest set; rows with a null id take no part. Other
    columns are not read. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    sig = staged(_largest(signatures(docs, k, m, r)), "signatures")
    filled = sig.where("n_shingles > 0")
    reps = filled.groupBy("set_a", "set_b").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    reps = staged(reps, "classes")
    rows = reps.select("id", "keys").mapInArrow(_combine, "key long, x long, y long")
    edges = rows.repartition("key").sortWithinPartitions("key", "x").mapInArrow(_link, "key long, x long, y long")
    edges = staged(edges, "tree")
    named = components(_all_links(docs, edges, reps, k, percent))
    classes = reps.select("set_a", "set_b", F.col("id").alias("node")).join(named, "node", "left")
    classes = classes.select("set_a", "set_b", F.coalesce("component", "node").alias("c"))
    out = sig.select("id", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left")
    component = F.coalesce("c", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), (component == F.col("id")).alias("kept"))
