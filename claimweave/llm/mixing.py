"""Mixing sources to target weights by min-cost flow, for documents that may belong to several sources.

Documents are summed to membership patterns (the set of sources a document belongs to). A pattern offers its words
once for each allowed copy, the second copy at a higher cost than the first and so on (a convex cost); it may send
them to any of its sources, and a source takes no more than its quota. The cheapest largest flow says how many words
of each pattern are taken: patterns of one connected set of sources form one problem, and the sets are solved side
by side. A pattern's words become whole copies of all its documents and a rest; documents follow a seeded order, and
those before the point where the rest is used up are taken once more. The one document at that point is cut there.
Sums are by (pattern, bucket of the order), so only the documents of one bucket a pattern are ever sorted.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.components import components
from claimweave.llm.stages import staged

WEIGHTS = (3.0, 1.0, 2.0)  # by place of the source in code point order, repeating
SHARE = 1.5  # words of the mix against words of all documents
COPIES = 2  # most often a document is taken
BUCKET = 4096  # documents of a pattern in one bucket of the seeded order, on average
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0 in code point order, null last; no task sorts them all."""
    order = F.col("source").asc_nulls_last()
    placed = staged(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix_sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return placed.join(parts, "part").select("source", "source_size", (F.col("before") + nth - 1).alias("rank"))


def _level(sources: DataFrame, words: float, copies: int) -> float:
    """The level l with sum of min(cap, l * weight) = words, or infinity where all sources stop at their caps.

    The sum is concave and piecewise linear in l, so each round (one aggregate, two numbers) shares the excess of all
    capped sources among the others, and the rounds end when no further source is above its cap.
    """
    cap = copies * F.col("source_size")
    level = 0.0
    while True:
        full = cap <= level * F.col("weight")
        row = sources.agg(F.sum(F.when(full, cap)).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("free")).first()
        if not row.free:
            return float("inf")
        now = (words - (row.used or 0)) / row.free
        if now <= level:
            return level
        level = now


def targets(patterns: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """(source, source_size, rank, weight, target) for ``patterns(members, n, mass)``.

    A document counts in the size of each of its sources, once in the words to be shared.
    """
    sizes = patterns.select(F.explode("members").alias("source"), "mass").groupBy("source").agg(F.sum("mass").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = staged(_ranked(sizes).withColumn("weight", weight), "mix_weights")
    total = patterns.where(F.size("members") > 0).agg(F.sum("mass")).first()[0] or 0
    level = _level(ranked, share * total, copies)
    cap = (copies * F.col("source_size")).cast("double")
    return ranked.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")) if level < float("inf") else cap)


def cheapest_flow(masses: list[int], members: list[list[int]], quotas: dict[int, int], copies: int) -> dict[tuple[int, int], int]:
    """Words sent from pattern i to source s, of the cheapest among the largest flows.

    All cost lies on the arcs into the patterns and rises with the copy, so the cheapest path always uses the lowest
    copy that still leads somewhere: copies are opened one after another and each is filled to the largest flow by
    shortest augmenting paths, which may take words from one source to another but never send a copy back.
    """
    sent = {(i, s): 0 for i, own in enumerate(members) for s in own}
    users: dict[int, list[int]] = {}
    for i, s in sent:
        users.setdefault(s, []).append(i)
    room = dict(quotas)
    supply = [0] * len(masses)
    for _ in range(copies):
        supply = [left + mass for left, mass in zip(supply, masses)]
        while True:
            # Breadth first from all patterns with words left; back arcs lead from a source to a pattern it draws on.
            came: dict[tuple[str, int], tuple[str, int] | None] = {("p", i): None for i, left in enumerate(supply) if left > 0}
            queue, end = deque(came), None
            while queue and end is None:
                kind, at = queue.popleft()
                if kind == "p":
                    for s in members[at]:
                        if ("s", s) not in came:
                            came["s", s] = (kind, at)
                            if room[s] > 0:
                                end = ("s", s)
                                break
                            queue.append(("s", s))
                else:
                    for i in users[at]:
                        if sent[i, at] > 0 and ("p", i) not in came:
                            came["p", i] = (kind, at)
                            queue.append(("p", i))
            if end is None:
                break
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            amount = min([supply[path[0][1]], room[end[1]]] + [sent[b[1], a[1]] for a, b in zip(path, path[1:]) if a[0] == "s"])
            for a, b in zip(path, path[1:]):
                if a[0] == "p":
                    sent[a[1], b[1]] += amount
                else:
                    sent[b[1], a[1]] -= amount
            supply[path[0][1]] -= amount
            room[end[1]] -= amount
    return sent


def flows(patterns: DataFrame, wanted: DataFrame, copies: int = COPIES) -> DataFrame:
    """(members, source, rank, words): words that each pattern sends to each of its sources.

    ``wanted(source, rank, target)``. One task holds the patterns (not the documents) of one connected set of sources.
    """
    each = patterns.select("members", "mass", F.explode("members").alias("source"))
    each = each.join(wanted.select(F.col("source").alias("s"), "rank", F.round("target").cast("long").alias("quota")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    linked = each.groupBy("members").agg(F.min("rank").alias("first"), F.array_sort(F.collect_list("rank")).alias("ranks"))
    edges = linked.where("size(ranks) > 1").select("first", F.explode("ranks").alias("rank"))
    if edges.isEmpty():
        each = each.withColumn("component", F.col("rank"))
    else:
        named = components(edges)
        each = each.join(named, F.col("rank") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rank")).drop("node")
    rows = each.select("component", "members", "mass", "source", "rank", "quota")

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(name=[repr(list(m)) for m in part["members"]]).sort_values(["name", "rank"], ignore_index=True)
        part["pattern"] = pd.factorize(part["name"])[0]
        one = part.drop_duplicates("pattern")
        own = [[int(r) for r in g] for _, g in part.groupby("pattern")["rank"]]
        quotas = {int(r): int(q) for r, q in zip(part["rank"], part["quota"])}
        sent = cheapest_flow([int(m) for m in one["mass"]], own, quotas, copies)
        words = np.array([sent[p, int(r)] for p, r in zip(part["pattern"], part["rank"])], dtype=np.int64)
        return part[["members", "source", "rank"]].assign(words=words)

    kind = dict(patterns.dtypes)["members"]
    return rows.groupBy("component").applyInPandas(solve, f"members {kind}, source {kind[6:-1]}, rank long, words long")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE, copies: int = COPIES, seed: int = 13,
) -> DataFrame:
    """One row per input row: id, size (words), source_size and target of its source, taken (words the mix takes of it).

    ``source_col`` names one source, or an array of them for documents of several sources; then source_size and
    target are arrays in code point order, null last. Null is a source like others. Null and empty texts have size 0
    and nothing taken; a source without words has target 0. A document of no source (a null or empty array) has
    empty arrays and nothing taken. Taken is a whole number of copies of the document, but for at most one document a
    pattern, which is cut so that the pattern gives exactly the words of the flow (targets rounded to words). The order
    depends on seed, id and text only; rows equal in both are interchangeable. Other columns are ignored.
    """
    if id_col in {"size", "source_size", "target", "taken"}:
        raise ValueError(f"the id column may not be called {id_col}")
    kind = dict(docs.dtypes)[source_col]
    many = kind.startswith("array")
    source = F.col(source_col)
    members = F.array_sort(F.array_distinct(F.coalesce(source, F.array().cast(kind)))) if many else F.array(source.cast("string"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(text_col, F.lit("")))))
    sized = staged(docs.select(F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size"), members.alias("members"), order.alias("order")), "mix_sized")
    patterns = staged(sized.groupBy("members").agg(F.count("*").alias("n"), F.sum("size").alias("mass")), "mix_patterns")
    wanted = staged(targets(patterns, weights, share, copies), "mix_targets")
    sent = staged(flows(patterns, wanted, copies), "mix_flows")
    facts = wanted.select(F.col("source").alias("s"), "source_size", "target")
    known = sent.join(facts, F.col("source").eqNullSafe(F.col("s"))).groupBy("members").agg(
        F.array_sort(F.collect_list(F.struct("rank", "source_size", "target"))).alias("facts"), F.sum("words").alias("take")
    )
    plan = patterns.join(known, "members", "left").select(
        "members", F.coalesce(F.col("facts.source_size"), F.array().cast("array<long>")).alias("source_size"),
        F.coalesce(F.col("facts.target"), F.array().cast("array<double>")).alias("target"),
        F.coalesce(F.expr("CASE WHEN mass > 0 THEN take div mass END"), F.lit(0)).alias("whole"),
        F.coalesce(F.expr("CASE WHEN mass > 0 THEN take % mass END"), F.lit(0)).alias("rest"),
        F.ceil(F.col("n") / BUCKET).alias("buckets"),
    )
    plan = staged(plan, "mix_plan")
    # Thirteen hexadecimal digits are 52 bits: the place in [0, 1) is exact.
    place = F.conv(F.substring("order", 1, 13), 16, 10).cast("double") / float(1 << 52)
    rows = sized.join(plan, "members").withColumn("bucket", F.floor(place * F.col("buckets")))
    sums = rows.where("rest > 0").groupBy("members", "bucket", "rest").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("members").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    edge = sums.withColumn("before", before).where("before < rest AND rest <= before + words")
    edge = staged(edge.select("members", F.col("bucket").alias("edge"), (F.col("rest") - F.col("before")).alias("need")), "mix_edges")
    rows = rows.drop("rest", "buckets").join(edge, "members", "left")
    at_edge = F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))
    clear = rows.where(~at_edge).withColumn("extra", F.when(F.col("bucket") < F.col("edge"), F.col("size")).otherwise(F.lit(0)))
    upto = F.sum("size").over(Window.partitionBy("members").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("need") - upto + F.col("size")))
    out = clear.unionByName(rows.where(at_edge).withColumn("extra", extra))
    fact = (lambda c: F.col(c)) if many else (lambda c: F.col(c)[0].alias(c))
    return out.select(
        F.col("id").alias(id_col), "size", fact("source_size"), fact("target"), (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken")
    )
