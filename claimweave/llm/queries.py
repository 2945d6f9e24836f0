"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm import (
    bpe, chat, gam, graph_ann, kneser_ney, line_dedup, minhash, mixing, packing, prefix_trie, quality_rules, text_cnn, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(function):
    QUERIES[function.__name__] = function
    return function


def _crc(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


@_query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text without lines that an earlier line equals or differs from by one word."""
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_copies").alias("n_copies"), F.col("_n_near").alias("n_near"), "text")


@_query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return packing.with_crc(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@_query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest(bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@_query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    rows = rows.union(spark.range(2).select(F.lit(-7).cast("long"), "id", role, F.lit(text)))
    records = chat.canonical(chat.from_rows(rows))
    return chat.digests(chat.formatted(records, "conv_id"))


ORACLES["op4_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + 8 + length(text) + (length(text) - length(replace(text, '\', '')))
    + (length(text) - length(replace(text, '</turn>', ''))) // 7
    + length(regexp_replace(regexp_replace(text, '[^#]', ' ', 'g'), '#( |$)', ' ', 'g'))
    - length(replace(regexp_replace(regexp_replace(text, '[^#]', ' ', 'g'), '#( |$)', ' ', 'g'), '#', ''))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@_query
def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_crc("doc_id") % 7 == 2, F.lit(False))
    model = kneser_ney.fit(docs.where(~held_out).select("text"), least=1)
    scored = kneser_ney.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), *(c for c in scored.columns if c != "doc_id"))


@_query
def op6_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return graph_ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


@_query
def op7_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = gam.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), _crc("id") % 5 != 0)
    return scored.select("doc_id", F.coalesce(_crc("doc_id") % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op8_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = text_cnn.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), _crc("id") % 4 != 2)
    return scored.select(
        "doc_id", F.coalesce(_crc("doc_id") % 4 == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), F.col("threshold").alias("lang_threshold"),
    )


@_query
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=2)


@_query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents")).drop("distance")


@_query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


# crc32 bit by bit; prefixes are joined digests of role and text.
ORACLES["op11_prefix_trie"] = """
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT DISTINCT c, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h FROM own),
parts AS (
  SELECT v.c, o.i, o.role, o.text FROM convs v JOIN own o ON o.c = v.base AND o.i <= v.h
  UNION ALL SELECT v.c, 1000000 + o.i, o.role, o.text FROM convs v JOIN own o ON o.c = v.c AND o.i > v.h),
turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, md5(length(role) || ':' || role || text) AS id, strlen(text) AS bytes FROM parts),
prefixes AS (
  SELECT c, d, string_agg(id, '') OVER (PARTITION BY c ORDER BY d) AS name, bytes FROM turns
  UNION ALL SELECT c, 0, '', 0 FROM convs),
lengths AS (SELECT c, max(d) AS n FROM prefixes GROUP BY c),
nodes AS (SELECT name, any_value(d) AS d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS own FROM prefixes GROUP BY name),
ended AS (SELECT name, sha256(string_agg(p.c::VARCHAR, ',' ORDER BY p.c)) AS ends FROM prefixes p JOIN lengths l ON p.c = l.c AND p.d = l.n GROUP BY name),
family AS (SELECT left(name, length(name) - 32) AS name, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
below AS (
  SELECT p.name, sum(w.own) AS saved, count(*) FILTER (w.leaf) AS leaves FROM prefixes p
  JOIN (SELECT nodes.conv_id, nodes.d, nodes.own, family.n IS NULL AS leaf FROM nodes LEFT JOIN family USING (name)) w ON w.conv_id = p.c AND w.d >= p.d GROUP BY p.name)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(f.n, 0) AS n_children, b.leaves AS n_leaves,
  CAST(b.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM nodes n JOIN below b USING (name) LEFT JOIN family f USING (name) LEFT JOIN ended e USING (name)
LEFT JOIN nodes up ON n.d > 0 AND up.name = left(n.name, length(n.name) - 32)
"""


@_query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = whitening.whiten(vectors, whitening.fit(vectors))
    out = out.select(F.col("id").alias("vec_id"), "n", "deviation", F.posexplode("whitened").alias("at", "whitened"), "explained", "identity_error")
    return out.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.col("explained")[F.col("at")].alias("explained"), "identity_error")


@_query
def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


# In order of cap over weight, the first source below its cap when all before it stop at theirs sets the level.
ORACLES["op13_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    md5('13:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS ord FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM d GROUP BY source),
r AS (SELECT *, 1.5::DOUBLE * (SELECT sum(size) FROM d) AS words, row_number() OVER (ORDER BY 2.0 * source_size / w, source) AS k FROM s),
c AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM r),
l AS (SELECT arg_min((words - capped) / free, k) AS level FROM c WHERE (words - capped) / free <= 2.0 * source_size / w),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, w * (SELECT level FROM l)) AS target FROM s),
p AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM t),
u AS (SELECT d.*, p.source_size, p.target, p.quota,
  sum(size) OVER (PARTITION BY d.source ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE size * (quota // source_size) + greatest(0, least(size, quota % source_size - before)) END AS BIGINT) AS taken FROM u
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
