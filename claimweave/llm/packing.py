"""Pack tokenised documents into sequences of fixed length: concatenate and cut.

Pass one tokenises every document once and writes its ids to a table in the shared folder, together with the
partition that wrote it and the number of ids before it in that partition. The partitions' totals (one number
each) give every partition's global offset as a prefix sum. Pass two cuts each document at the global multiples of
the sequence length; a document that crosses a boundary yields a record on either side. No row is shuffled.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.stages import small_batches, staged

LENGTH = 1024
END_ID = 0
CACHED_PIECES = 400_000
_SPECIAL = "<|endoftext|>"


class ByteTokens:
    """Ids of texts under a byte-level BPE vocabulary, as little-endian bytes.

    The split pattern never joins a character to a single space after it, so a text without runs of spaces falls
    apart before every space and each part has ids of its own. Parts repeat, hence the cache. Other texts are
    encoded whole.
    """

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={_SPECIAL: len(ranks)})
        encoding = self.encoding

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                if len(self) >= CACHED_PIECES:
                    self.clear()
                if piece.isalpha():  # one match of the pattern
                    ids = encoding._encode_single_piece(" " + piece)
                else:
                    ids = encoding.encode_ordinary(" " + piece)
                value = self[piece] = array("H", ids).tobytes()
                return value

        self.pieces = Pieces()

    def ids(self, text: str) -> bytes:
        parts = text.split(" ")
        if _SPECIAL in text or "" in parts:
            return np.array(self.encoding.encode(text, allowed_special="all"), "<u2").tobytes()
        first = np.array(self.encoding.encode_ordinary(parts[0]), "<u2").tobytes()
        return first + b"".join(map(self.pieces.__getitem__, parts[1:]))


@lru_cache(maxsize=1)
def tokens_at(ranks_path: str, pattern: str) -> ByteTokens:
    """One instance for all tasks of a worker process, so that parts known stay known."""
    return ByteTokens(ranks_path, pattern)


def _tokenised(ranks_path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_at(ranks_path, pattern)
        part, before = TaskContext.get().partitionId(), 0
        end = np.array([END_ID], "<u2").tobytes()
        for batch in batches:
            ids = [(tokens.ids(t) if t else b"") + end for t in batch.column("text").to_pylist()]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(sizes), pa.array(starts), pa.array(np.full(len(ids), part))],
                ["doc_id", "ids", "doc_tokens", "before", "part"],
            )

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first, sizes = batch.column("first").to_numpy(), batch.column("doc_tokens").to_numpy()
            pieces = (first + sizes - 1) // length - first // length + 1
            row = np.repeat(np.arange(len(first)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[row] // length + nth
            start = np.maximum(sequence * length, first[row]) - first[row]
            end = np.minimum((sequence + 1) * length - first[row], sizes[row])
            blobs = [b.as_py() for b in batch.column("ids")]
            parts = [blobs[r][2 * a : 2 * b] for r, a, b in zip(row, start, end)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(end - start),
                    pa.array(sizes[row]), pa.array(sequence), pa.array(start + first[row] - sequence * length), pa.array(parts, pa.binary()),
                ],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return run


def pack(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Pieces of documents in sequences of ``length`` ids, with ``ids`` (16-bit little-endian) of each piece.

    Columns: doc_id, start (ids of the document before the piece), length, doc_tokens, sequence_id, offset (place in
    the sequence), ids. A document is its text's ids and id 0, so null and empty texts have one id. All sequences
    are full but the last. Every row is packed: repeated rows and null document ids included. Documents follow one
    another in the order of the input's partitions. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {kind}, ids binary, doc_tokens long, before long, part long"
    tokens = staged(rows.mapInArrow(_tokenised(ranks_path, pattern), schema), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).orderBy("part").collect()  # one row a partition
    base, offsets = 0, []
    for row in totals:
        offsets.append((row.part, base))
        base += row.n
    offsets = spark.createDataFrame(offsets, "part long, base long")
    placed = tokens.join(F.broadcast(offsets), "part").select("doc_id", "ids", "doc_tokens", (F.col("base") + F.col("before")).alias("first"))
    return placed.mapInArrow(
        _cut(length), f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )


def _crc(column: pa.ChunkedArray | pa.Array) -> list[int]:
    return [zlib.crc32(np.frombuffer(b.as_py(), "<u2").astype("<u4").tobytes()) for b in column]


def with_crc(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ids_crc32 of their ids as unsigned little-endian 32-bit integers, in place of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(_crc(batch.column("ids")), pa.int64())], [*batch.schema.names[:at], "ids_crc32"])

    names = [c for c in pieces.columns if c != "ids"]
    kinds = dict(pieces.dtypes)
    return pieces.select(*names, "ids").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", ids_crc32 long")
