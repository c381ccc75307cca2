"""Blocks of documents whose words are numbered, and sent apart from them.

A corpus-wide table of distinct words can be made without sending the texts:
a block keeps its documents as word numbers and sends each distinct word once,
in strings of the words that share a bucket of a hash. What is found out about
the words comes back the same way. Blocks are written once, bucketed by their
number, so they join what comes back without an exchange of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapcast.llm.common import doc_columns, shared_path, worker_task

#: Text bytes of a block, and those that a bucket of blocks aims at.
BLOCK, BUCKET = 16 << 20, 64 << 20


class Numbers(dict):
    """Words to their numbers, in the order in which they are met."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


BLOCKS = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())),
                    ("counts", pa.binary()), ("ranks", pa.binary()), ("buckets", pa.list_(pa.int32())), ("words", pa.list_(pa.binary()))])
BLOCKS_DDL = ("block long, doc_ids array<long>, sizes array<int>, counts binary, ranks binary, "
              "buckets array<int>, words array<binary>")
#: What a block holds besides its words.
DOCUMENTS = ["block", "doc_ids", "sizes", "counts", "ranks"]


def joined(parts: list[bytes]) -> bytes:
    """Byte strings with their lengths in front."""
    return np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def parted(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    ends = (4 * n + 4 + np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64)).tolist()
    return [data[a:b] for a, b in zip([4 * n + 4, *ends], ends)]


def packed_numbers(numbers: np.ndarray, kinds: int) -> tuple[bytes, bytes]:
    """(counts, ranks): how often each number occurs, and the numbers as ranks
    by descending count, so that most are small; both as planes of the first,
    second, third and fourth bytes, which compress well."""
    counts = np.bincount(numbers, minlength=kinds)
    rank = np.empty(kinds, np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(kinds)
    return _planes(counts), _planes(rank[numbers])


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _whole(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).reshape(-1).view("<u4")


def block_numbers(counts: bytes, ranks: bytes) -> np.ndarray:
    """The numbers that ``packed_numbers`` packed."""
    return np.argsort(-_whole(counts).astype(np.int64), kind="stable").astype(np.int32)[_whole(ranks)]


def block_buckets(docs: DataFrame, text_col: str = "text") -> int:
    """Buckets of blocks for these documents: a single number."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    total = int(docs.select(F.sum(F.octet_length(text))).first()[0] or 0)
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BUCKET)


def blocks_of(docs: DataFrame, splitter: Callable, id_col: str = "doc_id", text_col: str = "text",
              parts_wanted: int | None = None) -> DataFrame:
    """One row per block of documents: each one's words as numbers (see
    ``packed_numbers``), and the block's distinct words in the order of their
    numbers, by buckets of a hash. Written once as a table bucketed by block.
    A ``splitter()`` has ``of`` (a text to the bytes of its numbers) and
    ``numbers`` (its words so far)."""
    spark = docs.sparkSession
    parts_wanted = parts_wanted or block_buckets(docs, text_col)
    n_buckets = 4 * parts_wanted  # several a task, to even them out

    @worker_task()
    def cut(batches):
        part, seq, ids, parts, size, chunks = TaskContext.get().partitionId(), 0, [], [], 0, splitter()

        def row():
            words = [w.encode() for w in chunks.numbers]
            bucket = np.fromiter(map(crc32, words), np.uint32, len(words)) % np.uint32(n_buckets)
            order = np.argsort(bucket, kind="stable")
            number = np.empty(len(words), np.int64)
            number[order] = np.arange(len(words))
            held, first = np.unique(bucket[order], return_index=True)
            order = order.tolist()
            data = [joined([words[k] for k in order[a:b]]) for a, b in zip(first, [*first[1:], len(words)])]
            counts, ranks = packed_numbers(number[np.frombuffer(b"".join(parts), "<i4")], len(words))
            cols = [[(part << 32) + seq], [ids], [[len(p) // 4 for p in parts]], [counts], [ranks],
                    [held.astype(np.int32)], [data]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, BLOCKS)], schema=BLOCKS)

        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = t.as_py()
                ids.append(i)
                parts.append(chunks.of(text.decode("utf-8", "replace")))
                size += len(text) + 1
                if size >= BLOCK:
                    yield row()
                    seq, ids, parts, size, chunks = seq + 1, [], [], 0, splitter()
        if ids:
            yield row()

    name = f"tapcast_blocks_{uuid.uuid4().hex}"
    (doc_columns(docs, id_col, text_col).mapInArrow(cut, BLOCKS_DDL).write.bucketBy(parts_wanted, "block")
     .option("compression", "zstd").option("path", shared_path(spark, "blocks")).saveAsTable(name))
    return spark.table(name)


def bucketed_words(blocks: DataFrame) -> DataFrame:
    """(block, bucket, words) of all blocks, a row for each bucket's words."""
    return (blocks.select("block", F.explode(F.arrays_zip("buckets", "words")).alias("w"))
            .select("block", F.col("w.buckets").alias("bucket"), F.col("w.words").alias("words")))


def whole_buckets(batches, columns: tuple[str, ...], size: int):
    """Lists of rows, of whole buckets, of some ``size`` bytes in their last
    column; the batches' rows come sorted by bucket."""
    rows, held = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if held >= size and row[1] != rows[-1][1]:
                yield rows
                rows, held = [], 0
            rows.append(row)
            held += len(row[-1])
    if rows:
        yield rows
