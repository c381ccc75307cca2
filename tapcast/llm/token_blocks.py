"""Token files of patched frame-of-reference blocks.

A table of segments in Parquet; each segment holds whole documents and is one
binary payload:

    magic "PFR1" | u32 ids | u32 blocks | u32 block size
    u32 start of each block, and the end       (the block index)
    per block: u32 minimum | u8 width | u8 0 | u16 exceptions
               values less the minimum, ``width`` low bits each, bit-packed
               u16 positions and u32 full values of the exceptions

All numbers are little-endian. The width of a block is what the value at
``percentile`` needs; larger values are exceptions, kept in full.

Cases: a null text counts as empty (its one id is the end id); a null id sorts
first and comes back null; repeated rows are separate documents; an empty
table gives empty files and an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapcast.llm.common import doc_columns, ship_package, token_encoder, worker_task

BLOCK = 1024
SEGMENT_IDS = 1 << 17
HEAD = np.dtype([("min", "<u4"), ("width", "u1"), ("pad", "u1"), ("exceptions", "<u2")])


def encode_segment(ids: np.ndarray, percentile: float = 0.9, block: int = BLOCK) -> bytes:
    """One payload for an array of unsigned 32-bit ids."""
    n = len(ids)
    n_blocks = -(-n // block)
    full = np.zeros(n_blocks * block, np.uint32)
    full[:n] = ids
    full[n:] = full[(n_blocks - 1) * block] if n else 0
    rows = full.reshape(n_blocks, block)
    low = rows.min(axis=1, initial=np.iinfo(np.uint32).max) if n else np.zeros(0, np.uint32)
    rest = rows - low[:, None]
    at = np.partition(rest, int(percentile * (block - 1)), axis=1)[:, int(percentile * (block - 1))]
    width = np.ceil(np.log2(at.astype(np.float64) + 1)).astype(np.uint8)
    out: list[bytes] = [b""] * n_blocks
    for w in np.unique(width):
        which = np.nonzero(width == w)[0]
        part = rest[which]
        packed = _packed(part, int(w))
        over = part >> np.uint64(w) > 0
        for i, b in enumerate(which):
            pos = np.nonzero(over[i])[0]
            head = np.array([(low[b], w, 0, len(pos))], HEAD)
            out[b] = (head.tobytes() + packed[i].tobytes() + pos.astype("<u2").tobytes()
                      + part[i][pos].astype("<u4").tobytes())
    starts = np.cumsum([0, *map(len, out)]).astype("<u4")
    return b"PFR1" + np.array([n, n_blocks, block], "<u4").tobytes() + starts.tobytes() + b"".join(out)


def _layout(payload: bytes) -> tuple[int, int, np.ndarray, int]:
    if payload[:4] != b"PFR1":
        raise ValueError("not a token segment")
    n, n_blocks, block = (int(x) for x in np.frombuffer(payload, "<u4", 3, 4))
    return n, block, np.frombuffer(payload, "<u4", n_blocks + 1, 16).astype(np.int64), 16 + 4 * (n_blocks + 1)


def _patched(rest: np.ndarray, body: bytes, packed: int, width: int, n_exc: int) -> np.ndarray:
    at = HEAD.itemsize + packed
    pos = np.frombuffer(body, "<u2", n_exc, at)
    rest[pos] = np.frombuffer(body, "<u4", n_exc, at + 2 * n_exc)
    return rest


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values to rows of bytes: ``width`` low bits each. Eight values
    fill ``width`` bytes; they are put together in 64-bit words."""
    n, block = values.shape
    eights = -(-block // 8)
    full = np.zeros((n, eights * 8), np.uint64)
    full[:, :block] = values & np.uint64((1 << width) - 1)
    full = full.reshape(n, eights, 8)
    words = np.zeros((n, eights, 4), "<u8")
    for k in range(8):
        word, bit = divmod(k * width, 64)
        words[:, :, word] |= full[:, :, k] << np.uint64(bit)
        if bit + width > 64:
            words[:, :, word + 1] |= full[:, :, k] >> np.uint64(64 - bit)
    out = words.view(np.uint8).reshape(n, eights, 32)[:, :, :width]
    return np.ascontiguousarray(out).reshape(n, -1)[:, :-(-block * width // 8)]


def _unpacked(data: np.ndarray, block: int, width: int) -> np.ndarray:
    """Rows of packed bytes to rows of ``block`` values: each is read from the
    64-bit word at its first byte."""
    if not width:
        return np.zeros((len(data), block), np.uint32)
    size = data.shape[1] + 8
    flat = np.zeros((len(data), size), np.uint8)
    flat[:, :-8] = data
    words = np.ndarray(len(data) * size - 7, "<u8", flat, strides=(1,))
    bit = np.arange(block) * width
    at = (np.arange(len(data)) * size)[:, None] + (bit >> 3)
    return (words[at] >> (bit & 7).astype(np.uint64) & np.uint64((1 << width) - 1)).astype(np.uint32)


def decode_block(payload: bytes, k: int) -> np.ndarray:
    """The ids of one block, found through the index."""
    n, block, starts, base = _layout(payload)
    body = payload[base + starts[k]:base + starts[k + 1]]
    head = np.frombuffer(body, HEAD, 1)[0]
    w, packed = int(head["width"]), -(-block * int(head["width"]) // 8)
    rest = _unpacked(np.frombuffer(body, np.uint8, packed, HEAD.itemsize)[None], block, w)[0].copy()
    ids = _patched(rest, body, packed, w, int(head["exceptions"])) + head["min"]
    return ids[:n - k * block]


def decode_segment(payload: bytes) -> np.ndarray:
    """All ids; blocks of one width are unpacked together."""
    n, block, starts, base = _layout(payload)
    n_blocks = len(starts) - 1
    raw = np.frombuffer(payload, np.uint8)
    heads = raw[(base + starts[:-1])[:, None] + np.arange(HEAD.itemsize)].reshape(-1).view(HEAD)
    out = np.zeros((n_blocks, block), np.uint32)
    for w in np.unique(heads["width"]):
        which = np.nonzero(heads["width"] == w)[0]
        packed = -(-block * int(w) // 8)
        at = (base + starts[which] + HEAD.itemsize)[:, None] + np.arange(packed)
        rest = _unpacked(raw[at], block, int(w)).copy()
        for i, b in enumerate(which):
            if m := int(heads["exceptions"][b]):
                _patched(rest[i], payload[base + starts[b]:base + starts[b + 1]], packed, int(w), m)
        out[which] = rest + heads["min"][which][:, None]
    return out.reshape(-1)[:n]


SEGMENTS = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("first_token", pa.int64()),
                      ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                      ("n_tokens", pa.list_(pa.int32())), ("payload", pa.binary())])
SEGMENTS_DDL = ("shard int, segment int, first_token long, n_ids long, doc_ids array<long>, "
                "n_tokens array<int>, payload binary")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text", percentile: float = 0.9) -> None:
    """Tokenize whole texts and write them in ascending id order: one range
    exchange, then each task packs its shard as it reads it. A segment closes
    at the first document end past ``SEGMENT_IDS`` ids."""
    end = np.array([end_id], "<u4").tobytes()

    @worker_task("tokens")
    def segments(batches):
        shard, segment, first = TaskContext.get().partitionId(), 0, 0
        doc_ids, sizes, parts, held = [], [], [], 0
        enc = token_encoder(tokenizer)

        def closed():
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = [[shard], [segment], [first], [len(ids)], [doc_ids], [sizes],
                   [encode_segment(ids, percentile)]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, SEGMENTS)],
                                              schema=SEGMENTS)

        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = enc.ids(text.as_py()) + end
                doc_ids.append(i)
                sizes.append(len(ids) // 4)
                parts.append(ids)
                held += sizes[-1]
                if held >= SEGMENT_IDS:
                    yield closed()
                    segment, first = segment + 1, first + held
                    doc_ids, sizes, parts, held = [], [], [], 0
        if parts:
            yield closed()

    (doc_columns(docs, id_col, text_col)
     .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(segments, SEGMENTS_DDL)
     .write.option("compression", "uncompressed").parquet(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents from the files: doc_id, start, n_tokens, ids (array<int>,
    read as unsigned), and where they lie (shard, segment)."""
    return _documents(spark, path, with_ids=True)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Like read_tokens with ids_crc32 (unsigned, of little-endian unsigned
    32-bit ids) in place of the ids."""
    return _documents(spark, path, with_ids=False)


def _documents(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    ship_package(spark)
    files = spark.read.schema(SEGMENTS_DDL).parquet(path)
    # One row per shard: what lies before it.
    before = (files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
              .select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base")))
    kind = pa.list_(pa.int32()) if with_ids else pa.int64()
    fields = [("doc_id", pa.int64()), ("in_shard", pa.int64()), ("n_tokens", pa.int64()),
              ("ids" if with_ids else "ids_crc32", kind), ("shard", pa.int32()), ("segment", pa.int32())]
    schema = pa.schema(fields)

    def decoded(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_segment(row["payload"])
                ends = np.cumsum(row["n_tokens"])
                starts = ends - row["n_tokens"]
                parts = [ids[a:b] for a, b in zip(starts, ends)]
                last = ([p.astype(np.int32) for p in parts] if with_ids
                        else [zlib.crc32(p.astype("<u4").tobytes()) for p in parts])
                n = len(parts)
                cols = [row["doc_ids"], starts + row["first_token"], ends - starts, last,
                        np.full(n, row["shard"]), np.full(n, row["segment"])]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)],
                                                 schema=schema)

    ddl = ("doc_id long, in_shard long, n_tokens long, "
           + ("ids array<int>" if with_ids else "ids_crc32 long") + ", shard int, segment int")
    return (files.select("shard", "segment", "first_token", "doc_ids", "n_tokens", "payload")
            .mapInArrow(decoded, ddl).join(before, "shard")
            .select("doc_id", (F.col("in_shard") + F.col("base")).alias("start"), "n_tokens",
                    "ids" if with_ids else "ids_crc32", "shard", "segment"))
