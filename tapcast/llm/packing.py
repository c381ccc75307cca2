"""Cost-balanced packing of token documents into fixed-length sequences.

The attention cost of a piece of n tokens is ``linear * n + quadratic * n * n``
(documents do not attend to each other). Documents are dealt by a hash of
their id, text and place into groups of about ``GROUP_TOKENS`` tokens, however
many rows one id has. Within a group the
number of sequences follows from its tokens: full ones, then a tail whose
lengths are powers of two, so that nothing is padded. Documents go, longest
first, to the sequence of lowest cost that still has room for them; a document
longer than a sequence is first cut into full pieces, and one that fits nowhere
whole is cut into the largest rooms that are left.

Cases: a null text counts as empty (one end id); a null id comes back null;
equal lengths go by id; repeated rows are packed each; an empty table
gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapcast.llm.common import doc_columns, token_encoder, worker_task

#: Tokens a packing group aims at: its ids fit a Python worker many times over.
GROUP_TOKENS = 1 << 22
#: Cost of a piece: feed-forward work per token, attention work per pair.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096


def sequence_lengths(tokens: int, capacity: int) -> np.ndarray:
    """Full sequences, then the powers of two that make up the rest."""
    full, rest = divmod(tokens, capacity)
    tail = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return np.array([capacity] * full + tail, np.int64)


def pack(lengths: np.ndarray, capacity: int, linear: float = LINEAR,
         quadratic: float = QUADRATIC) -> np.ndarray:
    """Pieces (document, start, length, sequence, offset) of documents whose
    lengths are given; every token lies in exactly one piece."""
    lengths = np.asarray(lengths, np.int64)
    room = sequence_lengths(int(lengths.sum()), capacity)
    size = room.copy()
    cost = np.zeros(len(room))
    pieces = []

    def place(doc: int, start: int, n: int, seq: int) -> None:
        pieces.append((doc, start, n, seq, size[seq] - room[seq]))
        room[seq] -= n
        cost[seq] += linear * n + quadratic * n * n

    whole = np.repeat(np.arange(len(lengths)), lengths // capacity)
    first = np.cumsum(lengths // capacity) - lengths // capacity
    items = [(capacity, int(d), (k - int(first[d])) * capacity) for k, d in enumerate(whole)]
    items += [(int(n % capacity), d, int(n - n % capacity)) for d, n in enumerate(lengths) if n % capacity]
    items.sort(key=lambda x: (-x[0], x[1], x[2]))
    for n, doc, start in items:
        while n:
            seq = int(np.where(room >= n, cost, np.inf).argmin())
            if room[seq] < n:  # fits nowhere whole: fill the largest room
                seq = int(room.argmax())
            take = min(n, int(room[seq]))
            place(doc, start, take, seq)
            n, start = n - take, start + take
    return np.array(pieces, np.int64).reshape(-1, 5)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """(doc_id, width, ids binary, salt): whole texts as little-endian unsigned
    32-bit ids, or 16-bit ones where all ids fit, and the end id. The salt
    tells rows of one id, and copies of one row, apart."""
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("salt", pa.int64())])

    @worker_task("tokens")
    def encoded(batches):
        enc, part, copies = token_encoder(tokenizer), TaskContext.get().partitionId(), Counter()
        narrow = max(enc.tok.get_vocab_size(), end_id + 1) <= 1 << 16
        for batch in batches:
            ids = [enc.ids(t.as_py()) + end for t in batch.column("text")]
            salt = []
            for i, x in zip(batch.column("doc_id").to_pylist(), ids):
                own = (i, zlib.crc32(x))
                salt.append(own[1] << 31 ^ copies[own] << 16 ^ part)
                copies[own] += 1
            if narrow:
                ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
            width = pa.array([2 if narrow else 4] * len(ids), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), width, pa.array(ids, pa.binary()),
                                              pa.array(salt, pa.int64())], schema=schema)

    return (doc_columns(docs, id_col, text_col)
            .mapInArrow(encoded, "doc_id long, width int, ids binary, salt long"))


def group_count(docs: DataFrame, text_col: str = "text") -> int:
    """Groups for this corpus: one per ``GROUP_TOKENS`` tokens at about two
    bytes of text a token, counted over all rows (a single number)."""
    total = docs.select(F.sum(F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))).first()[0]
    return max(1, int(total or 0) // (2 * GROUP_TOKENS))


def packed(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
           linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, sequence_length, and ids (little-endian unsigned 32-bit) if asked
    for. One exchange of the ids by group; each group packs on its own."""
    n = group_count(docs, text_col)
    group = F.pmod(F.xxhash64("doc_id", "salt"), F.lit(n))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
             "sequence_length"]
    schema = pa.schema([(c, pa.int64()) for c in names] + [("ids", pa.binary())] * with_ids)

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        doc_ids, raw = rows.column("doc_id").to_pylist(), rows.column("ids").to_pylist()
        order = sorted(range(len(raw)), key=lambda k: (doc_ids[k] is not None, doc_ids[k] or 0, raw[k]))
        width = rows.column("width").to_pylist()
        ids = [np.frombuffer(raw[k], "<u2" if width[k] == 2 else "<u4") for k in order]
        sizes = np.array([len(x) for x in ids], np.int64)
        p = pack(sizes, capacity, linear, quadratic)
        doc, start, length, seq, offset = p.T
        cut = [ids[d][s:s + k].astype("<u4").tobytes() for d, s, k in p[:, :3]]
        held = np.bincount(seq, weights=length).astype(np.int64)
        cols = [[doc_ids[order[d]] for d in doc], start, length, [zlib.crc32(x) for x in cut], sizes[doc],
                (key[0].as_py() << 32) + seq, offset, held[seq]] + [cut] * with_ids
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    ddl = ", ".join(f"{c} long" for c in names) + ", ids binary" * with_ids
    return (tokenized(docs, tokenizer, end_id, id_col, text_col).withColumn("g", group)
            .groupBy("g").applyInArrow(one, ddl))
