"""Byte-level BPE by replaying merges over the corpus' distinct words.

Texts are split by the tokenizer's pattern to words, which merge on their own.
Documents are cut into blocks; a block numbers its distinct words and keeps
each document as word numbers. All blocks' words meet in one exchange, where
every distinct word of the corpus is encoded once:

* an index holds, for each mergeable pair's rank, the positions at which the
  pair stands in the words;
* ranks are taken up in ascending order; all positions of a rank merge from
  left to right;
* a merge touches its two neighbours alone: their new pairs enter the index
  under their own ranks. Where a new pair's rank is lower than the one at work
  (a token that can be made in two ways), the rest of that word waits until the
  lower rank is done, so every word sees its merges in the order in which a
  lowest-rank-first, leftmost-first encoder applies them.

The words' ids go back to the blocks in a second exchange. Blocks are written
once, bucketed by their number, so their texts don't cross the network. Words
travel by the buckets of a hash, a block's words of one bucket as one string;
a block sends a word once, so a word of every document is no hot key.

A word that is in the vocabulary is one token without merging. Ids are written
as little-endian unsigned 32-bit integers. Decoding joins the tokens' bytes.

Cases: a null text is empty and has no ids; null ids and repeated rows are kept
as they are; a very long text is a block of its own; bytes that aren't UTF-8
count as U+FFFD; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapcast.llm.blocks import DOCUMENTS, Numbers, block_numbers, blocks_of, bucketed_words, joined, parted, whole_buckets
from tapcast.llm.common import claim, keeps

#: Symbols that are merged side by side.
SYMBOLS = 400_000
#: A space after a character that is no white space always starts a new word.
CUT = re.compile(r"(?<=\S)(?= )")
ODD = re.compile(r"\s ")
#: Marks that may follow a word; they are one word then.
MARKS = ".,;:!?|%$&*#\"()"


class Vocabulary:
    """Ranks of tokens, all single bytes among them."""

    def __init__(self, rank: dict[bytes, int]) -> None:
        self.rank = rank
        self.token = {n: t for t, n in self.rank.items()}
        self.singles = [bytes([b]) for b in range(256)]
        # The rank of two bytes' merge; -1 if they don't merge.
        self.byte_pairs = np.array([[self.rank.get(a + b, -1) for b in self.singles] for a in self.singles])


@lru_cache(maxsize=2)
def _read(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(token): int(n) for token, n in (line.split() for line in f if line.strip())})


keeps("ranks", _read.cache_clear)


def vocabulary(path: str) -> Vocabulary:
    """A file of base64 tokens with their ranks, kept by this process."""
    claim("ranks")
    return _read(path)


def replay(words: list[bytes], v: Vocabulary) -> list[list[int]]:
    """Ids of words, all merged together in rank order."""
    data = np.frombuffer(b"\x00".join(words) + b"\x00", np.uint8)
    n = len(data)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1  # a barrier behind each word
    first = np.concatenate([[0], ends[:-1] + 1])
    rank = v.byte_pairs[data[:-1], data[1:]]
    rank[ends - 1] = rank[ends[:-1]] = -1
    # Each symbol's bytes, the places of its neighbours, and the rank of its
    # pair with the next one; barriers are empty.
    symbol = [v.singles[x] for x in data.tolist()]
    for e in ends.tolist():
        symbol[e] = b""
    behind, before, ranked = list(range(1, n + 1)), list(range(-1, n - 1)), rank.tolist() + [-1]
    starts, at = first.tolist(), np.nonzero(rank >= 0)[0]
    at = at[np.argsort(rank[at], kind="stable")]
    kinds, cut = np.unique(rank[at], return_index=True)
    index = {int(k): p.tolist() for k, p in zip(kinds, np.split(at, cut[1:]))} if len(at) else {}
    heap = list(index)
    heapify(heap)
    of, token = v.rank.get, v.token
    while heap:
        r = heappop(heap)
        positions, made = index.pop(r), token[r]
        positions.sort()
        waiting: set[int] = set()
        later = []
        for p in positions:
            if ranked[p] != r:
                continue
            if waiting and bisect_right(starts, p) in waiting:
                later.append(p)
                continue
            q = behind[p]
            after = behind[p] = behind[q]
            before[after], symbol[p], ranked[q], ranked[p] = p, made, -1, -1
            lead = before[p]
            for x, pair in ((lead, symbol[lead] + made if symbol[lead] else None),
                            (p, made + symbol[after] if symbol[after] else None)):
                new = of(pair)
                if new is None:
                    if pair:
                        ranked[x] = -1
                    continue
                ranked[x] = new
                if new in index:
                    index[new].append(x)
                else:
                    index[new] = [x]
                    heappush(heap, new)
                if new < r:
                    waiting.add(bisect_right(starts, p))
        if later:
            index[r] = later
            heappush(heap, r)
    out = []
    for p, end in zip(starts, ends.tolist()):
        ids = []
        while p < end:
            ids.append(of(symbol[p]))
            p = behind[p]
        out.append(ids)
    return out


def encode_words(words: list[bytes], v: Vocabulary) -> list[bytes]:
    """Ids of distinct words as bytes; those in the vocabulary don't merge."""
    out = [v.rank.get(w) for w in words]
    rest = [k for k, r in enumerate(out) if r is None]
    merged = dict(zip(rest, replay([words[k] for k in rest], v))) if rest else {}
    return [np.array(merged[k] if r is None else [r], "<u4").tobytes() for k, r in enumerate(out)]


# -- words ------------------------------------------------------------------

class _Chunks(dict):
    """Chunk of a text -> the numbers of its words, as bytes. The chunks that
    follow a space are kept without it in ``spaced``."""

    def __init__(self, pattern: str, lead: str = "", numbers: Numbers | None = None) -> None:
        self.find, self.lead = regex.compile(pattern).findall, lead
        self.numbers = Numbers() if numbers is None else numbers
        self.spaced = self if lead else _Chunks(pattern, " ", self.numbers)

    def number(self, word: str) -> bytes:
        return self.numbers[word].to_bytes(4, "little")

    def __missing__(self, chunk: str) -> bytes:
        out = self.split(self.lead + chunk)
        if len(chunk) <= 64:
            self[chunk] = out
        return out

    def split(self, chunk: str) -> bytes:
        core = chunk.rstrip(MARKS)
        word = core[1:] if core[:1] == " " else core
        if word.isalpha() and max(word) < "\u0250":  # what most chunks are: a word, and marks
            return self.number(core) + self.number(chunk[len(core):]) if len(core) < len(chunk) else self.number(core)
        line, _, next_line = chunk.partition("\n")
        if line and next_line and not (line[-1].isspace() or next_line[0].isspace()):  # the break is a word
            return self.split(line) + self.number("\n") + self.split(next_line)
        return b"".join(map(self.number, self.find(chunk)))

    def of(self, text: str) -> bytes:
        if ODD.search(text) or text[:1] == " ":
            return b"".join(map(self.__getitem__, CUT.split(text)))
        head, *rest = text.split(" ")
        return b"".join(chain([self[head]], map(self.spaced.__getitem__, rest)))


# -- encoding and decoding --------------------------------------------------

IDS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("ids", pa.binary())])


def encoded_words(words: DataFrame, path: str) -> DataFrame:
    """(block, bucket, ids) from (block, bucket, words): every distinct word
    is encoded once, in the task that all its bucket's rows go to."""

    def run(batches):
        v = vocabulary(path)
        for rows in whole_buckets(batches, ("block", "bucket", "words"), SYMBOLS):
            own = [parted(w) for _, _, w in rows]
            new = list(dict.fromkeys(chain.from_iterable(own)))
            ids, a, size = {}, 0, 0
            for k, w in enumerate(new):
                size += len(w)
                if size >= SYMBOLS or k + 1 == len(new):
                    ids.update(zip(new[a:k + 1], encode_words(new[a:k + 1], v)))
                    a, size = k + 1, 0
            out = [joined(list(map(ids.__getitem__, x))) for x in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(list(IDS)[:2])]
                + [pa.array(out, pa.binary())], schema=IDS)

    return (words.repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(run, "block long, bucket int, ids binary"))


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                     ("decoded_sha256", pa.string())])


def _put_back(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, schema: pa.Schema,
              finished: Callable) -> DataFrame:
    """Blocks' documents from their words' ids: ``finished`` of a document's
    ids gives what follows doc_id and n_tokens."""
    blocks = blocks_of(docs, lambda: _Chunks(pattern), id_col, text_col)

    def put_back(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        by_bucket = sorted(zip(right.column("bucket").to_pylist(), right.column("ids").to_pylist()))
        of = [x for _, data in by_bucket for x in parted(data)]
        row = left.to_pylist()[0]
        numbers, at, sizes, out = block_numbers(row["counts"], row["ranks"]), 0, [], []
        for n in row["sizes"]:
            ids = b"".join(map(of.__getitem__, numbers[at:at + n].tolist()))
            at += n
            sizes.append(len(ids) // 4)
            out.append(finished(ids))
        cols = [row["doc_ids"], sizes, *zip(*out)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    types = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return (blocks.select(*DOCUMENTS).groupBy("block")
            .cogroup(encoded_words(bucketed_words(blocks), path).groupBy("block"))
            .applyInArrow(put_back, ", ".join(f"{f.name} {types[f.type]}" for f in schema)))


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens and ids (binary: little-endian
    unsigned 32-bit)."""
    return _put_back(docs, path, pattern, id_col, text_col, ENCODED, lambda ids: (ids,))


def bytes_of(ids: bytes, v: Vocabulary) -> bytes:
    return b"".join(map(v.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decoded(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that their ids stand for; an id that the
    vocabulary lacks is an error, null ids give null."""
    if text_col in rows.columns:
        raise ValueError(f"{text_col} is a column already")

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            out = [None if x is None else bytes_of(x, v) for x in batch.column(ids_col).to_pylist()]
            yield batch.append_column(text_col, pa.array(out, pa.binary()))

    schema = rows.withColumn(text_col, F.lit(None).cast("binary")).schema
    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded and again
    decoded texts, made where the ids are."""

    def hashed(ids: bytes) -> tuple[str, str]:
        return hashlib.sha256(ids).hexdigest(), hashlib.sha256(bytes_of(ids, vocabulary(path))).hexdigest()

    return _put_back(docs, path, pattern, id_col, text_col, DIGESTS, hashed)
