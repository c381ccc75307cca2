"""Alignment of two tokenizers' tokens over a corpus.

A text is tokenized by A (byte-level BPE, with a space in front) and by B
(pieces, which adds that space). Where tokens of both end at the same byte the
text is cut into groups; an A and a B token whose byte ranges overlap are
linked. A pair's count is the number of documents that link it.

Both tokenizers start a new token at a space behind any character that is no
white space, so a text's alignment is that of its chunks. Documents are kept as
blocks of chunk numbers; every distinct chunk of the corpus is tokenized and
aligned once, in the task of its bucket, and sent to the blocks that hold it.

1. Each task sends its chunks' distinct pairs; Spark's distinct pairs are dealt
   to shards by their A id.
2. Each shard's pairs get a minimal perfect hash: levels of bit arrays, a pair's
   slot being the rank of the first bit that it has for itself. The pairs, in
   slot order, verify every lookup.
3. First pass: documents are put together from their chunks; a block counts
   its documents' distinct pairs in one dense vector over a shard's slots, and
   vectors are summed in parts of slots, by trees of ``FAN``.
4. Second pass: documents are put together again and their links' counts
   looked up.

A hash with its pairs and counts is broadcast: a shard holds about
``SHARD_PAIRS`` pairs (an A id has no more than B has ids), so its size is
bounded; with more pairs there are more shards, taken one after the other, and
their documents' sums are added.

Cases: null and empty texts, and texts whose tokens don't spell them (U+2581 in
the text), have no tokens; null ids and repeated rows are kept as they are; an
empty table gives no rows; other columns are ignored; a very long text is a
block of its own.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapcast.llm.blocks import (DOCUMENTS, Numbers, block_buckets, block_numbers, blocks_of, bucketed_words, joined,
                                parted, whole_buckets)
from tapcast.llm.common import _byte_chars, claim, keeps, mix, release, shared_path, worker_task
from tapcast.session import materialize

#: Pairs of a shard; slots of a vector's part; vectors summed at once.
SHARD_PAIRS, PART, FAN = 4_000_000, 1 << 16, 32
#: Bytes of chunks aligned side by side, and links that are sorted at a time.
CHUNKS, LINKS = 1 << 20, 500_000
CUT = re.compile(r"(?<=\S)(?= )")
ODD = re.compile(r"\s ")
_G = np.uint64(0x9E3779B97F4A7C15)


# -- minimal perfect hash ---------------------------------------------------

class PerfectHash:
    """Slots 0 to n - 1 for n distinct 64-bit keys. Level k has a bit for each
    key that no other key of that level hashes to; the others go on to the
    next level. A slot is the number of set bits before a key's own."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        ones = np.bitwise_count(np.concatenate(levels)).astype(np.int64) if levels else np.zeros(0, np.int64)
        before = np.cumsum(ones) - ones
        self.before = np.split(before, np.cumsum([len(x) for x in levels])[:-1]) if levels else []

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], np.asarray(keys, np.uint64)
        while len(rest):
            size = 64 * -(-2 * len(rest) // 64)  # two bits a key
            at = cls._at(rest, len(levels), size)
            own = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[own]] = 1
            levels.append(np.packbits(bits, bitorder="little").view("<u8"))
            rest = rest[~own]
        return cls(levels)

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(keys * _G + np.uint64(level + 1)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key (for unknown keys some slot, or -1)."""
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        keys = np.asarray(keys, np.uint64)
        for k, (words, before) in enumerate(zip(self.levels, self.before)):
            at = self._at(keys[rest], k, 64 * len(words))
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            low = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[rest[hit]] = before[at[hit] >> 6] + np.bitwise_count(low)
            rest = rest[~hit]
            if not len(rest):
                break
        return out

    def to_bytes(self) -> tuple[list[int], bytes]:
        return [len(x) for x in self.levels], b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, sizes: list[int], data: bytes) -> PerfectHash:
        words = np.frombuffer(data, "<u8")
        return cls(np.split(words, np.cumsum(sizes)[:-1]) if len(sizes) else [])


class Shard:
    """A shard's hash, its keys by slot, and later their counts."""

    def __init__(self, hashed: PerfectHash, keys: np.ndarray) -> None:
        self.hashed, self.keys, self.counts, self.best = hashed, keys, None, None

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Verified slots; a key that isn't in the shard is an error."""
        at = self.hashed.slots(keys)
        if len(at) and ((at < 0).any() or (self.keys[at] != keys).any()):
            raise ValueError("a pair is not in its shard")
        return at

    def counted(self, counts: np.ndarray, b_size: int) -> Shard:
        """With counts, and which are the highest of their A id."""
        a = self.keys // np.uint64(b_size)
        order = np.argsort(a, kind="stable")
        first = np.nonzero(np.r_[True, a[order][1:] != a[order][:-1]])[0] if len(a) else np.zeros(0, np.int64)
        top = np.maximum.reduceat(counts[order], first) if len(a) else counts
        best = np.zeros(len(a), bool)
        best[order] = counts[order] == np.repeat(top, np.diff(np.r_[first, len(a)]))
        self.counts, self.best = counts, best
        return self


# -- aligning ---------------------------------------------------------------

class Chunker(dict):
    """Texts to chunk numbers; a chunk is kept without its first space."""

    def __init__(self) -> None:
        self.numbers = Numbers()

    def __missing__(self, chunk: str) -> bytes:
        out = self[chunk] = self.numbers[chunk].to_bytes(4, "little")
        return out

    def of(self, text: str) -> bytes:
        if not text:
            return b""
        if ODD.search(text) or text[0] == " ":
            return b"".join([self[c[1:]] for c in CUT.split(" " + text)])
        return b"".join(map(self.__getitem__, text.split(" ")))


class Aligner:
    """Chunks (without their first space) to links and groups."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {c: b for b, c in _byte_chars().items()}
        # Special tokens never occur: their strings are ordinary text.
        spelled = {i: bytes(byte[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()
                   if all(c in byte for c in t)}
        self.a_bytes = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.b_size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.b_size)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(t) for t in side]) for side in (self.a_bytes, self.b_bytes))
        self.space, self.line = self.b.piece_to_id("▁"), self.b.piece_to_id("<0x0A>")
        # Every id with what may stand behind it in a text of groups.
        self.said = [b"%d%s" % (i, mark) for n, marks in ((len(self.a_bytes), (b",", b"|")), (self.b_size, (b",", b";")))
                     for mark in marks for i in range(n)]
        self.said_len = np.array([len(x) for x in self.said])

    def tokens(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides. B reads chunks as lines of one text: a line end
        is a token of its own there."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)]
        easy = [c != "" and "\n" not in c for c in chunks]
        lines = [c for c, e in zip(chunks, easy) if e]
        ids = np.array(self.b.encode("\n ".join(lines)), np.int64)
        ends = np.nonzero(ids == self.line)[0]
        ids = ids.tolist()
        of_lines = iter([ids[x:y] for x, y in zip([0, *(ends + 1).tolist()], [*ends.tolist(), len(ids)])])
        return a, [next(of_lines) if e else self.b.encode(c) if c else [self.space] for c, e in zip(chunks, easy)]

    def aligned(self, chunks: list[str]) -> list[tuple[bytes, bytes, int, int]]:
        """(links, groups, A tokens, B tokens) of each chunk; no tokens where
        they don't spell it."""
        out = [(b"", b"", 0, 0)] * len(chunks)
        a, b = self.tokens(chunks)
        raw = [b" " + c.encode("utf-8", "replace") for c in chunks]
        good = [k for k, want in enumerate(raw) if b"".join([self.a_bytes[i] for i in a[k]]) == want
                and b"".join([self.b_bytes[j] for j in b[k]]) == want]
        if not good:
            return out
        n_a, n_b = np.array([len(a[k]) for k in good]), np.array([len(b[k]) for k in good])
        x, y = (np.fromiter(chain.from_iterable(t[k] for k in good), np.int64, int(n.sum())) for t, n in ((a, n_a), (b, n_b)))
        end_x, end_y = np.cumsum(self.a_len[x]), np.cumsum(self.b_len[y])  # chunks stand behind each other
        low = np.searchsorted(end_y, end_x - self.a_len[x], "right")
        many = np.searchsorted(end_y - self.b_len[y], end_x, "left") - low
        first = np.cumsum(many) - many
        partner = np.arange(int(many.sum())) + np.repeat(low - first, many)
        links = (np.repeat(x, many) * self.b_size + y[partner]).astype("<u4")
        link_end = np.cumsum(many)[np.cumsum(n_a) - 1]
        # Texts of groups: A ids, a bar, B ids, a semicolon.
        both = np.intersect1d(end_x, end_y, assume_unique=True)
        group_x, group_y = np.searchsorted(both, end_x), np.searchsorted(both, end_y)
        in_x, in_y = np.bincount(group_x, minlength=len(both)), np.bincount(group_y, minlength=len(both))
        place_x = np.arange(len(x)) + (np.cumsum(in_y) - in_y)[group_x]
        place_y = np.arange(len(y)) + np.cumsum(in_x)[group_y]
        said = np.empty(len(x) + len(y), np.int64)
        n = len(self.a_bytes)
        said[place_x] = x + n * (end_x == both[group_x])
        said[place_y] = 2 * n + y + self.b_size * (end_y == both[group_y])
        text = b"".join(map(self.said.__getitem__, said.tolist()))
        text_end = np.cumsum(self.said_len[said])[np.cumsum(n_a + n_b) - 1].tolist()
        for k, p, q, u, v, i, j in zip(good, [0, *link_end[:-1].tolist()], link_end.tolist(), [0, *text_end[:-1]], text_end,
                                       n_a.tolist(), n_b.tolist()):
            out[k] = (links[p:q].tobytes(), text[u:v - 1], i, j)
        return out


@lru_cache(maxsize=1)
def _loaded(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


keeps("alignments", _loaded.cache_clear)


def aligner(a_path: str, b_path: str) -> Aligner:
    """This process's aligner; other operators' tasks drop it."""
    claim("alignments")
    return _loaded(a_path, b_path)


ALIGNED = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("links", pa.binary()), ("groups", pa.binary()),
                     ("sizes", pa.binary())])
ALIGNED_DDL = "block long, bucket int, links binary, groups binary, sizes binary"


def aligned_chunks(blocks: DataFrame, parts: int, a_path: str, b_path: str) -> DataFrame:
    """Each block's alignments of its chunks, by bucket: links and groups of
    each, and token counts of either side (little-endian unsigned 32-bit).
    Written once as a table bucketed as the blocks are."""

    def run(batches):
        own = aligner(a_path, b_path)
        for rows in whole_buckets(batches, ("block", "bucket", "words"), CHUNKS):
            held = [parted(w) for _, _, w in rows]
            new = list(dict.fromkeys(chain.from_iterable(held)))
            known, a, size = {}, 0, 0
            for k, w in enumerate(new):
                size += len(w)
                if size >= CHUNKS or k + 1 == len(new):
                    known.update(zip(new[a:k + 1], own.aligned([w.decode() for w in new[a:k + 1]])))
                    a, size = k + 1, 0
            cols = [[r[0] for r in rows], [r[1] for r in rows], [], [], []]
            for words in held:
                links, groups, n_a, n_b = zip(*map(known.__getitem__, words))
                cols[2].append(joined(links))
                cols[3].append(joined(groups))
                cols[4].append(np.array([n_a, n_b], "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ALIGNED)], schema=ALIGNED)

    spark = blocks.sparkSession
    rows = (bucketed_words(blocks).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, ALIGNED_DDL))
    name = f"tapcast_alignments_{uuid.uuid4().hex}"
    (rows.repartition(parts, "block").write.bucketBy(parts, "block").option("compression", "zstd")
     .option("path", shared_path(spark, "alignments")).saveAsTable(name))
    return spark.table(name)


class Block:
    """A block's documents over its chunks' alignments."""

    def __init__(self, left: pa.Table, right: pa.Table, with_groups: bool) -> None:
        row = left.to_pylist()[0]
        self.numbers, self.doc_ids = block_numbers(row["counts"], row["ranks"]), row["doc_ids"]
        self.sizes = np.array(row["sizes"], np.int64)
        order = np.argsort(right.column("bucket").to_numpy(), kind="stable")
        column = lambda c: (right.column(c)[int(k)].as_py() for k in order)
        # A string's parts are their lengths, then their bytes.
        links = [(np.frombuffer(x, "<u4", int.from_bytes(x[:4], "little"), 4),
                  np.frombuffer(x, "<u4", -1, 4 + 4 * int.from_bytes(x[:4], "little"))) for x in column("links")]
        self.many = np.concatenate([n for n, _ in links] or [np.zeros(0)]).astype(np.int64) // 4
        self.links = np.concatenate([x for _, x in links] or [np.zeros(0, np.uint32)])
        self.first = np.cumsum(self.many) - self.many
        pairs = [np.frombuffer(x, "<u4").reshape(2, -1) for x in column("sizes")]
        self.n_a, self.n_b = (np.concatenate([x[k] for x in pairs] or [np.zeros(0)]).astype(np.int64) for k in (0, 1))
        self.groups = [x for data in column("groups") for x in parted(data)] if with_groups else None
        # A document with a chunk that isn't spelled has no tokens.
        self.ends = np.cumsum(self.sizes)
        bad = np.concatenate([[0], np.cumsum(self.n_a[self.numbers] == 0)]) if len(self.numbers) else np.zeros(1, np.int64)
        self.spelled = (bad[self.ends] == bad[self.ends - self.sizes]) & (self.sizes > 0)

    def sums(self, of_chunk: np.ndarray) -> np.ndarray:
        """Each document's sum of its chunks' values; 0 without tokens."""
        total = np.concatenate([[0], np.cumsum(of_chunk[self.numbers])]).astype(np.int64)
        return np.where(self.spelled, total[self.ends] - total[self.ends - self.sizes], 0)

    def document_slots(self, slot: np.ndarray):
        """The distinct slots (0 and up) of documents' links, some documents
        at a time; ``slot`` has one for each of the chunks' links."""
        per_doc = self.sums(self.many)
        at = np.nonzero(self.spelled)[0]
        cut = np.cumsum(per_doc[at]) // LINKS
        for docs in np.split(at, np.nonzero(np.diff(cut))[0] + 1) if len(at) else ():
            numbers = np.concatenate([self.numbers[self.ends[d] - self.sizes[d]:self.ends[d]] for d in docs])
            many = self.many[numbers]
            first = np.cumsum(many) - many
            own = slot[np.arange(int(many.sum())) + np.repeat(self.first[numbers] - first, many)]
            doc = np.repeat(np.arange(len(docs)), per_doc[docs])
            doc, own = doc[own >= 0], own[own >= 0]
            yield np.unique(doc << 32 | own) & 0xFFFFFFFF


def shard_of(keys: np.ndarray, b_size: int, shards: int) -> np.ndarray:
    """A pair's shard: a hash of its A id."""
    return (mix(keys.astype(np.uint64) // np.uint64(b_size) + _G) % np.uint64(shards)).astype(np.int64)


# -- counting ---------------------------------------------------------------

def distinct_pairs(alignments: DataFrame) -> DataFrame:
    """All pairs that any chunk links, each once: (pair)."""

    @worker_task()
    def run(batches):
        for batch in batches:
            links = [x for data in batch.column("links").to_pylist() for x in parted(data)]
            pairs = np.unique(np.frombuffer(b"".join(links), "<u4"))
            yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64))], names=["pair"])

    return alignments.select("links").mapInArrow(run, "pair long").distinct()


def hashed_shards(pairs: DataFrame, b_size: int, shards: int) -> DataFrame:
    """One row per shard: its perfect hash and its keys in slot order."""

    def deal(batches):
        for batch in batches:
            keys = batch.column("pair").to_numpy()
            yield batch.append_column("shard", pa.array(shard_of(keys, b_size, shards)))

    def build(t: pa.Table) -> pa.Table:
        claim()
        keys = t.column("pair").to_numpy().astype(np.uint64)
        h = PerfectHash.build(keys)
        by_slot = np.zeros(len(keys), "<u4")
        by_slot[h.slots(keys)] = keys
        sizes, levels = h.to_bytes()
        return pa.table([t.column("shard").slice(0, 1), pa.array([sizes], pa.list_(pa.int32())),
                         pa.array([levels], pa.binary()), pa.array([by_slot.tobytes()], pa.binary())],
                        names=["shard", "sizes", "levels", "keys"])

    return (pairs.mapInArrow(deal, "pair long, shard long").groupBy("shard")
            .applyInArrow(build, "shard long, sizes array<int>, levels binary, keys binary"))


def _summed(t: pa.Table) -> pa.Table:
    total = np.zeros(PART, np.int64)
    for x in t.column("counts").to_pylist():
        total += np.frombuffer(x, "<i8")
    return pa.table([t.column("part").slice(0, 1), t.column("leaf").slice(0, 1),
                     pa.array([total.tobytes()], pa.binary())], names=["part", "leaf", "counts"])


def _slots(links: np.ndarray, shard: Shard, b_size: int, number: int, shards: int) -> np.ndarray:
    """Verified slots of links; -1 for those of other shards."""
    if shards == 1:
        return shard.slots(links)
    own = shard_of(links, b_size, shards) == number
    out = np.full(len(links), -1, np.int64)
    out[own] = shard.slots(links[own])
    return out


def pair_counts(blocks: DataFrame, alignments: DataFrame, shard: Shard, b_size: int, number: int,
                shards: int) -> np.ndarray:
    """Documents that link each pair of the shard, by slot."""
    sent = blocks.sparkSession.sparkContext.broadcast(shard)
    leaves = max(1, blocks.count())

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        claim()
        held = sent.value
        counts = np.zeros(-(-len(held.keys) // PART) * PART, np.int64)
        if left.num_rows:
            block = Block(left, right, with_groups=False)
            for own in block.document_slots(_slots(block.links, held, b_size, number, shards)):
                np.add.at(counts, own, 1)
        rows = counts.reshape(-1, PART)
        at = np.nonzero(rows.any(axis=1))[0]
        leaf = np.full(len(at), int(mix(left.column("block")[0].as_py())) % leaves if left.num_rows else 0)
        out = pa.table([pa.array(at), pa.array(leaf), pa.array([rows[k].tobytes() for k in at], pa.binary())],
                       names=["part", "leaf", "counts"])
        release()
        return out

    ddl = "part long, leaf long, counts binary"
    rows = materialize(blocks.select(*DOCUMENTS).groupBy("block")
                       .cogroup(alignments.select("block", "bucket", "links", "sizes").groupBy("block"))
                       .applyInArrow(run, ddl))
    while leaves > 1:
        leaves = -(-leaves // FAN)
        rows = (rows.withColumn("leaf", F.floor(F.col("leaf") / FAN)).groupBy("part", "leaf")
                .applyInArrow(_summed, ddl))
    out = np.zeros(-(-len(shard.keys) // PART) * PART, np.int64)
    for r in rows.collect():  # one vector of the shard's slots
        out[r["part"] * PART:(r["part"] + 1) * PART] += np.frombuffer(r["counts"], "<i8")
    return out[:len(shard.keys)]


# -- documents --------------------------------------------------------------

DONE = pa.schema([("block", pa.int64()), ("pos", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()),
                  ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()),
                  ("count_sum", pa.int64()), ("groups", pa.binary())])


def looked_up(blocks: DataFrame, alignments: DataFrame, shard: Shard, b_size: int, number: int, shards: int,
              with_groups: bool) -> DataFrame:
    """Per document: its sizes, and how many of its links of this shard are
    their A id's best, and their counts' sum."""
    sent = blocks.sparkSession.sparkContext.broadcast(shard)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        claim()
        if not left.num_rows:
            return DONE.empty_table()
        held, own = sent.value, Block(left, right, with_groups=True)
        slot = _slots(own.links, held, b_size, number, shards)
        here = slot >= 0
        of_chunk = np.repeat(np.arange(len(own.many)), own.many)[here]
        best = np.bincount(of_chunk, held.best[slot[here]], len(own.many))
        total = np.zeros(len(own.many), np.int64)
        np.add.at(total, of_chunk, held.counts[slot[here]])
        a, b, links = own.sums(own.n_a), own.sums(own.n_b), own.sums(own.many)
        groups = []
        for ok, end, size in zip(own.spelled.tolist(), own.ends.tolist(), own.sizes.tolist()):
            said = b";".join(map(own.groups.__getitem__, own.numbers[end - size:end].tolist())) if ok else b""
            groups.append(said if with_groups else hashlib.sha256(said).hexdigest().encode() if said else b"")
        n = len(own.doc_ids)
        # A group of x and y tokens has x + y - 1 links.
        cols = [np.full(n, left.column("block")[0].as_py()), np.arange(n), own.doc_ids, a, b, a + b - links, links,
                own.sums(best.astype(np.int64)), own.sums(total), groups]
        out = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, DONE)], schema=DONE)
        own = cols = groups = None
        release()
        return out

    return (blocks.select(*DOCUMENTS).groupBy("block")
            .cogroup(alignments.groupBy("block"))
            .applyInArrow(run, "block long, pos long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                               "n_best long, count_sum long, groups binary"))


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
            with_groups: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, and groups (``a1,a2|b1;a3|b2``) or their SHA-256."""
    b_size = Aligner(a_path, b_path).b_size
    parts = block_buckets(docs, text_col)
    blocks = blocks_of(docs, Chunker, id_col, text_col, parts)
    alignments = aligned_chunks(blocks, parts, a_path, b_path)
    pairs = materialize(distinct_pairs(alignments))
    shards = max(1, -(-pairs.count() // SHARD_PAIRS))
    table = materialize(hashed_shards(pairs, b_size, shards))
    done = []
    for k in range(shards):
        r = table.where(F.col("shard") == k).first()  # bounded by SHARD_PAIRS
        shard = Shard(PerfectHash.from_bytes(r["sizes"], r["levels"]) if r else PerfectHash([]),
                      np.frombuffer(r["keys"], "<u4") if r else np.zeros(0, np.uint32))
        shard.counted(pair_counts(blocks, alignments, shard, b_size, k, shards), b_size)
        part = looked_up(blocks, alignments, shard, b_size, k, shards, with_groups)
        done.append(part if shards == 1 else materialize(part))
    rows = done[0]
    if shards > 1:  # a document's sums of all shards
        for part in done[1:]:
            rows = rows.unionByName(part)
        rows = rows.groupBy("block", "pos").agg(
            *[F.first(c).alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")],
            F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = "groups" if with_groups else "groups_sha256"
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                       F.col("groups").cast("string").alias(out))
