"""Benchmark decontamination by MinHash containment search.

Items are short, documents long, so a document's own MinHash says nothing about
an item inside it. The signature is therefore the item's: its smallest shingle
hashes, as many as its size class asks for. Size classes are powers of two of
the item's shingle count. The share of an item's signature found in a document
estimates the containment without bias; a document is a candidate for an item
once enough of it is found that a containment of ``threshold`` cannot fall
short. Candidates are verified by exact shingle containment: distinct shingles
of the item found anywhere in the document, over all distinct shingles of the
item.

Items are worked off in blocks of at most ``BLOCK_SHINGLES`` shingles, so what
the tasks hold is bounded whatever the benchmark; documents are read once per
block and never cross the network.

Cases: a null or empty item matches nothing; a null text holds nothing; an item
of fewer than five words is one shingle of all its words, sought among the
document's runs of as many; equal items are reported each; repeated rows give a
match each; empty tables give no matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapcast.llm.common import SHINGLE, SIMILAR, doc_columns, shingle_hashes, word_hashes

#: Item shingles that a task holds at once (8 bytes each, and their postings).
BLOCK_SHINGLES = 4_000_000
#: Signature length of the smallest size class; each class above has half as
#: many again.
SIGNATURE = 32


def signature_size(n: int, threshold: float = SIMILAR) -> int:
    """Hashes of an item of ``n`` shingles: all of a small item; of a larger
    one a bottom sample that grows with its size class, and always more than
    the ``(1 - threshold) * n`` that a match may lack."""
    size_class = max(n, 1).bit_length() - 1
    grown = int(SIGNATURE * 1.5 ** max(0, size_class - 5))
    return min(n, max(grown, int((1 - threshold) * n) + 8))


class ItemIndex:
    """A block of items: signatures, and all shingles for verification."""

    def __init__(self, ids: list, texts: list[bytes], size: int, threshold: float) -> None:
        self.threshold, self.size, self.ids, self.all, self.widths = threshold, size, [], [], []
        hashes, owners, need = [], [], []
        for i, text in zip(ids, texts):
            words = word_hashes(text)
            if not len(words):
                continue
            full = np.unique(shingle_hashes(words, size))
            k = signature_size(len(full), threshold)
            lacking = len(full) - int(np.ceil(threshold * len(full) - 1e-9))
            hashes.append(full[:k])  # np.unique sorts: these are the smallest
            owners.append(np.full(k, len(self.ids)))
            need.append(max(1, k - lacking))
            self.ids.append(i)
            self.all.append(full)
            self.widths.append(min(size, len(words)))
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.need = np.array(need, np.int64)
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.owners = (np.concatenate(owners) if owners else np.zeros(0, np.int64))[order]

    def matches(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, shared, item's shingles) of the verified items."""
        if not len(words) or not self.ids:
            return []
        runs = [shingle_hashes(words, w) for w in sorted(set(self.widths)) if w <= len(words)]
        if not runs:
            return []
        found = np.concatenate(runs)
        lo = np.searchsorted(self.hashes, found)
        lo[lo == len(self.hashes)] = 0
        found = np.unique(found[self.hashes[lo] == found]) if len(self.hashes) else found[:0]
        if not len(found):
            return []
        a, b = np.searchsorted(self.hashes, found), np.searchsorted(self.hashes, found, side="right")
        hits = np.concatenate([self.owners[x:y] for x, y in zip(a, b)])
        count = np.bincount(hits, minlength=len(self.ids))
        out = []
        whole = None
        for item in np.nonzero(count >= self.need)[0]:
            if whole is None:
                whole = np.unique(np.concatenate(runs))
            full = self.all[item]
            shared = len(np.intersect1d(full, whole, assume_unique=True))
            if shared >= self.threshold * len(full) - 1e-9:
                out.append((int(item), shared, len(full)))
        return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, block: int) -> Iterator[tuple[list, list]]:
    """The items in blocks of bounded size, one block at a time on the driver
    (a text has fewer shingles than half its bytes, plus one)."""
    ids, texts, held = [], [], 0
    for r in doc_columns(items, id_col, text_col).toLocalIterator():
        ids.append(r[0])
        texts.append(bytes(r[1]))
        held += len(r[1]) // 2 + 1
        if held >= block:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_id: str = "item_id", item_text: str = "text", size: int = SHINGLE,
          threshold: float = SIMILAR, block: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, shared,
    item_shingles, containment."""
    ddl = "doc_id long, item_id long, shared long, item_shingles long, containment double"
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("shared", pa.int64()),
                        ("item_shingles", pa.int64()), ("containment", pa.float64())])
    texts = doc_columns(docs, id_col, text_col)
    out = docs.sparkSession.createDataFrame([], ddl)
    for ids, bodies in item_blocks(items, item_id, item_text, block):
        sent = docs.sparkSession.sparkContext.broadcast((ids, bodies))

        def search(batches, sent=sent):
            index = ItemIndex(*sent.value, size, threshold)
            for batch in batches:
                found = [(i, index.ids[m], s, n, s / n)
                         for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"))
                         for m, s, n in index.matches(word_hashes(t.as_py()))]
                cols = list(zip(*found)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)],
                                                 schema=schema)

        out = out.unionByName(texts.mapInArrow(search, ddl))
    return out


def kept(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
         item_text: str = "text", size: int = SHINGLE, threshold: float = SIMILAR,
         block: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are: one
    pass per block of items, no exchange."""
    schema = docs.schema
    for ids, bodies in item_blocks(items, item_id, item_text, block):
        sent = docs.sparkSession.sparkContext.broadcast((ids, bodies))

        def clean(batches, sent=sent):
            index = ItemIndex(*sent.value, size, threshold)
            for batch in batches:
                texts = batch.column(text_col).cast(pa.binary()).to_pylist()
                yield batch.filter(pa.array([not index.matches(word_hashes(t or b"")) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(clean, schema)
    return docs
