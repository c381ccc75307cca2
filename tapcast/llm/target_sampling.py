"""Importance resampling towards a target distribution.

Texts are bags of hashed word n-grams. A bucket's gain is the smoothed log
ratio of its share in the target texts to its share in the documents; a
document's weight is the mean gain of its n-grams. Documents are drawn without
replacement by adding Gumbel noise, a hash of the id, to the weights and taking
the highest scores.

The texts of a batch are joined with separators that no word holds. One regex
pass splits the whole buffer; a binary search of the words' places in the
documents' offsets gives each word's document, which masks n-grams across
documents before the buckets are counted. Word hashes are CRC-32s that go on
from one word to the next, so an n-gram costs one short call and is never put
together. A long buffer is split in windows, the last words carried over.

The corpus' bucket counts are one small vector per task, summed by Spark; gains
are a vector of ``buckets`` numbers, whatever the corpus' size. Ranks come from
a range exchange of scores and the partitions' row counts, never from one task.

Cases: a null text has no words; a null id hashes as an empty string, and comes
before others in ties; repeated rows count and are drawn each; texts without
n-grams have weight 0; without target texts all counts of the target are 0; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapcast.llm.common import doc_columns, ship_package, utf8, worker_task
from tapcast.session import materialize

BUCKETS, ORDER = 10_000, 2
#: Bytes that one regex pass splits (a longer word is taken whole).
WINDOW = 4 << 20
WORD = re.compile(rb"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)")
GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
SEPARATOR = b"\x00"


def ngrams(texts: list[bytes], order: int = ORDER):
    """Yields (words, documents, hashes): the documents that hold the next
    words' n-grams and the n-grams' CRC-32s, and of those how many have one
    word (they come first)."""
    data = SEPARATOR.join(texts).lower()
    offsets = np.cumsum([0] + [len(t) + len(SEPARATOR) for t in texts[:-1]])
    kept: list[bytes] = []
    kept_doc = np.zeros(0, np.int64)
    at = 0
    while at < len(data):
        end = len(data)
        if at + WINDOW < end:
            gap = GAP.search(data, at + WINDOW)
            end = gap.end() if gap else end
        pieces = WORD.split(data[at:end])
        places = at + np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))[:-1:2]
        words = kept + pieces[1::2]
        doc = np.concatenate([kept_doc, np.searchsorted(offsets, places, side="right") - 1])
        old, at = len(kept), end
        docs, hashes, state = [doc[old:]], [], list(map(crc32, words))
        hashes.append(np.array(state[old:], np.uint32))
        for k in range(1, order):
            state = list(map(crc32, words[k:], map(crc32, repeat(b" "), state[:-1])))
            new = max(0, old - k)  # n-grams that end in words of this window
            inside = doc[k + new:] == doc[new:len(doc) - k] if len(doc) > k else np.zeros(0, bool)
            docs.append(doc[k + new:][inside])
            hashes.append(np.array(state[new:], np.uint32)[inside])
        yield len(words) - old, np.concatenate(docs), np.concatenate(hashes)
        kept, kept_doc = words[len(words) - order + 1:], doc[len(words) - order + 1:]
        if order == 1:
            kept, kept_doc = [], kept_doc[:0]


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS,
                  order: int = ORDER) -> np.ndarray:
    """Feature counts of all texts by bucket (``buckets`` numbers)."""

    @worker_task()
    def counted(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, h in ngrams(batch.column("text").to_pylist(), order):
                total += np.bincount(h % np.uint32(buckets), minlength=buckets)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    ship_package(docs.sparkSession)
    texts = docs.select(utf8(F.col(text_col)).alias("text"))
    rows = texts.mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():  # at most one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1) * (s + n) / ((x + 1) * (t + n))))
                     for x, y in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of Gumbel noise, rounded down: a hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


WEIGHED = pa.schema([("doc_id", pa.int64()), ("xh", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()),
                     ("weight", pa.int64()), ("score", pa.int64())])
WEIGHED_DDL = "doc_id long, xh long, n_words long, n_features long, weight long, score long"


def weighed(docs: DataFrame, gain: np.ndarray, seed: int = 7, order: int = ORDER, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, xh (a hash of the text), n_words,
    n_features, weight and score."""
    buckets = np.uint32(len(gain))

    def score(batches):
        for batch in batches:
            size = batch.num_rows
            words, features, total = (np.zeros(size, np.int64) for _ in range(3))
            for n, doc, h in ngrams(batch.column("text").to_pylist(), order):
                words += np.bincount(doc[:n], minlength=size)
                features += np.bincount(doc, minlength=size)
                total += np.bincount(doc, gain[h % buckets], minlength=size).astype(np.int64)
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            extra = [noise(i, seed) for i in batch.column("doc_id").to_pylist()]
            cols = [words, features, weight, weight + np.array(extra, np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("xh"), *map(pa.array, cols)],
                                             schema=WEIGHED)

    return doc_columns(docs, id_col, text_col).withColumn("xh", F.xxhash64("text")).mapInArrow(score, WEIGHED_DDL)


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with their rank (1, 2, ...) by score, high to low, ties to the
    smaller id: a range exchange, then each partition numbers its own rows."""
    order = [F.desc("score"), F.asc("doc_id"), F.asc("xh"), F.asc("row")]

    def numbered(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield (batch.append_column("part", pa.array(np.full(n, part, np.int32)))
                   .append_column("at", pa.array(np.arange(at, at + n))))
            at += n

    ddl = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", row long, part int, at long"
    # The row's number parts equal rows, however many there are.
    own = materialize(rows.withColumn("row", F.monotonically_increasing_id())
                      .repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(numbered, ddl))
    sizes = own.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row a partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return own.join(before, "part").select(*rows.columns, (F.col("before") + F.col("at") + 1).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7,
              buckets: int = BUCKETS, order: int = ORDER, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """Every row of ``docs``: doc_id, xh, n_words, n_features, weight, score,
    and rank among the ``percent`` per cent of texts of ``least_words`` words
    or more that are drawn; the others' rank is null."""
    gain = gains(bucket_counts(docs, text_col, buckets, order), bucket_counts(target, text_col, buckets, order))
    rows = materialize(weighed(docs, gain, seed, order, id_col, text_col))
    fit = rows.where(F.col("n_words") >= least_words)
    most = percent * fit.count() // 100
    drawn = ranked(fit).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return drawn.unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def selected(docs: DataFrame, target: DataFrame, percent: int = 25, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns; rows of
    equal id and text go together."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    drawn = (resampled(docs, target, percent, **options).where("rank is not null")
             .select(F.col("doc_id").alias("i"), F.col("xh").alias("x")).distinct())
    rows = docs.select(F.struct("*").alias("row"))
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")).cast("binary")
    same = F.col("row")[id_col].cast("long").eqNullSafe(F.col("i")) & (F.xxhash64(text) == F.col("x"))
    return rows.join(drawn, same, "left_semi").select("row.*")
