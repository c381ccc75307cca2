"""Repeated byte strings by distributed prefix doubling over sampled positions.

Every byte that lies in a string of ``length`` bytes which also starts earlier
(in a document of smaller id, or earlier in the same one) is removed. Matches
never cross documents.

Positions get ranks: equal ranks mean equal strings (64-bit hash names).
Doubling 1, 2, 4, ... ``SEED`` bytes needs only a document's own bytes, so it is
done where the document is read. From there only sampled positions go on: in
every run of ``length - SEED + 1`` positions those whose rank is smallest, so
equal strings of ``length`` bytes hold samples at equal places. Spark then
sorts (rank, next rank, position), the next rank naming all bytes that any
``length``-byte string around the sample can hold:

* a rank that occurs once is unique and dropped;
* equal pairs are past the threshold: all but the first position are repeats,
  with every string that owns them;
* equal ranks with different next ranks end inside the threshold, at the edge
  of a match. For these alone every string around the sample is named and
  compared, to the byte.

Ranks found twice in one input batch are settled there, so a string that fills
a third of the corpus sends one row per batch to its rank's group. For a rank
with very many edges (a common string in ever new surroundings) doubling goes
on: the range of starts of the strings around its samples is halved, each half
ranked by the bytes that all its strings share, unique ones dropped, and what
is still crowded is halved again, down to single strings.

Cases: a null text is empty; texts shorter than ``length`` keep all bytes; a
null id sorts first; rows of equal id go by a hash of their text; rows with
equal id and text are one document and give a row each; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapcast.llm.common import doc_columns, mix, ship_package, utf8, worker_task
from tapcast.session import materialize

#: Bytes of the string a sampled rank names: a power of two.
SEED = 32
#: Text bytes worked on at once; batches that settle repeats on the spot.
CHUNK, BATCH = 1 << 19, 1 << 25
_G = np.uint64(0x9E3779B97F4A7C15)


def ranks(data: np.ndarray) -> np.ndarray:
    """Names of the ``SEED``-byte strings at all positions that have one."""
    h = mix(data.astype(np.uint64) + np.uint64(1))
    k = 1
    while k < SEED:
        h = mix(h[:-k] * _G + h[k:])
        k *= 2
    return h


def _slide(a: np.ndarray, width: int, pick) -> np.ndarray:
    """Minima or maxima of all runs of ``width`` values, by doubling."""
    k = 1
    while 2 * k <= width:
        a = pick(a[:-k], a[k:])
        k *= 2
    rest = width - k
    return pick(a[:-rest], a[rest:]) if rest else a


def samples(h: np.ndarray, length: int) -> np.ndarray:
    """Positions whose rank is the smallest of some run of ranks that a
    ``length``-byte string holds (all of them in a tie)."""
    run = length - SEED + 1
    low = _slide(h, run, np.minimum)
    # A position is chosen if the largest of the minima over it is its own rank.
    edge = np.zeros(run - 1, np.uint64)
    return np.nonzero(_slide(np.concatenate([edge, low, edge]), run, np.maximum) == h)[0]


SAMPLES = pa.schema([("g", pa.int64()), ("w", pa.int64()), ("doc", pa.int64()), ("h", pa.int64()),
                     ("at", pa.int32()), ("settled", pa.bool_())])
SAMPLES_DDL = "g long, w long, doc long, h long, at int, settled boolean"


def _sample_rows(texts: DataFrame, length: int) -> DataFrame:
    """Samples of all documents: rank g, next rank w, position. Of equal
    (g, w) in a batch only the first competes further on; the others are
    settled repeats, and their g is a hash of the position instead."""

    @worker_task()
    def sampled(batches):
        held, size = [], 0

        def flush():
            g, w, doc, key, at = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((at, key, doc, w, g))
            same = (g[order][1:] == g[order][:-1]) & (w[order][1:] == w[order][:-1])
            first = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(g)), 0))
            lead = order[first]  # the first of each row's class
            again = np.zeros(len(g), bool)
            again[order] = (doc[lead] != doc[order]) | (key[lead] != key[order]) | (at[lead] != at[order])
            g = np.where(again, mix(doc.astype(np.uint64) * _G + at.astype(np.uint64)), g)
            w = np.where(again, np.uint64(0), w)
            cols = [g.view(np.int64), w.view(np.int64), doc, key, at.astype(np.int32), again]
            for a in range(0, len(g), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[a:a + 100_000], f.type, mask=(c[a:a + 100_000] == NO_ID) if f.name == "doc" else None)
                     for c, f in zip(cols, SAMPLES)], schema=SAMPLES)

        for batch in batches:
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            keys = batch.column("h").to_numpy(zero_copy_only=False)
            for doc, key, text in zip(ids, keys, batch.column("text")):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                size += len(data)
                if len(data) >= length:
                    for at, g, w in _document_samples(data, length):
                        held.append((g, w, np.full(len(at), doc), np.full(len(at), key), at))
                if size >= BATCH and held:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return texts.mapInArrow(sampled, SAMPLES_DDL)


#: Stands for a null id inside a batch; it sorts first, as null does.
NO_ID = -(2**63)


def _document_samples(data: np.ndarray, length: int):
    """(positions, ranks, next ranks) of one document, worked off in chunks
    that overlap so that each sees every run of ranks it decides on."""
    n, run = len(data), length - SEED + 1
    with np.errstate(over="ignore"):
        for a in range(0, max(1, n - SEED + 1), CHUNK):
            lo = max(0, a - length - run)
            hi = min(n, a + CHUNK + length + run + SEED)
            h = ranks(data[lo:hi])
            at = samples(h, length) + lo
            at = at[(at >= a) & (at < a + CHUNK)]
            yield at, h[at - lo], next_ranks(h, lo, n, at, length)


def next_ranks(h: np.ndarray, base: int, n: int, at: np.ndarray, length: int) -> np.ndarray:
    """Names of all bytes within ``length`` of a sample, cut at the ends of
    its document of ``n`` bytes; put together from ranks that overlap. The
    ranks ``h`` start at byte ``base``."""
    lo, hi = np.maximum(at - (length - SEED), 0), np.minimum(at + length, n) - SEED
    name = mix(((at - lo).astype(np.uint64) << np.uint64(32)) + (hi - at).astype(np.uint64))
    for step in range(-(length - SEED), length - SEED + 1, SEED):
        name = mix(name * _G + h[np.clip(at + step, lo, hi) - base])
    return mix(name * _G + h[hi - base])


#: Edge samples of one rank that a task compares at once; ranks with more are
#: doubled further.
GROUP = 4096


def _marks(rows: DataFrame) -> DataFrame:
    """Samples that are repeats (g null), and the first samples of each next
    rank where a rank has several: edges (g, and members of the rank's group).
    All others are unique and dropped."""
    pair = Window.partitionBy("settled", "g", "w").orderBy("doc", "h", "at")
    group = Window.partitionBy("settled", "g").orderBy("w").rangeBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.struct("doc", "h", "at")
    ranked = (rows.withColumn("repeat", F.col("settled") | ~F.first(place).over(pair).eqNullSafe(place))
              .withColumn("several", F.first("w").over(group) != F.last("w").over(group))
              .withColumn("members", F.count(F.lit(1)).over(group)))
    edge = ~F.col("repeat")
    return (ranked.where("repeat or several")
            .select(F.when(edge, F.col("g")).alias("g"), "doc", "h", "at",
                    F.when(edge, F.col("members")).alias("members")))


AROUND = pa.schema([("g", pa.int64()), ("doc", pa.int64()), ("h", pa.int64()), ("at", pa.int32()),
                    ("lo", pa.int32()), ("around", pa.binary())])
AROUND_DDL = "g long, doc long, h long, at int, lo int, around binary"


def _around(joined: DataFrame, length: int) -> DataFrame:
    """Edge samples with the bytes of all strings that hold them."""

    def cut(batches):
        for batch in batches:
            out = []
            for doc, key, text, edges in zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(),
                                             batch.column("text").to_pylist(), batch.column("edges").to_pylist()):
                for e in edges:
                    lo = max(0, e["at"] - (length - SEED))
                    out.append((e["g"], doc, key, e["at"], lo, text[lo:e["at"] + length]))
            cols = list(zip(*out)) or [[]] * len(AROUND)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, AROUND)], schema=AROUND)

    return joined.mapInArrow(cut, AROUND_DDL)


def edge_names(around: list[bytes], offset: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the ``length``-byte strings around samples, one row a sample,
    one column a start from ``length - SEED`` bytes before it up to itself; and
    which of them lie inside the document. ``offset``: bytes before the sample
    that are missing."""
    span = length - SEED
    full = np.zeros((len(around), span + length), np.uint8)
    size = np.array([len(x) for x in around])
    inside = np.arange(span + length)
    inside = (inside >= offset[:, None]) & (inside < (offset + size)[:, None])
    full[inside] = np.frombuffer(b"".join(around), np.uint8)
    h = mix(full.astype(np.uint64) + np.uint64(1))
    k = 1
    while k < SEED:
        h = mix(h[:, :-k] * _G + h[:, k:])
        k *= 2
    name = h[:, :span + 1]
    for step in [*range(SEED, span, SEED), span]:
        name = mix(name * _G + h[:, step:step + span + 1])
    starts = np.arange(span + 1)
    return name, (starts >= offset[:, None]) & (starts + length <= (offset + size)[:, None])


RANGES = pa.schema([("doc", pa.int64()), ("h", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])
RANGES_DDL = "doc long, h long, a int, b int"


def _edge_repeats(around: DataFrame, length: int) -> DataFrame:
    """Start ranges [a, b] of strings around edge samples that occur earlier.
    Rows come sorted by rank and position; a rank's rows stay together."""
    span = length - SEED

    def settle(t: pa.Table):
        g = t.column("g").to_numpy()
        at, lo = t.column("at").to_numpy(), t.column("lo").to_numpy()
        name, ok = edge_names(t.column("around").to_pylist(), lo - (at - span), length)
        with np.errstate(over="ignore"):
            key = mix(name * _G + mix(g.view(np.uint64))[:, None] + np.arange(span + 1, dtype=np.uint64))
        row, col = np.nonzero(ok)
        _, first, back = np.unique(key[row, col], return_index=True, return_inverse=True)
        lead = row[first][back]
        doc, h = t.column("doc").fill_null(NO_ID).to_numpy(), t.column("h").to_numpy()
        again = np.zeros((len(g), span + 3), np.int8)
        again[row, col + 1] = (doc[lead] != doc[row]) | (h[lead] != h[row]) | (at[lead] != at[row])
        change = np.diff(again, axis=1)
        (r, a), (_, b) = np.nonzero(change == 1), np.nonzero(change == -1)
        start = at[r] - span + a
        return pa.RecordBatch.from_arrays([t.column("doc").combine_chunks().take(pa.array(r)), pa.array(h[r]),
                                           pa.array(start.astype(np.int32)),
                                           pa.array((start + b - a - 1).astype(np.int32))], schema=RANGES)

    @worker_task()
    def compared(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            g = held.column("g").to_numpy()
            whole = int(np.searchsorted(g, g[-1])) if len(g) else 0  # the last rank may go on
            if whole >= GROUP:
                for a, b in _group_slices(g[:whole]):
                    yield settle(held.slice(a, b - a))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            for a, b in _group_slices(held.column("g").to_numpy()):
                yield settle(held.slice(a, b - a))

    return (around.repartition("g").sortWithinPartitions("g", "doc", "h", "at")
            .mapInArrow(compared, RANGES_DDL))


def _group_slices(g: np.ndarray):
    """Slices of about ``GROUP`` rows that end where a rank ends."""
    ends = np.r_[np.nonzero(g[1:] != g[:-1])[0] + 1, len(g)]
    a = 0
    while a < len(g):
        b = int(ends[min(np.searchsorted(ends, a + GROUP), len(ends) - 1)])
        yield a, b
        a = b


HALVES = pa.schema([*AROUND, ("first", pa.int32()), ("last", pa.int32())])
HALVES_DDL = AROUND_DDL + ", first int, last int"


def _halves(rows: DataFrame, length: int) -> DataFrame:
    """Each sample's strings, whose starts are ``first`` to ``last`` after the
    first one that can hold it, in two halves; a half is named by the bytes
    that all its strings share. Of equal halves in a batch one goes on; the
    others are repeats (g null)."""
    span = length - SEED

    @worker_task()
    def split(batches):
        for batch in batches:
            out, seen = [], set()
            items = zip(*(batch.column(c).to_pylist() for c in HALVES.names[1:]))
            for doc, key, at, lo, text, first, last in sorted(
                    items, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
                base, half = at - span - lo, (first + last) // 2
                for a, b in ((first, half), (half + 1, last)):
                    start, end = max(0, base + a), min(len(text), base + b + length)
                    if end - start < length:
                        continue  # the document ends within all of them
                    name = hashlib.blake2b(text[base + b:base + a + length], digest_size=8, salt=b"%d %d" % (a, b)).digest()
                    own = text[start:end]
                    same = (name, start - base, own)
                    g = None if same in seen else int.from_bytes(name, "little", signed=True)
                    seen.add(same)
                    out.append((g, doc, key, at, lo + start, own, a, b))
            cols = list(zip(*out)) or [[]] * len(HALVES)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, HALVES)], schema=HALVES)

    return rows.mapInArrow(split, HALVES_DDL)


def _crowded_repeats(around: DataFrame, length: int) -> DataFrame:
    """As ``_edge_repeats`` for ranks with any number of edges: the doubling
    goes on. The range of starts is halved step by step; a half whose shared
    bytes occur once is dropped, small groups are compared, and the crowded
    ones halved again, down to single strings, so rows follow real matches."""
    place, found = F.struct("doc", "h", "at"), []
    # Written first, so that no task runs two Python steps (and two workers).
    rows = materialize(around).withColumns({"first": F.lit(0), "last": F.lit(length - SEED)})
    while rows.limit(1).count():
        halves = materialize(_halves(rows.select(*HALVES.names), length))
        found.append(halves.where("g is null").select(
            "doc", "h", F.col("lo").alias("a"), (F.col("lo") + F.octet_length("around") - length).alias("b")))
        named = halves.where("g is not null")
        held = named.groupBy("g").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        shared = materialize(named.join(held, "g"))
        found.append(_edge_repeats(shared.where(F.col("members") <= GROUP).select(*AROUND.names), length))
        large = shared.where(F.col("members") > GROUP)
        single = large.where("first = last")
        lead = single.groupBy("g").agg(F.min(place).alias("lead"))
        found.append(single.join(lead, "g").where(~F.col("lead").eqNullSafe(place))
                     .select("doc", "h", F.col("lo").alias("a"), F.col("lo").alias("b")))
        rows = large.where("first < last")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def merged(a: np.ndarray, b: np.ndarray, n: int, length: int) -> list[tuple[int, int]]:
    """Maximal removed [start, end) of a text of ``n`` bytes from the start
    ranges [a, b] of its repeated strings."""
    a, b = np.maximum(a, 0).astype(np.int64), np.minimum(b, n - length).astype(np.int64)
    a, b = a[a <= b], b[a <= b] + length
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order]) if len(b) else b
    new = np.r_[True, a[1:] > b[:-1]] if len(a) else np.zeros(0, bool)
    last = np.r_[new[1:], True] if len(a) else new
    return list(zip(a[new].tolist(), b[last].tolist()))


def repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text",
            with_text: bool = False, whole_characters: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with
    ``with_text`` the kept bytes and ``rest``, a struct of the other columns of
    ``docs`` (with ``whole_characters`` less the bytes of characters that lost
    some); ``h`` tells texts of one id apart (0 where ids are unique)."""
    if length < 2 * SEED:
        raise ValueError(f"strings must have {2 * SEED} bytes at least")
    texts = doc_columns(docs, id_col, text_col)
    carried = docs
    if with_text:  # in both uses of the exchange below, so that it is made once
        ship_package(docs.sparkSession)
        others = [c for c in docs.columns if c != text_col]
        carried = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("text"),
                              F.struct(*others).alias("rest"))
    twice = texts.groupBy("doc_id").count().where("count > 1").limit(1).count()
    h = F.xxhash64("text") if twice else F.lit(0).cast("long")
    texts = texts.withColumn("h", h)
    carried = carried.withColumn("h", h) if with_text else texts
    marks = materialize(_marks(_sample_rows(texts, length)))
    crowded = marks.where(F.col("members") > GROUP).limit(1).count()

    spread = carried.repartition("doc_id", "h")
    own = [spread[c] for c in spread.columns]

    def with_lists(lists: DataFrame, how: str) -> DataFrame:
        same = spread.doc_id.eqNullSafe(lists.doc) & (spread.h == lists.h)
        rest = [c for c in lists.columns if c not in ("doc", "h")]
        return spread.join(lists.hint("shuffle_hash"), same, how).select(*own, *rest)

    def around(edges: DataFrame) -> DataFrame:
        listed = edges.groupBy("doc", "h").agg(F.collect_list(F.struct("g", "at")).alias("edges"))
        return _around(with_lists(listed, "inner"), length)

    found = marks.where("g is null").select("doc", "h", (F.col("at") - (length - SEED)).alias("a"), F.col("at").alias("b"))
    found = found.unionByName(_edge_repeats(around(marks.where(F.col("members") <= GROUP)), length))
    if crowded:
        found = found.unionByName(_crowded_repeats(around(marks.where(F.col("members") > GROUP)), length))
    lists = found.groupBy("doc", "h").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
              ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("h", pa.int64())]
    schema = pa.schema(fields + [("kept", pa.binary())] * with_text)
    given = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                               "h long" + ", kept binary" * with_text)
    if with_text:
        given.add(spread.schema["rest"])

    @worker_task()
    def cut(batches):
        for batch in batches:
            out = []
            columns = [batch.column(c) for c in ("doc_id", "h", "text", "a", "b")]
            for row in range(batch.num_rows):
                doc, key, text, a, b = (c[row] for c in columns)
                data = text.as_py()
                runs = [] if not a.is_valid else merged(a.values.to_numpy(), b.values.to_numpy(), len(data), length)
                edges = [0, *[x for r in runs for x in r], len(data)]
                kept = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2]))
                out.append((doc.as_py(), len(data), len(data) - len(kept), len(runs),
                            hashlib.sha256(kept).hexdigest(), key.as_py())
                           + ((kept.decode("utf-8", "ignore").encode() if whole_characters else kept,) if with_text else ()))
            cols = list(zip(*out)) or [[]] * len(schema)
            cols = [pa.array(c, f.type) for c, f in zip(cols, schema)]
            yield pa.RecordBatch.from_arrays(cols + ([batch.column("rest")] if with_text else []),
                                             names=schema.names + ["rest"] * with_text)

    return with_lists(lists, "left").mapInArrow(cut, given)


def without_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``docs`` with its columns, the text being what is kept of it: whole
    characters only. Other columns stay as they are; a null text becomes an empty one."""
    done = repeats(docs, length, id_col, text_col, with_text=True, whole_characters=True)
    return done.select(*[F.col("kept").cast("string").alias(c) if c == text_col else F.col("rest")[c].alias(c)
                         for c in docs.columns])
