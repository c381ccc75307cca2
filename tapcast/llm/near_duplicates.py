"""Near duplicates by BagMinHash.

A document is the multiset of its five-word shingles. Its signature has ``M``
components; each is the shingle occurrence with the earliest arrival in a
Poisson process whose rate is the shingle's weight, so two components agree
with a probability equal to the weighted Jaccard similarity. Weights are
discretised to counts. The processes form a hierarchy over weight: the levels
[0, 1), [1, 2), [2, 4), [4, 8), ... of a shingle have processes of their own,
and a level that is only partly below the weight is split in halves, the first
arrival falling in one of them. Arrivals past the time at which all components
of a document are settled are never made, which leaves about M ln M points a
document, however long it is.

Signatures are cut into bands; documents that agree in a band are candidates.
Groups are never expanded into pairs: in each bucket all members are compared
with one pivot, verified pairs become links, and components of links become
classes; then a second pivot is taken from the members outside the first
pivot's class. Whatever then still shares a bucket without sharing a class is
compared inside tasks; a bucket of more such members than a task holds is dealt
to blocks, and blocks are compared in twos. Links to pivots are verified by
signatures first (a loose bound), then by the exact multiset similarity; links
within blocks by exact overlap counts.

Copies (equal word sequences) are one node throughout.

Cases: a null text is empty; texts without words are duplicates only of equal
texts; fewer than five words are one shingle; null ids take part, and a class
of null ids alone has a null class id; repeated rows are copies; an empty table
gives no rows.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapcast.llm.common import (SHINGLE, SIMILAR, doc_columns, mix, multiset_similarity, shingle_hashes,
                                utf8, word_hashes, worker_task)
from tapcast.llm.components import components
from tapcast.session import materialize, scratch

#: 24 bands of 4: a pair of similarity 0.8 shares none with probability 3e-6.
BANDS, ROWS = 24, 4
M = BANDS * ROWS
#: Agreeing components under which a pair is not worth an exact look: over five
#: standard deviations below what similarity 0.8 gives.
AGREE = 56
#: Members, and bytes of their texts, that a task compares at once; a larger
#: bucket is dealt to blocks of half as much, and blocks are compared in twos.
GROUP, GROUP_BYTES = 1024, 16 << 20
_G = np.uint64(0x9E3779B97F4A7C15)
_ODD = [np.uint64(x) for x in (0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9, 0xF1357AEA2E62A9C5)]


def _wait(seed: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Exponential waiting times from hashes."""
    t = (mix(seed ^ _ODD[0]) >> np.uint64(11)).astype(np.float64)
    t += 0.5
    t *= 2.0**-53
    np.negative(np.log(t, out=t), out=t)
    t /= rate
    return t


def bag_minhash(item: np.ndarray, weight: np.ndarray, bag: np.ndarray, n_bags: int,
                m: int = M) -> np.ndarray:
    """Signatures (n_bags, m) of multisets: items (64-bit hashes) with counts,
    ``bag`` their sorted bag numbers. Empty bags have zeros."""
    total = np.bincount(bag, weight, n_bags)
    best = np.full(n_bags * m, np.inf)
    who = np.zeros(n_bags * m, np.uint64)
    limit = np.zeros(n_bags)
    open_ = total > 0
    limit[open_] = (np.log(m) + 3) / total[open_]
    with np.errstate(over="ignore"):
        while open_.any():
            use = np.flatnonzero(open_[bag] & (weight > 0))
            _run(item[use], weight[use].astype(np.int64), bag[use], limit, m, best, who)
            open_ = open_ & np.isinf(best.reshape(n_bags, m)).any(axis=1)
            limit[open_] *= 2
    return who.reshape(n_bags, m)


def _tell(slot, t, point, m, best, who) -> None:
    """Arrivals at the components that their points name, of bags whose
    components start at ``slot``."""
    at = slot + (point % np.uint64(m)).astype(np.int64)
    np.minimum.at(best, at, t)
    won = np.flatnonzero(best[at] == t)
    who[at[won]] = point[won]


def _run(item, weight, bag, limit, m, best, who) -> None:
    """All arrivals before each bag's limit."""
    # Roots: the levels below the weight.
    level = [(item, np.zeros(len(item), np.int64), np.ones(len(item), np.int64), weight, bag)]
    lo = 1
    while len(weight) and lo < weight.max():
        over = weight > lo
        k = int(over.sum())
        level.append((item[over], np.full(k, lo), np.full(k, lo), weight[over], bag[over]))
        lo *= 2
    item, lo, width, weight, bag = (np.concatenate(x) for x in zip(*level))
    seed = mix(item * _G + lo.astype(np.uint64))
    t = _wait(seed, m * width)
    point, told = mix(seed ^ _ODD[1]), np.zeros(len(seed), bool)
    units = []
    while len(seed):
        unit = width == 1
        units.append(tuple(x[unit] for x in (seed, t, bag, point, told)))
        wide = np.flatnonzero(~unit & (t < limit[bag]))
        seed, lo, width, weight, bag, t, point, told = (
            x[wide] for x in (seed, lo, width, weight, bag, t, point, told))
        inside = lo + width <= weight
        tell = np.flatnonzero(inside & ~told)
        _tell(bag[tell] * m, t[tell], point[tell], m, best, who)
        told = told | inside
        # It splits: one half keeps the arrival, the other waits on.
        half, out = width // 2, []
        right_has = (mix(point ^ width.astype(np.uint64)) & np.uint64(1)).astype(bool)
        for right in (False, True):
            child = mix(seed ^ _ODD[3] ^ np.uint64(right))
            has = right_has == right
            t2 = np.where(has, t, t + _wait(child, m * half))
            start = lo + half * right
            below = start < weight
            out.append(tuple(x[below] for x in (
                child, start, half, weight, bag, t2,
                np.where(has, point, mix(child ^ _ODD[1])), has & told)))
        seed, lo, width, weight, bag, t, point, told = (np.concatenate(x) for x in zip(*out))
    if units:
        _run_units(*(np.concatenate(x) for x in zip(*units)), limit, m, best, who)


def _run_units(seed, t, bag, point, told, limit, m, best, who) -> None:
    """As ``_run`` for unit levels, nearly all there are: they lie below the
    weight and only wait for their next arrival."""
    slot, limit = bag * m, limit[bag]
    live = np.flatnonzero(t < limit)
    tell = live[~told[live]]
    _tell(slot[tell], t[tell], point[tell], m, best, who)
    while len(live):
        seed, t, slot, limit = mix(seed[live] ^ _ODD[2]), t[live], slot[live], limit[live]
        t += _wait(seed, float(m))
        live = np.flatnonzero(t < limit)
        _tell(slot[live], t[live], mix(seed[live] ^ _ODD[1]), m, best, who)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; equal keys mean equal bands."""
    with np.errstate(over="ignore"):
        parts = sig.reshape(len(sig), BANDS, ROWS)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
        for r in range(ROWS):
            key = mix(key * _G + parts[:, :, r])
    return key


SIGNED = pa.schema([("doc_id", pa.int64()), ("xh", pa.int64()), ("node", pa.binary()),
                    ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])
SIGNED_DDL = "doc_id long, xh long, node binary, bands array<long>, sig binary"


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """Every row's node (a digest of its words; of its bytes if it has none),
    band keys and signature. Wordless texts have no bands."""

    @worker_task("words")
    def sign(batches):
        for batch in batches:
            texts = batch.column("text")
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                items, counts, bags, nodes = [], [], [], []
                for i in range(part.num_rows):
                    text = texts[a + i].as_py()
                    words = word_hashes(text)
                    nodes.append(blake2b(words.tobytes() if len(words) else b"\x00" + text, digest_size=16).digest())
                    x, n = np.unique(shingle_hashes(words, size), return_counts=True)
                    items.append(x)
                    counts.append(n)
                    bags.append(np.full(len(x), i))
                sig = bag_minhash(np.concatenate(items), np.concatenate(counts), np.concatenate(bags), len(nodes))
                keys = band_keys(sig).view(np.int64)
                short = (sig & np.uint64(0xFFFFFFFF)).astype("<u4")
                has = [len(x) > 0 for x in items]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("xh"), pa.array(nodes, pa.binary()),
                     pa.array([k if ok else [] for k, ok in zip(keys, has)], pa.list_(pa.int64())),
                     pa.array([s.tobytes() for s in short], pa.binary())], schema=SIGNED)

    texts = doc_columns(docs, id_col, text_col).withColumn("xh", F.xxhash64("text"))
    return texts.mapInArrow(sign, SIGNED_DDL)


def _agreeing(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree in ``AGREE`` components at least."""
    both = (pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
            .join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b"))

    def close(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, M) for c in ("sa", "sb"))
            ok = pa.array((x == y).sum(axis=1) >= AGREE)
            yield batch.select(["a", "b"]).filter(ok)

    return both.select("a", "b", "sa", "sb").mapInArrow(close, "a binary, b binary")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Pairs whose exact multiset similarity reaches the threshold."""
    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b"))

    @worker_task("words")
    def exact(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("ta"), batch.column("tb")):
                p, q = (shingle_hashes(word_hashes(t.as_py()), size) for t in (x, y))
                few, many = sorted((len(p), len(q)))
                ok.append(few >= threshold * many - 1e-9 and multiset_similarity(p, q) >= threshold - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(exact, "a binary, b binary")


def overlaps(prints: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Multiset overlaps of all pairs: equal shingles are told apart by their
    count within a document, then shared ones are counted by matrix products
    of a bounded number of columns."""
    items, owner = [], []
    for k, p in enumerate(prints):
        p = np.sort(p)
        new = np.r_[True, p[1:] != p[:-1]] if len(p) else np.zeros(0, bool)
        at = np.arange(len(p))
        with np.errstate(over="ignore"):
            items.append(mix(p + (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64) * _G))
        owner.append(np.full(len(p), k))
    _, column, count = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = np.concatenate(owner)[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    column = np.cumsum(np.r_[0, column[1:] != column[:-1]]) if len(column) else column
    total = np.zeros((len(prints), len(prints)), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        part = slice(*np.searchsorted(column, [a, a + columns]))
        hold = np.zeros((len(prints), columns), np.float32)
        hold[owner[part], column[part] - a] = 1
        total += hold @ hold.T
    return total


def merges(roots: list[bytes], texts: list[bytes], size: int, threshold: float) -> list[tuple[int, int]]:
    """Pairs of members whose classes a chain of verified links joins: each
    joined class's first member with the least of what it is joined to."""
    prints = [shingle_hashes(word_hashes(t), size) for t in texts]
    n = np.array([len(p) for p in prints])
    both = overlaps(prints)
    linked = both >= threshold * (n[:, None] + n - both) - 1e-6
    _, start = np.unique(np.array(roots), return_inverse=True)
    label = start.copy()
    while True:
        low = np.where(linked, label, len(label)).min(axis=1, initial=len(label))
        low = np.minimum(low, label)
        by_root = np.full(start.max() + 1, len(label))
        np.minimum.at(by_root, start, low)  # members of one class go together
        if (by_root[start] == label).all():
            break
        label = by_root[start]
    first = np.unique(start, return_index=True)[1]
    return [(int(first[label[k]]), int(k)) for k in first if label[k] != start[k]]


def _bucket_links(rest: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Class-merging links (a, b) of unsettled buckets (bucket, node, root)."""
    sized = rest.join(texts.select("node", "size"), "node")
    held = sized.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    half = F.greatest(F.ceil(F.col("n") * 2 / GROUP), F.ceil(F.col("bytes") * 2 / GROUP_BYTES))
    blocks = F.when((F.col("n") > GROUP) | (F.col("bytes") > GROUP_BYTES), half).otherwise(1).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (rest.join(held.select("bucket", blocks.alias("blocks")), "bucket")
             .withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("key"),
                     "node", "root"))

    def settle(t: pa.Table):
        nodes = t.column("node").to_pylist()
        found = merges(t.column("root").to_pylist(), t.column("text").to_pylist(), size, threshold)
        return pa.RecordBatch.from_arrays([pa.array([nodes[x] for x, _ in found], pa.binary()),
                                           pa.array([nodes[y] for _, y in found], pa.binary())], names=["a", "b"])

    @worker_task("words")
    def compared(batches):
        rows = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rows is None else pa.concat_tables([rows, pa.Table.from_batches([batch])])
            key = rows.column("key").to_numpy()
            ends = np.r_[np.nonzero(key[1:] != key[:-1])[0] + 1]
            for a, b in zip(np.r_[0, ends[:-1]].astype(int), ends) if len(ends) else ():
                yield settle(rows.slice(a, b - a))
            rows = rows.slice(int(ends[-1])) if len(ends) else rows
        if rows is not None and rows.num_rows:
            yield settle(rows)

    return (dealt.join(texts.select("node", "text"), "node").select("key", "node", "root", "text")
            .repartition("key").sortWithinPartitions("key", "node")
            .mapInArrow(compared, "a binary, b binary"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            size: int = SHINGLE, threshold: float = SIMILAR) -> DataFrame:
    """One row per row of ``docs``: doc_id, xh (a hash of its text), class_id
    (the smallest doc_id of its class), class_size (rows) and is_first (the
    class's first row by id, then xh)."""
    rows = materialize(signed(docs, id_col, text_col, size))
    nodes = materialize(rows.groupBy("node").agg(F.first("bands").alias("bands"), F.first("sig").alias("sig"),
                                                 F.min(F.struct("doc_id", "xh")).alias("row")))
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    ends = (buckets.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("last"))
            .where("pivot != last").select("bucket", "pivot"))
    shared = materialize(buckets.join(ends, "bucket"))

    sigs = nodes.select("node", "sig")
    # Texts of all nodes that share a bucket, one row of docs for each.
    wanted = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "row.doc_id", "row.xh")
    texts = doc_columns(docs, id_col, text_col).withColumn("xh", F.xxhash64("text"))
    same = texts.doc_id.eqNullSafe(wanted.doc_id) & (texts.xh == wanted.xh)
    texts = materialize(texts.join(wanted, same).groupBy("node").agg(F.first("text").alias("text"))
                        .withColumn("size", F.octet_length("text")))

    def links_of(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        # Written in between, so that no task runs two Python steps (and two workers).
        return materialize(_verified(materialize(_agreeing(pairs, sigs)), texts, size, threshold))

    links = links_of(shared.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
    roots = materialize(components(links))

    def unsettled(held: DataFrame) -> DataFrame:
        """Bucket rows with their roots, where a bucket has several."""
        known = (held.join(roots, "node", "left")
                 .withColumn("root", F.coalesce("root", "node")))
        open_ = (known.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"),
                                             F.count(F.lit(1)).alias("members"))
                 .where("r0 != r1").select("bucket", "members"))
        return known.join(open_, "bucket")

    left = materialize(unsettled(shared).where("members > 2"))
    own = left.where("node = pivot").select("bucket", F.col("root").alias("pivot_root"))
    outside = left.join(own, "bucket").where("root != pivot_root")
    second = outside.groupBy("bucket").agg(F.min(F.struct("node", "root")).alias("p"))
    pairs = (left.join(second, "bucket").where("root != p.root and node != pivot")
             .select(F.col("p.node").alias("a"), F.col("node").alias("b")))
    links = materialize(links.unionByName(links_of(pairs)).distinct())
    roots = materialize(components(links))

    rest = materialize(unsettled(left.drop("root", "members")).select("bucket", "node", "root"))
    links = materialize(links.unionByName(_bucket_links(rest, texts, size, threshold)).distinct())
    roots = materialize(components(links))

    known = (rows.select("doc_id", "xh", "node").join(roots, "node", "left")
             .select("doc_id", "xh", F.coalesce("root", "node").alias("root")))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "xh")
    heads = known.groupBy("root").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("class_size"))
    return known.join(heads, "root").select(
        "doc_id", "xh", F.col("head.doc_id").alias("class_id"), "class_size",
        F.col("head").eqNullSafe(place).alias("is_first"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that head their class; of equal rows, one."""
    with scratch(docs.sparkSession):  # signatures, buckets and links are done with
        firsts = materialize(classes(docs, id_col, text_col).where("is_first").select(
            F.col("doc_id").alias("first_id"), "xh"), keep=True)
    # The row goes in one struct: none of its names can clash.
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"),
                        F.xxhash64(utf8(F.col(text_col))).alias("h"))
    same = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("xh"))
    kept = keyed.join(firsts, same, "left_semi")
    if firsts.groupBy("first_id", "xh").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["id", "h"])
    return kept.select("row.*")
