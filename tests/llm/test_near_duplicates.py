import os
import time
from collections import defaultdict

import numpy as np
import pytest

from tapcast.llm import near_duplicates as N
from tapcast.llm import queries
from tapcast.llm.common import multiset_similarity, shingle_hashes, word_hashes
from tapcast.llm.components import components
from tapcast.session import ensure_checkpoint_dir

from .cases import CLASHING, ROWS, SF, awkward, empty, texts


def signature(bag):
    items = np.array(sorted(bag), np.uint64)
    counts = np.array([bag[int(i)] for i in items])
    return N.bag_minhash(items, counts, np.zeros(len(items), int), 1)[0]


def test_signatures_estimate_weighted_jaccard_without_bias():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        a, b = {}, {}
        for key in rng.integers(0, 2**62, 60).tolist():
            n = int(rng.integers(0, 40))
            m = max(0, n + int(rng.integers(-9, 10)))
            a |= {key: n} if n else {}
            b |= {key: m} if m else {}
        keys = set(a) | set(b)
        jaccard = (sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys))
        errors.append((signature(a) == signature(b)).mean() - jaccard)
    assert abs(np.mean(errors)) < 3 * 0.05 / np.sqrt(60) + 0.003
    assert np.std(errors) < 0.08


def test_signature_of_a_bag_does_not_depend_on_its_neighbours():
    rng = np.random.default_rng(1)
    items, counts = rng.integers(0, 2**62, 90).astype(np.uint64), rng.integers(1, 9, 90)
    bag = np.repeat([0, 2, 3], 30)
    both = N.bag_minhash(items, counts, bag, 5)
    for k, i in enumerate([0, 2, 3]):
        s = slice(30 * k, 30 * k + 30)
        assert (N.bag_minhash(items[s], counts[s], np.zeros(30, int), 1)[0] == both[i]).all()
    assert not both[1].any() and not both[4].any()


def brute(rows):
    """Class of each row: the smallest id among its linked rows."""
    prints = [shingle_hashes(word_hashes((t or "").encode())) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for k, p in enumerate(prints):
        for x in set(p.tolist()):
            by[x].append(k)
    pairs = {(a, b) for v in by.values() for n, a in enumerate(v) for b in v[n + 1:]}
    pairs |= {(a, b) for a in range(len(rows)) for b in range(a) if not len(prints[a]) and (rows[a][1] or "") == (rows[b][1] or "")}
    for a, b in pairs:
        if multiset_similarity(prints[a], prints[b]) >= 0.8 - 1e-9:
            root[find(a)] = find(b)
    heads = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        heads[find(k)].append(i)
    least = {r: min((i for i in v if i is not None), default=None) for r, v in heads.items()}
    return sorted((i, least[find(k)]) for k, (i, _) in enumerate(rows))


def test_query_against_brute_force(spark):
    docs = list(texts().items())
    got = sorted((r.doc_id, r.class_id) for r in queries.op4_bagminhash(spark, SF).collect())
    assert got == brute(docs)


def near_copies(n, seed=0):
    """A group of copies of one text, each with its own few changes, and texts
    that share a passage with them without being near copies."""
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(n):
        words = list(base)
        for k in rng.integers(0, len(words), int(rng.integers(0, 7))):
            words[k] = f"n{rng.integers(10**9)}"
        rows.append((i, " ".join(words)))
    for i in range(n, n + n // 2):
        rows.append((i, " ".join(base[:120] + [f"r{rng.integers(10**9)}" for _ in range(150)])))
    return rows


@pytest.mark.parametrize("group", [1024, 6])
def test_large_group_of_near_copies(spark, monkeypatch, group):
    monkeypatch.setattr(N, "GROUP", group)
    rows = near_copies(60, group)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id, r.class_id) for r in N.classes(df).collect()) == brute(rows)


def test_awkward_rows_and_kept_rows(spark):
    got = N.classes(awkward(spark)).collect()
    assert len(got) == len(ROWS)
    by = defaultdict(set)
    for r in got:
        by[r.class_id].add(r.doc_id)
    assert by[4] == {4, 5} and by[1] == {1, 2, None} and by[6] == {6} and by[9] == {9}
    kept = N.deduplicated(awkward(spark))
    assert kept.columns == ["doc_id", "text", *CLASHING]
    rows = kept.collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in rows) == [-1, 1, 3, 4, 4, 6, 7, 8, 9, 2**53 + 1, 2**53 + 3]
    assert N.classes(empty(spark)).count() == 0


def test_overlaps_and_merges_of_a_group():
    rows = near_copies(40, 3)
    rows += [(100, "a a a a a a a a b"), (101, "a a a a a a a a a b"), (102, "x")]
    prints = [shingle_hashes(word_hashes(t.encode())) for _, t in rows]
    both = N.overlaps(prints, columns=7)
    for i in range(len(rows)):
        for j in range(i):
            s = multiset_similarity(prints[i], prints[j])
            assert abs(both[i, j] / (len(prints[i]) + len(prints[j]) - both[i, j]) - s) < 1e-6
    expected = dict(brute(rows))
    got = {k: k for k in range(len(rows))}
    for a, b in N.merges([str(i).zfill(4).encode() for i, _ in rows], [t.encode() for _, t in rows], 5, 0.8):
        got[b] = a
    ids = [i for i, _ in rows]
    assert {i: ids[got[k]] for k, i in enumerate(ids)} == expected


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 107), (107, 103), (5, 5), (200, 200)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 107: 100, 103: 100}
    assert components(df.limit(0)).count() == 0


def plain_run(item, weight, bag, limit, m, best, who):
    """All arrivals before each bag's limit, every level worked off alike."""
    # Roots: the levels below the weight.
    level = [(item, np.zeros(len(item), np.int64), np.ones(len(item), np.int64), weight, bag)]
    lo = 1
    while len(weight) and lo < weight.max():
        over = weight > lo
        k = int(over.sum())
        level.append((item[over], np.full(k, lo), np.full(k, lo), weight[over], bag[over]))
        lo *= 2
    item, lo, width, weight, bag = (np.concatenate(x) for x in zip(*level))
    seed = N.mix(item * N._G + lo.astype(np.uint64))
    t = N._wait(seed, m * width)
    point, told = N.mix(seed ^ N._ODD[1]), np.zeros(len(seed), bool)
    while True:
        live = t < limit[bag]
        if not live.any():
            return
        seed, lo, width, weight, bag, t, point, told = (
            x[live] for x in (seed, lo, width, weight, bag, t, point, told))
        inside = lo + width <= weight
        tell = inside & ~told
        at = bag[tell] * m + (point[tell] % np.uint64(m)).astype(np.int64)
        np.minimum.at(best, at, t[tell])
        won = best[at] == t[tell]
        who[at[won]] = point[tell][won]
        told = told | inside
        # A unit level waits for its next arrival.
        unit = width == 1
        nxt = N.mix(seed[unit] ^ N._ODD[2])
        out = [(nxt, lo[unit], width[unit], weight[unit], bag[unit], t[unit] + N._wait(nxt, float(m)),
                N.mix(nxt ^ N._ODD[1]), np.zeros(len(nxt), bool))]
        # A wider one splits: one half keeps the arrival, the other waits on.
        wide = ~unit
        half = width[wide] // 2
        right_has = (N.mix(point[wide] ^ width[wide].astype(np.uint64)) & np.uint64(1)).astype(bool)
        for right in (False, True):
            child = N.mix(seed[wide] ^ N._ODD[3] ^ np.uint64(right))
            has = right_has == right
            t2 = np.where(has, t[wide], t[wide] + N._wait(child, m * half))
            start = lo[wide] + half * right
            below = start < weight[wide]
            out.append(tuple(x[below] for x in (
                child, start, half, weight[wide], bag[wide], t2,
                np.where(has, point[wide], N.mix(child ^ N._ODD[1])), has & told[wide])))
        seed, lo, width, weight, bag, t, point, told = (np.concatenate(x) for x in zip(*out))


def test_unit_levels_are_worked_off_faster_and_alike(monkeypatch):
    rng = np.random.default_rng(4)
    n_bags, per = 256, 380
    item = rng.integers(0, 2**62, n_bags * per).astype(np.uint64)
    weight = rng.choice([1, 1, 1, 1, 1, 1, 1, 1, 2, 3, 9, 400], len(item), p=[.12] * 8 + [.02, .01, .009, .001])
    bag = np.repeat(np.arange(n_bags), per)

    def timed():
        least = float("inf")
        for _ in range(3):
            began = time.process_time()
            sig = N.bag_minhash(item, weight, bag, n_bags)
            least = min(least, time.process_time() - began)
        return sig, least

    now, seconds = timed()
    monkeypatch.setattr(N, "_run", plain_run)
    plain, plain_seconds = timed()
    assert (now == plain).all()
    assert seconds < 0.75 * plain_seconds


def test_stage_leaves_only_the_rows_it_keeps(spark):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:").rstrip("/") + "/tables"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = near_copies(12)
    kept = N.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert len(set(os.listdir(folder)) - before) == 1
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in brute(rows)})
