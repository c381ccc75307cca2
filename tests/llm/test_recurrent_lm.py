import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tapcast.llm import queries
from tapcast.llm import recurrent_lm as L
from tapcast.llm.toxicity import held_out

from .cases import ROWS, SF, awkward, empty, texts


def base(rows):
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(x for i, w in tokens if not out(i) for x in w)
    n, v = sum(c.values()), len(c)
    return [(i, out(i), len(w), sum(c[x] > 0 for x in w), n,
             sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for i, w in tokens]


def same(rows, expected):
    key = lambda r: (-1 if r[0] is None else r[0], r[2], round(r[5], 6))
    got = sorted((tuple(r)[:6] for r in rows), key=key)
    for a, b in zip(got, sorted(expected, key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)


def test_query_against_counts_and_base_score(spark):
    rows = queries.op5_recurrent_lm(spark, SF).collect()
    same(rows, base(texts().items()))
    assert all(r.score < 0 for r in rows)
    # Held-out texts are likelier than under the unigram base.
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_gradients_through_time_and_document_starts():
    net = L.Network(np.zeros(L.CLASSES, np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    t, b = 6, 3
    target, before = rng.integers(0, L.CLASSES, (t, b)), rng.integers(0, L.CLASSES, (t, b))
    fresh, live, h = np.zeros((t, b), bool), np.ones((t, b)), rng.standard_normal((b, L.HIDDEN))
    fresh[3, 1], live[5, 2] = True, 0
    loss = lambda: net.window(before, target, fresh, live, h)[0] / live.sum()
    for k, g in net.window(before, target, fresh, live, h)[1].items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = net.p[k][at], 1e-5
        net.p[k][at] = old + e
        up = loss()
        net.p[k][at] = old - e
        slope = (up - loss()) / (2 * e)
        net.p[k][at] = old
        assert abs(slope - g[at]) < 1e-4 * max(1e-2, abs(slope)), k


def test_state_runs_through_the_whole_document():
    """Side by side, each text gets the score it has alone, step by step."""
    rng = np.random.default_rng(0)
    net = L.Network(np.zeros(L.CLASSES, np.float32))
    docs = [bytes(rng.integers(0, L.CLASSES, n).astype(np.uint8)) for n in (1, 700, 3, 40, 1)]
    got = net.log10(docs)
    for d, s in zip(docs, got):
        h, before, total = np.zeros((1, L.HIDDEN), np.float32), net.START, 0.0
        for x in d:
            h, _ = net.step(np.array([before]), h)
            e = (h @ net.p["wo"] + net.p["bo"])[0].astype(np.float64)
            total += e[x] - np.log(np.exp(e).sum())
            before = x
        assert math.isclose(s, total / np.log(10), rel_tol=1e-4)


def test_training_learns_a_sequence():
    net = L.Network(np.zeros(L.CLASSES, np.float32))
    docs = [bytes([1, 2, 3, 4] * 20 + [L.END]) for _ in range(200)]
    before = net.log10(docs[:1])[0]
    for _ in range(12):
        net.train(docs)
    assert net.log10(docs[:1])[0] > 0.3 * before


def test_probabilities_of_a_class_sum_to_one():
    n, v = np.full(L.CLASSES, 100.0), np.full(L.CLASSES, 3.0)
    counts = L.Counts(1000, 30, 10, {}, n, v)
    own = np.array([50, 30, 20, 0])
    p = 10 ** counts.inner(own, np.full(4, L.SINGLES))
    assert math.isclose(p.sum(), 1.0)


def test_awkward_rows_and_empty_table(spark):
    rows = L.scores(awkward(spark), held_out(F.col("doc_id"), 5)).collect()
    same(rows, base(ROWS))
    assert L.scores(empty(spark), held_out(F.col("doc_id"), 5)).count() == 0


def test_ids_beside_a_null_id(spark):
    ids = [None] + [2**53 + k for k in range(1, 9)]
    docs = spark.createDataFrame([(i, f"text of {i}") for i in ids], "doc_id long, text string").coalesce(1)
    rows = L.scores(docs, held_out(F.col("doc_id"), 5)).collect()
    assert {r.doc_id for r in rows} == set(ids)


def test_training_takes_the_same_rows_at_any_corpus_size(spark):
    """Null ids too; counts that tell of a large corpus change nothing."""
    rows = [(i if i % 2 else None, i % 5 == 1, bytearray([i % 7, L.END])) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, held_out boolean, classes binary").coalesce(1)
    n, v = np.full(L.CLASSES, 100.0), np.full(L.CLASSES, 3.0)
    start = L.Network(L.Counts(160, 30, 10, {}, n, v).prior()).flat()
    for part in (docs, docs.where("doc_id is null")):
        small, middle, large = (L.trained(part, L.Counts(t, 30, 10, {}, n, v)).flat()
                                for t in (160, 20_000_000, 500_000_000))
        assert np.abs(small - start).max() > 1e-3
        assert (small == middle).all() and (small == large).all()


def test_pieces_go_on_where_the_last_one_ended():
    """One pass over two pieces makes as many steps as its tokens need."""
    docs = [bytes([1, 2, 3, 4] * 20 + [L.END]) for _ in range(200)]
    net = L.Network(np.zeros(L.CLASSES, np.float32))
    assert net.train(docs[:100]) + net.train(docs[100:]) == 200 * 81
    assert net.steps == 2 * -(-81 // L.STEPS)  # equal texts: a stream each


def test_batch_words_are_counted_after_one_sort(spark, monkeypatch):
    """The word table needs one sort and one window."""
    plans = []
    monkeypatch.setattr(L, "materialize", lambda df: plans.append(df) or df)
    df = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "a")], "doc_id long, text string").repartition(3)
    table, counts = L.counted(L.batches_of(df, F.lit(False), "doc_id", "text"))
    plan = plans[0]._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window ") == 1
    assert (counts.tokens, counts.kinds, counts.ends) == (9, 4, 3)
    assert table.count() == len({(r.batch, r.pos) for r in table.collect()})
