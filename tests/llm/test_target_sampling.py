import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapcast.llm import queries
from tapcast.llm import target_sampling as ts

from .cases import ROWS, SF, awkward, empty, real, texts


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features(text, order=2):
    w = words(text)
    return [" ".join(w[i:i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def brute(docs, bench):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for x in group for f in features(x)) for group in ([x for _, x in docs], bench))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000))))
            for b in range(10000)]
    out = []
    for i, x in docs:
        f = features(x)
        weight = sum(gain[bucket(y)] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = [r for r, (_, x) in zip(out, docs) if len(words(x)) >= 20]
    for k, r in enumerate(sorted(fit, key=lambda r: (-r[3], r[0]))[:25 * len(fit) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def test_query_against_brute_force(spark):
    got = queries.op13_target_resampling(spark, SF)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    bench = [r[1] for r in real("benchmark")]
    assert sorted(map(tuple, got.collect()), key=str) == brute(sorted(texts().items()), bench)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab Z9é\n.\x00", max_size=30), min_size=1, max_size=6), st.integers(1, 3),
       st.sampled_from([1, 5, 1 << 20]))
def test_windows_and_documents_keep_their_ngrams(parts, order, window):
    old, ts.WINDOW = ts.WINDOW, window
    try:
        got, n_words = Counter(), 0
        for n, doc, h in ts.ngrams([p.encode() for p in parts], order):
            got.update(zip(doc.tolist(), h.tolist()))
            n_words += n
    finally:
        ts.WINDOW = old
    assert got == Counter((d, zlib.crc32(f.encode())) for d, p in enumerate(parts) for f in features(p, order))
    assert n_words == sum(len(words(p)) for p in parts)


def test_awkward_rows_ties_and_empty_tables(spark):
    bench = spark.createDataFrame([("w1x w2x one two three",)], "text string")
    many = ROWS + [(11, "same words " * 15)] * 40 + [(12, "other words " * 15)] * 9
    rows = ts.resampled(awkward(spark, many), bench, percent=50).collect()
    assert len(rows) == len(many)
    fit = sum(len(words(t)) >= 20 for _, t in many)
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, fit // 2 + 1))
    by_rank = sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])
    assert [r.score for r in by_rank] == sorted((r.score for r in by_rank), reverse=True)
    assert ts.resampled(empty(spark), bench).count() == 0
    none = ts.resampled(awkward(spark), bench.limit(0)).collect()
    assert len(none) == len(ROWS)
    picked = ts.selected(awkward(spark, many), bench, percent=50)
    assert picked.columns == awkward(spark).columns and {r.doc_id for r in picked.collect()} <= {3, 11, 12}


def test_drawn_texts_are_nearer_the_target(spark):
    docs = spark.createDataFrame(
        [(i, " ".join(("alpha beta gamma" if i % 5 == 0 else "delta rho tau").split() * 10)) for i in range(500)],
        "doc_id long, text string")
    bench = spark.createDataFrame([("alpha beta gamma alpha beta",)] * 50, "text string")
    rows = ts.resampled(docs, bench, percent=10).where("rank is not null").collect()
    assert np.mean([r.doc_id % 5 == 0 for r in rows]) > 0.9


@pytest.mark.parametrize("seed", [1, 2])
def test_ranks_go_on_over_partitions(spark, seed):
    rows = spark.createDataFrame([(i, 0, (i * 7919 * seed) % 50) for i in range(2000)],
                                 "doc_id long, xh long, score long").repartition(7)
    got = ts.ranked(rows).collect()
    want = sorted((r for r in rows.collect()), key=lambda r: (-r.score, r.doc_id))
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"])] == [r.doc_id for r in want]
