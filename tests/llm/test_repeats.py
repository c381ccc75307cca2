import hashlib
import random
import zlib

import numpy as np
import pytest

from tapcast.llm import queries, repeats

from .cases import CLASHING, ROWS, SF, awkward, empty, texts

L = 100


def brute(rows):
    """(id, bytes) in order -> (id, n_bytes, n_removed, n_spans, sha256)."""
    seen, out = set(), []
    for i, data in rows:
        mask = np.zeros(len(data), bool)
        for p in range(len(data) - L + 1):
            s = data[p:p + L]
            if s in seen:
                mask[p:p + L] = True
            seen.add(s)
        spans = int((np.diff(np.r_[0, mask.astype(np.int8)]) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~mask]) if data else b""
        out.append((i, len(data), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(df):
    return sorted(tuple(r)[:5] for r in repeats.repeats(df).collect())


def test_query_against_brute_force(spark):
    got = sorted(tuple(r) for r in queries.op10_prefix_doubling(spark, SF).collect())
    assert got == brute((i, t.encode()) for i, t in texts().items())


def random_rows(seed, n=120):
    rng = random.Random(seed)
    word = lambda k, abc: "".join(rng.choice(abc) for _ in range(k))
    pool = [word(rng.choice([31, 32, 33, 40, 66, 99, 100, 101, 150, 400]), "ab") for _ in range(14)]
    pool += ["a" * 300, "xyz" * 120, "ü" * 80, "é漢" * 60]
    return [(i, "".join(rng.choice(pool) if rng.random() < 0.7 else word(rng.randint(0, 200), "abc")
                        for _ in range(rng.randint(0, 6)))) for i in range(n)]


@pytest.mark.parametrize("group", [4096, 3])
def test_random_texts_with_and_without_crowded_ranks(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = random_rows(group)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = brute((i, t.encode()) for i, t in rows)
    assert run(df) == expected
    assert sum(e[2] for e in expected) > 1000


@pytest.mark.parametrize("group", [0, 3, 40])
def test_halved_ranks_give_the_same_ranges(spark, monkeypatch, group):
    """The path for ranks that stay crowded, against the one for others."""
    rows = [(i, t[:400]) for i, t in random_rows(8, 40)]
    cut = [(zlib.crc32(t[at:at + 32]), i, 0, at, max(0, at - 68), t[max(0, at - 68):at + L])
           for i, t in ((i, t.encode()) for i, t in rows) for at in range(len(t) - 31)]
    around = spark.createDataFrame([c[:5] + (bytearray(c[5]),) for c in cut], repeats.AROUND_DDL)

    def starts(df):
        return {(r.doc, s) for r in df.collect() for s in range(r.a, r.b + 1)}

    want = starts(repeats._edge_repeats(around, L))
    monkeypatch.setattr(repeats, "GROUP", group)
    assert want and starts(repeats._crowded_repeats(around, L)) == want


def test_samples_cover_every_string_and_chunks_agree(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    whole = [np.concatenate(x) for x in zip(*repeats._document_samples(data, L))]
    at = whole[0]
    assert np.diff(np.r_[-1, at, len(data) - 32 + 1]).max() <= L - 32 + 1
    monkeypatch.setattr(repeats, "CHUNK", 512)
    parts = [np.concatenate(x) for x in zip(*repeats._document_samples(data, L))]
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_merged_runs():
    assert repeats.merged(np.array([-68, 200, 90]), np.array([0, 210, 95]), 1000, L) == [(0, 195), (200, 310)]
    assert repeats.merged(np.zeros(0, int), np.zeros(0, int), 50, L) == []
    assert repeats.merged(np.array([950]), np.array([980]), 1000, L) == []


def test_awkward_rows_and_empty_table(spark):
    long = ROWS[3][1]
    rows = [*ROWS, (10, "x" + long), (11, long), (11, long), (12, "z" * 99), (12, "z" * 99 + "y")]
    got = repeats.repeats(awkward(spark, rows)).collect()
    assert len(got) == len(rows)
    size = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in got}
    n = len(long.encode())
    # The first long text repeats inside itself: its words have a period.
    assert size[3] == brute([(3, long.encode())])[0][1:4]
    assert size[11] == (n, n, 1) and size[10][1] == n and size[12][1] == 0
    assert repeats.repeats(empty(spark)).count() == 0


def test_texts_keep_their_columns_and_whole_characters(spark):
    text = "ü" * 200
    df = awkward(spark, [(1, "a" + text), (2, text), (3, None), (4, "short")])
    got = {r.doc_id: r for r in repeats.without_repeats(df).collect()}
    assert list(got[1].asDict()) == ["doc_id", "text", *CLASHING]
    assert got[2].text == "" and got[3].text == "" and got[4].text == "short" and got[4].rest == "extra rest"
    assert got[1].text.startswith("aü")
