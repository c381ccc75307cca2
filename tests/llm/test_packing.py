import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapcast.llm import packing, queries
from tapcast.llm.common import tokenizer_path

from .cases import ROWS, SF, awkward, empty, texts
from .test_token_blocks import exact


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=40), st.sampled_from([8, 64]))
def test_pieces_cover_every_token_once_without_padding(lengths, capacity):
    pieces = packing.pack(np.array(lengths), capacity)
    for d, n in enumerate(lengths):
        own = sorted((s, k) for doc, s, k, _, _ in pieces if doc == d)
        assert [s for s, _ in own] == [sum(k for _, k in own[:i]) for i in range(len(own))]
        assert sum(k for _, k in own) == n
    for seq in {p[3] for p in pieces}:
        own = sorted((o, k) for _, _, k, s, o in pieces if s == seq)
        assert [o for o, _ in own] == [sum(k for _, k in own[:i]) for i in range(len(own))]
        total = sum(k for _, k in own)
        assert total == capacity or total & (total - 1) == 0 and total < capacity


def test_documents_that_fit_are_not_cut_while_there_is_room():
    pieces = packing.pack(np.array([4, 4, 4, 4]), 8)
    assert sorted(pieces[:, 2]) == [4, 4, 4, 4]


def test_costs_are_balanced():
    rng = np.random.default_rng(0)
    lengths = np.minimum(4096, rng.lognormal(6, 1, 3000).astype(int) + 1)
    pieces = packing.pack(lengths, 4096)
    cost = np.zeros(pieces[:, 3].max() + 1)
    np.add.at(cost, pieces[:, 3], pieces[:, 2] + pieces[:, 2] ** 2 / 4096)
    full = cost[np.bincount(pieces[:, 3], pieces[:, 2]) == 4096]
    assert np.median(full) <= full.mean() * 1.2


def check(rows, expected):
    cover = {k: np.zeros(len(v), int) for k, v in expected.items()}
    for r in rows:
        ids = expected[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
        cover[r.doc_id][r.start:r.start + r.length] += 1
    assert all((c == 1).all() for c in cover.values())


def test_query_against_brute_force(spark):
    rows = queries.op1_packing(spark, SF).collect()
    check(rows, {i: np.array(exact(t) + [2], "<u4") for i, t in texts().items()})


def test_awkward_rows_and_empty_table(spark):
    rows = packing.packed(awkward(spark), tokenizer_path(), 2, with_ids=True).collect()
    total = sum(len(exact(t)) + 1 for _, t in ROWS)
    assert sum(r.length for r in rows) == total
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert packing.packed(empty(spark), tokenizer_path(), 2).count() == 0


@pytest.mark.parametrize("tokens", [0, 1, 4095, 4096, 10000])
def test_sequence_lengths_add_up(tokens):
    s = packing.sequence_lengths(tokens, 4096)
    assert s.sum() == tokens and all(x == 4096 or x & (x - 1) == 0 for x in s)


def test_ids_beside_a_null_id_and_many_copies(spark, monkeypatch):
    rows = [(None, "no id")] + [(2**53 + k, f"text {k}") for k in range(1, 8)] + [(5, "a copy of one row")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = packing.packed(docs, tokenizer_path(), 2).collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows}
    assert sum(r.length for r in got) == sum(len(exact(t)) + 1 for _, t in rows)
    monkeypatch.setattr(packing, "GROUP_TOKENS", 64)  # the copies go to several groups
    got = packing.packed(docs, tokenizer_path(), 2).collect()
    assert len({r.sequence_id >> 32 for r in got if r.doc_id == 5}) > 2
    assert sum(r.length for r in got) == sum(len(exact(t)) + 1 for _, t in rows)
