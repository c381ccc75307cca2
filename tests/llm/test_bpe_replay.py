import hashlib
from functools import lru_cache

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tapcast.llm import blocks, bpe_replay, queries
from tapcast.llm.common import tokenizer_path

from .cases import ROWS, SF, awkward, empty, texts

PATH = tokenizer_path("byte_bpe_50k.tiktoken")
PATTERN = queries.public_pattern()


@lru_cache(maxsize=1)
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, special_tokens={},
                             mergeable_ranks=dict(bpe_replay.vocabulary(PATH).rank))


def brute(text):
    ids = library().encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())


def test_query_against_the_library(spark):
    got = queries.op11_merge_replay(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"),
                          ("decoded_sha256", "string")]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == {i: brute(t) for i, t in texts().items()}


def lowest_first(word, rank):
    """One merge at a time: the lowest rank, the leftmost place."""
    parts = [word[i:i + 1] for i in range(len(word))]
    while True:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank), default=None)
        if best is None:
            return [rank[p] for p in parts]
        parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=14), min_size=1, max_size=8, unique=True), st.randoms())
def test_replay_merges_in_the_order_of_the_plain_encoder(words, rng):
    # A small vocabulary in random order: many tokens can be made in two ways.
    words = [bytes(b % 3 + 97 for b in w) for w in words]
    tokens = [bytes([a, b]) for a in b"abc" for b in b"abc"]
    tokens += [x + y for x in tokens for y in (b"a", b"b", b"ab", b"ca")]
    tokens = list(dict.fromkeys(tokens))
    rng.shuffle(tokens)
    v = bpe_replay.Vocabulary({bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate(tokens)})
    assert bpe_replay.replay(words, v) == [lowest_first(w, v.rank) for w in words]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab's 1.\n\t\x1c\x85\xa0 　é漢🙂́'tll", max_size=40))
def test_words_are_those_of_the_pattern(text):
    chunks = bpe_replay._Chunks(PATTERN)
    numbers = np.frombuffer(chunks.of(text), "<i4")
    words = [w.encode() for w in chunks.numbers]
    assert b"".join(words[k] for k in numbers) == text.encode()
    ids = bpe_replay.encode_words(words, bpe_replay.vocabulary(PATH))
    got = np.frombuffer(b"".join(ids[k] for k in numbers), "<u4").tolist()
    assert got == library().encode_ordinary(text)


def test_awkward_rows_ids_and_empty_table(spark, monkeypatch):
    big = [(2**53 + 1, "near"), (2**53 + 3, "far"), (None, None), (5, "<|endoftext|> ordinary"), (6, "x" * 3000)]
    rows = bpe_replay.digests(awkward(spark, ROWS + big), PATH, PATTERN).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, rows), key=key) == sorted(((i, *brute(t)) for i, t in ROWS + big), key=key)
    assert bpe_replay.digests(empty(spark), PATH, PATTERN).count() == 0


def test_decoding_alone(spark):
    ids = [library().encode_ordinary(t) for t in ("one two", "漢字", "")]
    rows = spark.createDataFrame([(k, bytearray(np.array(x, "<u4").tobytes())) for k, x in enumerate(ids)] + [(9, None)],
                                 "k long, ids binary")
    got = {r.k: r.decoded for r in bpe_replay.decoded(rows, PATH).collect()}
    assert got == {0: b"one two", 1: "漢字".encode(), 2: b"", 9: None}
    with pytest.raises(ValueError):
        bpe_replay.decoded(rows, PATH, text_col="k")


def test_encoding_alone(spark):
    rows = [(1, "one two  three"), (2, None), (2**53 + 1, "漢字 \n\n x"), (None, "it's")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe_replay.encoded(docs, PATH, PATTERN).collect()}
    assert got == {i: library().encode_ordinary(t or "") for i, t in rows}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60))
def test_packed_numbers_come_back(numbers):
    packed = blocks.packed_numbers(np.array(numbers, np.int64), 31)
    assert blocks.block_numbers(*packed).tolist() == numbers
