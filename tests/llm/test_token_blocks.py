import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tapcast.llm import queries
from tapcast.llm.common import TokenEncoder, shared_path, tokenizer_path
from tapcast.llm.token_blocks import (decode_block, decode_segment, encode_segment, read_digests,
                                      read_tokens, write_tokens)

from .cases import ROWS, SF, awkward, empty, texts


def exact(text):
    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    return tok.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", [
    "", "Plain words, and Marks!", "it's we'll DON'T", "für 漢字 ñandú 🙂 ½ 12345 x2", "a b c​d",
    "é Å İ İ", "ΣΑΣ σας", "<|endoftext|> <|startoftext|>", "...!!!", "“quoted” – dash… .", "x" * 500])
def test_chunked_ids_equal_whole_text_ids(text):
    ids = TokenEncoder(tokenizer_path()).ids(text.encode())
    assert np.frombuffer(ids, "<u4").tolist() == exact(text)


def test_chunked_ids_on_real_texts():
    enc = TokenEncoder(tokenizer_path())
    for text in list(texts().values())[:60]:
        assert np.frombuffer(enc.ids(text.encode()), "<u4").tolist() == exact(text)


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("top", [0, 1, 50000, 2**32 - 1])
def test_segment_round_trip(n, top):
    rng = np.random.default_rng(n + 1)
    ids = rng.integers(0, top, n, dtype=np.uint32, endpoint=True)
    ids[rng.random(n) < 0.05] = top  # outliers
    payload = encode_segment(ids)
    assert (decode_segment(payload) == ids).all()
    for k in range(-(-n // 1024)):
        assert (decode_block(payload, k) == ids[k * 1024:(k + 1) * 1024]).all()


def test_outliers_are_exceptions_and_blocks_are_narrow():
    ids = np.full(1024, 70000, np.uint32)
    ids[5] = 4_000_000_000
    assert len(encode_segment(ids)) < 60


def test_wrong_payload_is_refused():
    with pytest.raises(ValueError):
        decode_segment(b"nope" + b"\0" * 20)


def test_query_against_brute_force(spark):
    got = {r.doc_id: r for r in queries.op2_token_blocks(spark, SF).collect()}
    start = 0
    for doc, text in texts().items():
        ids = np.array(exact(text) + [1], "<u4")
        r = got[doc]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(texts())


def test_awkward_rows_and_empty_table(spark):
    path = shared_path(spark, "t")
    write_tokens(awkward(spark), path, tokenizer_path(), 1)
    got = read_tokens(spark, path).collect()
    assert sorted((r.doc_id or -1, tuple(r.ids)) for r in got) == sorted(
        (i or -1, tuple(exact(t) + [1])) for i, t in ROWS)
    assert sorted(r.start for r in got)[0] == 0
    path = shared_path(spark, "t")
    write_tokens(empty(spark), path, tokenizer_path(), 1)
    assert read_digests(spark, path).count() == 0
