import hashlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tapcast.llm import queries
from tapcast.llm import token_alignment as ta
from tapcast.llm.common import tokenizer_path

from .cases import ROWS, SF, awkward, empty, texts

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@lru_cache(maxsize=1)
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_of():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


BYTE = byte_of()


def plain(text):
    """(A ids, B ids, groups, links) of a whole text."""
    if not text:
        return [], [], [], []
    a, b = libraries()
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    xs = [bytes(BYTE[c] for c in a.id_to_token(i)) for i in x]
    ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    if not b"".join(xs) == b"".join(ys) == (" " + text).encode():
        return [], [], [], []
    ea, eb = np.cumsum([len(p) for p in xs]), np.cumsum([len(p) for p in ys])
    low = np.searchsorted(eb, ea - [len(p) for p in xs], "right")  # B tokens that end behind an A token's start
    high = np.searchsorted(eb - [len(p) for p in ys], ea, "left")  # and start before its end
    links = [(x[i], y[j]) for i in range(len(x)) for j in range(low[i], high[i])]
    groups, fa, fb = [], 0, 0
    place_a, place_b = ({int(e): k + 1 for k, e in enumerate(t)} for t in (ea, eb))
    for e in sorted(set(place_a) & set(place_b)):
        i, j = place_a[e], place_b[e]
        groups.append(",".join(map(str, x[fa:i])) + "|" + ",".join(map(str, y[fb:j])))
        fa, fb = i, j
    return x, y, groups, links


def brute(docs):
    parts = [plain(t) for _, t in docs]
    count = Counter(p for *_, links in parts for p in set(links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return sorted(((i, len(x), len(y), len(g), len(ln), sum(count[p] == best[p[0]] for p in ln), sum(count[p] for p in ln),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
                   for (i, _), (x, y, g, ln) in zip(docs, parts)), key=str)


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_query_against_brute_force(spark):
    got = queries.op12_token_alignment(spark, SF)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert rows(got) == brute(sorted(texts().items()))


ODD = [(20, "a▁b"), (21, "  two  spaces   three "), (22, "<|endoftext|> <s> <0x0A> <unk>"), (23, " "), (24, "tab\t x\n\n y \xa0 z"),
       (2**53 + 1, "near"), (2**53 + 3, "far"), (25, "\x00 nul"), (26, "x" * 5000)]


def test_awkward_rows_in_one_shard_and_in_several(spark, monkeypatch):
    want = brute(ROWS + ODD)
    assert rows(ta.aligned(awkward(spark, ROWS + ODD), A, B)) == want
    monkeypatch.setattr(ta, "SHARD_PAIRS", 1500)
    assert rows(ta.aligned(awkward(spark, ROWS + ODD), A, B)) == want
    assert ta.aligned(empty(spark), A, B).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .'\n\t\xa0é漢🙂<0x>▁ ", max_size=24))
def test_chunks_align_as_whole_texts_do(text):
    chunker = ta.Chunker()
    numbers = np.frombuffer(chunker.of(text), "<i4")
    found = ta.aligner(A, B).aligned(list(chunker.numbers))
    own = [found[k] for k in numbers]
    x, y, groups, links = plain(text)
    if not x:
        assert not own or any(r[2] == 0 for r in own)
        return
    keys = np.frombuffer(b"".join(r[0] for r in own), "<u4")
    assert sorted((int(k) // 32000, int(k) % 32000) for k in keys) == sorted(links)
    assert b";".join(r[1] for r in own).decode() == ";".join(groups)
    assert (sum(r[2] for r in own), sum(r[3] for r in own)) == (len(x), len(y))


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**40), max_size=400))
def test_perfect_hash_is_minimal_and_survives_bytes(keys):
    keys = np.array(sorted(keys), np.uint64)
    h = ta.PerfectHash.from_bytes(*ta.PerfectHash.build(keys).to_bytes())
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))


def test_unknown_keys_are_an_error():
    keys = np.arange(0, 1000, 2, dtype=np.uint64)
    h = ta.PerfectHash.build(keys)
    by_slot = np.zeros(len(keys), np.uint32)
    by_slot[h.slots(keys)] = keys
    shard = ta.Shard(h, by_slot)
    assert (shard.keys[shard.slots(keys.astype(np.uint32))] == keys).all()
    for k in (1, 3, 777):
        try:
            shard.slots(np.array([k], np.uint32))
        except ValueError:
            continue
        raise AssertionError(k)
