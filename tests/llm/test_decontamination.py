import re

import duckdb

from tapcast.llm import decontamination as D
from tapcast.llm import queries
from tapcast.llm.common import word_hashes

from .cases import CLASHING, ROWS, SF, awkward, empty, texts


def shingles(text):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_query_against_brute_force(spark):
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    held = {i: shingles(t) for i, t in texts().items()}
    expected = {(d, i) for i, t in items for d in held
                if shingles(t) and len(shingles(t) & held[d]) >= 0.8 * len(shingles(t))}
    got = {(r.doc_id, r.item_id) for r in queries.op9_decontamination(spark, SF).collect()}
    assert got == expected and expected


ITEMS = [(1, "one two three four five six"), (2, None), (3, ""), (4, "word"), (5, "w1x w2x w3x"), (5, "w1x w2x w3x"),
         (6, " ".join(f"w{i}x" for i in range(100, 400))), (7, "nothing like this anywhere at all")]


def test_awkward_rows_blocks_and_clashing_columns(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "'x' as shared")
    for block in (10, D.BLOCK_SHINGLES):
        got = sorted((r.doc_id or -1, r.item_id, r.shared) for r in D.leaks(awkward(spark), items, block=block).collect())
        assert got == sorted([(4, 1, 2), (4, 1, 2), (5, 1, 2), (8, 4, 1), (3, 5, 1), (3, 5, 1), (3, 6, 296)])
    clean = D.kept(awkward(spark), items)
    assert clean.columns == ["doc_id", "text", *CLASHING]
    assert sorted(str(r.text) for r in clean.collect()) == sorted(
        str(t) for i, t in ROWS if i not in (3, 5, 8) and not (i == 4 and "one" in t))


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.leaks(empty(spark), items).count() == 0
    assert D.leaks(awkward(spark), items.limit(0)).count() == 0
    assert D.kept(awkward(spark), items.limit(0)).count() == len(ROWS)


def test_partial_containment_at_the_threshold():
    item = [f"t{i}" for i in range(24)]  # 20 shingles
    index = D.ItemIndex([1], [" ".join(item).encode()], 5, 0.8)
    # Changing the last four words loses four shingles, the fifth one more.
    assert index.matches(word_hashes(" ".join(item[:20]).encode()))[0][1:] == (16, 20)
    assert not index.matches(word_hashes(" ".join(item[:19]).encode()))


def test_signature_never_loses_a_match():
    for n in (1, 5, 31, 32, 33, 200, 1000, 20000):
        k = D.signature_size(n)
        assert k <= n and k > 0.2 * n - 1
