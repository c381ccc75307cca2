import hashlib
import re

from pyspark.sql import functions as F

from tapcast.llm import queries, syncmers

from .cases import ROWS, SF, awkward, empty, texts


def anchors_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r[0]: r[1] for r in syncmers.with_anchors(df, "text", "a").select("doc_id", "a").collect()}


def hashes(spark, words):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i long, w string")
    return [r[1] for r in df.select("i", F.xxhash64("w")).orderBy("i").collect()]


def test_anchors_are_closed_syncmers(spark):
    words = [f"w{i * 7919 % 331}" for i in range(120)]
    h, k = hashes(spark, words), syncmers.K
    chosen = [i for i in range(len(h) - k + 1) if min(h[i:i + k]) in (h[i], h[i + k - 1])]
    got = anchors_of(spark, [(1, " ".join(words)), (2, "  " + "\n".join(w.upper() for w in words) + " ")])
    assert len(got[1]) == len(chosen) and got[1] == got[2]
    # Context-free: what surrounds a run never changes its anchors.
    moved = anchors_of(spark, [(1, "new start here " + " ".join(words) + " new end")])[1]
    assert set(got[1]) <= set(moved)


def test_query_against_brute_force(spark):
    docs = texts()
    ids = sorted(docs)
    got = {r.doc_id: r for r in queries.op8_syncmers(spark, SF).collect()}
    assert sorted(got) == ids
    prints, edited = {}, []
    for n, i in enumerate(ids):
        t, u = docs[i], docs[ids[(n + 1) % len(ids)]]
        half = len(t) // 2
        e = t[:len(t) - half] + u[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        edited.append((i, e))
    again = anchors_of(spark, edited)
    cut = lambda s: {s[k:k + 8] for k in range(0, len(s), 8)}
    for n, i in enumerate(ids):
        r, u = got[i], got[ids[(n + 1) % len(ids)]]
        a, e, b = cut(r.fingerprint), cut(r.edited_fingerprint), cut(u.fingerprint)
        assert len(r.edited_fingerprint) == 8 * len(again[i])
        alike = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert abs(r.near_edited - alike(a, e)) < 1e-12 and abs(r.near_next - alike(a, b)) < 1e-12


def test_awkward_rows_and_empty_table(spark):
    rows = syncmers.fingerprints(awkward(spark)).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in rows) == sorted((i or -1, len(t or "")) for i, t in ROWS)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert syncmers.fingerprints(empty(spark)).count() == 0
    one = syncmers.fingerprints(spark.createDataFrame([(5, "only one text")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_plan_has_no_python(spark):
    df = syncmers.fingerprints(spark.read.parquet(f"{SF}/documents.parquet"))
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))


def short_texts(spark, least=40):
    """Texts of 8 to 13 words of which no 8-mer is an anchor, all different."""
    words = [f"v{i * 7919 % 1009}" for i in range(1500)]
    h = dict(zip(words, hashes(spark, words)))
    out, k = [], syncmers.K
    for a in range(0, len(words) - 13, 13):
        t = words[a:a + 8 + a % 3]
        if not any(min(h[w] for w in t[i:i + k]) in (h[t[i]], h[t[i + k - 1]]) for i in range(len(t) - k + 1)):
            out.append(t)
    assert len(out) >= least
    return out


def test_short_texts_without_an_anchor_have_all_their_shorter_runs(spark):
    texts_ = short_texts(spark)
    got = anchors_of(spark, [(i, " ".join(t)) for i, t in enumerate(texts_)])
    half = syncmers.K // 2
    assert all(len(got[i]) == len(t) - half + 1 for i, t in enumerate(texts_))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts_[:6])] + [(6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    near = {r.doc_id: r for r in syncmers.fingerprints(df).collect()}
    assert all(near[i].near_next == 0 and near[i].fingerprint for i in range(6))
    # Equal ones are alike.
    same = spark.createDataFrame([(0, " ".join(texts_[0])), (1, " ".join(texts_[0]))], "doc_id long, text string")
    assert all(r.near_next == 1 for r in syncmers.fingerprints(same).collect())


def test_places_are_those_of_the_anchors_first_words(spark):
    words = [f"w{i * 7919 % 331}" for i in range(120)]
    h, k = hashes(spark, words), syncmers.K
    chosen = [i for i in range(len(h) - k + 1) if min(h[i:i + k]) in (h[i], h[i + k - 1])]
    short = short_texts(spark)[0]
    rows = [(1, " ".join(words)), (2, "only four words here"), (3, None), (4, " ".join(short))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in syncmers.fingerprints(df).collect()}
    assert got[1].places == chosen and got[2].places == [0] and got[3].places == []
    assert got[4].places == list(range(len(short) - k // 2 + 1))
    assert all(8 * len(r.edited_places) == len(r.edited_fingerprint) for r in got.values())


def test_places_over_whole_real_texts_against_plain_python(spark):
    """Every anchor of every text, by a plain search over its words."""
    docs = texts()
    words = {i: [w for w in re.split(r"[ \t\n\x0b\f\r]+", t.lower()) if w] for i, t in docs.items()}
    every = sorted({w for ws in words.values() for w in ws})
    h, k = dict(zip(every, hashes(spark, every))), syncmers.K
    df = spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r.a_at for r in syncmers.with_anchors(df, "text", "a").select("doc_id", "a_at").collect()}
    for i, ws in words.items():
        own = [h[w] for w in ws]
        want = [p for p in range(len(own) - k + 1) if min(own[p:p + k]) in (own[p], own[p + k - 1])]
        if want:
            assert got[i] == want
        else:  # short texts have all their shorter runs
            assert got[i] == list(range(max(0, len(ws) - k // 2 + 1) if len(ws) >= k else min(1, len(ws))))
