"""Toxicity: a bidirectional gated recurrent network with attention pooling,
trained in numpy, over overlapping word windows of a whole text: windows of
``WINDOW`` words, one from every ``STRIDE``-th word and one at the end, so every
word is scored, and every run of ``WINDOW - STRIDE + 1`` words in one piece.

A word's input joins a word embedding, the mean embedding of its character
4- and 5-grams, and three evidence values: how much more often the word and its
character n-grams occur in toxic documents than in others (smoothed log odds).
Two gated recurrent layers read a window forwards and backwards; attention
pools their states; a logistic unit scores the window. A document's score is
that of its worst window.

Training knows only document labels. Windows are chosen by the network itself:
each toxic document teaches its worst window, each clean one its worst and some
others (multiple-instance learning). While training, evidence about a word is
taken without the document at hand, so the network cannot read the label off a
rare word. At the end scores are shifted so that the best cut between the two
classes lies at ``CUT``.

Evidence is counted by a Spark aggregation, and the cut chosen from a Spark
histogram of scores, both over all labelled rows that are not held out. Only the
network's gradients come from a bounded sample: at most ``SAMPLE`` documents of
either class, those with the smallest hash of their id. Scoring covers all
documents, whole.

Cases: a null text is empty; texts without words score 0; unlabelled training
rows are not used; without both classes among the labels every score is 0; null
ids are scored like others; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapcast.llm.common import doc_columns, mix, ship_package, worker_task
from tapcast.session import materialize

#: Most training documents of either class.
SAMPLE = 1000
WINDOW, STRIDE = 32, 24
HIDDEN, EMBED = 8, 6
#: Times windows are chosen anew; gradient steps at least, over all of them.
EPOCHS, LEAST_STEPS = 6, 600
CUT = 0.7
_WORD_TABLE, _GRAM_TABLE, _EMBED_TABLE = 1 << 20, 1 << 19, 1 << 13
_CLIP = 4.0
#: Logits of a histogram's bin, and the bins on either side of 0.
BIN, BINS = 1 / 64, 4096


class _Vocabulary(dict):
    """Chunk -> little-endian int32 numbers of its words, for one batch."""

    pattern = re.compile(r"\w+")

    def __init__(self) -> None:
        super().__init__()
        self.numbers: dict[str, int] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        n = self.numbers
        found = self.pattern.findall(chunk.decode("utf-8", "replace").lower())
        out = np.array([n.setdefault(w, len(n)) for w in found], "<i4").tobytes()
        self[chunk] = out
        return out

    def of(self, text: bytes) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, text.lower().split())), "<i4")


def _hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, n-gram hashes, first n-gram of each word) of
    ``^word$`` bytes: all 4- and 5-grams, or the whole if it is shorter."""
    raw = [b"^" + w.encode() + b"$" for w in words]
    size = np.array([len(r) for r in raw])
    flat = np.frombuffer(b"".join(raw) + b"^" * 5, np.uint8).astype(np.uint64)
    end = np.cumsum(size)
    start = end - size
    with np.errstate(over="ignore"):
        g4 = flat[:-3] | flat[1:-2] << np.uint64(8) | flat[2:-1] << np.uint64(16) | flat[3:] << np.uint64(24)
        g5 = mix(g4[:-1] | flat[4:][:len(g4) - 1] << np.uint64(32) | np.uint64(1 << 40))
        g4 = mix(g4)
        inside = np.repeat(end, size) - np.arange(len(flat) - 5)  # bytes to the word's end
        four, five = inside >= 4, inside >= 5
        n4, n5 = np.maximum(size - 3, 1), np.maximum(size - 4, 0)
        first = np.concatenate([[0], np.cumsum(n4 + n5)[:-1]])
        four |= (size < 4).repeat(size) & (np.arange(len(flat) - 5) == start.repeat(size))
        grams = np.empty(int((n4 + n5).sum()), np.uint64)
        word = np.repeat(np.arange(len(raw)), size)
        offset = np.arange(len(flat) - 5) - start[word]
        grams[(first[word] + offset)[four]] = g4[:len(word)][four]
        grams[(first[word] + n4[word] + offset)[five]] = g5[:len(word)][five]
        # A word's hash: the sum of its bytes' hashes with their places.
        place = mix(flat[:len(word)] * np.uint64(0x9E3779B97F4A7C15) + mix(offset.astype(np.uint64) + np.uint64(7)))
        whole = mix(np.add.reduceat(place, start)) if len(raw) else np.zeros(0, np.uint64)
    return whole, grams, first


@dataclass
class Evidence:
    """Documents of either class that hold a word or an n-gram (by bucket)."""

    size: int
    toxic: np.ndarray = field(default=None)
    clean: np.ndarray = field(default=None)
    n_toxic: int = 0
    n_clean: int = 0

    def __post_init__(self) -> None:
        self.toxic, self.clean = np.zeros(self.size, np.float32), np.zeros(self.size, np.float32)

    def add(self, buckets: np.ndarray, label: int) -> None:
        (self.toxic if label else self.clean)[np.unique(buckets)] += 1
        self.n_toxic, self.n_clean = self.n_toxic + label, self.n_clean + 1 - label

    def odds(self, buckets: np.ndarray, without: int | None = None) -> np.ndarray:
        p, n, n_p, n_n = self.toxic[buckets], self.clean[buckets], self.n_toxic, self.n_clean
        if without is not None:  # leave out the document at hand
            p, n = np.maximum(p - without, 0), np.maximum(n - (1 - without), 0)
            n_p, n_n = n_p - without, n_n - (1 - without)
        odds = np.log((p + 0.5) / (n_p + 1)) - np.log((n + 0.5) / (n_n + 1))
        return np.clip(odds * (p + n) / (p + n + 2), -_CLIP, _CLIP).astype(np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters, forward pass and gradients. Inputs of a window batch:
    x (T, B, D), mask (T, B)."""

    def __init__(self, rng: np.random.Generator) -> None:
        d, h = 2 * EMBED + 4, HIDDEN
        w = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"ew": 0.1 * w(_EMBED_TABLE, EMBED), "ec": 0.1 * w(_EMBED_TABLE, EMBED),
                  "wf": w(d, 3 * h), "wb": w(d, 3 * h), "uf": w(h, 3 * h), "ub": w(h, 3 * h),
                  "wa": w(2 * h, h), "va": w(h, 1), "wo": w(2 * h, 1), "bo": np.zeros(1, np.float32)}
        self.p["ew"] *= np.float32(np.sqrt(_EMBED_TABLE) / 10)
        self.p["ec"] *= np.float32(np.sqrt(_EMBED_TABLE) / 10)

    @staticmethod
    def layer(px, mask, u, keep=None):
        """States of one direction for input products px (T, B, 3H)."""
        t_max, b, k = px.shape
        h = np.zeros((b, k // 3), np.float32)
        out = np.empty((t_max, b, k // 3), np.float32)
        k = k // 3
        for t in range(t_max):
            q = h @ u
            zr = _sigmoid(px[t, :, :2 * k] + q[:, :2 * k])
            z, r = zr[:, :k], zr[:, k:]
            n = np.tanh(px[t, :, 2 * k:] + r * q[:, 2 * k:])
            if keep is not None:
                keep.append((h, z, r, n, q[:, 2 * k:]))
            h = (n + z * (h - n)) * mask[t][:, None]
            out[t] = h
        return out

    @staticmethod
    def layer_back(dout, mask, u, keep):
        """Gradients of a layer: (of its input products, of u)."""
        t_max, b, k = dout.shape
        dpx = np.empty((t_max, b, 3 * k), np.float32)
        du = np.zeros_like(u)
        dh = np.zeros((b, k), np.float32)
        for t in range(t_max - 1, -1, -1):
            h, z, r, n, qn = keep[t]
            dh = (dh + dout[t]) * mask[t][:, None]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * qn * r * (1 - r)
            dpx[t] = np.concatenate([dz, dr, dn], axis=1)
            dq = np.concatenate([dz, dr, dn * r], axis=1)
            du += h.T @ dq
            dh = dh * z + dq @ u.T
        return dpx, du

    def pooled(self, hf, hb, mask):
        s = np.concatenate([hf, hb], axis=2)
        a = np.tanh(s @ self.p["wa"])
        e = np.where(mask[:, :, None] > 0, a @ self.p["va"], np.float32(-30))
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        c = (w * s).sum(axis=0)
        return s, a, w, c, (c @ self.p["wo"])[:, 0] + self.p["bo"]

    def logits(self, pf, pb, mask):
        """From input products of both directions, in text order."""
        hf = self.layer(pf, mask, self.p["uf"])
        hb = self.layer(pb[::-1], mask[::-1], self.p["ub"])[::-1]
        return self.pooled(hf, hb, mask)[-1]

    def gradients(self, x, mask, y, weight):
        p, kf, kb = self.p, [], []
        hf = self.layer(x @ p["wf"], mask, p["uf"], kf)
        hb = self.layer((x @ p["wb"])[::-1], mask[::-1], p["ub"], kb)[::-1]
        s, a, w, c, logit = self.pooled(hf, hb, mask)
        d = ((_sigmoid(logit) - y) * weight).astype(np.float32)
        g = {"bo": np.array([d.sum()], np.float32), "wo": c.T @ d[:, None]}
        dc = d[:, None] * p["wo"][:, 0]
        ds = w * dc
        dw = (s * dc).sum(axis=2, keepdims=True)
        de = w * (dw - (w * dw).sum(axis=0))
        g["va"] = (a * de).sum(axis=(0, 1))[:, None]
        da = de * p["va"][:, 0] * (1 - a * a)
        g["wa"] = np.tensordot(s, da, ([0, 1], [0, 1]))
        ds = ds + da @ p["wa"].T
        h = HIDDEN
        df, g["uf"] = self.layer_back(ds[:, :, :h], mask, p["uf"], kf)
        db, g["ub"] = self.layer_back(ds[::-1, :, h:], mask[::-1], p["ub"], kb)
        db = db[::-1]
        g["wf"], g["wb"] = (np.tensordot(x, v, ([0, 1], [0, 1])) for v in (df, db))
        return g, df @ p["wf"].T + db @ p["wb"].T, logit


class ToxicityModel:
    """Evidence, network and the final shift; picklable, a few megabytes."""

    def __init__(self) -> None:
        self.words, self.grams = Evidence(_WORD_TABLE), Evidence(_GRAM_TABLE)
        self.net = Network(np.random.default_rng(7))
        self.cut = None

    # -- inputs ---------------------------------------------------------
    @staticmethod
    def buckets(vocab: list[str]):
        """Table places of words and of their n-grams, each word's first
        n-gram, and their numbers."""
        w, g, first = _hashed(vocab)
        n = np.diff(np.append(first, len(g)))
        return ((w % np.uint64(_WORD_TABLE)).astype(np.int32), (g % np.uint64(_GRAM_TABLE)).astype(np.int32),
                first.astype(np.int32), n.astype(np.int32))

    def evidence(self, places, without: int | None = None) -> np.ndarray:
        wb, gb, first, n = places
        odds = self.grams.odds(gb, without)
        return np.stack([self.words.odds(wb, without), np.maximum.reduceat(odds, first),
                         np.add.reduceat(odds, first) / n.astype(np.float32)], axis=1)

    def inputs(self, places, evidence: np.ndarray) -> np.ndarray:
        """Inputs of words, (words, D)."""
        wb, gb, first, n = places
        return np.concatenate([
            self.net.p["ew"][wb % _EMBED_TABLE],
            np.add.reduceat(self.net.p["ec"][gb % _EMBED_TABLE], first) / n[:, None].astype(np.float32),
            evidence, np.ones((len(wb), 1), np.float32)], axis=1)

    # -- training -------------------------------------------------------
    def count(self, texts: list[bytes], labels: list[int]) -> None:
        """Add the evidence of these documents."""
        v = _Vocabulary()
        ids = [np.unique(v.of(t)) for t in texts]
        if not v.numbers:
            return
        wb, gb, first, n = self.buckets(list(v.numbers))
        for used, y in zip(ids, labels):
            if len(used):
                grams = np.repeat(first[used] - np.cumsum(n[used]) + n[used], n[used]) + np.arange(n[used].sum())
                self.words.add(wb[used], y)
                self.grams.add(gb[grams], y)

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = EPOCHS) -> ToxicityModel:
        """Train on these documents; they are the evidence, too, unless it
        was counted before (over documents that include these)."""
        rng = np.random.default_rng(11)
        docs = []
        if not self.words.n_toxic + self.words.n_clean:
            self.count(texts, labels)
        for text, y in zip(texts, labels):
            v = _Vocabulary()
            ids = v.of(text)
            if len(ids):
                docs.append((self.buckets(list(v.numbers)), ids, y))
        if len({y for _, _, y in docs}) < 2:
            return self
        # Evidence about a document's words without the document itself.
        docs = [(places, ids, y, self.evidence(places, y)) for places, ids, y in docs]
        state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.net.p.items()}
        step = 0
        scores = None
        for epoch in range(epochs):
            if epoch:
                scores = self._doc_logits(docs)
            picks = []
            for i, (_, ids, y, left_out) in enumerate(docs):
                starts = window_starts(len(ids))
                if epoch == 0:
                    most = left_out[:, :2].max(axis=1)[ids]
                    s = np.array([most[a:a + WINDOW].max() for a in starts])
                else:
                    s = scores[i]
                order = np.argsort(-s)
                take = order[:1] if y else np.unique(np.append(order[:2], rng.choice(len(s), min(2, len(s)))))
                picks += [(i, int(starts[k]), y) for k in take]
            ys = np.array([p[2] for p in picks])
            share = np.where(ys == 1, 0.5 / max(1, ys.sum()), 0.5 / max(1, (1 - ys).sum())) * len(ys)
            passes = -(-LEAST_STEPS // (epochs * -(-len(picks) // 128)))
            for _ in range(passes):
                order = rng.permutation(len(picks))
                for a in range(0, len(order), 128):
                    part = order[a:a + 128]
                    step += 1
                    self._learn([picks[k] for k in part], share[part].astype(np.float32), docs, state, step)
        scores = np.array([s.max() for s in self._doc_logits(docs)])
        self.cut = best_cut(scores, np.array([d[2] for d in docs]))
        return self

    def _doc_logits(self, docs) -> list[np.ndarray]:
        """Logits of all windows of each document, many documents at once."""
        out: list[np.ndarray] = []
        for a in range(0, len(docs), 64):
            part = docs[a:a + 64]
            x = np.concatenate([self.inputs(places, left_out) for places, _, _, left_out in part])
            first = np.cumsum([0] + [len(d[3]) for d in part[:-1]])
            index, doc = windows([ids + f for (_, ids, _, _), f in zip(part, first)], with_doc=True)
            logit = self._window_logits(x @ self.net.p["wf"], x @ self.net.p["wb"], index)
            out += np.split(logit, np.nonzero(doc[1:] != doc[:-1])[0] + 1)
        return out

    def _window_logits(self, pf, pb, index, batch: int = 2048):
        """Logits of windows of word numbers (windows, T); -1 is no word."""
        pf, pb = (np.concatenate([v, np.zeros((1, v.shape[1]), np.float32)]) for v in (pf, pb))
        out = np.empty(len(index), np.float32)
        for a in range(0, len(index), batch):
            part = index[a:a + batch].T
            out[a:a + batch] = self.net.logits(pf[part], pb[part], (part >= 0).astype(np.float32))
        return out

    def _learn(self, picks, weight, docs, state, step, rate: float = 0.01) -> None:
        index, start, parts, left_out = np.full((len(picks), WINDOW), -1), 0, [], []
        for k, (i, a, _) in enumerate(picks):
            (wb, gb, first, n), ids, _, own = docs[i]
            used, at = np.unique(ids[a:a + WINDOW], return_inverse=True)
            index[k, :len(at)] = at + start
            start += len(used)
            grams = np.repeat(first[used] - np.cumsum(n[used]) + n[used], n[used]) + np.arange(n[used].sum())
            parts.append((wb[used], gb[grams], n[used]))
            left_out.append(own[used])
        wb, gb, n = (np.concatenate(v) for v in zip(*parts))
        first = np.cumsum(n) - n
        x = self.inputs((wb, gb, first, n), np.concatenate(left_out))
        pad = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        mask = (index >= 0).T.astype(np.float32)
        y = np.array([p[2] for p in picks], np.float32)
        g, dx, _ = self.net.gradients(pad[index.T], mask, y, weight / len(picks))
        flat = np.zeros_like(pad)
        np.add.at(flat, index.T.reshape(-1), dx.reshape(-1, dx.shape[2]))
        flat = flat[:-1]
        g["ew"], g["ec"] = np.zeros_like(self.net.p["ew"]), np.zeros_like(self.net.p["ec"])
        np.add.at(g["ew"], wb % _EMBED_TABLE, flat[:, :EMBED])
        np.add.at(g["ec"], gb % _EMBED_TABLE,
                  np.repeat(flat[:, EMBED:2 * EMBED] / n[:, None].astype(np.float32), n, axis=0))
        for k, v in self.net.p.items():
            m, s = state[k]
            m += 0.1 * (g[k] - m)
            s += 0.01 * (g[k] ** 2 - s)
            v -= rate * (0.05 if k in ("ew", "ec") else 1.0) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)

    # -- scoring --------------------------------------------------------
    def score_batch(self, texts: list[bytes]) -> np.ndarray:
        """Scores of whole texts, all windows."""
        out = np.zeros(len(texts))
        if self.cut is None:
            return out
        worst = self.worst_logits(texts)
        found = ~np.isnan(worst)
        out[found] = _sigmoid(worst[found] - self.cut + np.log(CUT / (1 - CUT)))
        return out

    def worst_logits(self, texts: list[bytes], without: int | None = None) -> np.ndarray:
        """The worst window's logit of each text, NaN of one without words.
        ``without`` is the label of all these texts if they were counted: then
        each is scored by the evidence of all other documents."""
        out = np.full(len(texts), np.nan)
        v = _Vocabulary()
        ids = [v.of(t) for t in texts]
        if not v.numbers:
            return out
        places = self.buckets(list(v.numbers))
        x = self.inputs(places, self.evidence(places, without))
        index, doc = windows(ids, with_doc=True)
        logit = self._window_logits(x @ self.net.p["wf"], x @ self.net.p["wb"], index)
        first = np.nonzero(np.r_[True, doc[1:] != doc[:-1]])[0]
        out[doc[first]] = np.maximum.reduceat(logit, first).astype(np.float64)
        return out


def window_starts(n: int) -> np.ndarray:
    """Overlapping windows that cover ``n`` words."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def windows(ids: list[np.ndarray], with_doc: bool = False):
    """Word numbers of all windows (windows, T), -1 past a text's end; and the
    text each window is of. Texts without words have none."""
    size = np.array([len(x) for x in ids])
    count = np.where(size > 0, np.maximum(1, -(-(size - WINDOW + STRIDE) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(ids)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    at = (k * STRIDE)[:, None] + np.arange(WINDOW)
    begin = np.cumsum(size) - size
    flat = np.append(np.concatenate(ids) if ids else np.zeros(0, np.int32), np.int32(-1))
    where = np.where(at < size[doc][:, None], at + begin[doc][:, None], len(flat) - 1)
    return (flat[where], doc) if with_doc else (flat[where],)


def best_cut(scores: np.ndarray, y: np.ndarray) -> float:
    """The logit between two scores with the best F1; in the middle of the
    widest gap among equally good ones."""
    order = np.argsort(-scores)
    s, t = scores[order], y[order]
    hit = np.cumsum(t)
    f1 = 2 * hit / (np.arange(1, len(t) + 1) + t.sum())
    after = np.append(s[1:], s[-1] - 1)
    good = np.nonzero(f1 >= f1.max() - 1e-12)[0]
    k = good[np.argmax((s - after)[good])]
    return float((s[k] + after[k]) / 2)


def histogram_cut(bins: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """``best_cut`` of a histogram: between two bins that hold scores."""
    order = np.argsort(-bins)
    b, n, t = bins[order], (clean + toxic)[order], toxic[order]
    f1 = 2 * np.cumsum(t) / (np.cumsum(n) + t.sum())
    low = b * BIN
    after = np.append((b[1:] + 1) * BIN, low[-1] - 1)
    good = np.nonzero(f1 >= f1.max() - 1e-12)[0]
    k = good[np.argmax((low - after)[good])]
    return float((low[k] + after[k]) / 2)


def held_out(id_col: Column, parts: int = 3) -> Column:
    """The rows that no model learns from; a null id is not one of them."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts == 1


def pieces(column, chunk: int = 8 << 20):
    """(from, to) of runs of a batch's texts of about ``chunk`` bytes."""
    size = np.cumsum([len(t.as_buffer()) for t in column])
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + chunk)))
        yield a, b
        a = b


EVIDENCE = pa.schema([("bucket", pa.int32()), ("toxic", pa.int64()), ("clean", pa.int64())])


def counted(labelled: DataFrame) -> ToxicityModel:
    """An untrained model with the evidence of all rows (text, y). A task
    sends what it counted by bucket; the sums are bounded by the tables."""

    @worker_task()
    def count(batches):
        own, some = ToxicityModel(), False
        for batch in batches:
            for a, b in pieces(batch.column("text")):
                part = batch.slice(a, b - a)
                own.count(part.column("text").to_pylist(), part.column("y").to_pylist())
                some = True
        if some:
            both = [np.concatenate([getattr(own.words, k), getattr(own.grams, k), [n]]).astype(np.int64)
                    for k, n in (("toxic", own.words.n_toxic), ("clean", own.words.n_clean))]
            at = np.nonzero(both[0] + both[1])[0]
            for a in range(0, len(at), 10_000):
                k = at[a:a + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(both[0][k]), pa.array(both[1][k])],
                                                 schema=EVIDENCE)

    parts = labelled.select("text", "y").mapInArrow(count, "bucket int, toxic long, clean long")
    sums = parts.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    model = ToxicityModel()
    at = sums.column("bucket").to_numpy()
    for k in ("toxic", "clean"):
        dense = np.zeros(_WORD_TABLE + _GRAM_TABLE + 1)
        dense[at] = sums.column(k).to_numpy()
        setattr(model.words, k, dense[:_WORD_TABLE].astype(np.float32))
        setattr(model.grams, k, dense[_WORD_TABLE:-1].astype(np.float32))
        setattr(model.words, "n_" + k, int(dense[-1]))
        setattr(model.grams, "n_" + k, int(dense[-1]))
    return model


def chosen_cut(labelled: DataFrame, model: ToxicityModel) -> float:
    """The cut with the best F1 over all rows (text, y) of ``counted``; each
    is scored by the evidence of the others."""
    sent = labelled.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("y", pa.int32()), ("logit", pa.float64())])

    @worker_task()
    def score(batches):
        for batch in batches:
            for a, b in pieces(batch.column("text")):
                texts, y = (batch.column(c).slice(a, b - a).to_pylist() for c in ("text", "y"))
                for label in (0, 1):
                    own = [t for t, v in zip(texts, y) if v == label]
                    s = sent.value.worst_logits(own, label)
                    s = s[~np.isnan(s)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), label, np.int32)), pa.array(s)], schema=schema)

    bins = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("logit") / BIN))).cast("int").alias("bin")
    rows = (labelled.select("text", "y").mapInArrow(score, "y int, logit double")
            .groupBy(bins).agg(F.sum(1 - F.col("y")).alias("clean"), F.sum("y").alias("toxic"))).collect()
    return histogram_cut(*(np.array([r[k] for r in rows], np.int64) for k in ("bin", "clean", "toxic")))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample: int = SAMPLE, parts: int = 3) -> ToxicityModel:
    """A model from all labelled documents that are not held out: their
    evidence and their scores' histogram, and a bounded sample of either class
    that reaches the driver for the network."""
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    marked = marked.where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"), parts)).groupBy("doc_id").agg(F.max("y").alias("y"))
    able = doc_columns(docs, id_col, text_col).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), parts))
    # The same join at every size: a few labels would be broadcast, many not.
    labelled = materialize(able.join(marked.hint("shuffle_hash"), "doc_id"))
    ids, taken = labelled.select("doc_id", "y").distinct(), None
    for y in (0, 1):
        one = ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        taken = one if taken is None else taken.unionByName(one)
    # At most 2 * sample rows of a number: bounded, so broadcast.
    rows = (labelled.join(F.broadcast(taken.select("doc_id")), "doc_id")
            .groupBy("doc_id").agg(F.max("text"), F.max("y")).collect())  # of repeated ids one text
    rows = sorted(((r[0], bytes(r[1]), r[2]) for r in rows), key=lambda r: (r[0], r[1]))
    if len({r[2] for r in rows}) < 2:
        return ToxicityModel()
    model = counted(labelled).fit([r[1] for r in rows], [r[2] for r in rows])
    if model.cut is not None:
        model.cut = chosen_cut(labelled, model)
    return model


SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def scored(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text",
           chunk: int = 8 << 20) -> DataFrame:
    """(doc_id, score) of every row; a text's own bytes are all that a score
    depends on."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @worker_task()
    def score(batches):
        for batch in batches:
            size = np.cumsum([len(t.as_buffer()) for t in batch.column("text")])
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + chunk)))
                part = batch.slice(a, b - a)
                s = sent.value.score_batch(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s)], schema=SCORES)
                a = b

    return doc_columns(docs, id_col, text_col).mapInArrow(score, "doc_id long, score double")


def kept(docs: DataFrame, model: ToxicityModel, text_col: str = "text", chunk: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` that score under ``CUT``, all columns as they are:
    one pass, no exchange."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @worker_task()
    def under(batches):
        for batch in batches:
            texts = [b"" if t is None else t for t in batch.column(text_col).cast(pa.binary()).to_pylist()]
            size = np.cumsum([len(t) for t in texts])
            a = 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + chunk)))
                yield batch.slice(a, b - a).filter(pa.array(sent.value.score_batch(texts[a:b]) < CUT))
                a = b

    return docs.mapInArrow(under, docs.schema)
