"""Document log-likelihood by a gated recurrent language model.

Tokens are words (runs of bytes without ASCII white space, A-Z lowered) and one
end per text. The output is class-factored: the network gives the probability
of the next token's class, counts over all training tokens give the token's
probability within its class. The most frequent words and the end are classes
of their own; all other words, known or not, fall into classes by a hash of
their last two bytes, in which every unknown word has the mass of half a count.

Counting is a Spark job over all documents. Texts are cut to batches of bounded
size; a batch numbers its words and sends each word once, so a frequent word is
as many rows as there are batches. Counts come back to the batch the same way.

The network is trained in numpy by truncated back-propagation: streams of
documents, windows of ``STEPS`` tokens, the state carried from window to window
and cleared at a document's start. Pieces of about ``PIECE`` tokens are gone
over once each, and their weights averaged by their tokens, ``ROUNDS`` times: the
network sees every training document that often, whatever the corpus' size.

Cases: a null text is empty and has the end alone; a null id counts as not held
out; words without valid UTF-8 can't occur in a string column; without training
documents the counts are 0 and classes are equally likely; repeated rows count
each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapcast.llm.common import doc_columns, worker_task
from tapcast.session import materialize

#: Text bytes of a batch.
BATCH = 16 << 20
#: Classes: frequent words, hashed word ends, and the end of a text.
SINGLES, HASHED = 63, 32
CLASSES = SINGLES + HASHED + 1
END = CLASSES - 1
HIDDEN = 16
#: Back-propagation: steps of a window, streams side by side.
STEPS, STREAMS = 24, 256
#: Passes over all training documents, at every size.
ROUNDS = 2
#: Tokens that are dealt to streams at a time and make one model (bounded
#: memory). Which documents share a piece follows the files' order.
PIECE = 4_000_000
RATE = 0.01


# -- counting ---------------------------------------------------------------

class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


BATCHES = pa.schema([("batch", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
                     ("sizes", pa.list_(pa.int32())), ("tokens", pa.binary()), ("words", pa.list_(pa.binary())),
                     ("counts", pa.list_(pa.int32()))])
BATCHES_DDL = ("batch long, doc_ids array<long>, held_out array<boolean>, sizes array<int>, tokens binary, "
               "words array<binary>, counts array<int>")


def batches_of(docs: DataFrame, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    """One row per batch of documents (``held_out`` is an expression over
    doc_id): token numbers of each (little-endian
    int32), the batch's words, and how often its training texts hold them."""

    @worker_task()
    def numbered(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids, held, parts, size, numbers = [], [], [], 0, _Numbers()

        def row():
            counts = np.zeros(len(numbers), np.int64)
            train = [p for p, h in zip(parts, held) if not h]
            if train:
                counts += np.bincount(np.concatenate(train), minlength=len(numbers))
            cols = [[(part << 32) + seq], [ids], [held], [[len(p) for p in parts]],
                    [b"".join(p.tobytes() for p in parts)], [list(numbers)], [counts]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, BATCHES)], schema=BATCHES)

        for batch in batches:
            for i, h, t in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(),
                               batch.column("text")):
                text = t.as_py()
                words = text.lower().split()
                ids.append(i)
                held.append(h)
                parts.append(np.fromiter(map(numbers.__getitem__, words), "<i4", len(words)))
                size += len(text) + 1
                if size >= BATCH:
                    yield row()
                    seq += 1
                    ids, held, parts, size, numbers = [], [], [], 0, _Numbers()
        if ids:
            yield row()

    texts = doc_columns(docs, id_col, text_col).withColumn("held_out", held_out)
    return texts.mapInArrow(numbered, BATCHES_DDL)


class Counts:
    """What scoring needs of the corpus besides a word's own count: all
    numbers are bounded by the number of classes."""

    def __init__(self, tokens: int, kinds: int, ends: int, singles: dict[int, int],
                 class_tokens: np.ndarray, class_kinds: np.ndarray) -> None:
        self.tokens, self.kinds, self.ends, self.singles = tokens, kinds, ends, singles
        self.class_tokens, self.class_kinds = class_tokens, class_kinds

    def base(self, c: np.ndarray) -> np.ndarray:
        """log10 of a token's smoothed unigram probability."""
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))

    def inner(self, c: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 of a token's probability within its class."""
        n, v = self.class_tokens[cls], self.class_kinds[cls]
        return np.where((cls < SINGLES) | (cls == END), 0.0, np.log10((c + 0.5) / (n + 0.5 * (v + 1))))

    def prior(self) -> np.ndarray:
        p = self.class_tokens + 0.5
        return np.log(p / p.sum()).astype(np.float32)


def counted(batches: DataFrame) -> tuple[DataFrame, Counts]:
    """(batch, pos, c, cls, name): the corpus count of each word of each batch,
    its hashed class, and a hash of the words frequent enough to be a class of
    their own; and the corpus figures."""
    words = batches.select("batch", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "w"))
    words = words.select("batch", "pos", F.col("w.words").alias("word"), F.col("w.counts").cast("long").alias("n"))
    sums = batches.select(
        F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)),
        F.sum(F.size(F.filter("held_out", lambda h: ~h)))).first()
    tokens, ends = int(sums[0] or 0), int(sums[1] or 0)
    tokens += ends
    # A frequent word has a 2000th of all tokens: there are 2000 at most.
    by_word = Window.partitionBy("word")
    cls = F.lit(SINGLES) + F.pmod(F.xxhash64(F.expr("right(cast(word as string), 2)")), F.lit(HASHED)).cast("int")
    table = materialize(
        words.withColumn("c", F.sum("n").over(by_word))
        .withColumn("first", F.col("batch") == F.min("batch").over(by_word))  # one sort for both
        .select("batch", "pos", "c", cls.alias("cls"), "first",
                F.when(F.col("c") * 2000 >= tokens, F.xxhash64("word")).alias("name")))
    once = table.where("first and c > 0")
    top = once.where("name is not null").orderBy(F.desc("c"), "name").limit(SINGLES).collect()
    singles = {r["name"]: k for k, r in enumerate(top)}
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    kinds = ends > 0
    for r in once.groupBy("cls").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        n[r["cls"]], v[r["cls"]] = r["n"], r["v"]
        kinds += r["v"]
    for k, r in enumerate(top):
        n[k], v[k] = r["c"], 1
        n[r["cls"]], v[r["cls"]] = n[r["cls"]] - r["c"], v[r["cls"]] - 1
    n[END], v[END] = ends, ends > 0
    return table.drop("first"), Counts(tokens, int(kinds), ends, singles, n, v)


DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                       ("n_known", pa.int64()), ("base_score", pa.float64()), ("inner", pa.float64()),
                       ("classes", pa.binary())])
DOCUMENTS_DDL = ("doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, "
                 "inner double, classes binary")


def classed(batches: DataFrame, table: DataFrame, counts: Counts) -> DataFrame:
    """Per document: its figures and its tokens' classes (a byte each)."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for row in left.to_pylist():  # one batch
            c, cls = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
            pos = right.column("pos").to_numpy()
            c[pos], cls[pos] = right.column("c").to_numpy(), right.column("cls").to_numpy()
            named = right.filter(right.column("name").is_valid())
            for p, name in zip(named.column("pos").to_pylist(), named.column("name").to_pylist()):
                cls[p] = counts.singles.get(name, cls[p])
            # The end is one more word.
            c, cls = np.append(c, counts.ends), np.append(cls, END)
            base, inner = counts.base(c), counts.inner(c, cls)
            ids, ends = np.frombuffer(row["tokens"], "<i4"), np.cumsum(row["sizes"])
            tokens = np.insert(ids, ends, len(c) - 1)
            last = ends + np.arange(1, len(ends) + 1)
            first = last - np.asarray(row["sizes"]) - 1
            byte = cls[tokens].astype(np.uint8)
            cols = [row["doc_ids"], row["held_out"], last - first,
                    np.add.reduceat((c > 0)[tokens].astype(np.int64), first),
                    np.add.reduceat(base[tokens], first), np.add.reduceat(inner[tokens], first),
                    [byte[a:b].tobytes() for a, b in zip(first, last)]]
            tables.append(pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(cols, DOCUMENTS)], schema=DOCUMENTS))
        return pa.concat_tables(tables) if tables else DOCUMENTS.empty_table()

    left = batches.select("batch", "doc_ids", "held_out", "sizes", "tokens")
    return left.groupBy("batch").cogroup(table.groupBy("batch")).applyInArrow(one, DOCUMENTS_DDL)


# -- the network ------------------------------------------------------------

def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    """Weights: ``wi`` (class before, or the start) to gates, ``u`` state to
    gates, ``wo`` and ``bo`` state to classes."""

    START = CLASSES

    def __init__(self, prior: np.ndarray, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        w = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {"wi": w(CLASSES + 1, 3 * HIDDEN), "u": w(HIDDEN, 3 * HIDDEN),
                  "wo": 0.1 * w(HIDDEN, CLASSES), "bo": prior.copy()}
        self.moments, self.steps, self.rooms = {}, 0, {}

    def flat(self) -> np.ndarray:
        return np.concatenate([v.reshape(-1) for v in self.p.values()])

    def set_flat(self, values: np.ndarray) -> Network:
        at = 0
        for k, v in self.p.items():
            self.p[k] = values[at:at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    def step(self, before: np.ndarray, h: np.ndarray):
        """(new state, and what its gradient needs)."""
        k = HIDDEN
        x, q = self.p["wi"][before], h @ self.p["u"]
        zr = _sigmoid(x[:, :2 * k] + q[:, :2 * k])
        z, r = zr[:, :k], zr[:, k:]
        n = np.tanh(x[:, 2 * k:] + r * q[:, 2 * k:])
        return n + z * (h - n), (h, z, r, n, q[:, 2 * k:])

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array that the next window uses again: fresh memory costs more
        than the work on it."""
        kind = self.p["wi"].dtype
        if name not in self.rooms or self.rooms[name].shape != shape or self.rooms[name].dtype != kind:
            self.rooms[name] = np.empty(shape, kind)
        return self.rooms[name]

    def tall(self) -> bool:
        """Whether a logit may pass 80, where its power is cut: states lie
        within -1 and 1."""
        return bool((np.abs(self.p["wo"]).sum(axis=0) + np.abs(self.p["bo"])).max() > 79)

    def window(self, before, target, fresh, live, h):
        """Loss, gradients and last state of a window (steps, streams). Only
        the states go step by step, in place, with a stream in each column;
        classes and weights are done at once."""
        p, k, room = self.p, HIDDEN, self.room
        t_max, b = before.shape
        rows = t_max * b
        x, q, dx = (room(c, t_max, 3 * k, b) for c in ("x", "q", "dx"))
        was, n, now, dqn, top, fn, fz, fr = (room(c, t_max, k, b) for c in ("was", "n", "now", "dqn", "top", "fn", "fz", "fr"))
        zr, e = room("zr", t_max, 2 * k, b), room("e", rows, CLASSES)
        flat, wide = room("flat", t_max, b, k), room("wide", t_max, b, 3 * k)
        np.take(p["wi"], before, axis=0, out=wide, mode="clip")
        x[...] = wide.transpose(0, 2, 1)
        keep = (~fresh)[:, None, :].astype(x.dtype)
        u, h = np.ascontiguousarray(p["u"].T), np.ascontiguousarray(h.T)
        with np.errstate(over="ignore"):  # a gate of 0
            for t in range(t_max):
                gates, new, state = zr[t], n[t], now[t]
                np.multiply(h, keep[t], out=was[t])
                np.matmul(u, was[t], out=q[t])
                np.add(x[t, :2 * k], q[t, :2 * k], out=gates)
                np.negative(gates, out=gates)
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                np.multiply(gates[k:], q[t, 2 * k:], out=new)
                new += x[t, 2 * k:]
                np.tanh(new, out=new)
                np.subtract(was[t], new, out=state)
                state *= gates[:k]
                state += new
                h = state
        flat[...] = now.transpose(0, 2, 1)
        flat, on, at = flat.reshape(-1, k), live.reshape(-1), np.arange(rows)
        np.matmul(flat, p["wo"], out=e)
        e += p["bo"]
        if self.tall():
            np.minimum(e, x.dtype.type(80), out=e)
        np.exp(e, out=e)
        own, size = target.reshape(-1), e.sum(axis=1)
        loss = -(np.log(e[at, own] / size + 1e-30) * on).sum()
        weight = (on / max(1.0, float(on.sum()))).astype(x.dtype)
        e *= (weight / size)[:, None]
        e[at, own] -= weight
        g = {"wo": flat.T @ e, "bo": e.sum(axis=0)}
        np.matmul(e, p["wo"].T, out=flat)
        top[...] = flat.reshape(t_max, b, k).transpose(0, 2, 1)
        z, r, qn = zr[:, :k], zr[:, k:], q[:, 2 * k:]
        # Factors that don't depend on the gradient that comes back:
        # (1 - z)(1 - nn), (was - n) z (1 - z), qn r (1 - r).
        np.subtract(1, z, out=fz)
        np.multiply(n, n, out=fn)
        np.subtract(1, fn, out=fn)
        fn *= fz
        fz *= z
        np.subtract(was, n, out=fr)
        fz *= fr
        np.subtract(1, r, out=fr)
        fr *= r
        fr *= qn
        back, back_n = np.ascontiguousarray(p["u"][:, :2 * k]), np.ascontiguousarray(p["u"][:, 2 * k:])
        dh = np.zeros((k, b), x.dtype)
        for t in range(t_max - 1, -1, -1):
            d = dx[t]
            dh += top[t]
            np.multiply(dh, fz[t], out=d[:k])
            np.multiply(dh, fn[t], out=d[2 * k:])
            np.multiply(d[2 * k:], fr[t], out=d[k:2 * k])
            np.multiply(d[2 * k:], r[t], out=dqn[t])
            dh *= z[t]
            dh += back @ d[:2 * k]
            dh += back_n @ dqn[t]
            dh *= keep[t]
        wide[...] = dx.transpose(0, 2, 1)
        dflat = wide.reshape(-1, 3 * k)
        # Inputs' gradients, summed by class.
        order = np.argsort(before.reshape(-1), kind="stable")
        seen, first = np.unique(before.reshape(-1)[order], return_index=True)
        ordered = np.take(dflat, order, axis=0, out=room("ordered", rows, 3 * k), mode="clip")
        g["wi"] = np.zeros_like(p["wi"])
        g["wi"][seen] = np.add.reduceat(ordered, first, axis=0)
        flat.reshape(t_max, b, k)[...] = was.transpose(0, 2, 1)
        wide[:, :, 2 * k:] = dqn.transpose(0, 2, 1)
        g["u"] = flat.T @ dflat
        return loss, g, np.ascontiguousarray(h.T)

    def train(self, docs: list[bytes], steps: int = STEPS, streams: int = STREAMS, rate: float = RATE) -> int:
        """One pass over the documents, dealt to streams; the tokens seen.
        Another call goes on with the moments of the steps before."""
        docs = sorted(docs, key=lambda d: (-len(d), d))
        # No more streams than the longest document leaves tokens for.
        streams = max(1, min(streams, sum(map(len, docs)) // max(1, len(docs[0]))))
        load, lanes = [0] * streams, [[] for _ in range(streams)]
        for d in docs:
            k = load.index(min(load))
            lanes[k].append(np.frombuffer(d, np.uint8))
            load[k] += len(d)
        rng = np.random.default_rng(5)
        for lane in lanes:
            rng.shuffle(lane)
        longest = -(-max(load) // steps) * steps
        target = np.zeros((longest, streams), np.uint8)
        before = np.full((longest, streams), self.START, np.uint8)
        fresh, live = np.zeros((longest, streams), bool), np.zeros((longest, streams), bool)
        for k, lane in enumerate(lanes):
            if lane:
                flat = np.concatenate(lane)
                starts = np.cumsum([0] + [len(x) for x in lane[:-1]])
                n = len(flat)
                target[:n, k], live[:n, k] = flat, 1
                before[1:n, k] = flat[:-1]
                before[starts, k] = self.START
                fresh[starts, k] = True
        h = np.zeros((streams, HIDDEN), np.float32)
        if not self.moments:
            self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for a in range(0, longest, steps):
            s = slice(a, a + steps)
            _, g, h = self.window(before[s], target[s], fresh[s], live[s], h)
            self.steps = i = self.steps + 1
            for k, v in self.p.items():
                m1, m2 = self.moments[k]
                m1 += 0.1 * (g[k] - m1)
                m2 += 0.01 * (g[k] ** 2 - m2)
                v -= rate * (m1 / (1 - 0.9**i)) / (np.sqrt(m2 / (1 - 0.99**i)) + 1e-6)
        return int(live.sum())

    def log10(self, docs: list[bytes]) -> np.ndarray:
        """log10 probability of each document's class sequence; all documents
        go forward side by side, each to its own end."""
        size = np.array([len(d) for d in docs])
        order = np.argsort(-size, kind="stable")
        flat = np.frombuffer(b"".join(docs[i] for i in order), np.uint8)
        length = size[order]
        first = np.cumsum(length) - length
        active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
        out = np.zeros(len(docs))
        h = np.zeros((len(docs), HIDDEN), np.float32)
        before = np.full(len(docs), self.START)
        wo, bo = self.p["wo"], self.p["bo"]
        room = np.empty((len(docs), CLASSES), wo.dtype)
        for t, k in enumerate(active):
            h, _ = self.step(before[:k], h[:k])
            e = np.matmul(h, wo, out=room[:k])
            e += bo
            target = flat[first[:k] + t]
            own = e[np.arange(k), target]
            np.exp(np.minimum(e, np.float32(80), out=e), out=e)
            out[order[:k]] += own - np.log(e.sum(axis=1))
            before = target
        return out / np.log(10)


def trained(documents: DataFrame, counts: Counts, rounds: int = ROUNDS) -> Network:
    """Averaged weights of the passes over all training documents: each piece
    of about ``PIECE`` tokens starts from the same weights."""
    net = Network(counts.prior())
    chosen = documents.where(~F.col("held_out")).select("classes")
    schema = pa.schema([("n", pa.int64()), ("weights", pa.list_(pa.float32()))])
    for _ in range(rounds):
        start = net.flat()

        def fit(batches, start=start):
            docs, size = [], 0

            def piece():
                own = Network(np.zeros(CLASSES, np.float32)).set_flat(start)
                n = own.train(docs)
                return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([own.flat()], pa.list_(pa.float32()))],
                                                  schema=schema)

            for batch in batches:
                for d in batch.column("classes").to_pylist():
                    docs.append(d)
                    size += len(d)
                    if size >= PIECE:
                        yield piece()
                        docs, size = [], 0
            if docs:
                yield piece()

        fits = chosen.mapInArrow(fit, "n long, weights array<float>")
        mean = (fits.select("n", F.posexplode("weights").alias("pos", "w"))
                .groupBy("pos").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w"))).collect()
        if mean:
            net.set_flat(np.array([r["w"] for r in sorted(mean, key=lambda r: r["pos"])]))
    return net


def scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score
    (log10 probability of the whole text)."""
    parts = materialize(batches_of(docs, held_out, id_col, text_col))
    table, counts = counted(parts)
    documents = materialize(classed(parts, table, counts))
    net = trained(documents, counts)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                        ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            own = b.column("inner").to_numpy() + net.log10(b.column("classes").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")]
                + [pa.array(own)], schema=schema)

    done = documents.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, "
                                     "base_score double, score double")
    return done.select("doc_id", "held_out", "n_tokens", "n_known",
                       F.lit(counts.tokens).cast("long").alias("train_tokens"), "base_score", "score")
