"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input joins its own vector (zero for words seen in few training texts) and the mean vector of
its character pairs. Overlapping windows of 32 words, one from every eighth word on (every sixteenth in
training), cover a text; a text's score is that of its most toxic window.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import texts

LENGTH = 32
#: Words from one window's start to the next, in scoring and in training.
STRIDE, TRAINING_STRIDE = 8, 16
#: From this score on a text is toxic, in op5 and in the pipeline.
THRESHOLD = 0.3
PAIRS, HIDDEN = 1 << 11, 8
DIM = 12
#: Bytes that end a word: ASCII but letters and digits.
CUT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(CUT).split()


def pair_slots(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed character pairs of all words in turn, and how many each has."""
    b = np.frombuffer(b"".join(b"^" + w + b"$" for w in ws), np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
    ends = np.cumsum(sizes + 1) - 1
    return np.delete((b * 263 + np.roll(b, -1)) % PAIRS, ends), sizes


def windows(n: int, stride: int = STRIDE) -> np.ndarray:
    """Starts of the windows that cover n words."""
    return np.arange(0, max(1, n - LENGTH + stride), stride) if n else np.zeros(0, np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


class Network:
    """Parameters, scores of windows, and gradients."""

    def __init__(self, vocabulary: dict[bytes, int], seed: int = 7):
        self.vocabulary = vocabulary
        r = np.random.default_rng(seed)
        n = lambda *s, scale=0.1: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {"word": n(len(vocabulary) + 1, DIM, scale=0.05), "pair": n(PAIRS, DIM), "att": n(2 * HIDDEN, scale=0.3), "out": n(2 * HIDDEN, scale=0.5), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": n(2 * DIM, 3 * HIDDEN, scale=0.4), f"u{d}": n(HIDDEN, 3 * HIDDEN, scale=0.3), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.scale, self.shift, self.prior = 1.0, 0.0, 0.1

    def inputs(self, ws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors of words; also their own slots (0: not in the vocabulary), pairs and pair counts."""
        slots = np.array([self.vocabulary.get(w, 0) for w in ws], np.int64)
        flat, sizes = pair_slots(ws)
        mean = np.add.reduceat(self.p["pair"][flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / sizes[:, None]
        return np.concatenate([self.p["word"][slots], mean], axis=1).astype(np.float32), slots, flat, sizes

    def run(self, x: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x: projected inputs of the distinct words for either direction; ids and mask: windows by LENGTH."""
        m, k = len(ids), HIDDEN
        states, tape = np.zeros((LENGTH, m, 2 * k), np.float32), []
        for d, order in (("f", range(LENGTH)), ("b", range(LENGTH - 1, -1, -1))):
            h, u, col = np.zeros((m, k), np.float32), self.p[f"u{d}"], slice(0, k) if d == "f" else slice(k, 2 * k)
            for t in order:
                a, g = x[d][ids[:, t]], h @ u
                zr = sigmoid(a[:, : 2 * k] + g[:, : 2 * k])
                z, r = zr[:, :k], zr[:, k:]
                n = np.tanh(a[:, 2 * k :] + r * g[:, 2 * k :])
                new = h + mask[:, t, None] * (1 - z) * (n - h)
                if keep:
                    tape.append((d, t, h, z, r, n, g[:, 2 * k :]))
                h = new
                states[t][:, col] = h
        e = (states @ self.p["att"]).T
        e = np.where(mask > 0, e, -1e9)
        w = np.exp(e - e.max(1, keepdims=True))
        w = w / w.sum(1, keepdims=True)
        pooled = np.einsum("mt,tmh->mh", w, states)
        logit = pooled @ self.p["out"] + self.p["bias"]
        return (logit, states, w, pooled, tape) if keep else logit

    def project(self, raw: np.ndarray) -> dict[str, np.ndarray]:
        return {d: raw @ self.p[f"w{d}"] + self.p[f"c{d}"] for d in "fb"}

    def gradients(self, ws: list[bytes], ids, mask, target):
        """Gradients of the mean cross-entropy; ids point into the words."""
        raw, slots, flat, sizes = self.inputs(ws)
        x = self.project(raw)
        logit, states, w, pooled, tape = self.run(x, ids, mask, keep=True)
        k, m = HIDDEN, len(ids)
        g = {n: np.zeros_like(v) for n, v in self.p.items() if n not in ("word", "pair")}
        dl = ((sigmoid(logit) - target) / m).astype(np.float32)
        g["out"], g["bias"] = pooled.T @ dl, dl.sum(keepdims=True)
        dp = dl[:, None] * self.p["out"]
        dw = np.einsum("mh,tmh->mt", dp, states)
        de = w * (dw - (w * dw).sum(1, keepdims=True))
        ds = w.T[:, :, None] * dp[None] + de.T[:, :, None] * self.p["att"]
        g["att"] = np.einsum("mt,tmh->h", de, states)
        dx = {d: np.zeros((len(ws), 3 * k), np.float32) for d in "fb"}
        for d in "fb":
            u, col, dh = self.p[f"u{d}"], slice(0, k) if d == "f" else slice(k, 2 * k), np.zeros((m, k), np.float32)
            for _, t, h, z, r, n, gn in reversed([s for s in tape if s[0] == d]):
                dh = dh + ds[t][:, col]
                mk = mask[:, t, None]
                dn = dh * mk * (1 - z) * (1 - n * n)
                dz = dh * mk * (h - n) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                da = np.concatenate([dz, dr, dn], axis=1)
                dg = np.concatenate([dz, dr, dn * r], axis=1)
                np.add.at(dx[d], ids[:, t], da)
                g[f"u{d}"] += h.T @ dg
                dh = dh * (1 - mk * (1 - z)) + dg @ u.T
            g[f"w{d}"], g[f"c{d}"] = raw.T @ dx[d], dx[d].sum(0)
        draw = dx["f"] @ self.p["wf"].T + dx["b"] @ self.p["wb"].T
        g["word"], g["pair"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["pair"])
        np.add.at(g["word"], slots, draw[:, :DIM])
        g["word"][0] = 0
        np.add.at(g["pair"], flat, np.repeat(draw[:, DIM:] / sizes[:, None], sizes, axis=0))
        return g


class Coder:
    """Texts as windows of indexes into a growing list of distinct words."""

    def __init__(self, stride: int = STRIDE):
        self.index: dict[bytes, int] = {b"": 0}
        self.words: list[bytes] = [b""]
        self.stride = stride

    def code(self, text: str) -> np.ndarray:
        """Windows by LENGTH; 0 past the text's end."""
        ws = words(text)
        index = self.index
        for w in set(ws).difference(index):
            index[w] = len(self.words)
            self.words.append(w)
        starts = windows(len(ws), self.stride)
        padded = np.zeros(len(ws) + LENGTH, np.int32)
        padded[: len(ws)] = [index[w] for w in ws]
        return padded[starts[:, None] + np.arange(LENGTH)]


def mask_of(ids: np.ndarray) -> np.ndarray:
    return (ids > 0).astype(np.float32)


def _logits(net: Network, x: dict[str, np.ndarray], ids: np.ndarray) -> np.ndarray:
    return np.concatenate([net.run(x, b, mask_of(b)) for b in (ids[i : i + 4096] for i in range(0, len(ids), 4096))]) if len(ids) else np.zeros(0, np.float32)


def train(rows: list[tuple[str, int]], prior: float, epochs: int = 4, least: int = 5, seed: int = 7) -> Network:
    """Fits to (text, label) rows: each epoch learns from the windows that now score highest in each text.

    A fifth of the rows sets the scale and shift of the final score, weighted to the class prior.
    """
    rng = np.random.default_rng(seed)
    coder = Coder(TRAINING_STRIDE)
    coded = [coder.code(t) for t, _ in rows]
    label = np.array([y for _, y in rows], np.float32)
    held = rng.random(len(rows)) < 0.2
    seen = np.zeros((2, len(coder.words)))
    for n, i in enumerate(coded):
        if not held[n]:
            seen[int(label[n])][np.unique(i)] += 1
    seen[:, 0] = 0
    known = np.flatnonzero(seen.sum(0) >= least)
    net = Network({coder.words[j]: k + 1 for k, j in enumerate(known)}, seed)
    net.prior = prior
    net.p["word"][0] = 0
    if not len(label) or label.min() == label.max():
        return net
    owner = np.repeat(np.arange(len(rows)), [len(i) for i in coded])
    ids = np.concatenate(coded)
    del coded
    # word vectors start from the smoothed log-odds of the texts that hold them
    total = [max(1, int(((label == y) & ~held).sum())) for y in (0, 1)]
    odds = (np.log((seen[1] + 1) / (total[1] + 2)) - np.log((seen[0] + 1) / (total[0] + 2)))[known]
    net.p["word"][1:, :4] += (odds * seen.sum(0)[known] / (seen.sum(0)[known] + 20)).astype(np.float32)[:, None] * np.array([1, -1, 0.5, -0.5], np.float32)
    m1, m2, step = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    for epoch in range(epochs):
        logit = _logits(net, net.project(net.inputs(coder.words)[0]), ids)
        noise = logit + rng.standard_normal(len(logit)).astype(np.float32) * (0.3 if epoch else 1.0)
        order = np.lexsort((-noise, owner))
        first = np.r_[True, owner[order][1:] != owner[order][:-1]]
        second = np.r_[False, first[:-1]] & ~first
        pick = order[(first | second) & ~held[owner[order]]]
        rng.shuffle(pick)
        for i in range(0, len(pick), 256):
            b = pick[i : i + 256]
            distinct, local = np.unique(ids[b], return_inverse=True)
            g = net.gradients([coder.words[j] for j in distinct], local.reshape(len(b), LENGTH), mask_of(ids[b]), label[owner[b]])
            step += 1
            for k, v in g.items():
                m1[k] += 0.1 * (v - m1[k])
                m2[k] += 0.01 * (v * v - m2[k])
                net.p[k] -= 0.01 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)
    logit = _logits(net, net.project(net.inputs(coder.words)[0]), ids)
    best = np.full(len(rows), -30.0)
    np.maximum.at(best, owner, logit)
    use = held & (best > -30) if len(set(label[held])) == 2 else best > -30
    x, y = best[use], label[use]
    weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum()))
    a, c = 1.0, 0.0
    for _ in range(3000):
        d = (sigmoid(a * x + c) - y) * weight
        a, c = a - 0.3 * float((d * x).sum()), c - 0.3 * float(d.sum())
    net.scale, net.shift = max(a, 0.05), c
    return net


class Scorer:
    """Scores batches of texts; the inputs of distinct words are kept until there are more than `most_words`."""

    def __init__(self, net: Network, most_words: int = 200_000):
        self.net, self.most = net, most_words
        self.coder, self.done = Coder(), 0
        self.room = {d: np.zeros((1 << 14, 3 * HIDDEN), np.float32) for d in "fb"}

    def _flush(self, held: list[tuple[int, np.ndarray]], out: np.ndarray) -> None:
        new = self.net.project(self.net.inputs(self.coder.words[self.done :])[0]) if self.done < len(self.coder.words) else {}
        for d, v in new.items():
            while len(self.room[d]) < self.done + len(v):
                self.room[d] = np.concatenate([self.room[d], np.zeros_like(self.room[d])])
            self.room[d][self.done : self.done + len(v)] = v
        self.done = len(self.coder.words)
        logit = _logits(self.net, self.room, np.concatenate([h[1] for h in held]))
        at = 0
        for i, ids in held:
            out[i] = sigmoid(np.float64(self.net.scale * logit[at : at + len(ids)].max() + self.net.shift))
            at += len(ids)
        if self.done > self.most:
            self.coder, self.done = Coder(), 0

    def __call__(self, batch: pa.Array) -> np.ndarray:
        out = np.full(len(batch), float(self.net.prior))
        held, pending = [], 0
        for i, t in enumerate(batch):
            ids = self.coder.code(t.as_py() or "")
            if len(ids):
                held.append((i, ids))
                pending += len(ids)
            if pending >= 4096:
                self._flush(held, out)
                held, pending = [], 0
        if held:
            self._flush(held, out)
        return out


def scores(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) of every row; a text without words scores the prior. One scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer(b.column(1)))], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold. One scan, no shuffle."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for b in batches:
            yield b.filter(pa.array(scorer(b.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, most: int = 2000, most_chars: int = 16_000_000) -> Network:
    """A network fitted to at most `most` labelled rows of each class, drawn by the hash of their id.

    Of these the rows whose texts begin within the first `most_chars` code points of their class are
    learnt from, each whole, which bounds the memory. One executor task trains; only the network, of a
    few MB, comes to the driver. Rows whose crc32(doc_id) mod 4 is 2 are never learnt from, neither
    their labels nor their prior.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(~held_out("doc_id")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    drawn = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    chosen = drawn[0].union(drawn[1]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").withColumn("before", F.coalesce(F.sum(F.length("text")).over(order), F.lit(0)))
    prior = n.get(1, 0) / max(1, sum(n.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[:2])
        net = train([(t, y) for _, t, y in held], prior)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((net.vocabulary, net.p, net.scale, net.shift))], pa.binary())], ["net"])

    made = rows.where(F.col("before") < most_chars).select("doc_id", "text", "toxic").coalesce(1).mapInArrow(run, "net binary").first()
    net = Network({}) if made is None else Network.__new__(Network)
    net.prior = prior
    if made is not None:
        net.vocabulary, net.p, net.scale, net.shift = pickle.loads(bytes(made[0]))
    return net


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row. Null texts count as empty; without labels of both classes all rows score the prior."""
    s = scores(docs, fit(docs, labels))
    return s.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
