"""Quality from positives and unlabelled text: a small network that minimises the non-negative unbiased risk, in numpy."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, column, text_chunks
from .repetition import _lines, _repeated

#: Documents that are fitted on, at most, and the bytes of their texts: trusted positives, and unlabelled ones.
POSITIVES, UNLABELLED, SAMPLE_BYTES = 2500, 5000, 24_000_000
HIDDEN = 24

# Classes of bytes: lower case, upper case, digits, blanks, line breaks, punctuation of sentences, other signs, beyond ASCII.
_KINDS = 8
_KIND = np.full(256, 6, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 7
_KIND[[32, 9, 11, 12]], _KIND[[10, 13]] = 3, 4
_KIND[np.frombuffer(b".,;:'\"?!()-", np.uint8)] = 5
FEATURES = _KINDS * _KINDS + 7


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, words) of whole texts: shares of each transition between classes of bytes; number and length of words; shares of
    words that are distinct, follow themselves, stand in repeated 5-word windows, or in lines equal to an earlier one."""
    w = Words(data, offsets)
    docs = len(offsets) - 1
    out = np.zeros((docs, FEATURES), np.float64)
    kind = _KIND[data]
    doc = np.repeat(np.arange(docs), np.diff(offsets))
    inside = doc[1:] == doc[:-1]
    pair = (doc[:-1] * _KINDS + kind[:-1]) * _KINDS + kind[1:]
    size = np.diff(offsets)
    out[:, : _KINDS * _KINDS] = np.bincount(pair[inside], minlength=docs * _KINDS * _KINDS).reshape(docs, -1) / np.maximum(size - 1, 1)[:, None]
    n = np.maximum(w.count, 1)
    of = lambda mark: np.bincount(w.doc[mark], minlength=docs) / n
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    again = np.zeros(len(h), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    rest = out[:, _KINDS * _KINDS :]
    rest[:, 0] = np.log1p(w.count)
    rest[:, 1] = np.bincount(w.doc, w.length, docs) / n
    rest[:, 2] = np.bincount(d[fresh], minlength=docs) / n
    rest[:, 3] = of(again)
    rest[:, 4] = of(_repeated(w, 5))
    rest[:, 5] = of(_lines(w)[1])
    rest[:, 6] = rest[:, 2] * rest[:, 0]
    return out, w.count


class Network:
    """Features, brought to one scale, through one hidden layer; only: the answer where there was nothing to learn from."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, rng: np.random.Generator):
        self.mean, self.spread = mean, spread
        self.p = {"W": rng.normal(0, len(mean) ** -0.5, (len(mean), HIDDEN)), "b": np.zeros(HIDDEN), "v": rng.normal(0, HIDDEN**-0.5, HIDDEN), "c": np.zeros(1)}
        self.prior: float | None = None
        self.only: float | None = None

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -4, 4)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(z @ self.p["W"] + self.p["b"])
        return hidden @ self.p["v"] + self.p["c"][0], hidden

    def gradients(self, z: np.ndarray, hidden: np.ndarray, slope: np.ndarray) -> dict[str, np.ndarray]:
        """Of a loss whose derivative by each output is slope."""
        back = slope[:, None] * self.p["v"] * (1 - hidden**2)
        return {"W": z.T @ back, "b": back.sum(0), "v": hidden.T @ slope, "c": slope.sum(keepdims=True)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def risk(g: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """(positive part, negative part, derivative to follow) of the unbiased risk with the loss l(x) = sigmoid(-x).

    positive part: prior * E_p[l(g)]. Negative part: E_u[l(-g)] - prior * E_p[l(-g)], an estimate of what the negatives cost, which
    can't be below 0; where it is, the step goes up that part instead, and takes back what was fitted to the sample.
    """
    s = sigmoid(g)
    p, u = positive, ~positive
    up, slope = prior * np.mean(1 - s[p]), s * (1 - s)
    down = np.mean(s[u]) - prior * np.mean(s[p])
    d_up, d_down = np.zeros_like(g), np.zeros_like(g)
    d_up[p] = -prior * slope[p] / p.sum()
    d_down[u] = slope[u] / u.sum()
    d_down[p] = -prior * slope[p] / p.sum()
    return up, down, d_up + d_down if down >= 0 else -d_down


def _fit(net: Network, pos: np.ndarray, unl: np.ndarray, prior: float | None, rng: np.random.Generator, steps: int = 900, batch: int = 256, rate: float = 0.004) -> Network:
    """Adam steps on the non-negative risk; where prior is None, on the logistic loss of positives against unlabelled."""
    m, v = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}
    positive = np.arange(2 * batch) < batch
    for t in range(1, steps + 1):
        z = np.concatenate([pos[rng.integers(0, len(pos), batch)], unl[rng.integers(0, len(unl), batch)]])
        g, hidden = net.forward(z)
        slope = (sigmoid(g) - positive) / len(g) if prior is None else risk(g, positive, prior)[2]
        grad = net.gradients(z, hidden, slope)
        for k in net.p:
            x = grad[k] + 1e-5 * net.p[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * x, 0.999 * v[k] + 0.001 * x * x
            net.p[k] = net.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return net


def estimated_prior(pos: np.ndarray, unl: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among the unlabelled, from scores of rows that the scorer hasn't seen.

    Above any cut the unlabelled hold at least prior * (share of positives above it); so the prior is at most the least ratio of
    the two shares over all cuts, and near it where few negatives score high. The cut is chosen with the sampling
    error of both shares added, so that a few top scores do not decide.
    """
    cuts = np.unique(pos)
    above = lambda x: 1 - np.searchsorted(np.sort(x), cuts, side="left") / len(x)
    p, u = above(pos), above(unl)
    error = np.sqrt(np.log(4 / delta) / 2) * (len(pos) ** -0.5 + len(unl) ** -0.5)
    best = int(np.argmin((u + error) / np.maximum(p, 1e-9)))
    return float(np.clip(u[best] / p[best], 0.02, 0.99))


def train(pos: np.ndarray, unl: np.ndarray, seed: int = 7) -> Network:
    """From features of trusted positives and of unlabelled texts. Halves of each teach a scorer, whose scores of the other halves
    give the prior; then all of them teach the network. With no positives every text is held to be of low quality, and with
    nothing unlabelled every text to be of high quality, as is one that is like all the positives."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([pos, unl])
    mean, spread = (both.mean(0), both.std(0) + 1e-3) if len(both) else (np.zeros(FEATURES), np.ones(FEATURES))
    net = Network(mean, spread, rng)
    if len(pos) < 2 or len(unl) < 2:
        net.only = float(len(pos) > 0)
        return net
    pos, unl = net.scaled(pos)[rng.permutation(len(pos))], net.scaled(unl)[rng.permutation(len(unl))]
    scorer = _fit(Network(mean, spread, rng), pos[::2], unl[::2], None, rng, steps=500)
    net.prior = estimated_prior(scorer.forward(pos[1::2])[0], scorer.forward(unl[1::2])[0])
    return _fit(net, pos, unl, net.prior, rng)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, most_bytes: int = SAMPLE_BYTES) -> Network:
    """Trains on at most `positives` documents that labels trusts (quality 1) and `unlabelled` others of any kind, whose labels
    aren't read, each with most_bytes of text at most and chosen by hash of doc_id. Only those texts are fetched, into
    the one task that trains, and only the network comes to the driver.

    Documents with crc32(doc_id as text) mod 3 = 1, null ids and null texts teach nothing; an id with labels of both kinds isn't
    trusted. Of rows that repeat a doc_id the text of the least hash is read. A text that would pass the bytes is passed
    over. A document may stand on both sides, as the unlabelled ones are drawn from all.
    """
    learnt = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    first = lambda ids, salt, n: [r[0] for r in ids.filter(learnt).orderBy(F.xxhash64(F.lit(salt), "doc_id"), "doc_id").limit(n).select("doc_id").collect()]
    known = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = docs.select(column(docs, "doc_id", "long").cast("long").alias("doc_id"), column(docs, "text", "string").alias("text")).filter(F.col("text").isNotNull())
    trusted = set(first(known.filter("quality = 1"), "p", positives))
    drawn = set(first(texts.select("doc_id"), "u", unlabelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side: dict[bool, list[tuple[int, np.ndarray]]] = {True: [], False: []}
        left = {True: most_bytes, False: most_bytes}
        for b in batches:
            ids, sizes = b.column("doc_id").to_pylist(), b.column("size").to_pylist()
            for i, j, data, offsets in text_chunks(b.column("text")):
                x = features(data, offsets)[0]
                for at in range(i, j):
                    for kind, chosen in ((True, trusted), (False, drawn)):
                        if ids[at] in chosen and sizes[at] <= left[kind]:
                            left[kind] -= sizes[at]
                            side[kind].append((ids[at], x[at - i]))
        pos, unl = (np.array([x for _, x in sorted(side[k], key=lambda r: r[0])]).reshape(-1, FEATURES) for k in (True, False))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(pos, unl))], pa.binary())], ["net"])

    one = texts.filter(F.col("doc_id").isin(sorted(trusted | drawn))).groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    one = one.withColumns({"size": F.octet_length("text"), "at": F.xxhash64("doc_id")})
    trained = one.repartition(1).sortWithinPartitions("at", "doc_id").mapInArrow(run, "net binary").collect() if trusted | drawn else []
    return pickle.loads(bytes(trained[0][0])) if trained else train(np.empty((0, FEATURES)), np.empty((0, FEATURES)))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score, predicted) of every row of docs.

    score is 0 to 1, from 0.5 on predicted 1; a null or wordless text scores 0. A network that had nothing to learn from
    gives every text its one answer (train). Repeated rows score alike; texts are read whole; extra columns are ignored; an
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    docs = docs.select(column(docs, "doc_id", "long").cast("long").alias("doc_id"), column(docs, "text", "string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            for i, j, data, offsets in text_chunks(b.column("text")):
                x, words = features(data, offsets)
                s = sigmoid(net.forward(net.scaled(x))[0]) if net.only is None else np.full(j - i, net.only)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(np.where(words > 0, s, 0.0))], ["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
