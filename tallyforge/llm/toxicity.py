"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A step of the network is a word. Its inputs are a word embedding (hashed) and the mean of its character embeddings
(hashed character 1- to 4-grams with marked word ends), projected once for each distinct word. Texts are read
whole in overlapping windows of words; a text's score is that of its most toxic window, calibrated on the text level.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import U64, Words, blocks, column, mix64, text_chunks

#: Labelled documents of each class that training reads, at most, and the bytes of their texts.
SAMPLE, SAMPLE_BYTES = 800, 1 << 23
#: Words of a window, and how far the next one begins: windows overlap by half, and the last one ends with the text, so
#: every run of 12 words lies whole in some window.
WINDOW, STRIDE = 24, 12
WORD_ROWS, CHAR_ROWS, WORD_DIM, CHAR_DIM, HIDDEN = 1 << 13, 1 << 14, 6, 10, 8


@dataclass
class Vocabulary:
    """Distinct words of some texts: a hashed word row, and hashed character n-gram rows (ragged)."""

    word: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    count: np.ndarray


def vocabulary(w: Words) -> tuple[Vocabulary, np.ndarray]:
    """(distinct words, index of each word among them). Words compare in lower case of A-Z."""
    _, at, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    start, length = w.start[at], w.length[at]
    # each word between two marks (byte 0), many words as one buffer
    size = length + 2
    rows, count = [np.empty(0, np.int32)], np.zeros(len(at), np.int64)
    for i, j in blocks(size):
        base, n = np.cumsum(size[i:j]) - size[i:j], length[i:j]
        buf = np.zeros(int(size[i:j].sum()), np.uint8)
        pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        low = w.data[pos + np.repeat(start[i:j], n)]
        buf[pos + np.repeat(base + 1, n)] = low + np.uint8(32) * ((low >= 65) & (low <= 90))
        owner = np.repeat(np.arange(j - i), size[i:j])
        wide = buf.astype(U64) + U64(1)
        part, owners = [], []
        for k in (1, 2, 3, 4):
            m = len(buf) - k + 1
            if m <= 0:
                continue
            h = np.full(m, k, U64)
            for x in range(k):
                h = h * U64(257) + wide[x : m + x]
            ok = owner[:m] == owner[k - 1 :]
            part.append((mix64(h[ok]) % U64(CHAR_ROWS)).astype(np.int32))
            owners.append(owner[:m][ok])
        owners = np.concatenate(owners)
        rows.append(np.concatenate(part)[np.argsort(owners, kind="stable")])
        count[i:j] = np.bincount(owners, minlength=j - i)
    word = (mix64(w.hash[at]) % U64(WORD_ROWS)).astype(np.int64)
    return Vocabulary(word, np.concatenate(rows), np.cumsum(count) - count, count), inverse


def windows(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of every window: STRIDE apart, the last one ending with the text; none for no words."""
    n = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(count)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    first = np.minimum(k * STRIDE, np.maximum(count[doc] - WINDOW, 0))
    return doc, first + (np.cumsum(count) - count)[doc], np.minimum(count[doc], WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters p: E, C embeddings; W, b input and U recurrent weights of both directions (gates r, z, n); attention
    A, a; output o, c. cal: slope and shift that turn a text's top window logit into its own. only: the score of every
    text, where one class of labels or none was there to learn from."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        init = lambda *s, scale=0.2: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {"E": init(WORD_ROWS, WORD_DIM, scale=0.05), "C": init(CHAR_ROWS, CHAR_DIM, scale=0.3), "W": init(d, 6 * h), "b": np.zeros(6 * h, np.float32), "Uf": init(h, 3 * h, scale=0.3), "Ub": init(h, 3 * h, scale=0.3), "A": init(2 * h, h), "a": init(h), "o": init(2 * h), "c": np.zeros(1, np.float32)}
        self.cal = (1.0, 0.0)
        self.only: float | None = None

    def embed(self, v: Vocabulary) -> np.ndarray:
        chars = np.empty((len(v.first), CHAR_DIM), np.float32)
        for i, j in blocks(v.count):
            lo, hi = v.first[i], v.first[j - 1] + v.count[j - 1]
            chars[i:j] = np.add.reduceat(self.p["C"][v.grams[lo:hi]], v.first[i:j] - lo, axis=0) / np.sqrt(v.count[i:j])[:, None].astype(np.float32)
        return np.concatenate([self.p["E"][v.word], chars], axis=1)

    def _run(self, x: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list | None) -> np.ndarray:
        """x: (T, B, 3H) projected inputs in reading order; mask (T, B). Hidden states (T, B, H)."""
        t, b, _ = x.shape
        h, out = np.zeros((b, HIDDEN), np.float32), np.empty((t, b, HIDDEN), np.float32)
        for i in range(t):
            g = h @ u
            rz = _sigmoid(x[i, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
            n = np.tanh(x[i, :, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            m = mask[i][:, None]
            new = np.where(m, new, h)
            if keep is not None:
                keep.append((h, g, r, z, n, m))
            out[i] = h = new
        return out

    def forward(self, proj: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Window logits. proj: (distinct words, 6H); index: (T, B) distinct words; mask (T, B)."""
        x = proj[index]
        fk, bk = ([], []) if keep is not None else (None, None)
        f = self._run(x[:, :, : 3 * HIDDEN], mask, self.p["Uf"], fk)
        b = self._run(x[::-1, :, 3 * HIDDEN :], mask[::-1], self.p["Ub"], bk)[::-1]
        h = np.concatenate([f, b], axis=2)
        s = np.tanh(h @ self.p["A"])
        e = np.where(mask, s @ self.p["a"], -1e9)
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = (alpha[:, :, None] * h).sum(axis=0)
        if keep is not None:
            keep.update(x=x, fk=fk, bk=bk, h=h, s=s, alpha=alpha, pooled=pooled, mask=mask)
        return pooled @ self.p["o"] + self.p["c"][0]

    def _back_run(self, dh_out: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t, b, _ = dh_out.shape
        dx, du, dh = np.zeros((t, b, 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros((b, HIDDEN), np.float32)
        for i in range(t - 1, -1, -1):
            h, g, r, z, n, m = kept[i]
            dh = dh + dh_out[i]
            d = np.where(m, dh, 0)
            dn, dz = d * (1 - z) * (1 - n * n), d * (h - n) * z * (1 - z)
            dr = dn * g[:, 2 * HIDDEN :] * r * (1 - r)
            dx[i] = np.concatenate([dr, dz, dn], axis=1)
            dg = np.concatenate([dr, dz, dn * r], axis=1)
            du += h.T @ dg
            dh = np.where(m, d * z, dh) + dg @ u.T
        return dx, du

    def gradients(self, keep: dict, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        p, h, s, alpha = self.p, keep["h"], keep["s"], keep["alpha"]
        g = {"o": keep["pooled"].T @ dlogit, "c": np.array([dlogit.sum()], np.float32)}
        dp = dlogit[:, None] * p["o"]
        dh = alpha[:, :, None] * dp
        da = (h * dp).sum(axis=2)
        de = np.where(keep["mask"], alpha * (da - (alpha * da).sum(axis=0)), 0)
        ds = de[:, :, None] * p["a"] * (1 - s * s)
        g["a"] = np.tensordot(s, de, ((0, 1), (0, 1)))
        g["A"] = np.tensordot(h, ds, ((0, 1), (0, 1)))
        dh = (dh + ds @ p["A"].T).astype(np.float32)
        dxf, g["Uf"] = self._back_run(dh[:, :, :HIDDEN], keep["fk"], p["Uf"])
        dxb, g["Ub"] = self._back_run(dh[::-1, :, HIDDEN:], keep["bk"], p["Ub"])
        return g, np.concatenate([dxf, dxb[::-1]], axis=2)


class _Adam:
    def __init__(self, p: dict, rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, p: dict, g: dict) -> None:
        self.t += 1
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, d in g.items():
            self.m[k] += 0.1 * (d - self.m[k])
            self.v[k] += 0.001 * (d * d - self.v[k])
            p[k] -= (self.rate * fix) * self.m[k] / (np.sqrt(self.v[k]) + 1e-7)


def _gather(first: np.ndarray, size: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(T, B) distinct-word index and mask of windows."""
    t = np.arange(WINDOW)[:, None]
    mask = t < size
    return inverse[np.minimum(first + t, len(inverse) - 1)], mask


def window_logits(net: Network, v: Vocabulary, inverse: np.ndarray, first: np.ndarray, size: np.ndarray, block: int = 2048) -> np.ndarray:
    proj = net.embed(v) @ net.p["W"] + net.p["b"]
    out = [net.forward(proj, *_gather(first[i : i + block], size[i : i + block], inverse)) for i in range(0, len(first), block)]
    return np.concatenate(out) if out else np.empty(0, np.float32)


def _top(doc: np.ndarray, logit: np.ndarray, n: int) -> np.ndarray:
    best = np.full(n, -np.inf)
    np.maximum.at(best, doc, logit)
    return best


def telling_windows(w: Words, labels: np.ndarray, doc: np.ndarray, first: np.ndarray, size: np.ndarray, stem: int = 5) -> np.ndarray:
    """For every window, the most telling of its words: log-odds of the word, or of its first `stem` bytes, by how many
    toxic and clean texts hold it, less one standard error."""
    powers_of = np.minimum(w.length, stem)
    stems = np.empty(len(w.hash), U64)
    for i, j in blocks(powers_of):
        n = powers_of[i:j]
        pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        low = w.data[pos + np.repeat(w.start[i:j], n)].astype(U64) | U64(32)
        stems[i:j] = mix64(np.add.reduceat(low << (U64(8) * pos.astype(U64)), np.cumsum(n) - n) + (n.astype(U64) << U64(50)))
    toxic_docs, clean_docs = labels.sum() + 1, (1 - labels).sum() + 1
    odds = np.full(len(w.hash), -np.inf)
    for key in (w.hash, stems):
        _, k = np.unique(key, return_inverse=True)
        pair = np.unique(k.astype(np.int64) * len(labels) + w.doc)
        of, kk = labels[pair % len(labels)], pair // len(labels)
        t, c = np.bincount(kk, of, k.max() + 1), np.bincount(kk, 1 - of, k.max() + 1)
        value = np.log((t + 0.5) / toxic_docs) - np.log((c + 0.5) / clean_docs) - np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        odds = np.maximum(odds, value[k])
    index = np.minimum(first + np.arange(WINDOW)[:, None], len(odds) - 1)
    return np.where(np.arange(WINDOW)[:, None] < size, odds[index], -np.inf).max(axis=0)


def train(texts: list[str], labels: list[int], seed: int = 7, steps: tuple[int, ...] = (140, 120, 100), batch: int = 192) -> Network:
    """Multiple-instance training. Every window of a clean text is clean. Of each toxic text, the first pass takes the
    windows whose most telling word stands out; later passes those that the network itself scores within reach of its
    best. Word embeddings are dropped at random, so that characters must carry words of few labels. Texts without words teach
    nothing; where the others are of one class, every text is held to be of that class, and clean where there are none."""
    net, rng = Network(seed), np.random.default_rng(seed)
    parts = list(text_chunks(pa.array(texts, pa.large_string()), 1 << 62))
    w = Words(parts[0][2], parts[0][3], lower=True) if parts else None
    doc, first, size = windows(w.count) if w else (np.empty(0, np.int64),) * 3
    y = np.asarray(labels, np.int64)[doc]
    clean, toxic = np.flatnonzero(y == 0), np.flatnonzero(y == 1)
    if not len(clean) or not len(toxic):
        net.only = float(len(toxic) > 0)
        return net
    v, inverse = vocabulary(w)
    telling = telling_windows(w, np.asarray(labels), doc[toxic], first[toxic], size[toxic])
    chosen = toxic[telling >= np.minimum(_top(doc[toxic], telling, len(labels))[doc[toxic]], 0.8 * np.median(_top(doc[toxic], telling, len(labels))[np.unique(doc[toxic])]))]
    adam, hard = _Adam(net.p, 0.01), clean
    for stage, count in enumerate(steps):
        if stage:
            logit = window_logits(net, v, inverse, first, size)
            best = _top(doc[toxic], logit[toxic], len(labels))
            chosen = toxic[logit[toxic] >= np.minimum(best[doc[toxic]], np.maximum(0.5 * best[doc[toxic]], 1.0))]
            hard = clean[np.argsort(-logit[clean])[: max(batch, len(clean) // 20)]]
        adam.rate = (0.01, 0.006, 0.003)[min(stage, 2)]
        for _ in range(count):
            half = batch // 2
            pick = np.concatenate([rng.choice(chosen, half), rng.choice(clean, half - half // 3), rng.choice(hard, half // 3)])
            target = np.concatenate([np.ones(half), np.zeros(half)]).astype(np.float32)
            index, mask = _gather(first[pick], size[pick], inverse)
            used, local = np.unique(index, return_inverse=True)
            length = v.count[used]
            at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(v.first[used], length)
            sub = Vocabulary(v.word[used], v.grams[at], np.cumsum(length) - length, length)
            x = net.embed(sub)
            shown = np.ones_like(x)
            shown[:, :WORD_DIM] = (rng.random(len(x)) < 0.5)[:, None] * 2
            shown[:, WORD_DIM:] = (rng.random((len(x), CHAR_DIM)) < 0.8) / 0.8
            x = x * shown
            proj = x @ net.p["W"] + net.p["b"]
            keep: dict = {}
            logit = net.forward(proj, local.reshape(index.shape), mask, keep)
            g, dproj_steps = net.gradients(keep, ((_sigmoid(logit) - target) / len(pick)).astype(np.float32))
            flat, steps_ = dproj_steps.reshape(-1, 6 * HIDDEN), local.reshape(-1)
            order = np.argsort(steps_, kind="stable")
            dproj = np.add.reduceat(flat[order], np.searchsorted(steps_[order], np.arange(len(used))), axis=0)
            g["W"], g["b"] = x.T @ dproj, dproj.sum(axis=0)
            dx = (dproj @ net.p["W"].T) * shown
            g["E"], g["C"] = np.zeros_like(net.p["E"]), np.zeros_like(net.p["C"])
            np.add.at(g["E"], sub.word, dx[:, :WORD_DIM])
            np.add.at(g["C"], sub.grams, np.repeat(dx[:, WORD_DIM:] / np.sqrt(length)[:, None].astype(np.float32), length, axis=0))
            adam.step(net.p, g)
    best = _top(doc, window_logits(net, v, inverse, first, size), len(labels))
    read = np.isfinite(best)
    net.cal = _calibrate(best[read], np.asarray(labels)[read])
    return net


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift: the cut between the classes with the fewest errors, in the middle of its gap, becomes 0."""
    order = np.argsort(x)
    xs, ys = x[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(ys)]) + np.concatenate([np.cumsum((1 - ys)[::-1])[::-1], [0]])
    at = np.flatnonzero(wrong == wrong.min())
    edge = lambda i: (xs[max(i - 1, 0)] + xs[min(i, len(xs) - 1)]) / 2
    gap = max(at, key=lambda i: xs[min(i, len(xs) - 1)] - xs[max(i - 1, 0)])
    return 1.0, -float(edge(gap))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Network:
    """Trains on per_class documents of each class and most_bytes of their texts at most, chosen by hash of doc_id. Only
    those texts are fetched, into the one task that trains, and only the network comes to the driver.

    A document with labels of both classes counts as toxic; null labels and null ids teach nothing. Of rows that repeat a
    doc_id the text of the least hash is read. A text that would pass the bytes is passed over. See train for missing classes.
    """
    known = labels.filter(F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids: list[tuple[int, int]] = []
    for label in (0, 1):
        ids += [(r[0], label) for r in known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id").collect()]
    of = dict(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, left = [], {0: most_bytes, 1: most_bytes}
        for b in batches:
            for doc_id, text, size in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "size"))):
                if size <= left[of[doc_id]]:
                    left[of[doc_id]] -= size
                    rows.append((doc_id, text))
        rows.sort()
        net = train([r[1] for r in rows], [of[r[0]] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])

    chosen = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text")).filter(F.col("doc_id").isin(list(of)) & F.col("text").isNotNull())
    one = chosen.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).withColumns({"size": F.octet_length("text"), "at": F.xxhash64("doc_id")})
    trained = one.repartition(1).sortWithinPartitions("at", "doc_id").mapInArrow(run, "net binary").collect() if of else []
    return pickle.loads(bytes(trained[0][0])) if trained else train([], [])


def score(docs: DataFrame, net: Network, *keep: str) -> DataFrame:
    """(doc_id, score, predicted, windows) of every row of docs, and where columns to keep are named, `text` if it is one of
    them and a struct `kept` of the others.

    score is 0 to 1, that of the most toxic of all overlapping windows of the whole text; a null or wordless text has
    no window and scores 0. A network that saw one class gives every text that class (train). Repeated rows score alike;
    columns of any name may be kept; others are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    others = [c for c in keep if c != "text"]
    kept = [F.struct(*[docs[c] for c in others]).alias("kept")] if others else []
    docs = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"), *kept)
    back = [f for f in docs.schema.fields if f.name == "kept" or f.name == "text" and "text" in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            for i, j, data, offsets in text_chunks(b.column("text"), 1_000_000):
                w = Words(data, offsets, lower=True)
                doc, first, size = windows(w.count)
                best = np.full(j - i, -np.inf)
                if len(doc) and net.only is None:
                    v, inverse = vocabulary(w)
                    best = _top(doc, window_logits(net, v, inverse, first, size), j - i)
                s = np.where(np.isfinite(best), _sigmoid(net.cal[0] * best + net.cal[1]), 0.0) if net.only is None else np.full(j - i, net.only)
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array(np.bincount(doc, minlength=j - i)), *(part.column(f.name) for f in back)], ["doc_id", "score", "windows", *(f.name for f in back)])

    schema = StructType([*StructType.fromDDL("doc_id long, score double, windows long").fields, *back])
    return docs.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of docs that net does not predict to be toxic; columns stay as they are, whatever their names."""
    kept = score(docs, net, *docs.columns).filter("predicted = 0")
    return kept.select(*[F.col("text").cast(docs.schema["text"].dataType) if c == "text" else F.col("kept")[c].alias(c) for c in docs.columns])
