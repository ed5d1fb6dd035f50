"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words (the last one may be shorter).
Every passage is encoded by a small network over character-class, word-shape and
hashed byte-pair shares; a gated attention layer weighs the encodings of a bag, and a
logistic layer scores their weighted mean (Ilse et al. 2018). Only document labels
are learned from; the attention finds the passages that matter.

The network is trained on the driver from at most ``SAMPLE`` labelled documents outside
the held-out fold, those of least id hash, by at most ``BAG`` passages of each, evenly spaced
over its whole text; their features, not their texts, are collected. Scoring reads every text of every document in executors.

Edge cases.  Null and empty texts are a bag of one all-zero passage. Several labels of a
document count by majority, ties as 1; null labels and labels without document are not
learned from. If no label or only one value is left, the score is the mean label (0.5
without any). Rows with equal doc_id are scored each by its own text; one of them is learned from. A null doc_id
counts as held out. Extra columns are ignored by ``scores`` and kept by
``keep_good``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Words, every, fresh, mix, small_batches, text_blocks

PASSAGE, CUT, FOLDS = 64, 0.3, 5
#: Labelled documents that the network is fitted on at most.
SAMPLE = 4000
#: Passages of a document that the network is fitted on at most.
BAG = 64
_CLASSES, _SHAPES, _PAIRS = 48, 64, 128
WIDTH = _CLASSES + _SHAPES + _PAIRS + 4
_HIDDEN, _GATE = 24, 16

_CLASS = np.full(256, 47, np.int64)  # each mark its own class; letters by case, digits, wider characters
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:], _CLASS[32] = 0, 1, 2, 3, 4
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = np.arange(5, 5 + 32)


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (float32 rows), and the first row of each text (one more at the end)."""
    w = Words.of(texts)
    n = np.diff(w.ptr)
    count = np.maximum(1, -(-n // PASSAGE))
    first = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros((int(first[-1]), WIDTH), np.float32)
    if len(w) == 0:
        return out, first
    at = np.arange(len(w)) - np.repeat(w.ptr[:-1], n)
    of = np.repeat(first[:-1], n) + at // PASSAGE  # passage of each word
    begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    rows, words = of[begin], np.diff(np.append(begin, len(w))).astype(np.float32)
    size = w.end - w.start
    where = np.full(len(out), -1, np.int64)
    where[rows] = np.arange(len(rows))
    step = 1 << 14
    for lo in range(0, len(rows), step):  # passages at a time, which bounds the histograms
        hi = min(lo + step, len(rows))
        a, b = int(begin[lo]), int(begin[hi]) if hi < len(rows) else len(w)
        s, e = int(w.start[a]), int(w.end[b - 1])
        raw = w.buf[s:e].astype(np.int64)
        edge = np.append(w.start[begin[lo:hi]] - s, e - s)
        mine = np.repeat(np.arange(hi - lo), np.diff(edge))
        m, chars = hi - lo, np.diff(edge)[:, None].astype(np.float32)
        x = out[rows[lo:hi]]
        x[:, :_CLASSES] = np.bincount(mine * _CLASSES + _CLASS[raw], minlength=m * _CLASSES).reshape(m, -1) / chars
        pair = (_CLASS[raw[:-1]] * 61 + _CLASS[raw[1:]] * 7 + (raw[:-1] ^ raw[1:]) % 5) % _PAIRS
        inside = mine[:-1] == mine[1:]  # what follows a passage is none of its pairs
        x[:, _CLASSES : _CLASSES + _PAIRS] = np.bincount(mine[:-1][inside] * _PAIRS + pair[inside], minlength=m * _PAIRS).reshape(m, -1) / chars
        f, l, k = _CLASS[w.buf[w.start[a:b]]], _CLASS[w.buf[w.end[a:b] - 1]], np.minimum(size[a:b], 12)
        shape = (f * 31 + l * 17 + k // 3) % _SHAPES
        own = np.repeat(np.arange(m), words[lo:hi].astype(np.int64))
        x[:, _CLASSES + _PAIRS : WIDTH - 4] = np.bincount(own * _SHAPES + shape, minlength=m * _SHAPES).reshape(m, -1) / words[lo:hi, None]
        x[:, -4] = np.bincount(own, size[a:b], m) / words[lo:hi] / 10
        out[rows[lo:hi]] = np.sqrt(x)
    h = w.hashes()
    order = np.argsort(mix(h ^ of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))  # equal words of a passage stand together
    same = (h[order][1:] == h[order][:-1]) & (of[order][1:] == of[order][:-1])
    out[rows, -3] = np.bincount(where[of[order][1:][same]], minlength=len(rows)) / words
    out[rows, -2] = np.minimum(words / PASSAGE, 1)
    out[rows, -1] = np.log1p(np.repeat(count, count)[rows]) / 5
    return out, first


class GatedAttention:
    """Encoder, gated attention and logistic layer, with its own gradients."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, rng: np.random.Generator):
        self.mean, self.scale = mean, scale
        glorot = lambda i, o: rng.standard_normal((i, o)).astype(np.float32) * np.float32(np.sqrt(2 / (i + o)))
        zeros = lambda n: np.zeros(n, np.float32)
        self.p = {"w": glorot(WIDTH, _HIDDEN), "b": zeros(_HIDDEN), "v": glorot(_HIDDEN, _GATE), "u": glorot(_HIDDEN, _GATE), "a": glorot(_GATE, 1)[:, 0], "c": glorot(_HIDDEN, 1)[:, 0], "d": zeros(1)}

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        p, start, n = self.p, first[:-1], np.diff(first)
        z = (x - self.mean) * self.scale
        h = np.tanh(z @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, start), n))
        alpha = e / np.repeat(np.add.reduceat(e, start), n)
        bag = np.add.reduceat(alpha[:, None] * h, start, axis=0)
        score = 1 / (1 + np.exp(-np.clip(bag @ p["c"] + p["d"], -30, 30)))
        return score, (z, h, t, g, alpha, bag)

    def gradients(self, first: np.ndarray, y: np.ndarray, score: np.ndarray, kept: tuple) -> dict[str, np.ndarray]:
        p, n, (z, h, t, g, alpha, bag) = self.p, np.diff(first), kept
        d = (score - y) / len(y)
        to_bag = np.repeat(d[:, None] * p["c"], n, axis=0)
        to_alpha = (to_bag * h).sum(1)
        to_e = alpha * (to_alpha - np.repeat(np.add.reduceat(alpha * to_alpha, first[:-1]), n))
        to_t, to_g = to_e[:, None] * g * p["a"] * (1 - t * t), to_e[:, None] * t * p["a"] * g * (1 - g)
        to_h = (alpha[:, None] * to_bag + to_t @ p["v"].T + to_g @ p["u"].T) * (1 - h * h)
        return {"w": z.T @ to_h, "b": to_h.sum(0), "v": h.T @ to_t, "u": h.T @ to_g, "a": (t * g).T @ to_e, "c": bag.T @ d, "d": d.sum(keepdims=True)}

    @classmethod
    def fit(cls, bags: list[np.ndarray], y: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 0.004, decay: float = 1e-4, seed: int = 7) -> GatedAttention:
        rng = np.random.default_rng(seed)
        total, square, n = np.zeros(WIDTH), np.zeros(WIDTH), 0
        for b in bags:
            total += b.sum(0, dtype=np.float64)
            square += (b.astype(np.float64) ** 2).sum(0)
            n += len(b)
        mean = total / n
        spread = np.sqrt(np.maximum(square / n - mean**2, 0))
        net = cls(mean.astype(np.float32), np.where(spread > 1e-4, 1 / np.maximum(spread, 1e-4), 0).astype(np.float32), rng)
        m = {k: np.zeros_like(v) for k, v in net.p.items()}
        s = {k: np.zeros_like(v) for k, v in net.p.items()}
        step, batches = 0, -(-len(bags) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for i in range(batches):
                own = order[i::batches]
                x, first = np.concatenate([bags[j] for j in own]), np.concatenate(([0], np.cumsum([len(bags[j]) for j in own])))
                score, kept = net.forward(x, first)
                step += 1
                pace = rate * 0.5 * (1 + np.cos(np.pi * step / (epochs * batches)))
                for k, gr in net.gradients(first, y[own], score, kept).items():
                    gr = gr + decay * net.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * gr
                    s[k] = 0.999 * s[k] + 0.001 * gr * gr
                    net.p[k] = (net.p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return net


def _features(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_blocks(batches):
            x, first = passages(t["text"])
            bags = []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                some = slice(a, b) if b - a <= most else np.linspace(a, b - 1, most).astype(np.int64)
                bags.append(x[some].astype("<f2").tobytes())
            yield pa.RecordBatch.from_pydict({"y": t["y"].combine_chunks(), "x": pa.array(bags, pa.binary())})

    return run


def _score(net: GatedAttention | float, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_blocks(batches):
            if isinstance(net, float):
                score = np.full(t.num_rows, net)
            else:
                x, first = passages(t["text"])
                score = np.empty(t.num_rows)
                for lo in range(0, t.num_rows, 256):
                    hi = min(lo + 256, t.num_rows)
                    score[lo:hi] = net.forward(x[first[lo] : first[hi]], first[lo : hi + 1] - first[lo])[0]
            yield pa.RecordBatch.from_arrays([*(t[c].combine_chunks() for c in t.column_names), pa.array(score, pa.float64())], names=[*t.column_names, name])

    return run


def fold(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> GatedAttention | float:
    """Fit on at most ``sample`` labelled documents (doc_id, text; doc_id, quality) outside fold 0."""
    small_batches(docs.sparkSession)
    votes = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    some = votes.where(fold(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # broadcast: at most ``sample`` ids and labels
    chosen = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    chosen = chosen.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text", "y")).alias("x")).select("x.text", "x.y")
    rows = chosen.mapInArrow(_features(BAG), "y double, x binary").toArrow()
    y = rows["y"].to_numpy()
    if len(np.unique(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    blobs = rows["x"].to_pylist()
    order = sorted(range(len(y)), key=lambda i: (blobs[i], y[i]))  # the order of arrival must not matter
    return GatedAttention.fit([np.frombuffer(blobs[i], "<f2").reshape(-1, WIDTH).astype(np.float32) for i in order], y[order].astype(np.float32))


def scores(docs: DataFrame, net: GatedAttention | float, *keep: str, name: str = "score") -> DataFrame:
    """docs with text: the columns in ``keep`` (text with them) and the score, under a name they must not have."""
    small_batches(docs.sparkSession)
    wanted = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys((*keep, "text"))])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields)
    return wanted.mapInArrow(_score(net, name), f"{schema}, `{name}` double")


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents that the classifier does not reject, with the columns of docs."""
    name = fresh("score", docs.columns)
    return scores(docs, train(docs, labels), *docs.columns, name=name).where(F.col(name) >= cut).select(*every(docs))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = scores(docs, train(docs, labels), "doc_id")
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
