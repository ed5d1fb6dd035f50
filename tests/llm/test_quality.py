"""The network's gradients by differences, its features by a loop, bounded bags."""

import numpy as np
import pyarrow as pa

from quern.llm import quality as Q


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    net = Q.GatedAttention(np.zeros(Q.WIDTH, np.float32), np.ones(Q.WIDTH, np.float32), rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    first, x, y = np.array([0, 1, 4, 9]), rng.standard_normal((9, Q.WIDTH)), np.array([1.0, 0.0, 1.0])

    def loss():
        s = net.forward(x, first)[0]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    score, kept = net.forward(x, first)
    for name, gradient in net.gradients(first, y, score, kept).items():
        flat, g = net.p[name].reshape(-1), np.asarray(gradient).reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-5 - g[i]) < 1e-6, name


def test_forward_equals_a_loop():
    rng = np.random.default_rng(3)
    net = Q.GatedAttention(np.full(Q.WIDTH, 0.1), np.full(Q.WIDTH, 2.0), rng)
    x, first = rng.random((7, Q.WIDTH)), np.array([0, 3, 4, 7])
    want = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        h = [np.tanh((x[i] - 0.1) * 2 @ net.p["w"] + net.p["b"]) for i in range(a, b)]
        e = [np.exp((np.tanh(v @ net.p["v"]) / (1 + np.exp(-(v @ net.p["u"])))) @ net.p["a"]) for v in h]
        z = sum(w * v for w, v in zip(e, h, strict=True)) / sum(e)
        want.append(1 / (1 + np.exp(-(z @ net.p["c"] + net.p["d"][0]))))
    assert np.allclose(net.forward(x, first)[0], want, atol=1e-6)


def test_passages_equal_a_loop():
    """A passage of a block has the features that it has as a text of its own (but for the length of the bag)."""
    rng = np.random.default_rng(4)
    words = ["The", "cat", "sat,", "on", "1999", "é", "(mat)", "--", "aVeryLongWordOfManyLetters"]
    texts = [" ".join(rng.choice(words, n)) for n in (1, 63, 64, 65, 300)] + ["", None, " \n"]
    x, first = Q.passages(pa.array(texts))
    for d, text in enumerate(texts):
        own = (text or "").split()
        parts = [" ".join(own[i : i + Q.PASSAGE]) for i in range(0, max(1, len(own)), Q.PASSAGE)]
        assert first[d + 1] - first[d] == len(parts)
        for k, part in enumerate(parts):
            y = Q.passages(pa.array([part]))[0][0]
            last = k == len(parts) - 1  # the others have the space behind them, too
            assert np.allclose(x[first[d] + k][:-1], y[:-1], atol=1e-6 if last else 8e-2)


def test_bags_are_bounded(spark, monkeypatch):
    """Long texts and repeated ids give bounded bags, spaced over the whole text."""
    docs = spark.createDataFrame([(i, ("good " if i % 2 else "bad! ") * 64 * 50) for i in range(1, 40)] + [(3, "good " * 64)] * 200, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    monkeypatch.setattr(Q, "BAG", 8)
    sizes = []
    fit = Q.GatedAttention.fit.__func__
    monkeypatch.setattr(Q.GatedAttention, "fit", classmethod(lambda cls, bags, y: sizes.extend(map(len, bags)) or fit(cls, bags, y)))
    net = Q.train(docs, labels)
    assert len(sizes) <= 39 and max(sizes) == 8
    got = {r["doc_id"]: r["score"] for r in Q.scores(docs.where("doc_id <> 3"), net, "doc_id").collect()}
    assert all((s > 0.5) == (d % 2 == 1) for d, s in got.items())
