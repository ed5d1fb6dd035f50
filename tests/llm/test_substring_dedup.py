"""Windows that repeat, by brute force: rows of one id, frequent pieces."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import substring_dedup


def brute(rows, window):
    """(doc_id, text) pairs -> multiset of (doc_id, n_words, n_removed, digest); rows equal in both are one document."""
    docs = sorted({(d is not None, d or 0, t or "") for d, t in rows})
    words = {k: k[2].encode().split() for k in docs}
    first, later = {}, {k: set() for k in docs}
    # documents of one id have no order of their own in the contract: compare only what order cannot change
    for k in docs:
        for i in range(len(words[k]) - window + 1):
            w = tuple(words[k][i : i + window])
            if first.setdefault(w, (k, i)) != (k, i):
                later[k] |= set(range(i, i + window))
    out = []
    for d, t in rows:
        k = (d is not None, d or 0, t or "")
        kept = b" ".join(x for i, x in enumerate(words[k]) if i not in later[k])
        out.append((d, len(words[k]), len(later[k]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, substring_dedup.substring_dedup(spark, df, **options).collect()), key=repr)


def test_texts_of_one_id_with_equal_short_hashes(spark):
    """Two texts of one doc_id that agree in a 32-bit hash are still two documents."""
    texts = spark.range(300_000).select(F.concat_ws(" ", *[F.concat(F.lit(c), F.col("id")) for c in "abcdefghijklmnopqrstuvwxyzABC"]).alias("text"))
    twins = texts.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("t")).where("size(t) > 1").first()["t"]
    long = twins[0] + " " + " ".join(f"z{i}" for i in range(30))
    rows = [(7, twins[0]), (7, twins[1]), (None, twins[0]), (None, twins[1]), (8, twins[1] + " " + twins[0]), (9, long)]
    got = result(spark, rows, window=20)
    assert got == brute(rows, 20)


@pytest.mark.parametrize("spread", [1, 64, 100_000])
def test_frequent_pieces_decide_no_result(spark, monkeypatch, spread):
    """Whatever pieces count as frequent, the same words go."""
    rng = np.random.default_rng(1)
    words = [f"v{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 90))))) for i in range(60)]
    common = " ".join(words)
    rows += [(100 + i, f"x{i} y{i} {common} z{i} u{i} {common} w{i}") for i in range(30)]
    monkeypatch.setattr(substring_dedup, "SPREAD", spread)
    assert result(spark, rows, window=6, gram=3) == brute(rows, 6)
