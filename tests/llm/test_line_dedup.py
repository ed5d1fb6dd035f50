"""Maximal repeated runs of lines by brute force."""

import random

import pytest

from quern.llm import line_dedup as L


def brute(rows, least):
    """Lines that go, by windows of ``least`` lines, of texts in order of doc_id."""
    seen, gone = set(), {}
    for d, text in sorted(rows):
        lines = text.split("\n")
        gone[d] = set()
        for i in range(len(lines) - least + 1):
            w = tuple(lines[i : i + least])
            if w in seen:
                gone[d] |= set(range(i, i + least))
            seen.add(w)
    return gone


def lcp(docs, p, s):
    (d, i), (e, j), n = p, s, 0
    while i + n < len(docs[d]) and j + n < len(docs[e]) and docs[d][i + n] == docs[e][j + n]:
        n += 1
    return n


def corpus(seed):
    rng = random.Random(seed)
    base = [f"line {i}" for i in range(80)]
    rows = []
    for d in range(40):
        text = []
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(0, 80)
            text += base[at : at + rng.choice([1, 2, 3, 5, 8, 21, 50])]
            text += [rng.choice(["", "x", f"own {d} {rng.random()}"]) for _ in range(rng.randrange(0, 3))]
        rows.append((d, "\n".join(text)))
    return [*rows, (100, "\n".join(base)), (101, "\n".join(base)), (102, "\n".join(["a"] * 37)), (103, "")]


@pytest.mark.parametrize("least", [1, 3, 7])
def test_runs_by_brute_force(spark, least):
    rows = corpus(least)
    docs = {d: t.split("\n") for d, t in rows}
    gone = brute(rows, least)
    got = {r["doc_id"]: r for r in L.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), least=least).collect()}
    for d, lines in docs.items():
        r = got[d]
        spans = [(s["begin"], s["end"]) for s in r["spans"] or []]
        assert {i for a, b in spans for i in range(a, b)} == gone[d] and r["n_removed"] == len(gone[d])
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
        assert r["kept_text"] == ("\n".join(x for i, x in enumerate(lines) if i not in gone[d]))
        runs = [tuple(x) for x in r["runs"] or []]
        assert {i for a, b, *_ in runs for i in range(a, b)} == gone[d]
        for begin, end, e, j in runs:
            assert (e, j) < (d, begin) and end - begin >= least and lcp(docs, (d, begin), (e, j)) == end - begin  # maximal to the right
            # no earlier copy goes on for twice as long, and this is the first that goes on so deep
            best = max(lcp(docs, (d, begin), (f, k)) for f in docs for k in range(len(docs[f])) if (f, k) < (d, begin))
            assert best < 2 * (end - begin) and best >= end - begin


def test_levels_end_beyond_the_longest_run(spark):
    """Doubling goes on until every rank is unique."""
    from pyspark.sql import functions as F

    from quern.llm.common import Scratch

    rows = [(1, "\n".join(map(str, range(50)))), (2, "\n".join(map(str, range(5, 47)))), (3, "q")]
    docs = spark.createDataFrame(rows, "id long, text string").withColumn("tie", F.lit(""))
    scratch = Scratch(spark)
    levels = L.suffix_levels(docs, scratch, 3)
    assert sorted(levels) == [1, 2, 3, 6, 12, 24, 48] and levels[48].isEmpty() and not levels[24].isEmpty()
    assert [(r["id"], r["pos"], r["length"], r["first"]["id"], r["first"]["pos"]) for r in L.repeated_runs(levels, scratch, 3).collect()] == [(2, 0, 42, 1, 5)]
    for depth in (6, 24):  # ranks follow the order of the lines' ids
        assert levels[depth].groupBy("rank").agg(F.count_distinct("first").alias("n")).where("n <> 1").isEmpty()
