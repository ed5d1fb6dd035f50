"""Leaks by brute force: every item against every stretch, in any number of blocks."""

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import decontamination as D


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def plain(text):
    w = D.plain_words(pa.array([text], pa.string()))
    return [bytes(w.buf[a:b]) for a, b in zip(w.start, w.end, strict=True)]


def brute(doc, items):
    """Greatest share of an item's words in order within any stretch of twice its length, and the item: what any window of step 3 can see."""
    words, best = plain(doc), (0.0, False, 0)
    for name, text in items:
        item = plain(text)
        n = len(item)
        for i in range(0, max(1, len(words) - n), max(1, n // 6)):
            window = words[max(0, i - n // 2) : i + 2 * n - n // 2]
            share = lcs(item, window) / n
            if share >= D.SURE or share >= D.LIKELY and lcs(item[-D.ANSWER :], window) >= D.ANSWER_SHARE * len(item[-D.ANSWER :]):
                best = max(best, (share, name is not None, -(name or 0)))
    return best


@pytest.mark.parametrize("vocabulary", [60, 4000])
@pytest.mark.parametrize("block", [20_000, 3])
def test_leaks_by_brute_force(spark, monkeypatch, vocabulary, block):
    """Small and large vocabularies, one block and many: the same documents are contaminated."""
    rng = np.random.default_rng(vocabulary)
    words = [f"w{i}" for i in range(vocabulary)]
    some = lambda n: list(rng.choice(words, n))
    items = [(i if i else None, " ".join(some(int(rng.integers(12, 60))))) for i in range(9)]
    docs = []
    for i in range(60):
        text = some(int(rng.integers(20, 120)))
        if i % 2:
            item = items[i % 9][1].split()
            for j in rng.choice(len(item), int((0, 0.1, 0.2)[i % 3] * len(item)), replace=False):
                item[j] = "changed"
            at = int(rng.integers(0, len(text)))
            text = text[:at] + item + text[at:]
        docs.append((i, " ".join(text)))
    monkeypatch.setattr(D, "ITEM_BLOCK", block)
    got = D.leaks(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {i: brute(t, items) for i, t in docs}
    assert {r["doc_id"] for r in got if r["share"] > 0} == {i for i, b in want.items() if b[0]}
    planted = {r["doc_id"]: r["item"] for r in got if r["doc_id"] % 2}
    assert all(planted[i] == items[i % 9][0] for i in planted if want[i][0] == 1.0 and sum(lcs(plain(t), plain(docs[i][1])) == len(plain(t)) for _, t in items) == 1)


def test_ties_and_items_without_id(spark, monkeypatch):
    """Of items with equal shares the least item_id names a leak, from whatever block; without any item_id it is still one."""
    half = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"{half[0]} x {half[1]}"), (2, half[1]), (3, "none of it here at all"), (4, None)], "doc_id long, text string")
    for items, want in (([(8, half[0]), (5, half[1])], {1: 5, 2: 5}), ([(8, half[0]), (9, half[1])], {1: 8, 2: 9}), ([(8, half[0]), (None, half[1])], {1: 8, 2: None})):
        for block in (1, 20_000):
            monkeypatch.setattr(D, "ITEM_BLOCK", block)
            bench = spark.createDataFrame(items, "item_id long, text string")
            got = {r["doc_id"]: (r["item"], r["share"]) for r in D.leaks(spark, docs, bench).collect()}
            assert got == {d: (want.get(d), 1.0 if d in want else 0.0) for d in (1, 2, 3, 4)}
            assert sorted(r["doc_id"] for r in D.without_leaks(spark, docs, bench).collect()) == [3, 4]


def test_a_copy_in_a_corpus_of_two(spark):
    """A verbatim copy is found however few documents there are."""
    item = "what is the capital of the largest country in the world by area and how many people live there today answer moscow"
    docs = spark.createDataFrame([(1, f"before it {item} and after"), (2, "the other text of this corpus has words of its own")], "doc_id long, text string")
    got = D.leaks(spark, docs, spark.createDataFrame([(3, item)], "item_id long, text string")).collect()
    assert {r["doc_id"]: r["item"] for r in got} == {1: 3, 2: None}
