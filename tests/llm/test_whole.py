"""Whole results where a shortcut once left some out."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quern.llm import decontamination, near_dedup


def test_leaks_of_common_words_are_found(spark):
    """Items whose every word is common have null vectors; copies of them are leaks as well."""
    rng = np.random.default_rng(9)
    words = [f"c{i}" for i in range(300)]
    some = lambda n: " ".join(rng.choice(words, n))
    items = [(i, some(30)) for i in range(4)]
    docs = [(i, f"{some(80)} {items[i % 4][1]} {some(70)}" if i % 3 == 0 else some(180)) for i in range(60)]
    rare = decontamination.latent_space(spark.createDataFrame(docs, "doc_id long, text string"))[1]
    assert not rare[decontamination._columns(decontamination.plain_words(pa.array([t for _, t in items])).hashes())].any()
    got = decontamination.leaks(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: r["item"] for r in got} == {i: i % 4 if i % 3 == 0 else None for i, _ in docs}


def test_paraphrases_at_the_limit_are_found(spark, small):
    """All texts that keep 0.7 of an item's words in order, wherever the cosine of their windows lies."""
    rng = np.random.default_rng(10)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    corpus = " ".join(r["text"] or "" for r in docs.collect()).split()
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    changed = []
    for r in items.collect():
        for _ in range(5):
            words = r["text"].split()
            for i in rng.choice(len(words), int(0.3 * len(words)), replace=False):
                words[i] = str(rng.choice(corpus))
            changed.append((10_000 + len(changed), " ".join([*rng.choice(corpus, 50), *words, *rng.choice(corpus, 50)])))
    got = decontamination.leaks(spark, docs.unionByName(spark.createDataFrame(changed, docs.schema)), items).where("doc_id >= 10000")
    assert got.where(F.col("item").isNull()).count() == 0


def test_near_dedup_keeps_texts_without_doc_id(spark):
    """Texts without doc_id are documents of their own: none is lost and none joins other classes."""
    text = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    rows = [(None, text[0]), (None, text[1]), (None, text[2]), (None, text[2]), (5, text[0]), (9, text[1]), (7, text[3]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["digest"]): r["class_id"] for r in near_dedup.near_classes(spark, docs).collect()}
    md5 = lambda t: t and hashlib.md5(t.encode()).hexdigest()
    assert got == {(d, md5(t)): {text[0]: 5, text[1]: 9, text[3]: 7}.get(t) for d, t in rows}
    kept = [tuple(r) for r in near_dedup.near_dedup(spark, docs).collect()]
    assert sorted(kept, key=repr) == sorted([(5, text[0]), (9, text[1]), (7, text[3]), (None, text[2]), (None, None)], key=repr)


def test_near_dedup_loses_no_row(spark):
    """Rows with null and repeated ids, by SQL: classes consist of rows, and each keeps one."""
    import duckdb

    rng = np.random.default_rng(6)
    base = [[f"{c}{i}" for i in range(80)] for c in "abcdef"]
    rows = []
    for b in base:
        for d in (5, 5, None, 9, None):
            words = list(b)
            if rng.random() < 0.6:
                words[int(rng.integers(0, 80))] = f"n{len(rows)}"
            rows.append((d, " ".join(words)))
    rows += [(5, rows[0][1]), (None, rows[2][1]), (3, None), (3, None), (None, None), (4, ""), (6, ""), (None, " "), (1, "two words"), (2, "two words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.sql(near_dedup.OP4_SQL).fetchall()
    got = near_dedup.near_classes(spark, docs)
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["class_id"], r["kept"])) for r in got.collect())
    kept = near_dedup.near_dedup(spark, docs).collect()
    assert sorted(repr(r["doc_id"]) for r in kept) == sorted(repr(d) for d, _, k in want if k)
    texts = {r["text"] for r in kept}
    for b in base:  # something of every group stays
        assert any(t and t.startswith(f"{b[0][0]}1 ") or t and f" {b[0][0]}40 " in t for t in texts)
