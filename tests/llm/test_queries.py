"""Registered queries against SQL, brute force or held-out accuracy."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import near_dedup, token_output
from quern.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(agree, name):
    agree(QUERIES[name], ORACLES[name])


def texts(spark, small):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    scored = QUERIES["op5_quality"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in scored)
    assert np.mean([r["predicted"] == r["quality"] for r in scored]) >= 0.95


def test_tokens(spark, small):
    tok = token_output._tokenizer(token_output.default_tokenizer())
    start = 0
    for r in QUERIES["op8_token_output"](spark, small).orderBy("doc_id").collect():
        ids = tok.encode(texts_of(spark, small)[r["doc_id"]], add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


_KNOWN = {}


def texts_of(spark, small):
    if small not in _KNOWN:
        _KNOWN[small] = texts(spark, small)
    return _KNOWN[small]


def test_leaks_are_found(spark, small):
    items = [r["text"].split() for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    held = {d for d, t in texts_of(spark, small).items() if any(" ".join(i) in " ".join((t or "").split()) for i in items)}
    got = {r["doc_id"] for r in QUERIES["op9_decontamination"](spark, small).where("contaminated").collect()}
    assert got == held


def test_paraphrases_are_found(spark, small):
    from quern.llm.decontamination import leaks

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    changed = []
    for i, r in enumerate(items.collect()):
        words = r["text"].split()
        words[3::8] = ["other"] * len(words[3::8])
        changed.append((10_000 + i, "some words in front of it " + " ".join(words) + " and some behind"))
    got = leaks(spark, docs.unionByName(spark.createDataFrame(changed, "doc_id long, text string")), items).where("doc_id >= 10000")
    assert got.where(F.col("item").isNotNull()).count() >= 0.95 * len(changed)


def test_pseudonyms_hide(spark, small):
    import re

    for r in QUERIES["op3_pii_pseudonyms"](spark, small).collect():
        for old in re.findall(r"[\w.]+@[\w.]+\w|\b\d{1,3}(?:\.\d{1,3}){3}\b|\(\d{3}\) \d{3}-\d{4}", texts_of(spark, small)[r["doc_id"]] or ""):
            assert old not in r["text"]


def test_sampler_estimates(spark):
    """Equal samples estimate weighted Jaccard similarity, for any weights."""
    rng = np.random.default_rng(1)
    s = near_dedup.Sampler(4.0)
    est, true = [], []
    for _ in range(60):
        h = rng.integers(0, 1 << 62, 300).astype(np.uint64)
        w = rng.choice([4.0, 2.5, 7.0], 300)
        w2 = np.where(rng.random(300) < 0.8, w, 4.0)
        keep = rng.random(300) < 0.85
        a, b = s.sketch(h, w, np.array([0]))[0], s.sketch(h[keep], w2[keep], np.array([0]))[0]
        est.append((a == b).mean())
        v = np.where(keep, w2, 0)
        true.append(np.minimum(w, v).sum() / np.maximum(w, v).sum())
    assert abs(np.mean(est) - np.mean(true)) < 0.02


def test_document_counts_are_exact(spark, small, monkeypatch):
    """Every block knows the documents of all its shingles, whatever blocks and buckets there are."""
    import pyarrow as pa

    from quern.llm.common import Scratch

    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 30_000)
    monkeypatch.setattr(near_dedup, "BUCKET_BYTES", 20_000)
    scratch = Scratch(spark)
    _, keyed = near_dedup._numbered(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"), scratch)
    counts, docs = near_dedup.document_counts(keyed, scratch)
    own = {d: near_dedup.Shingles(pa.array([t])).hash for d, t in texts_of(spark, small).items()}
    every, n = np.unique(np.concatenate(list(own.values())), return_counts=True)
    known = dict(zip(every.tolist(), n.tolist(), strict=True))
    assert docs == sum(len(h) > 0 for h in own.values())
    blobs = {}
    for r in counts.collect():
        blobs.setdefault(r["block"], []).append(bytes(r["packed"]))
    assert len(blobs) > 5
    for r in keyed.where("wordy").select("block", "doc_id").collect():
        h = own[r["doc_id"]]
        assert near_dedup.Counts(blobs.get(r["block"], [])).of(h).tolist() == [known[x] for x in h.tolist()]


@pytest.mark.parametrize("wide", [1, 3, 16])
def test_near_dedup_blocks(spark, monkeypatch, wide):
    """A group larger than a block is still one class, by pairs of blocks or by pivots."""
    rng = np.random.default_rng(0)
    base = [f"t{i}" for i in rng.integers(0, 5000, 300)]
    rows = []
    for i in range(70):
        own = list(base)
        own[int(rng.integers(0, 300))] = f"new{i}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(f"u{j}" for j in rng.integers(0, 5000, 100))) for i in range(20)]
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "WIDE", wide)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 70 else i for i, _ in rows}


def test_pipeline_is_its_stages(spark, small):
    """run() equals its stages by brute force on their own inputs."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, small).collect(), docs.schema)
        assert after.columns == columns
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        old = {r["doc_id"] for r in before.select("doc_id").collect()}
        assert ids <= old
        if name == "quality_classifier":
            rejected = {r["doc_id"] for r in QUERIES["op5_quality"](spark, small).where("predicted = 0").collect()}
            assert ids == old - rejected and rejected
        if name == "near_dedup":
            classes = near_dedup.near_classes(spark, before).collect()
            assert ids == {r["class_id"] for r in classes} and after.count() == len(ids)
        if name == "decontamination":
            items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            leaked = {d for d in old if any(i in " ".join((texts_of(spark, small)[d] or "").split()) for i in items)}
            assert ids == old - leaked
        if name == "source_mixing":
            most = after.groupBy("doc_id").count().agg(F.max("count")).first()[0]
            assert most <= 2
        before = after
    got = corpus_pipeline.run(spark, small)
    assert got.count() == before.count()
    want = {r["doc_id"]: r["n"] for r in before.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()} == want


def test_near_dedup_loses_no_link_outside_the_largest_component(spark, monkeypatch):
    """Two groups that share a key, and chains whose ends are unlike, come out as by brute force."""
    rng = np.random.default_rng(4)
    rows = []
    for g in range(3):
        words = [f"g{g}w{i}" for i in range(200)]
        for i in range(25):  # a chain: each text replaces a little more
            words = list(words)
            for j in rng.integers(0, 200, 2):
                words[j] = f"g{g}n{i}x{j}"
            rows.append((100 * g + i, " ".join(words)))
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "WIDE", 1)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 100 * 100 for i, _ in rows}
