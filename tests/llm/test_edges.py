"""Nulls, empty and very long texts, repeated rows, empty tables and clashing names."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import decontamination, elias_fano, embedding_dedup, line_dedup, mixing, near_dedup, pseudonyms, quality, substring_dedup, token_output, warc_fixity
from quern.llm.common import Words, fresh, gram_hashes, sliding_min
from quern.llm.graph import connected_components

WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(WORDS[i * 7 % 400] + str(i) for i in range(120_000))
ROWS = [
    (1, " ".join(WORDS[:60]), "en", "a", 1),
    (2, "x " + " ".join(WORDS[10:50]) + " y", "en", "a", 1),
    (2, " ".join(WORDS[100:140]), None, None, None),
    (3, " ".join(WORDS[:60]), "en", "b", 1),
    (3, " ".join(WORDS[:60]), "en", "b", 1),
    (4, None, None, "a", None),
    (5, "", "en", "c", 0),
    (None, "odd words\there\n\n  and  there", "en", "b", 3),
    (6, LONG, "en", "a", 9),
    (7, "one two", "en", "c", 1),
    (8, "one two", "en", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("key", "tie", "spans", "id", "digest", "size", "bucket", "row", "mix", "score", "item", "share", "target", "source_size", "copies", "component", "label", "y", "words")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(f"old {c}") for c in CLASH}).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def as_words(text):
    return (text or "").encode().split()



def test_substring_dedup(spark, docs, none):
    got = {(r["doc_id"], r["kept_sha256"]): r for r in substring_dedup.substring_dedup(spark, docs, with_text=True).collect()}
    assert substring_dedup.substring_dedup(spark, docs).count() == len(ROWS)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1, digest(" ".join(WORDS[:60]))]["n_removed"] == 0
    assert got[2, digest("x y")]["n_removed"] == 40 and got[3, digest("")]["n_removed"] == 60
    assert got[4, digest("")]["n_words"] == 0 and got[5, digest("")]["n_words"] == 0
    assert got[None, digest("odd words here and there")]["n_words"] == 4
    assert got[6, digest(LONG)]["n_words"] == 120_000
    assert substring_dedup.substring_dedup(spark, none).collect() == []


def test_substring_dedup_in_small_blocks(spark, small):
    """Bounded folds give what whole buckets give."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(substring_dedup.substring_dedup(spark, docs, window=8, gram=3)) == key(substring_dedup.substring_dedup(spark, docs, window=8, gram=3, fold_bytes=4000))


def test_line_dedup(spark, docs, none):
    a = "\n".join("abcdef")
    rows = [(1, a), (2, "x\nb\nc\nd\ny"), (3, "a\nb"), (4, None), (5, ""), (6, a), (6, a), (None, "c\nd\ne")]
    got = {(r["doc_id"], r["n_lines"]): (r["n_removed"], r["kept_text"]) for r in line_dedup.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 6): (3, "a\nb\nf"), (2, 5): (3, "x\ny"), (3, 2): (0, "a\nb"), (4, 0): (0, None), (5, 1): (0, ""), (6, 6): (6, ""), (None, 3): (0, "c\nd\ne")}
    assert line_dedup.line_dedup(spark, docs).count() == len(ROWS) and line_dedup.line_dedup(spark, none).count() == 0
    ones = line_dedup.line_dedup(spark, spark.createDataFrame([(1, "a\na\nb"), (2, "b")], "doc_id long, text string"), least=1)
    assert {r["doc_id"]: r["kept_text"] for r in ones.collect()} == {1: "a\nb", 2: ""}


def test_near_dedup(spark, docs, none):
    rows = near_dedup.near_classes(spark, docs).collect()
    classes = {}
    for r in rows:
        classes.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert len(rows) == len(ROWS) and all(len(c) == 1 for c in classes.values())
    assert classes == {1: {1}, 2: {2}, 3: {1}, 4: {4}, 5: {5}, None: {None}, 6: {6}, 7: {7}, 8: {7}}
    kept = near_dedup.near_dedup(spark, docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 2, 4, 5, 6, 7]
    assert near_dedup.near_classes(spark, none).count() == 0 and near_dedup.near_dedup(spark, none).count() == 0


def test_quality(spark, docs, none, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    net = quality.train(spark.read.parquet(f"{small}/documents.parquet"), labels)
    got = quality.scores(docs.drop("score"), net, "doc_id").collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.train(docs, labels.limit(0)) == 0.5
    assert quality.train(docs, spark.createDataFrame([(1, 1), (1, None), (None, 0), (99, 0)], "doc_id long, quality int")) in (0.5, 1.0)
    assert quality.scores(none, net, "doc_id").count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, " ".join(WORDS[12:40])), (2, None), (3, ""), (4, " ".join(WORDS[12:40])), (5, "Zebra crossing, a question of style and of grace in old towns; answer: seven lights")], "item_id long, text string")
    got = {(r["doc_id"], r["share"]): r["item"] for r in decontamination.leaks(spark, docs.drop("item", "share"), items, keep=("doc_id",)).collect()}
    assert {d for (d, _), item in got.items() if item == 1} == {1, 2, 3} and all(i is None for (d, _), i in got.items() if d not in (1, 2, 3))
    kept = decontamination.without_leaks(spark, docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 4, 5, 6, 7, 8]
    assert decontamination.without_leaks(spark, none, items).count() == 0
    assert decontamination.without_leaks(spark, docs, items.limit(0)).count() == len(ROWS)


def test_mixing(spark, docs, none):
    rows = mixing.with_copies(docs).select("row.doc_id", "row.text", "row.source", "mix.*").collect()
    assert len(rows) == len(ROWS) and all(r["size"] == len(as_words(r["text"])) for r in rows)
    total = sum(r["size"] for r in rows)
    targets = {r["source"]: r["target"] for r in rows}
    assert sum(targets.values()) == pytest.approx(min(1.5 * total, 2 * total)) and all(r["target"] <= 2 * r["source_size"] + 1e-6 for r in rows)
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(none).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 50}, {"a": 0, "b": 10}, {"a": 0}, {"a": 5, None: 7}, {chr(97 + i): 3**i % 97 for i in range(12)}])
def test_targets_by_rounds(spark, sizes):
    """Water-filling in one pass is what repeated resharing ends at."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    want, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
        free -= over
    got = mixing.targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")).collect()
    assert {r["source"]: pytest.approx(r["target"]) for r in got} == want


def test_token_output(spark, docs, none, tmp_path):
    path = token_output.default_tokenizer()
    out = token_output.token_output(spark, docs, path, str(tmp_path / "t")).orderBy("start").collect()
    tok = token_output._tokenizer(path)
    assert [r["doc_id"] for r in out] == [None, 1, 2, 2, 3, 3, 4, 5, 6, 7, 8]
    start = 0
    texts = {}
    for d, t, *_ in ROWS:
        texts.setdefault(d, []).append(t or "")
    for r in out:
        ids = [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts[r["doc_id"]]]
        crc = [zlib.crc32(np.array(i, "<u4").tobytes()) for i in ids]
        assert r["start"] == start and r["ids_crc32"] in crc and r["n_tokens"] == len(ids[crc.index(r["ids_crc32"])])
        start += r["n_tokens"]
    shard = spark.read.parquet(str(tmp_path / "t")).where("n_docs > 1").first().asDict()
    assert token_output.token_range(shard, shard["n_docs"] - 1)[-1] == 2
    assert token_output.token_output(spark, none, path, str(tmp_path / "n")).collect() == []


@pytest.mark.parametrize("text", ["", " ", "  a  b\n c", "<|endoftext|> x<|endoftext|>y", "a.b,c d's we'll", "é è\n\nÉ.", "　a  b", "1,000.5 x\t\r\ny ", "日本語 text", "a" * 5000 + " " * 50 + "\n" * 9])
def test_pieces_encode_like_texts(text):
    e = token_output.Encoder(token_output.default_tokenizer())
    ids, ends = e.ids(pa.array([text, None, text]))
    want = e.tokenizer.encode(text, add_special_tokens=False).ids + [2]
    assert ids.tolist() == want + [2] + want and ends.tolist() == [len(want), len(want) + 1, 2 * len(want) + 1]


@pytest.mark.parametrize("gap", [1, 2, 60, 10**6])
@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
def test_elias_fano(n, gap):
    v = np.cumsum(np.random.default_rng(n + gap).integers(0, gap, n))
    f = elias_fano.EliasFano(elias_fano.encode(v))
    assert f.all().tolist() == v.tolist() and [f[i] for i in range(0, n, 5)] == v[::5].tolist()
    with pytest.raises(IndexError):
        f.select(n)
    with pytest.raises(ValueError):
        elias_fano.encode(np.array([2, 1]))


def test_pseudonyms(spark, docs, none):
    text = 'Mail Jane.Doe7@mail.example.com, +1 (830) 555-5433, card 4111 1111 1111 1111, ip 10.0.0.255, token = "aebccd4559894937c75946a5f6a3ed5b13ef9ee9", born 1990-02-28, ssn 123-45-6789, iban DE89 3704 0044 0532 0130 00.'
    new, spans = pseudonyms.pseudonymise(text, b"k")
    assert [k for _, _, k in spans] == ["email", "phone", "card", "ipv4", "secret", "date", "ssn", "iban"] and len(new) - len(text) in range(-12, 13)
    for start, size, kind in spans:
        value = new[start : start + size]
        assert value not in text
        if kind in ("card",):
            assert pseudonyms.luhn(value.replace(" ", "")) == 0
        if kind == "iban":
            assert pseudonyms._mod97(value.replace(" ", "")) == 1
    assert pseudonyms.pseudonymise(text, b"k") == (new, spans) and pseudonyms.pseudonymise(text, b"other")[0] != new
    clean = "Version 2.0. of 1234567890123456 at 999.1.1.1 on 2024-02-30 costs 3.50; 000-12-3456"
    assert pseudonyms.pseudonymise(clean, b"k") == (clean, [])
    got = pseudonyms.with_pseudonyms(docs, b"k").collect()
    assert sorted((r["text"] or "") for r in got) == sorted((t or "") for _, t, *_ in ROWS) and pseudonyms.with_pseudonyms(none, b"k").count() == 0


@pytest.mark.parametrize("n", [2, 3, 10, 1000])
def test_feistel_permutes(n):
    f = pseudonyms.Feistel(b"k", n, b"t")
    assert sorted(map(f, range(n))) == list(range(n)) and all(f(i) != i for i in range(n))


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    rows = [(i, b.tolist(), i % 2) for i, b in enumerate(base)]
    rows += [(100 + i, (2 * b + 0.05 * rng.standard_normal(16)).tolist(), i % 2) for i, b in enumerate(base[:10])]
    rows += [(200, base[0].tolist(), 0), (201, base[0].tolist(), 1), (202, None, 0), (203, [0.0] * 16, 0), (204, [float("nan")] * 16, 0), (205, [None] * 16, 0), (206, base[0].tolist(), None), (207, [1.0] * 8, 0), (208, [1.0] * 8, 0), (209, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit(1)).withColumn("cell", F.lit(1))
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.embedding_dedup(spark, df).collect()}
    good = [(i, np.array(v, float), y) for i, v, y in rows if v and y is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    links = {i: {j for j, w, z in good if j != i and z == y and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93} for i, v, y in good}
    comp = {i: i for i, *_ in rows}
    for _ in rows:
        comp |= {i: min([comp[i], *(comp[j] for j in js)]) for i, js in links.items()}
    assert got == {i: (len(links.get(i, ())), comp[i], comp[i] == i) for i, *_ in rows}
    assert embedding_dedup.embedding_dedup(spark, df.limit(0)).collect() == []
    assert embedding_dedup.embedding_dedup(spark, df.where("label is null")).first()["kept"]


def test_embedding_blocks(spark, monkeypatch):
    """Cells dealt into blocks find the same links, each once."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal(12) + 0.1 * rng.standard_normal((90, 12)) for _ in range(3)])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((u @ u.T) >= 0.93).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.embedding_dedup(spark, df).collect()}
    assert sum(got.values()) >= 0.99 * want.sum() and all(got[i] <= want[i] for i in got)


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(2, "http://b", "<p>é</p>"), (1, None, "x\r\n\r\ny"), (3, "http://c", None), (None, "u", "h"), (2, "http://b", "<p>é</p>")], "page_id long, url string, html string").withColumn("hash", F.lit(1))
    warc_fixity.write_warc(pages, str(tmp_path / "w"), files=1)
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    whole = warc_fixity.records(pages)
    got = sorted(warc_fixity.audit(spark, whole, whole).collect(), key=lambda r: r["at"])
    assert [r["page_id"] for r in got] == [None, 1, 2, 2, 3] and not any(r["damaged"] for r in got)
    for r in got:
        assert hashlib.sha256(raw[r["start"] : r["stop"] - 4]).hexdigest() == r["hash"] and raw[r["stop"] - 4 : r["stop"]] == b"\r\n\r\n"
    assert warc_fixity.audit(spark, whole.limit(0), whole.limit(0)).count() == 0
    lost = warc_fixity.audit(spark, whole, whole.where("page_id is null or page_id <> 3"))
    assert [r["page_id"] for r in lost.where("damaged").collect()] == [3]


def test_warc_reads_only_bad_branches(spark):
    rows = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("r"), "id").alias("record"))
    bad = rows.withColumn("record", F.when(F.col("page_id").isin(7, 250), "BAD").otherwise(F.col("record")))
    bad = bad.withColumn("record", F.rpad("record", 4, "!"))
    good = rows.withColumn("record", F.rpad("record", 4, "!"))
    assert sorted(r["page_id"] for r in warc_fixity.audit(spark, good, bad).where("damaged").collect()) == [7, 250]


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (7, 7), (None, 1)] + [(100 + i, 101 + i) for i in range(60)]
    got = {r["id"]: r["component"] for r in connected_components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {100 + i: 100 for i in range(61)}


def test_words():
    texts = ["", " a  b\tc ", "é x", None, "\n\n", "z"]
    w = Words.of(pa.array(texts))
    found = [[bytes(w.buf[s:e]) for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] for a, b in zip(w.ptr[:-1], w.ptr[1:], strict=True)]
    assert found == [as_words(t) for t in texts]
    h = np.random.default_rng(0).integers(0, 1 << 62, 150_000).astype(np.uint64)
    assert gram_hashes(h, 20)[70_000] == gram_hashes(h[70_000:70_020], 20)[0] and not gram_hashes(h[:3], 20).any()
    assert sliding_min(h[:100], 13).tolist() == [h[i : i + 13].min() for i in range(88)]
    assert fresh("a", ["A", "a_"]) == "a__"
