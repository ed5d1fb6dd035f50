"""Tokenizers of another kind, blocks of boundaries by select, many rows of one id."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import elias_fano, token_output


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    e = token_output.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not e.splits and token_output.Encoder(token_output.default_tokenizer()).splits
    texts = ["Don't SPLIT  me, 123.\nNew line", None, "", "é x"]
    ids, ends = e.ids(pa.array(texts))
    want = [e.tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert ids.tolist() == sum(want, []) and np.diff(ends, prepend=0).tolist() == [len(w) for w in want]


@pytest.mark.parametrize("gap", [1, 2, 60, 10**6])
@pytest.mark.parametrize("n", [1, 255, 256, 257, 3000])
def test_blocks_by_select(n, gap):
    v = np.cumsum(np.random.default_rng(n + gap).integers(0, gap, n))
    f = elias_fano.EliasFano(elias_fano.encode(v))
    blocks = [f.block(k).tolist() for k in range(-(-n // elias_fano.EVERY))]
    assert sum(blocks, []) == v.tolist()
    with pytest.raises(IndexError):
        f.block(len(blocks))


def test_many_rows_of_one_id(spark):
    """Rows without doc_id are dealt by their text; starts follow one another without a gap."""
    rows = [(None, f"text {i}") for i in range(2000)] + [(i // 3, f"more {i}") for i in range(900)] + [(-5, None)]
    got = sorted(token_output.token_output(spark, spark.createDataFrame(rows, "doc_id long, text string"), token_output.default_tokenizer()).collect(), key=lambda r: r["start"])
    tok = token_output._tokenizer(token_output.default_tokenizer())
    start, ids = 0, [(r[0] is not None, r[0] or 0) for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got] == ids
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    want = sorted((d or 0, zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for d, t in rows)
    assert sorted((r["doc_id"] or 0, r["ids_crc32"]) for r in got) == want
