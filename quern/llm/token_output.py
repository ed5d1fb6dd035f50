"""Token-ID output: shards of concatenated ids with Elias-Fano document boundaries.

Documents are range-partitioned and sorted by doc_id, so shards hold ascending,
disjoint ranges of ids.  A shard is one row of a Parquet table (any store that
Spark writes to will do):

    part, seq   partition number and place in it: (part, seq) is the corpus order
    before      ids in earlier shards of the partition
    n_docs, n_ids
    width       bytes of an id: 2 if the vocabulary fits, else 4
    ids         all ids in a row, little-endian
    bounds      Elias-Fano code of the cumulative ends of its documents (see elias_fano)
    doc_ids     Elias-Fano code of doc_id minus the shard's least doc_id
    least       the shard's least doc_id
    nulls       documents whose doc_id is null (they come first in the shard)

The corpus position of a shard is ``before`` plus the ids of earlier partitions: one
row per partition is summed and broadcast, which the number of partitions bounds.

Documents are read back in runs of ``elias_fano.EVERY``, each found by a select sample of
its shard's boundaries; no table of offsets is made.

Text is cut where the pre-tokeniser of byte-level BPE splits in any case (see ``_pieces``),
so pieces encode on their own and each distinct piece of a block is encoded once. Tokenizers
that do more than that (``_splits``) encode whole texts.

Edge cases.  A null or empty text has the end id alone.  Rows with equal doc_id
follow one another in order of their text's hash; each is a document of its own.  A
null doc_id comes first.  Extra columns are ignored; an empty table writes no shard
and returns no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import Scratch, flat, text_blocks
from quern.llm.elias_fano import EVERY, EliasFano, encode

END_ID = 2
#: Text bytes of a shard at most, but for a longer single text.
SHARD_BYTES = 8 << 20

_SHARD_DDL = "part int, seq int, before long, n_docs long, n_ids long, width int, ids binary, bounds binary, doc_ids binary, least long, nulls long"
_SHARD = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("bounds", pa.binary()), ("doc_ids", pa.binary()), ("least", pa.int64()), ("nulls", pa.int64())]
)

_NEXT = np.zeros(256, bool)  # first bytes of characters that are no white space
_NEXT[0x21:0x7F] = True
_NEXT[0xC3:0xE0] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_POINT = np.zeros(256, bool)  # splits off a letter; apostrophes may not, and <|> are in special tokens
_POINT[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = True
_ODD = np.zeros(256, bool)  # white space, first bytes of wider white space, and a special token's
_ODD[:0x20] = _ODD[[0x3C, 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _splits(path: str) -> bool:
    """Whether the tokenizer is byte-level BPE that splits texts as ``_pieces`` relies on, and does nothing else to them."""
    import json

    made = json.loads(_tokenizer(path).to_str())
    pre, model = made.get("pre_tokenizer") or {}, made.get("model") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    added = all(t["content"].startswith("<|") and t["content"].endswith("|>") for t in made.get("added_tokens", []))
    return bool(plain and added and made.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout"))


def _pieces(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of pieces: in front of a space that a character follows, between a letter and
    punctuation, and around a line end between characters. BPE splits there in any case."""
    n = len(data)
    cut = np.zeros(n + 3, bool)
    if n > 2:
        latin = np.zeros(n, bool)  # last byte of a two-byte Latin letter
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut[: n - 1] = (data[:-1] == 32) & _NEXT[data[1:]]
        cut[1:n] |= _POINT[data[1:]] & (_LETTER[data[:-1]] | latin[:-1])
        line = np.flatnonzero((data[1:-1] == 10) & _NEXT[data[2:]] & ((data[:-2] < 0x7F) & _NEXT[data[:-2]] | latin[:-2])) + 1
        cut[line] = cut[line + 1] = True
    cut[off] = True
    return np.flatnonzero(cut[:n])


class Encoder:
    """Encodes blocks of texts: each distinct piece of a block once, many pieces a call."""

    #: Pieces of one call, and the token that a line end between two of them is.
    CALL = 4096

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.splits = _splits(path)

    def _encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces in a row, and how many each has."""
        data, off = flat(pieces)
        last = data[off[1:] - 1]
        odd = np.add.reduceat(_ODD[data].astype(np.int64), off[:-1]) > 0
        first = data[off[:-1]] == 32
        odd |= (last == 32) | (np.add.reduceat((data == 32).astype(np.int64), off[:-1]) > first) | (self.line is None)
        n, parts, where = np.zeros(len(pieces), np.int64), [], []
        plain = np.flatnonzero(~odd)
        if len(plain):
            some = pieces.take(pa.array(plain))
            data, off = flat(some)
            joined = np.insert(data, off[1:], 10).tobytes()  # a line end after each piece
            edge = (off + np.arange(len(off))).tolist()
            texts = [joined[edge[i] : edge[min(i + self.CALL, len(plain))]].decode() for i in range(0, len(plain), self.CALL)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            end = np.flatnonzero(ids == self.line)
            if len(end) != len(plain):
                raise ValueError("the tokenizer does not split at line ends")
            n[plain] = np.diff(end, prepend=-1) - 1
            parts.append(ids[ids != self.line])
            where.append(plain)
        rest = np.flatnonzero(odd)
        if len(rest):
            each = [e.ids for e in self.tokenizer.encode_batch([x.decode() for x in pieces.take(pa.array(rest)).to_pylist()], add_special_tokens=False)]
            n[rest] = [len(e) for e in each]
            parts.append(np.array([i for e in each for i in e], np.uint32))
            where.append(rest)
        start = np.zeros(len(pieces), np.int64)
        order = np.concatenate(where)
        start[order] = np.concatenate(([0], np.cumsum(n[order])))[:-1]
        return np.concatenate(parts), np.stack([start, n])

    def ids(self, texts: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the end of each text in it."""
        data, off = flat(texts)
        if not self.splits:
            each = [e.ids for e in self.tokenizer.encode_batch([bytes(data[a:b]).decode() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], add_special_tokens=False)]
            out, stop = np.array([i for e in each for i in e], np.uint32), np.cumsum([len(e) for e in each], dtype=np.int64)
            return self._ended(out, stop, end_id)
        begin = _pieces(data, off)
        if len(begin):
            edge = pa.py_buffer(np.append(begin, len(data)).astype(np.int64))
            coded = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, edge, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
            known, (start, n) = self._encode(coded.dictionary)
            which = coded.indices.to_numpy()
            ends = np.concatenate(([0], np.cumsum(n[which])))
            out = np.empty(int(ends[-1]), np.uint32)
            for i in range(0, len(which), 1 << 16):  # bounded tables of places
                w = which[i : i + (1 << 16)]
                a, b = int(ends[i]), int(ends[i + len(w)])
                out[a:b] = known[np.repeat(start[w] - ends[i : i + len(w)], n[w]) + np.arange(a, b)]
        else:
            ends, out = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        return self._ended(out, ends[np.searchsorted(begin, off[1:])], end_id)

    @staticmethod
    def _ended(out: np.ndarray, stop: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        if end_id is not None:
            out = np.insert(out, stop, end_id)
            stop = stop + np.arange(1, len(stop) + 1)
        return out, stop


def _shards(path: str, end_id: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = Encoder(path), TaskContext.get().partitionId()
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        before = 0
        for seq, t in enumerate(text_blocks(batches, limit=limit)):
            ids, ends = encoder.ids(t["text"], end_id)
            doc_id = t["doc_id"].combine_chunks()
            nulls = doc_id.null_count
            real = doc_id.slice(nulls).to_numpy()
            least = int(real[0]) if len(real) else 0
            row = [part, seq, before, t.num_rows, len(ids), width, ids.astype(f"<u{width}").tobytes(), encode(ends), encode(real - least), least, nulls]
            before += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SHARD, strict=True)], schema=_SHARD)

    return run


def write_shards(spark: SparkSession, docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> None:
    """Tokenise docs (doc_id, text) and write the shard table to ``path``."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    key = F.col("doc_id").asc_nulls_first()
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, key, F.xxhash64("text")).sortWithinPartitions(key, F.xxhash64("text"))
    ordered.mapInArrow(_shards(tokenizer_path, end_id, shard_bytes), _SHARD_DDL).write.mode("overwrite").option("compression", "zstd").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            wide = memoryview(np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4").tobytes())
            bounds, known, nulls = EliasFano(r["bounds"]), EliasFano(r["doc_ids"]), r["nulls"]
            doc_ids, before = [None] * nulls, 0
            for k in range(-(-len(known) // EVERY)):
                doc_ids += (known.block(k) + r["least"]).tolist()
            for k in range(-(-len(bounds) // EVERY)):
                ends = bounds.block(k)
                begin = np.concatenate(([before], ends[:-1]))
                crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                own = doc_ids[k * EVERY : k * EVERY + len(ends)]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(own, pa.int64()), "start": pa.array(begin + r["base"]), "n_tokens": pa.array(ends - begin), "ids_crc32": pa.array(crc, pa.int64())}
                )
                before = int(ends[-1])


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.schema(_SHARD_DDL).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    place = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_base"))
    return shards.join(F.broadcast(place), "part").select(
        "width", "ids", "bounds", "doc_ids", "least", "nulls", (F.col("part_base") + F.col("before")).alias("base")
    ).mapInArrow(
        _read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_range(shard: dict, i: int) -> np.ndarray:
    """Ids of the i-th document of one shard row, by two selects on its boundaries."""
    bounds = EliasFano(shard["bounds"])
    begin = bounds[i - 1] if i else 0
    return np.frombuffer(shard["ids"], f"<u{shard['width']}")[begin : bounds[i]]


def token_output(spark: SparkSession, docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    path = path or f"{Scratch(spark).base}/tokens"
    write_shards(spark, docs, tokenizer_path, path, end_id)
    return read_shards(spark, path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
