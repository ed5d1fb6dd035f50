"""Substring dedup by super-k-mer partitioning.

A window is ``window`` consecutive words of one document.  A word goes when a
window that covers it also starts earlier: in a smaller doc_id, or earlier in the
same document.

1. Each block of documents finds its own repeated windows; only the first
   occurrence of a window in a block travels on, so a passage that a third of all
   documents share sends one copy a block, not one a document.
2. The surviving windows are cut into super-k-mers: consecutive windows with the
   same minimiser travel as one packed string to the bucket that the minimiser names.
   The minimiser is the least hash of a window's ``gram``-word pieces, but pieces so
   frequent that they alone could fill a bucket rank behind all others (``_frequent``).
   Equal windows have equal minimisers, so all copies of a window meet in one bucket.
3. A bucket sorts its windows by hash, compares the words of equal hashes byte by
   byte, keeps the first occurrence and reports the others.  Strings come in
   bounded blocks; between blocks only first occurrences are held.
4. Reported word ranges join their documents, which drop those words.

Edge cases.  Null and empty texts have no words: n_words 0, n_removed 0 and the
digest of the empty string.  Texts shorter than a window lose nothing.  Rows with
equal doc_id are ordered by a 128-bit hash of their text; rows equal in both are one
document and each gets its result.  A null doc_id orders before all others.
Extra input columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Scratch, Words, gram_hashes, input_bytes, sliding_min, text_blocks

#: Words of a window; words of a minimiser's piece; most windows of a packed string.
WINDOW, GRAM, MOST = 20, 4, 64
#: Input bytes (as stored) for a bucket, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 1 << 20, 256
#: Text bytes of a block that drops its own repeats.
CUT_BYTES = 4 << 20
#: A piece is frequent from 1 / SPREAD of a task's even share of all pieces on: a minimiser
#: names at most window - gram + 1 windows a piece, so it fills a fraction of a task.
SPREAD = 64
#: Pieces that are counted together; what a driver gets is at most 2 * SPREAD a shuffle partition.
FLUSH = 4 << 20
_NO_ID = -(1 << 63)

_ROUTED = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("tie2", pa.int64()), ("spans", pa.binary()), ("packed", pa.binary())])
_ROUTED_DDL = "bucket long, doc_id long, tie long, tie2 long, spans binary, packed binary"
_SPANS = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("tie2", pa.int64()), ("spans", pa.binary())])


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it, in any of the columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


class _Frequent:
    """A set of frequent pieces that ranks them behind the others."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def ranked(self, g: np.ndarray) -> np.ndarray:
        out = g >> np.uint64(1)
        at = np.flatnonzero(self.maybe[(g >> np.uint64(48)).astype(np.int64)])
        if len(at):
            k = np.minimum(np.searchsorted(self.hashes, g[at]), len(self.hashes) - 1)
            out[at[self.hashes[k] == g[at]]] |= np.uint64(1 << 63)
        return out


def _counted(gram: int, share: float):
    """Pieces with half the share of a flush; row null of each flush is its number of pieces."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        every = np.sort(np.concatenate(held))
        cut = np.flatnonzero(_runs(every))
        n = np.diff(np.append(cut, len(every)))
        some = n >= max(2.0, share / 2 * len(every))
        return pa.RecordBatch.from_pydict(
            {"piece": pa.array([None, *every[cut[some]].view(np.int64).tolist()], pa.int64()), "n": pa.array([len(every), *n[some].tolist()], pa.int64())}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for t in text_blocks(batches):
            w = Words.of(t["text"])
            held.append(w.grams(w.hashes(), gram)[1])
            size += len(held[-1])
            if size >= FLUSH:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    return run


def _frequent(docs: DataFrame, gram: int, tasks: int) -> _Frequent:
    """Pieces with 1 / (SPREAD * tasks) of all pieces: at most 2 * SPREAD * tasks of them reach the driver.

    They decide where windows meet, never which of them repeat.
    """
    share = 1 / (SPREAD * tasks)
    found = docs.select("text").mapInArrow(_counted(gram, share), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    total = F.first(F.when(F.col("piece").isNull(), F.col("n")), ignorenulls=True)
    found = Scratch(docs.sparkSession).save(found, "pieces")
    pieces = found.agg(total.alias("n")).first()["n"] or 0
    rows = found.where(F.col("piece").isNotNull() & (F.col("n") >= share / 2 * pieces)).select("piece").collect() if pieces else []
    return _Frequent(np.array([r[0] for r in rows], np.int64).view(np.uint64))


class _Pieces:
    """Texts (documents or packed strings) in ascending order of (doc_id, tie, first). tie: two columns."""

    def __init__(self, doc: np.ndarray, tie: np.ndarray, first: np.ndarray, words: Words, window: int):
        self.doc, self.tie, self.first, self.words, self.window = doc, tie, first, words, window

    def repeats(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Window starts, whether each repeats an earlier window, whether it is the very same one, word hashes."""
        w, k = self.words, self.window
        h = w.hashes()
        at, grams = w.grams(h, k)
        if len(at) == 0:
            return at, np.zeros(0, bool), np.zeros(0, bool), h
        order = np.argsort(grams)
        ordered = grams[order]
        cut = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        head = np.empty(len(at), np.int64)
        head[order] = np.repeat(np.minimum.reduceat(order, cut), np.diff(np.append(cut, len(order))))
        later = np.flatnonzero(head != np.arange(len(at)))
        if len(later):
            self._settle(at, head, later, grams)
        repeated = head != np.arange(len(at))
        same = np.zeros(len(at), bool)
        later = np.flatnonzero(repeated)
        if len(later):
            piece = np.searchsorted(w.ptr, at, side="right") - 1
            a, b = piece[later], piece[head[later]]
            pos = self.first[piece] + at - w.ptr[piece]
            same[later] = (self.doc[a] == self.doc[b]) & (self.tie[a] == self.tie[b]).all(1) & (pos[later] == pos[head[later]])
        return at, repeated, same, h

    def _settle(self, at: np.ndarray, head: np.ndarray, later: np.ndarray, grams: np.ndarray) -> None:
        """Compare words of equal hashes; on a collision, settle that hash by the words themselves."""
        w, k = self.words, self.window
        buf = w.buf.tobytes()
        a, b = at[later], at[head[later]]
        new = np.concatenate(([True], (np.diff(a) != 1) | (np.diff(b) != 1)))
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(a)) - 1
        bad = set()
        for s, e, t, f, i in zip(w.start[a[lo]].tolist(), w.end[a[hi] + k - 1].tolist(), w.start[b[lo]].tolist(), w.end[b[hi] + k - 1].tolist(), lo.tolist(), strict=True):
            if buf[s:e] != buf[t:f]:
                bad.add(i)
        if bad:
            for i, j in zip(lo.tolist(), hi.tolist(), strict=True):
                if i in bad:
                    for g in np.unique(grams[later[i : j + 1]]):
                        seen: dict[bytes, int] = {}
                        for x in np.flatnonzero(grams == g).tolist():
                            head[x] = seen.setdefault(buf[w.start[at[x]] : w.end[at[x] + k - 1]], x)

    def spans(self, at: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
        """Of windows that repeat: per piece, the covered word ranges in document positions."""
        if len(at) == 0:
            return
        w = self.words
        piece = np.searchsorted(w.ptr, at, side="right") - 1
        pos = self.first[piece] + at - w.ptr[piece]
        new = np.concatenate(([True], (np.diff(pos) > self.window) | (np.diff(piece) != 0) | (np.diff(pos) < 0)))
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(at)) - 1
        pairs = np.stack([pos[lo], pos[hi] + self.window], 1).astype("<i4")
        owner = piece[lo]
        cut = np.flatnonzero(np.concatenate(([True], np.diff(owner) != 0)))
        for i, j in zip(cut.tolist(), np.append(cut[1:], len(owner)).tolist(), strict=True):
            yield int(self.doc[owner[i]]), *self.tie[owner[i]].tolist(), pairs[i:j].tobytes()

    def strings(self, at: np.ndarray, h: np.ndarray, gram: int, frequent: _Frequent) -> tuple[np.ndarray, ...]:
        """Super-k-mers of the windows at ``at``: minimiser, piece, first word (block), windows."""
        g = frequent.ranked(gram_hashes(h, gram)[: max(0, len(h) - gram + 1)])
        least = sliding_min(g, self.window - gram + 1)[at]
        piece = np.searchsorted(self.words.ptr, at, side="right") - 1
        new = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(piece) != 0) | (least[1:] != least[:-1])))
        run = np.flatnonzero(new)
        inside = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        lo = np.flatnonzero(inside % MOST == 0)
        return least[lo], piece[lo], at[lo], np.diff(np.append(lo, len(at)))


def _pack(p: _Pieces, piece: np.ndarray, at: np.ndarray, n: np.ndarray, buf: bytes) -> bytes:
    """One bucket's strings: count, doc ids, ties, first positions, then the words, a line a string."""
    w = p.words
    s, e = w.start[at].tolist(), w.end[at + n + p.window - 2].tolist()
    doc = np.diff(p.doc[piece], prepend=0)  # pieces ascend, so steps are small and compress well
    head = np.array([len(at)], "<i8").tobytes() + doc.astype("<i8").tobytes() + (p.first[piece] + at - w.ptr[piece]).astype("<i8").tobytes() + p.tie[piece].astype("<i8").tobytes()
    return head + b"\n".join([buf[i:j] for i, j in zip(s, e, strict=True)])


def _unpack(blobs: list[bytes], window: int) -> _Pieces:
    doc, tie, first, texts = [], [], [], []
    for blob in blobs:
        n = int(np.frombuffer(blob, "<i8", 1)[0])
        head = np.frombuffer(blob, "<i8", 2 * n, 8).reshape(2, n)
        doc.append(np.cumsum(head[0]))
        first.append(head[1])
        tie.append(np.frombuffer(blob, "<i8", 2 * n, 8 + 16 * n).reshape(n, 2))
        texts += blob[8 + 32 * n :].split(b"\n")
    doc, tie, first = np.concatenate(doc), np.concatenate(tie), np.concatenate(first)
    order = np.lexsort((first, tie[:, 1], tie[:, 0], doc))
    return _Pieces(doc[order], tie[order], first[order], Words.of(pa.array([texts[i] for i in order.tolist()], pa.large_binary())), window)


def _rows(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)


def _cut(window: int, gram: int, buckets: int, frequent: _Frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for t in text_blocks(batches, limit=CUT_BYTES):
            doc, tie = t["doc_id"].to_numpy(), np.stack([t["tie"].to_numpy(), t["tie2"].to_numpy()], 1)
            order = np.lexsort((tie[:, 1], tie[:, 0], doc))
            order = order[_runs(doc[order], tie[order, 0], tie[order, 1])]
            p = _Pieces(doc[order], tie[order], np.zeros(len(order), np.int64), Words.of(t["text"].combine_chunks().take(pa.array(order))), window)
            at, repeated, _, h = p.repeats()
            if len(at) == 0:
                continue
            out = [(d % buckets, d, y, z, s, None) for d, y, z, s in p.spans(at[repeated])]
            if out:
                yield _rows(out, _ROUTED)
            least, piece, begin, n = p.strings(at[~repeated], h, gram, frequent)
            bucket = (least % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0)))
            buf, out = p.words.buf.tobytes(), []
            for lo, hi in zip(cut.tolist(), np.append(cut[1:], len(order)).tolist(), strict=True):
                x = order[lo:hi]
                out.append((int(bucket[x[0]]), None, None, None, None, press.compress(_pack(p, piece[x], begin[x], n[x], buf))))
            yield _rows(out, _ROUTED)

    return run


def _fold(window: int, limit: int):
    """Rows come sorted by bucket."""

    def settle(blobs: list[bytes], keep: bool) -> tuple[list[tuple], list[bytes]]:
        p = _unpack(blobs, window)
        at, repeated, same, h = p.repeats()
        found = list(p.spans(at[repeated & ~same]))
        if not keep or not len(at):
            return found, []
        left = at[~repeated]
        new = np.concatenate(([True], (np.diff(left) != 1) | (np.diff(np.searchsorted(p.words.ptr, left, side="right")) != 0)))
        lo = np.flatnonzero(new)
        piece = np.searchsorted(p.words.ptr, left[lo], side="right") - 1
        return found, [_pack(p, piece, left[lo], np.diff(np.append(lo, len(left))), p.words.buf.tobytes())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        bucket, blobs, size, out = None, [], 0, []
        for batch in batches:
            packed = batch.column("packed")
            local = batch.filter(packed.is_null())
            if local.num_rows:
                yield pa.RecordBatch.from_arrays([local.column(c) for c in _SPANS.names], schema=_SPANS)
            batch = batch.filter(packed.is_valid())
            for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if b != bucket and blobs:
                    out += settle(blobs, False)[0]
                    blobs, size = [], 0
                bucket = b
                blobs.append(press.decompress(blob))
                size += len(blobs[-1])
                if size > limit:
                    found, blobs = settle(blobs, True)
                    out += found
                    size = min(limit // 2, sum(map(len, blobs)))  # what is held must halve what is to come, not stall it
                if len(out) > 10_000:
                    yield _rows(out, _SPANS)
                    out = []
        if blobs:
            out += settle(blobs, False)[0]
        if out:
            yield _rows(out, _SPANS)

    return run


def _rebuild(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_blocks(batches):
            w = Words.of(t["text"])
            buf, size = w.buf.tobytes(), np.diff(w.ptr)
            gone = np.zeros(len(w) + 1, np.int64)
            for d, spans in enumerate(t["spans"].to_pylist()):
                if spans:
                    x = np.frombuffer(b"".join(spans), "<i4").reshape(-1, 2) + w.ptr[d]
                    np.add.at(gone, x[:, 0], 1)
                    np.add.at(gone, x[:, 1], -1)
            gone = np.cumsum(gone)[:-1] > 0
            edge = np.diff(np.concatenate(([0], ~gone, [0])).astype(np.int8))
            kept, digest = [], []
            n_removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[w.ptr])
            for d in range(t.num_rows):
                a, b = int(w.ptr[d]), int(w.ptr[d + 1])
                if n_removed[d] == 0:
                    text = buf[w.start[a] : w.end[b - 1]] if b > a else b""
                else:
                    inside = edge[a : b + 1].copy()
                    inside[0] = not gone[a]
                    inside[-1] = -int(not gone[b - 1])
                    lo, hi = np.flatnonzero(inside == 1) + a, np.flatnonzero(inside == -1) + a
                    text = b" ".join([buf[i:j] for i, j in zip(w.start[lo].tolist(), w.end[hi - 1].tolist(), strict=True)])
                digest.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode() if with_text else None)
            cols = [t["doc_id"].combine_chunks(), pa.array(size.astype(np.int64)), pa.array(n_removed.astype(np.int64)), pa.array(digest)]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols, names = [*cols, pa.array(kept, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def substring_dedup(spark: SparkSession, docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False, fold_bytes: int = 8 << 20) -> DataFrame:
    """Per document: n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    ``docs`` needs doc_id and text.  ``gram`` must not exceed ``window``.
    """
    scratch = Scratch(spark)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    repeat = not docs.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    # where no two rows have one doc_id, the text need not tell them apart
    ties = (F.xxhash64("text"), F.xxhash64(F.lit("tie"), "text")) if repeat else (F.lit(0).cast("long"), F.lit(0).cast("long"))
    ties = [t.alias(n) for t, n in zip(ties, ("tie", "tie2"), strict=True)]
    keyed = docs.select(key.alias("doc_id"), *ties, "text")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    buckets = n * -(-max(LEAST_BUCKETS, input_bytes(docs) // BUCKET_BYTES) // n)  # as many for each task
    gram = min(gram, window)
    routed = keyed.mapInArrow(_cut(window, gram, buckets, _frequent(docs, gram, n)), _ROUTED_DDL)
    spans = (
        routed.repartitionById(n, (F.col("bucket") % n).cast("int")).sortWithinPartitions("bucket").mapInArrow(_fold(window, fold_bytes), "doc_id long, tie long, tie2 long, spans binary")
        .groupBy("doc_id", "tie", "tie2").agg(F.collect_list("spans").alias("spans"))
    )
    spans = scratch.save(spans, "spans")  # frees the packed strings before the texts move
    joined = docs.select("doc_id", key.alias("key"), *ties, "text").join(spans.withColumnRenamed("doc_id", "key").hint("merge"), ["key", "tie", "tie2"], "left")
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans").mapInArrow(_rebuild(with_text), ddl)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS win
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 19)) AS i FROM w WHERE len(words) >= 20)
), dup AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM win
  ) WHERE nth > 1
), word AS (
  SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS i FROM w
), marked AS (
  SELECT word.doc_id, word.i, word.word,
    max(CASE WHEN dup.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY word.doc_id ORDER BY word.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM word LEFT JOIN dup ON word.doc_id = dup.doc_id AND word.i = dup.i
), kept AS (
  SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed,
    coalesce(string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY i), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(k.n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
