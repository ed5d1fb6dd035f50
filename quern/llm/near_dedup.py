"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles.

Weights.  A shingle is five consecutive words (all words of a shorter text) and
weighs (1 + ln tf) * (2 - ln df / ln N), where df of the N documents that have words hold
it: 2 for a shingle of one document, 1 for one of all. Every shingle's documents are counted.

0. Rows are written down with a number each, the digest of their text, and the block (about
   ``BLOCK_BYTES`` of text) that they are counted in. Rows are what classes consist of; a
   doc_id may be null or repeat.
1. Counting. A block sends its distinct shingle hashes with their documents, sorted and packed,
   to buckets by range of hash; so a shingle comes once a block, however many hold it. Buckets
   add up and send the shingles of two documents or more back to the blocks that have them.
2. Sketching. Blocks meet their counts and take ``ROWS * BANDS`` consistent weighted samples a
   text. The gamma and uniform variates of a (shingle, sample) pair come from a fixed table
   through a hash of the pair, so equal pairs draw equally everywhere.
3. Candidates. Equal bands meet in buckets, which compare all sketches and return a
   forest of promising pairs (an estimate that a pair at the threshold falls below with
   probability 1.3e-4), never the pairs.
4. Verification. Weighted shingles of a cluster of promising texts meet; pairs that links found
   so far do not connect yet are verified by exact weighted Jaccard similarity, and a
   forest of links returns. Large buckets and clusters are dealt in blocks (``_links``).
5. Classes are the connected components of the links between distinct texts.

With 16 bands of 4 rows a pair at 0.8 misses all bands with probability 2e-4.

Edge cases.  Equal texts, the empty one too, are one class; rows without text are alone;
texts without words have no other links. Rows with equal doc_id are documents of their own.
A class is named by its least doc_id, null where no row of it has one; its first row by
(doc_id, nulls last; digest; number) is kept. Extra columns are ignored by ``near_classes`` and
kept by ``near_dedup``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Scratch, Words, every, fresh, gram_hashes, input_bytes, mix, small_batches, text_blocks
from quern.llm.graph import connected_components

SHINGLE, THRESHOLD = 5, 0.8
ROWS, BANDS = 4, 16
SAMPLES = ROWS * BANDS
#: Least equal samples of a promising pair; documents of a block of candidates.
PROMISING, BLOCK = 39, 512
#: Blocks up to which all pairs of blocks of a key meet at once.
WIDE = 16
#: Text bytes of a block that shingles are counted by; stored bytes of the rows for a bucket.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
_TABLE = 1 << 16


class Shingles:
    """Distinct shingles of each text of a block: hash and tf, text d has ptr[d]:ptr[d+1], in order of hash."""

    def __init__(self, texts: pa.Array, n: int = SHINGLE):
        w = Words.of(texts)
        h = w.hashes()
        grams, ptr = gram_hashes(h, n), w.ptr.tolist()
        hashes, counts, size = [], [], [0]
        for a, b in zip(ptr[:-1], ptr[1:], strict=True):
            if b - a >= n:
                own = np.sort(grams[a : b - n + 1])
                cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                hashes.append(own[cut])
                counts.append(np.diff(np.append(cut, len(own))))
            elif b > a:
                hashes.append(mix(gram_hashes(h[a:b], b - a)[:1] + np.uint64(b - a)))
                counts.append(np.ones(1, np.int64))
            size.append(len(hashes[-1]) if b > a else 0)
        self.ptr = np.cumsum(size)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.tf = np.concatenate(counts) if counts else np.zeros(0, np.int64)

    def weights(self, counts: Counts, docs: int) -> np.ndarray:
        return (1 + np.log(self.tf)) * (2 - np.log(counts.of(self.hash)) / np.log(max(docs, 2)))


def pack(hashes: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending hashes and a count of each, as planes of the bytes of their steps."""
    planes = [np.diff(hashes, prepend=np.uint64(0)), n.astype(np.uint64) - np.uint64(1)]
    return zstandard.compress(b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes() for x in planes), 1)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    planes = [np.ascontiguousarray(x.reshape(8, -1).T).view(np.uint64)[:, 0] for x in (raw[: len(raw) // 2], raw[len(raw) // 2 :])]
    return np.cumsum(planes[0], dtype=np.uint64), planes[1].astype(np.int64) + 1


class Counts:
    """Documents of shingles; those that are not listed have one."""

    def __init__(self, blobs: list[bytes]):
        parts = [unpack(b) for b in blobs]
        hashes = np.concatenate([h for h, _ in parts]) if parts else np.zeros(0, np.uint64)
        order = np.argsort(hashes)  # a block that two tasks read may list a shingle twice, alike
        self.hashes = hashes[order]
        self.n = np.concatenate([n for _, n in parts])[order] if parts else np.zeros(0, np.int64)

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.ones(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.n[at], 1)


def _placed(limit: int, names: list[str]):
    """Adds number, block and whether there are words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, rows, size = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            text = batch.column("text")
            ends = size + np.cumsum(pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            begins = np.concatenate(([size], ends[:-1]))[: batch.num_rows]
            wordy = pc.match_substring_regex(text, "[^ \\t-\\r]").fill_null(False)
            new = [pa.array((part << 33) + rows + np.arange(batch.num_rows)), pa.array((part << 31) + begins // limit), wordy]
            rows, size = rows + batch.num_rows, int(ends[-1]) if batch.num_rows else size
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return run


def _numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """docs written with a number a row, and of it: row, block, wordy, doc_id, digest, text."""
    small_batches(docs.sparkSession)
    names = [fresh(n, docs.columns) for n in ("digest", "row", "block", "wordy")]
    known = docs.withColumn(names[0], F.md5(F.col("text")))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema.fields)
    saved = scratch.save(known.mapInArrow(_placed(BLOCK_BYTES, names[1:]), f"{ddl}, `{names[1]}` long, `{names[2]}` long, `{names[3]}` boolean"), "rows")
    digest, row, block, wordy = (F.col(f"`{n}`") for n in names)
    return saved, saved.select(row.alias("row"), block.alias("block"), wordy.alias("wordy"), F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), F.col("text"))


_BLOBS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("packed", pa.binary())])


def _hashes(buckets: int):
    """Distinct hashes of each block with their documents, by range of hash."""

    def packed(block: int, held: list[np.ndarray]) -> pa.RecordBatch:
        h = np.sort(np.concatenate(held))
        cut = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
        n, h = np.diff(np.append(cut, len(h))), h[cut]
        bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        lo = np.flatnonzero(np.diff(bucket, prepend=-1))
        hi = np.append(lo[1:], len(h))
        blobs = [pack(h[a:b], n[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[lo]), pa.array(np.full(len(lo), block)), pa.array(blobs, pa.binary())], schema=_BLOBS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for t in text_blocks(batches):
            s, of = Shingles(t["text"]), t["block"].to_numpy()
            cut = np.flatnonzero(np.diff(of, prepend=-1))
            for a, b in zip(cut.tolist(), np.append(cut[1:], len(of)).tolist(), strict=True):
                if held and of[a] != block:
                    yield packed(block, held)
                    held = []
                block = int(of[a])
                held.append(s.hash[s.ptr[a] : s.ptr[b]])
        if held:
            yield packed(block, held)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: what each block must know of it, the hashes of two documents or more."""
    def settle(blocks: list[int], blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(b) for b in blobs]
        h, n = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        order = np.argsort(h)
        ordered = h[order]
        cut = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), ordered[1:] != ordered[:-1])))
        total = np.empty(len(h), np.int64)
        total[order] = np.repeat(np.add.reduceat(n[order], cut), np.diff(np.append(cut, len(h)))) if len(h) else 0
        at, out = 0, []
        for block, (x, _) in zip(blocks, parts, strict=True):
            own = total[at : at + len(x)]
            some = own > 1
            if some.any():
                out.append((block, pack(x[some], own[some])))
            at += len(x)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["block", "packed"])

    bucket, blocks, blobs = None, [], []
    for batch in batches:
        for k, block, blob in zip(*(batch.column(c).to_pylist() for c in _BLOBS.names), strict=True):
            if k != bucket and blobs:
                yield from settle(blocks, blobs)
                blocks, blobs = [], []
            bucket = k
            blocks.append(block)
            blobs.append(blob)
    if blobs:
        yield from settle(blocks, blobs)


def document_counts(keyed: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Of numbered rows: (block, packed) with the documents of all shingles that two or more have, and the documents with words."""
    n = max(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), 1)
    buckets = n * max(1, -(-input_bytes(keyed) // (n * BUCKET_BYTES)))
    routed = keyed.where("wordy").select("block", "text").mapInArrow(_hashes(buckets), "bucket long, block long, packed binary")
    dealt = routed.repartitionById(n, (F.col("bucket") % n).cast("int")).sortWithinPartitions("bucket")
    return scratch.save(dealt.mapInArrow(_summed, "block long, packed binary"), "counts"), keyed.agg(F.count_if("wordy").alias("n")).first()["n"]


def _meet(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (with block and text) of each block behind the counts of the block."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    both = counts.withColumn("ord", F.lit(0)).unionByName(rows.withColumn("ord", F.lit(1)), allowMissingColumns=True)
    return both.repartition(n, "block").sortWithinPartitions("block", "ord")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, Counts]]:
    """Tables of about the size of ``text_blocks`` of the rows of one block, with its counts."""
    block, blobs, counts = None, [], Counts([])
    for t in text_blocks(batches):
        of, ord_ = t["block"].to_numpy(), t["ord"].to_numpy()
        cut = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(ord_, prepend=-1) != 0))
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(of)).tolist(), strict=True):
            if of[a] != block:
                block, blobs, counts = of[a], [], None
            if ord_[a] == 0:
                blobs += t["packed"].slice(a, b - a).to_pylist()
                continue
            if counts is None:
                blobs, counts = [], Counts(blobs)
            yield t.slice(a, b - a), counts


def _sortable(x: np.ndarray) -> np.ndarray:
    """float32 as uint64 whose upper half sorts like the numbers."""
    u = x.astype(np.float32).view(np.uint32)
    u = np.where(u >> 31, ~u, u | np.uint32(1 << 31))
    return u.astype(np.uint64) << np.uint64(32)


class Sampler:
    """Improved consistent weighted sampling (Ioffe 2010) with tabled variates.

    For weight w and variates r, c ~ Gamma(2, 1), b ~ U(0, 1): t = floor(ln w / r + b),
    ln a = ln c - r (t - b) - r. The shingle of least a is the sample; (shingle, t) names
    it, and a together with the shingle's hash stands for that pair.
    """

    def __init__(self, base: float):
        rng = np.random.default_rng(20100101)
        self.r, self.ln_c, self.b = rng.gamma(2, 1, _TABLE), np.log(rng.gamma(2, 1, _TABLE)), rng.random(_TABLE)
        self.odd = rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.base, self.table = base, _sortable(self._ln_a(np.log(base), slice(None)))

    def _ln_a(self, ln_w, at):
        r, b = self.r[at], self.b[at]
        return self.ln_c[at] - r * (np.floor(ln_w / r + b) - b) - r

    def sketch(self, hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """uint64 samples, a row for each of the texts that begin at ``starts`` (none empty)."""
        out = np.empty((len(starts), SAMPLES), np.uint64)
        special = np.flatnonzero(np.abs(weights - self.base) > 1e-12)
        ln_w = np.log(weights[special])
        ends = np.append(starts[1:], len(hashes))
        lo = 0
        while lo < len(starts):  # texts in runs that fit the cache
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + 65536, side="right")))
            a, b = int(starts[lo]), int(ends[hi - 1])
            h, cut = hashes[a:b], starts[lo:hi] - a
            s0, s1 = np.searchsorted(special, [a, b])
            odd_ones, ln = special[s0:s1] - a, ln_w[s0:s1]
            for k in range(SAMPLES):
                p = h * self.odd[k]
                at = (p >> np.uint64(48)).astype(np.int64)
                value = self.table[at]
                if len(odd_ones):
                    value[odd_ones] = _sortable(self._ln_a(ln, at[odd_ones]))
                value |= (p >> np.uint64(16)) & np.uint64(0xFFFFFFFF)
                out[lo:hi, k] = np.minimum.reduceat(value, cut)
            lo = hi
        return out


def _sketches(docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(2.0)
        for t, counts in _met(batches):
            s = Shingles(t["text"])
            some = np.flatnonzero(np.diff(s.ptr) > 0)
            x = sampler.sketch(s.hash, s.weights(counts, docs), s.ptr[some])
            bands = np.zeros((len(some), BANDS), np.uint64)
            for r in range(ROWS):
                bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + x[:, r::ROWS])
            bands += np.arange(BANDS, dtype=np.uint64)  # equal samples of different bands do not meet
            signs = (mix(x) >> np.uint64(48)).astype("<u2")
            keys, sig = np.empty(t.num_rows, object), np.empty(t.num_rows, object)
            for d, row, sign in zip(some.tolist(), mix(bands).view(np.int64).tolist(), signs, strict=True):
                keys[d], sig[d] = row, sign.tobytes()
            own = {c: t[c].combine_chunks() for c in ("row", "block", "doc_id", "digest")}
            yield pa.RecordBatch.from_pydict(own | {"bands": pa.array(keys, pa.list_(pa.int64())), "sig": pa.array(sig, pa.binary())})

    return run


def _vectors(docs: int):
    """Weighted shingles in place of the text: hashes, then weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, counts in _met(batches):
            s = Shingles(t["text"])
            w = s.weights(counts, docs)
            own = {c: t[c].combine_chunks() for c in ("key", "id", "blocks", "sig")}
            cut = list(zip(s.ptr[:-1].tolist(), s.ptr[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_pydict(own | {"vector": pa.array([s.hash[a:b].tobytes() + w[a:b].tobytes() for a, b in cut], pa.binary())})

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of consecutive rows with equal keys, several groups a table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if held:
            last = [held[-1].column(k)[held[-1].num_rows - 1] for k in keys]
            cols = [batch.column(k).to_numpy() for k in keys]
            same = np.ones(batch.num_rows, bool)
            for c, v in zip(cols, last, strict=True):
                same &= c == v.as_py()
            n = batch.num_rows if same.all() else int(np.argmin(same))
            if n:
                held.append(batch.slice(0, n))
            if n < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
            batch = batch.slice(n)
        if batch.num_rows:
            cols = [batch.column(k).to_numpy() for k in keys]
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            tail = int(np.flatnonzero(new)[-1])
            if tail:
                yield pa.Table.from_batches([batch.slice(0, tail)])
            held = [batch.slice(tail)]
    if held:
        yield pa.Table.from_batches(held)


def _bounds(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in keys:
        c = t[k].to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), t.num_rows)


def _signs(t: pa.Table) -> np.ndarray:
    sig = t["sig"].combine_chunks()
    off = np.frombuffer(sig.buffers()[1], np.int32)[sig.offset]
    return np.frombuffer(sig.buffers()[2], "<u2", len(sig) * SAMPLES, int(off)).reshape(-1, SAMPLES)


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal samples of each pair of rows."""
    out = np.zeros((len(x), len(y)), np.uint8)
    for k in range(SAMPLES):
        out += x[:, k, None] == y[None, :, k]
    return out


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


_KEYS = ["key", "i", "j"]


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _groups(batches, _KEYS):
        cut = _bounds(t, _KEYS)
        ids, sig = t["id"].to_numpy(), _signs(t)
        size = np.diff(cut)
        a, b = [], []
        pairs = cut[:-1][size == 2]  # most buckets are pairs: all at once
        good = (sig[pairs] == sig[pairs + 1]).sum(1) >= PROMISING
        a.append(ids[pairs[good]])
        b.append(ids[pairs[good] + 1])
        for lo, hi in zip(cut[:-1][size > 2].tolist(), cut[1:][size > 2].tolist(), strict=True):
            alike = _alike(sig[lo:hi], sig[lo:hi]) >= PROMISING
            inside = np.arange(hi - lo)
            root = inside.copy()
            while True:  # least reachable row, all rows at once
                new = np.minimum(root, np.where(alike, root[None, :], hi).min(1))
                new = new[new]
                if (new == root).all():
                    break
                root = new
            out = root != inside
            a.append(ids[lo:hi][out])
            b.append(ids[lo:hi][root[out]])
        yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})


def _verified(threshold: float):
    def similarity(vectors: list[tuple[np.ndarray, np.ndarray]], i: int, j: int) -> float:
        (h, x), (k, y) = sorted((vectors[i], vectors[j]), key=lambda v: len(v[0]))
        at = np.minimum(np.searchsorted(k, h), len(k) - 1)
        both = k[at] == h
        common = np.minimum(x[both], y[at[both]]).sum()
        return common / (x.sum() + y.sum() - common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, _KEYS):
            cut = _bounds(t, _KEYS)
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                part = t.slice(lo, hi - lo)
                ids, sig = part["id"].to_numpy(), _signs(part)
                raw = [np.frombuffer(v.as_buffer(), np.uint64) for v in part["vector"].combine_chunks()]
                vectors = [(v[: len(v) // 2], v[len(v) // 2 :].view(np.float64)) for v in raw]
                total = np.array([x.sum() for _, x in vectors])
                n = len(ids)
                alike = _alike(sig, sig)
                x, y = np.nonzero(np.triu(alike >= PROMISING, 1))
                fit = np.minimum(total[x], total[y]) >= threshold * np.maximum(total[x], total[y]) * (1 - 1e-9)  # else it can't be reached
                x, y = x[fit], y[fit]
                order = np.argsort(-alike[x, y].astype(np.int16), kind="stable")
                forest, found, known = _Forest(n), [], {}
                for i, part_of in enumerate(part["part"].to_pylist()):  # connected before: no need to compare
                    forest.join(known.setdefault(part_of, i), i)
                for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
                    if forest.root(i) != forest.root(j) and similarity(vectors, i, j) >= threshold:
                        forest.join(i, j)
                        found.append((int(ids[i]), int(ids[j])))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(n, *_KEYS).sortWithinPartitions(*_KEYS)


def _sizes(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(key, blocks) of the keys of more than one row."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    return scratch.save(sizes, f"{name}_sizes")


def _links(rows: DataFrame, sizes: DataFrame, kernel, scratch: Scratch, name: str) -> DataFrame:
    """Links (a, b) that connect whatever pairs of rows of a key the kernel links. rows: key, id, blocks, ... .

    Up to WIDE blocks, all blocks of a key meet in pairs. Of a larger key, one block of pivots
    meets every other block, which costs twice the rows; what this leaves outside the key's
    largest component then meets all blocks. So every pair meets but those that are connected
    already, and no group holds more than two blocks.
    """
    rest = [c for c in rows.columns if c not in ("key", "id", "blocks")]
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    partners = F.when(F.col("blocks") <= WIDE, every).when(block == 0, F.slice(every, 2, F.greatest(F.col("blocks") - 1, F.lit(1)))).otherwise(F.array(F.lit(0)))
    first = rows.withColumn("block", block).withColumn("other", F.explode(partners))
    first = first.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", F.col("id").alias("part"), *rest)
    found = scratch.save(_dealt(first).mapInArrow(kernel, "a long, b long"), f"{name}_first")
    if sizes.where(F.col("blocks") > WIDE).isEmpty():
        return found
    parts = connected_components(rows.sparkSession, found).withColumnRenamed("component", "part")
    wide = rows.where(F.col("blocks") > WIDE)
    placed = wide.select("key", "id", "blocks").join(parts, "id", "left").withColumn("part", F.coalesce("part", "id"))
    main = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
    outside = placed.join(main, "key").where("part != main").drop("main")
    groups = scratch.save(outside.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("groups")), f"{name}_outside")
    left = outside.join(groups, "key").withColumn("i", F.pmod(F.xxhash64("id", F.lit(1)), F.col("groups")).cast("int")).withColumn("j", F.explode(every))
    right = placed.join(groups, "key").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).withColumn("j", block)
    dealt = left.select(*_KEYS, "id", "part").unionByName(right.select(*_KEYS, "id", "part")).distinct()
    second = wide.drop("blocks").join(dealt, ["key", "id"]).select(*_KEYS, "id", "part", *rest)
    return found.unionByName(scratch.save(_dealt(second).mapInArrow(kernel, "a long, b long"), f"{name}_second"))


def _classes(spark: SparkSession, keyed: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """Of numbered rows, one row per distinct text: digest, class_id (least doc_id of its class), kept_row (the row that stands for the class)."""
    counts, docs = document_counts(keyed, scratch)
    texts = keyed.where("text is not null").select("row", "block", "doc_id", "digest", "text")
    sketches = scratch.save(_meet(texts, counts).mapInArrow(_sketches(docs), "row long, block long, doc_id long, digest string, bands array<long>, sig binary"), "sketches")
    # one row per distinct text: the partial aggregation keeps copies from travelling
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "block", "bands", "sig")
    distinct = scratch.save(sketches.groupBy("digest").agg(F.min(first).alias("x")).select("digest", F.col("x.row").alias("id"), "x.no_id", "x.doc_id", "x.block", "x.bands", "x.sig"), "distinct")
    scratch.drop("sketches")
    some = distinct.where("sig is not null")
    banded = some.select(F.explode("bands").alias("key"), "id", "sig")
    buckets = _sizes(some.select(F.explode("bands").alias("key")), scratch, "buckets")
    clusters = connected_components(spark, _links(banded.join(buckets.hint("merge"), "key"), buckets, _promising, scratch, "promising"))
    chosen = clusters.join(some.select("id", "sig"), "id").select(F.col("component").alias("key"), "id", "sig")
    chosen = scratch.save(chosen, "chosen")
    groups = _sizes(chosen, scratch, "groups")
    members = chosen.join(groups.hint("merge"), "key")
    held = keyed.select(F.col("row").alias("id"), "block", "text").join(members.hint("merge"), "id").select("block", "key", "id", "blocks", "sig", "text")
    vectors = scratch.save(_meet(held, counts).mapInArrow(_vectors(docs), "key long, id long, blocks int, sig binary, vector binary"), "vectors")
    scratch.drop("counts")
    links = scratch.save(_links(vectors, groups, _verified(threshold), scratch, "verified"), "links")
    scratch.drop("vectors")
    classes = connected_components(spark, links)
    nodes = distinct.select("digest", "id", F.struct("no_id", "doc_id", "digest", F.col("id").alias("row")).alias("first")).join(classes, "id", "left")
    nodes = scratch.save(nodes.select("digest", F.coalesce("component", "id").alias("component"), "first"), "nodes")
    least = scratch.save(nodes.groupBy("component").agg(F.min("first").alias("first")), "least")  # as a table, so that a join with a hot class can be split
    return scratch.save(nodes.drop("first").join(least.hint("merge"), "component").select("digest", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("kept_row")), "classes")


def near_classes(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, digest, class_id (least doc_id of the class), kept (it stands for the class)."""
    scratch = Scratch(spark)
    _, keyed = _numbered(docs.select("doc_id", "text"), scratch)
    ids = scratch.save(keyed.select("row", "doc_id", "digest"), "ids")
    classes = _classes(spark, keyed, scratch, threshold)
    scratch.drop("rows")
    found = ids.join(classes.hint("merge"), "digest", "left")
    alone = F.col("digest").isNull()
    return found.select("doc_id", "digest", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), (alone | (F.col("row") == F.col("kept_row"))).alias("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without near copies: of each class the row of least doc_id (of several such, the one of least text digest); all rows without text."""
    scratch = Scratch(spark)
    saved, keyed = _numbered(docs, scratch)
    classes = _classes(spark, keyed, scratch, threshold)
    kept = classes.select(F.col("kept_row").alias("row")).distinct().unionByName(keyed.where("digest is null").select("row"))
    number = saved.columns[-3]
    return saved.join(kept.hint("merge"), saved[f"`{number}`"] == kept["row"], "left_semi").select(*every(docs))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "kept")


OP4_SQL = """
WITH RECURSIVE base AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, md5(text)) AS r, doc_id, md5(text) AS digest, text FROM documents
), texts AS (
  SELECT digest, any_value(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, count(*) AS rows FROM base WHERE text IS NOT NULL GROUP BY digest
), s AS (
  SELECT digest, rows, array_to_string(words[i:i + 4], ' ') AS s
  FROM (SELECT digest, rows, words, unnest(generate_series(1, greatest(1, len(words) - 4))) AS i FROM texts WHERE len(words) > 0)
), tf AS (
  SELECT digest, rows, s, 1 + ln(count(*)) AS tf FROM s GROUP BY digest, rows, s
), idf AS (
  SELECT s, 2 - ln(sum(rows)) / ln(greatest((SELECT sum(rows) FROM texts WHERE len(words) > 0), 2)) AS idf FROM tf GROUP BY s
), x AS (
  SELECT digest, s, tf * idf AS w FROM tf JOIN idf USING (s)
), total AS (
  SELECT digest, sum(w) AS total FROM x GROUP BY digest
), common AS (
  SELECT a.digest AS x, b.digest AS y, sum(least(a.w, b.w)) AS common FROM x a JOIN x b ON a.s = b.s AND a.digest <> b.digest GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN total p ON p.digest = x JOIN total q ON q.digest = y WHERE common / (p.total + q.total - common) >= 0.8
), reach AS (
  SELECT x, y FROM links
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), comp AS (
  SELECT x, least(x, min(y)) AS c FROM reach GROUP BY x
), classes AS (
  SELECT r, doc_id, coalesce(c, digest, 'row ' || r) AS class FROM base LEFT JOIN comp ON digest = x
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY class) AS class_id, r = min(r) OVER (PARTITION BY class) AS kept FROM classes
"""
