"""Benchmark decontamination by latent semantic retrieval.

Words are lower-cased runs of letters and digits, hashed to ``FEATURES`` columns.

1. One pass over all documents takes document counts (for idf) and, for the term
   matrix T of consecutive ``PASSAGE``-word passages, the product T'T G with a fixed
   Gaussian matrix G. Scaled by idf its columns span the range of the randomised SVD of
   the TF-IDF matrix (Halko et al. 2011; the row scaling of G is part of the test matrix).
   Each task sends a fixed-size sum in parts, each part is added in one place, and the
   driver orthogonalises the whole.
2. Words become whitened latent vectors, centred on the corpus mean, so a passage is
   a difference of running sums; common words, which tell languages rather than
   contents apart, are null vectors. Windows of each length in ``LENGTHS`` slide over whole
   documents by a third of their length and are compared by cosine with the benchmark
   items of that length class: those so long that, wherever a copy begins, some window
   lies within it.
   Whatever the cosine misses (paraphrases, items of common words only, whose vectors are
   null) comes by an exact way: a common subsequence of LIKELY of an item's words leaves out at
   most those of its ``drop`` most frequent words, so so many of the others, its key words,
   must lie in the stretch around the window that step 3 reads (``_Keys``). No pair
   of window and item that step 3 would accept fails this, so what is found depends neither
   on the cosine nor on the latent space.
3. A candidate whose window lacks the item's rarer words, which is a bound on what may
   follow, goes; others are verified on the words themselves: the longest common subsequence of
   item and window (with as much on either side as the item is longer) over the item's length. From
   ``SURE`` on it is a leak; from ``LIKELY`` on it is a paraphrase if the item's answer,
   its last ``ANSWER`` words, also recurs there by ``ANSWER_SHARE``.

The benchmark is dealt by a hash of the texts into blocks of about ``ITEM_BLOCK`` items and
``BLOCK_BYTES`` of text, however many that makes; each block is a pass of steps 2 and 3, and what is
sent to executors is one block. The best match is that of the greatest share, then of the least item_id.

Edge cases.  Null and empty texts and items match nothing. A document shorter than a
window is one window. Repeated items count once by text (the least item_id names
them); a match with an item without item_id has a share but no item, and comes last among equals; rows with equal doc_id are judged each by its own text, and a null doc_id is judged
too. Extra columns are ignored by ``leaks`` and kept by ``without_leaks``; empty tables
give results without leaks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Words, every, flat, fresh, small_batches, text_blocks

FEATURES, RANK, OVER = 8192, 40, 8
#: Features that are summed together.
PART = 128
#: Words of a passage of the term matrix, and of sliding windows. Windows move by a third of their length.
PASSAGE, LENGTHS = 54, (3, 6, 12, 18, 27, 40, 60, 90, 135, 200)
COSINE, SURE, LIKELY, ANSWER, ANSWER_SHARE = 0.62, 0.7, 0.55, 8, 0.75
#: Items, and bytes of their texts, that one pass looks for.
ITEM_BLOCK, BLOCK_BYTES = 20_000, 8 << 20
#: Share of all words from which a feature is common: the bound on common subsequences counts rarer ones only.
COMMON = 0.001
#: Items whose key words are looked up together.
GROUP = 512
SEED = 4242

_PLAIN = np.full(256, 32, np.uint8)  # letters lower-cased, digits, wider characters; the rest separates
_PLAIN[0x30:0x3A], _PLAIN[0x61:0x7B], _PLAIN[0x41:0x5B], _PLAIN[0x80:] = range(0x30, 0x3A), range(0x61, 0x7B), range(0x61, 0x7B), range(0x80, 0x100)


def plain_words(texts: pa.Array) -> Words:
    data, off = flat(texts)
    out = _PLAIN[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1  # upper-case Latin letters
    up = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    out[up] += 0x20
    return Words(out, off)


def _columns(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(51)).astype(np.int32)  # 13 bits: FEATURES


def _gauss() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((FEATURES, RANK + OVER)).astype(np.float32)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part of the features: documents, counts of documents and words per feature, rows of T'T G."""
    g, docs = _gauss(), 0
    df, tf, product = np.zeros(FEATURES), np.zeros(FEATURES), np.zeros((FEATURES, RANK + OVER))
    size = PASSAGE
    for t in text_blocks(batches):
        w = plain_words(t["text"])
        if not len(w):
            continue
        f, n = _columns(w.hashes()), np.diff(w.ptr)
        docs += int((n > 0).sum())
        tf += np.bincount(f, minlength=FEATURES)
        for lo in range(0, len(n), 1024):
            hi = min(lo + 1024, len(n))
            seen = np.zeros((hi - lo, FEATURES), bool)
            a, b = w.ptr[lo], w.ptr[hi]
            seen[np.repeat(np.arange(hi - lo), n[lo:hi]), f[a:b]] = True
            df += seen.sum(0)
        at = np.arange(len(w)) - np.repeat(w.ptr[:-1], n)
        begin = np.flatnonzero(at % size == 0)
        step = 256
        for lo in range(0, len(begin), step):
            a, b = begin[lo], begin[lo + step] if lo + step < len(begin) else len(w)
            own = f[a:b]
            cut = begin[lo : lo + step] - a
            y = np.add.reduceat(g[own], cut)
            each = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, b - a)))
            order = np.argsort(own.astype(np.uint16), kind="stable")
            ranked = own[order]
            first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
            product[ranked[first]] += np.add.reduceat(y[each[order]], first)
    rows = [(k, docs, *(x[k * PART : (k + 1) * PART].astype(kind).tobytes() for x, kind in ((df, "<f8"), (tf, "<f8"), (product, "<f4")))) for k in range(FEATURES // PART)]
    yield _sums(rows)


def _sums(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["part", "docs", "df", "tf", "product"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each part of the features: a fixed number of fixed-size rows."""
    kinds = ("<f8", "<f8", "<f4")
    totals: dict[int, list] = {}
    for batch in batches:
        for r in batch.to_pylist():
            new = [np.frombuffer(r[c], kind).astype(np.float64) for c, kind in zip(("df", "tf", "product"), kinds, strict=True)]
            old = totals.setdefault(r["part"], [0, *(np.zeros_like(x) for x in new)])
            old[0] += r["docs"]
            for total, x in zip(old[1:], new, strict=True):
                total += x
    if totals:
        yield _sums([(k, n, *(x.astype(kind).tobytes() for x, kind in zip(sums, kinds, strict=True))) for k, (n, *sums) in sorted(totals.items())])


def latent_space(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whitened, centred vector of each feature (FEATURES x RANK), which features are rare, and the words of each."""
    parts = docs.select("text").mapInArrow(_gather, "part int, docs long, df binary, tf binary, product binary")
    # every part of the features is summed in one place; FEATURES / PART rows of a fixed size come back
    parts = parts.repartition(FEATURES // PART, "part").mapInArrow(_add, "part int, docs long, df binary, tf binary, product binary").collect()
    n, df, tf, product = 0, np.zeros(FEATURES), np.zeros(FEATURES), np.zeros((FEATURES, RANK + OVER))
    for r in parts:
        own = slice(r["part"] * PART, (r["part"] + 1) * PART)
        n = r["docs"]
        df[own], tf[own] = np.frombuffer(r["df"]), np.frombuffer(r["tf"])
        product[own] = np.frombuffer(r["product"], "<f4").reshape(PART, -1)
    if n == 0:
        return np.zeros((FEATURES, RANK), np.float32), np.ones(FEATURES, bool), tf
    idf = np.log((1 + n) / (1 + df)) + 0.1
    # A = T diag(idf); A'A Omega with Omega = diag(1 / idf) G; singular values from the projected A'A Omega
    sketch = idf[:, None] * product
    q, _ = np.linalg.qr(sketch)
    omega = _gauss() / idf[:, None]
    small = (q.T @ sketch) @ np.linalg.pinv(q.T @ omega)  # Nystroem estimate of q'A'A q
    value, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-value)[:RANK]
    basis = q @ turn[:, order] / np.sqrt(np.maximum(value[order], 1e-6 * max(value.max(), 1e-12)))
    vectors = idf[:, None] * basis
    vectors -= (tf @ vectors) / tf.sum()
    rare = tf < COMMON * tf.sum()
    vectors *= rare[:, None]
    return (vectors / max(np.abs(vectors).max(), 1e-12)).astype(np.float32), rare, tf


def places(words: list) -> dict:
    """Bits of the positions of each word."""
    out: dict = {}
    for i, x in enumerate(words):
        out[x] = out.get(x, 0) | 1 << i
    return out


def lcs(where: dict, n: int, b: list) -> int:
    """Length of the longest common subsequence of n placed words and b, by bit-parallel columns."""
    full = (1 << n) - 1
    v = full
    for x in b:
        if x in where:
            u = v & where[x]
            v = (v + u | v - u) & full
    return n - v.bit_count()


class _Keys:
    """The key words of some items of a length class: which stretches of documents hold enough of them."""

    def __init__(self, own: list[int], words: list[list[int]], length: int, tf: np.ndarray):
        self.own, self.length = np.array(own, np.int64), length
        key, item, need = [], [], []
        for k, i in enumerate(own):
            kinds, n = np.unique(np.array(words[i], np.uint64), return_counts=True)
            least = int(np.ceil(LIKELY * len(words[i]) - 1e-9))
            order = np.argsort(-tf[_columns(kinds)], kind="stable")
            drop = np.cumsum(n[order]) <= least // 2
            need.append(least - int(n[order][drop].sum()))
            key.append(kinds[order][~drop])
            item.append(np.full(len(key[-1]), k))
        key, item = np.concatenate(key), np.concatenate(item)
        order = np.argsort(key, kind="stable")
        self.key, first = np.unique(key[order], return_index=True)
        self.item, self.ptr = item[order], np.append(first, len(key))
        self.need, self.size = np.array(need, np.int64), np.array([len(words[i]) for i in own], np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.key >> np.uint64(44)).astype(np.int64)] = True

    def pairs(self, h: np.ndarray, some: np.ndarray, base: np.ndarray, n: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows (numbers) and items of which the window's stretch holds enough key words.

        Document d has the words base[d]:base[d] + n[d] of h and the windows first[d]:first[d] + count[d]; some: the words that may be keys.
        """
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = some[self.maybe[(h[some] >> np.uint64(44)).astype(np.int64)]]
        k = np.minimum(np.searchsorted(self.key, h[at]), len(self.key) - 1)
        same = self.key[k] == h[at]
        at, k = at[same], k[same]
        each = self.ptr[k + 1] - self.ptr[k]
        hit = np.repeat(at, each)
        item = self.item[np.repeat(self.ptr[k + 1] - np.cumsum(each), each) + np.arange(len(hit))]
        order = np.argsort(item, kind="stable")
        hit, item = hit[order], item[order]
        # a stretch that holds enough holds as many consecutive hits of the item
        begin = np.arange(len(hit))
        last = begin + self.need[item] - 1
        begin = begin[last < len(hit)]
        last = last[begin]
        begin = begin[(item[begin] == item[last]) & (hit[last] - hit[begin] < 2 * self.size[item[begin]])]
        if not len(begin):
            return none
        item, x, y = item[begin], hit[begin], hit[begin + self.need[item[begin]] - 1]
        doc = np.searchsorted(base, x, side="right") - 1  # of empty documents at the same place, the last has the words
        inside = y < base[doc] + n[doc]
        item, x, y, doc = item[inside], x[inside], y[inside], doc[inside]
        x, y, size, step = x - base[doc], y - base[doc], self.size[item], max(1, self.length // 3)
        low = np.clip(-((size - 1 - y) // step), 0, count[doc] - 1)
        high = np.where(n[doc] <= x + size, count[doc] - 1, np.minimum((x + size - self.length) // step, count[doc] - 1))
        many = np.maximum(high - low + 1, 0)
        nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        begins = np.minimum(nth * step, np.repeat(np.maximum(n[doc] - self.length, 0), many))
        fit = begins + np.repeat(size, many) > np.repeat(y, many)
        row, item = (np.repeat(first[doc], many) + nth)[fit], np.repeat(item, many)[fit]
        both = np.unique(row * len(self.own) + item)
        return both // len(self.own), self.own[both % len(self.own)]


class Items:
    """A block of benchmark items: words, length class, latent vectors."""

    def __init__(self, ids: list[int | None], texts: list[str], space: np.ndarray, rare: np.ndarray, tf: np.ndarray):
        w = plain_words(pa.array(texts, pa.string()))
        h = w.hashes()
        self.rare = rare
        self.ids, self.words, self.space = ids, [h[a:b].tolist() for a, b in zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist(), strict=True)], space
        size = self.size = np.array([len(x) for x in self.words], np.int64)
        self.places = [places(x) for x in self.words]
        self.of = {length: [] for length in LENGTHS}
        for i, n in enumerate(size.tolist()):
            if n:
                inside = [length for length in LENGTHS if length + max(1, length // 3) - 1 <= n]
                self.of[max(inside, default=LENGTHS[0])].append(i)
        has = []  # rare features of each item, as item * FEATURES + feature
        self.need = np.zeros(len(ids), np.int64)  # how many of them any match must have
        for i, words in enumerate(self.words):
            f = _columns(np.array(words, np.uint64))
            has.append(np.unique(f[rare[f]]).astype(np.int64) + i * FEATURES)
            self.need[i] = int(np.ceil(LIKELY * len(f) - 1e-9)) - int((~rare[f]).sum())
        self.has = np.concatenate([*has, np.array([1 << 62])])
        # most pairs are not among them: a table of a few bytes a pair says so without a search
        self.shift = np.uint64(64 - max(16, (16 * len(self.has) - 1).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[self._slots(self.has)] = True
        self.keys = {length: [_Keys(own[k : k + GROUP], self.words, length, tf) for k in range(0, len(own), GROUP)] for length, own in self.of.items()}
        self.maybe = np.zeros(1 << 20, bool)  # key words of any length class
        for groups in self.keys.values():
            for k in groups:
                self.maybe |= k.maybe
        self.vectors = {}
        for length, own in self.of.items():
            x = np.array([space[_columns(np.array(self.words[i], np.uint64))].sum(0) for i in own], np.float32).reshape(-1, RANK)
            self.of[length] = np.array(own, np.int64)
            self.vectors[length] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def shared(self, f: np.ndarray, left: np.ndarray, right: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Words of f[left:right] that are rare words of the item, for each candidate."""
        out = np.zeros(len(item), np.int64)
        inside = np.arange(int((right - left).max(initial=0)))
        for lo in range(0, len(item), 4096):
            at = left[lo : lo + 4096, None] + inside
            wanted = (item[lo : lo + 4096] * FEATURES)[:, None] + f[np.minimum(at, len(f) - 1)]
            found = np.flatnonzero((self.table[self._slots(wanted)] & (at < right[lo : lo + 4096, None])).ravel())
            some = wanted.ravel()[found]
            row = found[self.has[np.searchsorted(self.has, some)] == some] // max(1, len(inside))
            out[lo : lo + 4096] = np.bincount(row, minlength=len(wanted))
        return out


def _search(items: Items, cosine: float, names: tuple[str, str]):
    def judge(i: int, window: list) -> float:
        item = items.words[i]
        share = lcs(items.places[i], len(item), window) / len(item)
        if share >= SURE:
            return share
        answer = item[-ANSWER:]
        if share >= LIKELY and lcs(places(answer), len(answer), window) >= ANSWER_SHARE * len(answer):
            return share
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_blocks(batches):
            w = plain_words(t["text"])
            best: dict[int, tuple[float, bool, int]] = {}  # share, has an id, minus the id
            if len(w):
                h = w.hashes()
                f = _columns(h)
                for lo, hi in _chunks(w.ptr, 1 << 14):
                    a, b = int(w.ptr[lo]), int(w.ptr[hi])
                    rarer = items.rare[f[a:b]]  # the others are null vectors
                    at = np.concatenate(([0], np.cumsum(rarer)))
                    total = np.zeros((int(at[-1]) + 1, RANK), np.float32)
                    np.cumsum(items.space[f[a:b][rarer]], axis=0, dtype=np.float32, out=total[1:])
                    n, base = np.diff(w.ptr[lo : hi + 1]), w.ptr[lo:hi] - a
                    some = np.flatnonzero(items.maybe[(h[a:b] >> np.uint64(44)).astype(np.int64)])
                    for length, own in items.of.items():
                        if not len(own):
                            continue
                        step = max(1, length // 3)
                        count = np.where(n > 0, 1 + np.maximum(0, -(-(n - length) // step)), 0)
                        first = np.cumsum(count) - count
                        doc = np.repeat(np.arange(hi - lo), count)
                        nth = np.arange(len(doc)) - np.repeat(first, count)
                        begin = np.minimum(nth * step, np.maximum(n[doc] - length, 0)) + base[doc]
                        end = np.minimum(begin + length, base[doc] + n[doc])
                        x = total[at[end]] - total[at[begin]]
                        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
                        near = [k.pairs(h[a:b], some, base, n, first, count) for k in items.keys[length]]
                        for s in range(0, len(x), 8192):  # the comparison table stays bounded
                            found = np.flatnonzero((x[s : s + 8192] @ items.vectors[length].T >= cosine).ravel())
                            near.append((found // len(own) + s, own[found % len(own)]))
                        both = np.unique(np.concatenate([row * len(items.ids) + item for row, item in near]))
                        row, item = both // len(items.ids), both % len(items.ids)
                        margin = items.size[item]
                        left = np.maximum(base[doc[row]], end[row] - margin) + a
                        right = np.minimum(base[doc[row]] + n[doc[row]], begin[row] + margin) + a
                        fit = items.shared(f, left, right, item) >= items.need[item]
                        for r, i, u, v in zip(row[fit].tolist(), item[fit].tolist(), left[fit].tolist(), right[fit].tolist(), strict=True):
                            d = int(doc[r])
                            share = judge(i, h[u:v].tolist())
                            if share:
                                name = items.ids[i]
                                best[lo + d] = max(best.get(lo + d, (0.0, False, 0)), (share, name is not None, -(name or 0)))
            found = [best.get(d) for d in range(t.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [*(t[c].combine_chunks() for c in t.column_names), pa.array([-x[2] if x and x[1] else None for x in found], pa.int64()), pa.array([x[0] if x else 0.0 for x in found], pa.float64())],
                names=[*t.column_names, *names],
            )

    return run


def _chunks(ptr: np.ndarray, words: int) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about so many words."""
    lo = 0
    while lo < len(ptr) - 1:
        hi = max(lo + 1, int(np.searchsorted(ptr, ptr[lo] + words, side="right")) - 1)
        yield lo, hi
        lo = hi


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), cosine: float = COSINE, names: tuple[str, str] = ("item", "share")) -> DataFrame:
    """Columns ``keep`` of docs (text with them), the best matching leaked item or null, and the share of its words found in order."""
    small_batches(spark)
    space, rare, tf = latent_space(docs)
    unique = benchmark.where("text is not null").groupBy("text").agg(F.min("item_id").cast("long").alias("item_id"))
    size = unique.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n = max(1, -(-size["n"] // ITEM_BLOCK), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    blocks = (unique.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i).collect() for i in range(n))
    wanted = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys((*keep, "text"))])
    kept, out = wanted.columns, None
    for rows in blocks:
        rows = sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        items = Items([r["item_id"] for r in rows], [r["text"] for r in rows], space, rare, tf)
        schema = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        if out is None:
            out = wanted.mapInArrow(_search(items, cosine, names), f"{schema(wanted)}, `{names[0]}` long, `{names[1]}` double")
        else:
            new = tuple(fresh(c, out.columns) for c in names)
            more = out.mapInArrow(_search(items, cosine, new), f"{schema(out)}, `{new[0]}` long, `{new[1]}` double")
            item, share, item2, share2 = (F.col(c) for c in (*names, *new))
            better = (share2 > share) | (share2 == share) & item2.isNotNull() & (item.isNull() | (item2 < item))
            out = more.select(*[F.col(f"`{c}`") for c in kept], F.when(better, item2).otherwise(item).alias(names[0]), F.greatest(share, share2).alias(names[1]))
    return out


def without_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    names = (fresh("item", docs.columns), fresh("share", docs.columns))
    found = leaks(spark, docs, benchmark, keep=tuple(docs.columns), names=names, **options)
    return found.where(F.col(names[1]) == 0).select(*every(docs))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = leaks(spark, docs, benchmark)
    return found.select("doc_id", (F.col("share") > 0).alias("contaminated"), F.col("item").alias("item_id"), F.col("share").alias("lcs_share"))
