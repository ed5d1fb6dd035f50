"""Embedding near-dedup with an inverted multi-index.

1. Equal vectors of a label form one class, so copies are never compared.
2. Two codebooks, one for each half of a unit vector, are fitted on a bounded sample;
   their product is a grid of cells. Every vector is indexed in its nearest cell.
3. A multi-sequence traversal lists a vector's cells by rising squared distance (a
   heap over the two sorted lists) and stops at an excess over the nearest cell.
   The excess is calibrated on the sample: partners at exactly the threshold cosine
   in random directions must lie in visited cells for ``recall`` of all tries. A
   pair of cells is visited from the lower one only, so no pair is found twice.
4. Cells whose visitors and members exceed ``BLOCK`` are dealt into blocks; each
   pair of blocks is one bounded task that verifies exact cosines in double
   precision and returns link counts and a spanning forest, never all pairs.

Edge cases.  Vectors that are null, empty, zero or hold null or non-finite numbers,
and vectors with a null label, link with nothing (n_links 0, component their own
id, kept). Vectors of different lengths never link. Rows with equal ids and equal
vectors count as copies of each other. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Scratch
from quern.llm.graph import connected_components

THRESHOLD = 0.93
#: Vectors on which codebooks and the excess are fitted; the index itself holds every row.
SAMPLE = 8192
RECALL = 0.999
BLOCK = 512
SEED = 20240607


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(12):
        near = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        n = np.bincount(near, minlength=k)
        c = np.where(n[:, None] > 0, np.stack([np.bincount(near, x[:, d], k) for d in range(x.shape[1])], 1) / np.maximum(n, 1)[:, None], c)
    return c


class MultiIndex:
    def __init__(self, books: tuple[np.ndarray, np.ndarray], excess: float):
        self.books, self.excess = books, excess

    @classmethod
    def fit(cls, unit: np.ndarray, k: int, threshold: float, recall: float) -> MultiIndex:
        rng = np.random.default_rng(SEED)
        half, k = unit.shape[1] // 2, max(1, min(k, len(np.unique(unit, axis=0))))
        books = (_kmeans(unit[:, :half], k, rng), _kmeans(unit[:, half:], k, rng))
        index = cls(books, 0.0)
        x = unit[rng.integers(0, len(unit), 4096)]
        away = rng.standard_normal(x.shape)
        away -= (away * x).sum(1, keepdims=True) * x
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
        y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * away
        own, other = index.distances(x), index.distances(y)
        e = sum(a[np.arange(len(x)), b.argmin(1)] - a.min(1) for a, b in zip(own, other, strict=True))
        return cls(books, float(np.quantile(e, recall)) + 1e-9)

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.books[0].shape[1]
        return tuple(((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T) for x, c in zip((unit[:, :half], unit[:, half:]), self.books, strict=True))

    def visits(self, unit: np.ndarray) -> Iterator[list[int]]:
        """Cells of each vector, the nearest first."""
        k = len(self.books[1])
        one, two = self.distances(unit)
        order1, order2 = one.argsort(1), two.argsort(1)
        one, two = np.take_along_axis(one, order1, 1), np.take_along_axis(two, order2, 1)
        for a, b, p, q in zip(one.tolist(), two.tolist(), order1.tolist(), order2.tolist(), strict=True):
            most, cells = a[0] + b[0] + self.excess, []
            heap = [(a[0] + b[0], 0, 0)]
            while heap and heap[0][0] <= most:
                _, i, j = heapq.heappop(heap)
                cells.append(p[i] * k + q[j])
                if j + 1 < len(b):
                    heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
                if j == 0 and i + 1 < len(a):
                    heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
            yield cells


def unit_rows(vectors: pa.Array) -> np.ndarray:
    v = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
    # scaled by the largest part first, so that squares neither vanish nor overflow
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_PLACED_DDL = "cell long, id long, home boolean, weight long, vec array<double>"


def _place(indexes: dict[int, MultiIndex]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for dim in np.unique(t["dim"].to_numpy()).tolist():
                part = t.filter(pc.equal(t["dim"], dim))
                unit = unit_rows(part["vec"])
                row, cell, home = [], [], []
                for r, cells in enumerate(indexes[dim].visits(unit)):
                    own = cells[0]
                    mine = [c for c in cells if c >= own]
                    row += [r] * len(mine)
                    cell += mine
                    home += [c == own for c in mine]
                for lo in range(0, len(row), 10_000):
                    x = np.array(row[lo : lo + 10_000])
                    yield pa.RecordBatch.from_arrays(
                        [part["label"].combine_chunks().take(pa.array(x)), part["dim"].combine_chunks().take(pa.array(x)), pa.array(cell[lo : lo + 10_000], pa.int64()), part["id"].combine_chunks().take(pa.array(x)), pa.array(home[lo : lo + 10_000]), part["weight"].combine_chunks().take(pa.array(x)), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(unit[x].ravel()))],
                        names=["label", "dim", "cell", "id", "home", "weight", "vec"],
                    )

    return run


def _verify(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        """One pair of blocks: block numbers i <= j are in columns; rows of both."""
        ids, home, weight = t["id"].to_numpy(), t["home"].to_numpy(zero_copy_only=False).astype(bool), t["weight"].to_numpy()
        block, i, j = t["block"].to_numpy(), t["i"][0].as_py(), t["j"][0].as_py()
        x = t["vec"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        # rows before columns: each unordered pair of different classes once, one of them at home here
        linked = x @ x.T >= threshold
        linked &= home[:, None] | home[None, :]
        if i != j:
            linked &= block[:, None] != block[None, :]
        np.fill_diagonal(linked, False)
        n = linked @ weight
        root = np.arange(len(ids))[np.argsort(np.argsort(ids))]  # ranks of ids: least rank is least id
        while True:
            new = np.minimum(root, np.where(linked, root[None, :], len(ids)).min(1, initial=len(ids)))
            if (new == root).all():
                break
            root = new
        by_rank = np.sort(ids)
        some = n > 0
        return pa.table({"id": ids[some], "n": n[some], "root": by_rank[root[some]]})

    return run


def embedding_dedup(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """vectors: vec_id, embedding, label. Per row: vec_id, n_links, component_id, kept."""
    scratch = Scratch(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").alias("label"))
    real = F.transform("embedding", lambda v: v.cast("double"))
    fine = (
        F.col("label").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != F.lit(float("inf"))))
        & F.exists("embedding", lambda v: v != 0)
    )
    good = rows.where(F.coalesce(fine, F.lit(False))).withColumn("vec", real)
    classes = scratch.save(good.groupBy("label", "vec").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight")).withColumn("dim", F.size("vec")), "classes")
    dims = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per vector length
    indexes = {}
    for dim, n in dims:
        some = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toArrow()["vec"]
        indexes[dim] = MultiIndex.fit(unit_rows(some), int(np.clip(np.sqrt(n / 1500), 6, 256)), threshold, recall)
    kind = dict(classes.dtypes)["label"]
    placed = classes.select("label", "dim", "id", "weight", "vec").mapInArrow(_place(indexes), f"label {kind}, dim int, {_PLACED_DDL}") if indexes else None
    if placed is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    placed = scratch.save(placed, "placed")
    key = ["label", "dim", "cell"]
    wide = placed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocks = placed.join(wide, key).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *key, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "home", "weight", "vec"
    )
    found = dealt.groupBy(*key, "i", "j").applyInArrow(_verify(threshold), "id long, n long, root long")
    found = scratch.save(found.groupBy("id", "root").agg(F.sum("n").alias("n")), "found")
    parts = connected_components(spark, found.where("id != root").select("id", "root"))
    per_class = (
        classes.join(found.groupBy("id").agg(F.sum("n").alias("n")), "id", "left").join(parts, "id", "left")
        .select("label", "vec", F.coalesce("component", "id").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    )
    out = rows.withColumn("vec", F.when(F.coalesce(fine, F.lit(False)), real)).join(per_class, ["label", "vec"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), good AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach AS (
  SELECT x, y FROM links
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), comp AS (
  SELECT x, least(x, min(y)) AS c FROM reach GROUP BY x
)
SELECT v.vec_id, CAST(count(l.y) AS BIGINT) AS n_links, any_value(coalesce(c.c, v.vec_id)) AS component_id,
  v.vec_id = any_value(coalesce(c.c, v.vec_id)) AS kept
FROM v LEFT JOIN links l ON v.vec_id = l.x LEFT JOIN comp c ON v.vec_id = c.x
GROUP BY v.vec_id
"""
