"""Connected components over a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import Scratch

#: Parts that the links of one id are dealt into, so that an id with a third of all links is no single task.
SALT = 32


def _least(e: DataFrame) -> DataFrame:
    """Links (a, b) with m, the least b of their a. The links of an id never meet in one place, only the least of each part."""
    salted = e.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SALT)))
    parts = salted.groupBy("a", "part").agg(F.min("b").alias("m"))
    least = parts.withColumn("m", F.min("m").over(Window.partitionBy("a")))  # SALT rows an id at most
    return salted.join(least, ["a", "part"]).drop("part")


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    joined = _least(e)
    out = joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.unionByName(joined.select("a", F.col("m").alias("b"))).distinct()


def connected_components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """links: two long columns. Returns (id, component) of linked ids, component the least id reachable.

    Each round is written to the shared scratch folder; sizes only, no links, reach the driver. Every
    round brings some id nearer to the least one it can reach, so the rounds end by themselves.
    Null ends and self-links are ignored.
    """
    scratch = Scratch(spark)
    x, y = (F.col(c).cast("long") for c in links.columns[:2])
    e = links.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("a > b").where(x.isNotNull() & y.isNotNull()).distinct()
    e, n = scratch.save(e, "links0"), 0
    while True:
        # done when each id has one parent and no parent has a parent
        rows, ids = e.agg(F.count(F.lit(1)), F.count_distinct("a")).first()
        parents = e.select(F.col("b").alias("a")).distinct()
        if rows == ids and parents.join(e.select("a"), "a", "left_semi").isEmpty():
            roots = parents.select(F.col("a").alias("id"), F.col("a").alias("component"))
            return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
        n += 1
        e = scratch.save(_small(_large(e)), f"links{n}")
        if n > 1:
            scratch.drop(f"links{n - 1}")
