"""Keys, liveness, prefix scans, cursor pages and stored results."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import glob_regex


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: under ``spark.checkpoint.dir``, else the warehouse; in local mode, one that goes with the program."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local["):
        base = spark.conf.get("spark.sql.warehouse.dir")
    if base is None:
        own = tempfile.mkdtemp(prefix=f"quern-{name}-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def live(df: DataFrame, now, expire_at: str = "expire_at") -> DataFrame:
    """Rows whose time has not come; ``now`` is given so that results repeat."""
    if expire_at not in df.columns:
        return df
    return df.where(F.col(expire_at).isNull() | (F.col(expire_at) > F.lit(now)))


def glob(column: Column, pattern: str) -> Column:
    """Matches a glob. A literal start becomes a prefix test, which scans can use."""
    head = ""
    for c in pattern:
        if c in "*?[\\":
            break
        head += c
    if head == pattern:
        return column == pattern
    if pattern == head + "*":
        return F.startswith(column, F.lit(head)) if head else column.isNotNull()
    held = column.rlike(glob_regex(pattern))
    return F.startswith(column, F.lit(head)) & held if head else held


def prefix_scan(df: DataFrame, key: str, prefix: str, limit: int | None = None, reverse: bool = False) -> DataFrame:
    out = df.where(F.startswith(F.col(key), F.lit(prefix)))
    if limit is None:
        return out
    return out.orderBy(F.col(key).desc() if reverse else F.col(key).asc()).limit(limit)


def scan_page(df: DataFrame, key: str, after: str | None = None, match: str | None = None, count: int = 10, kind: str | None = None) -> DataFrame:
    """A cursor page: the next ``count`` keys after the last one seen, of which those that match."""
    page = df if after is None else df.where(F.col(key) > F.lit(after))
    page = page.orderBy(key).limit(count)
    if match is not None:
        page = page.where(glob(F.col(key), match))
    if kind is not None:
        page = page.where(F.col("type") == kind)
    return page


def requested(df: DataFrame, key: str, wanted: Iterable[object]) -> DataFrame:
    """Rows in request order, with nulls for keys that are missing."""
    wanted = list(wanted)
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    asked = spark.createDataFrame([(i, w) for i, w in enumerate(wanted)], f"ordinal int, `{key}` {kind}")
    return asked.join(df.where(F.col(key).isin(wanted)), key, "left").orderBy("ordinal")


def hash_documents(kv_hash: DataFrame, prefix: str, fields: list[str]) -> DataFrame:
    """Documents of hashes with a key prefix: one row a key, one column a field."""
    rows = kv_hash.where(F.startswith("key", F.lit(prefix)) & F.col("field").isin(fields))
    return rows.groupBy("key").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])


def json_documents(kv_json: DataFrame, prefix: str, paths: dict[str, str]) -> DataFrame:
    """Documents of JSON texts: one array column a path, all values that the path reaches."""
    rows = kv_json.where(F.startswith("key", F.lit(prefix)))

    def values(path: str) -> Column:
        found = F.get_json_object("doc", path)
        many = F.from_json(found, "array<string>")
        return F.when(found.isNull(), F.array().cast("array<string>")).when(F.startswith(found, F.lit("[")), many).otherwise(F.array(found))

    return rows.select("key", *[values(p).alias(n) for n, p in paths.items()])


def store(df: DataFrame, path: str, destination: str) -> None:
    """The result as the new value of key ``destination``: its partition is replaced, others stay."""
    out = df.drop("key").withColumn("key", F.lit(destination))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").parquet(path)
