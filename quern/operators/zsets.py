"""Sorted sets as (key, member, score) rows, ordered by score, then member."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.keys import glob


def add(zsets: DataFrame, rows: DataFrame, mode: str = "") -> DataFrame:
    """Upsert (key, member, score[, seq]). NX adds only, XX updates only, GT and LT update to higher or lower scores."""
    modes = set(mode.upper().split())
    if not modes <= {"NX", "XX", "GT", "LT"} or "NX" in modes and modes & {"XX", "GT", "LT"} or {"GT", "LT"} <= modes:
        raise ValueError(f"modes do not go together: {mode}")
    seq = F.col("seq") if "seq" in rows.columns else F.lit(0)
    pick = F.max("score") if "GT" in modes else F.min("score") if "LT" in modes else F.min_by("score", seq) if "NX" in modes else F.max_by("score", seq)
    new = rows.groupBy("key", "member").agg(pick.alias("new"))
    both = zsets.select("key", "member", F.col("score").alias("old")).join(new, ["key", "member"], "full_outer")
    if "NX" in modes:
        score = F.coalesce("old", "new")
    else:
        better = F.col("new") > F.col("old") if "GT" in modes else F.col("new") < F.col("old") if "LT" in modes else F.col("new").isNotNull()
        score = F.when(F.col("old").isNull(), F.col("new")).when(F.coalesce(better, F.lit(False)), F.col("new")).otherwise(F.col("old"))
    if "XX" in modes:
        both = both.where("old is not null")
    return both.select("key", "member", score.alias("score"))


def increment(zsets: DataFrame, rows: DataFrame) -> DataFrame:
    """Add (key, member, delta)."""
    every = zsets.select("key", "member", "score").unionByName(rows.select("key", "member", F.col("delta").alias("score")))
    return every.groupBy("key", "member").agg(F.sum("score").alias("score"))


def remove(zsets: DataFrame, rows: DataFrame) -> DataFrame:
    return zsets.join(rows.select("key", "member").distinct(), ["key", "member"], "left_anti")


def cardinality(zsets: DataFrame) -> DataFrame:
    return zsets.groupBy("key").agg(F.count(F.lit(1)).alias("card"))


def scores(zsets: DataFrame, key: str, members: Sequence[object]) -> DataFrame:
    asked = zsets.sparkSession.createDataFrame(list(enumerate(members)), f"ordinal int, member {dict(zsets.dtypes)['member']}")
    own = zsets.where((F.col("key") == key) & F.col("member").isin(list(members))).select("member", "score")
    return asked.join(own, "member", "left").select("ordinal", "member", "score").orderBy("ordinal")


def rank(zsets: DataFrame, key: str, member: object, reverse: bool = False) -> DataFrame:
    """0-based rank of one member: a count of what precedes it, without sorting."""
    own = zsets.where(F.col("key") == key)
    mine = own.where(F.col("member") == F.lit(member)).select(F.col("score").alias("s"), F.col("member").alias("m"))
    before = (F.col("score") < F.col("s")) | ((F.col("score") == F.col("s")) & (F.col("member") < F.col("m")))
    after = (F.col("score") > F.col("s")) | ((F.col("score") == F.col("s")) & (F.col("member") > F.col("m")))
    # the one row of the member is the broadcast side
    return own.join(F.broadcast(mine)).groupBy("m").agg(F.count_if(after if reverse else before).alias("rank")).select(F.col("m").alias("member"), "rank")


def _score_bound(text: str | float, low: bool) -> Column:
    s = str(text)
    opened = s.startswith("(")
    x = float(s[1:] if opened else s)
    c = F.col("score")
    return (c > x if opened else c >= x) if low else (c < x if opened else c <= x)


def by_score(low: str | float, high: str | float) -> Column:
    return _score_bound(low, True) & _score_bound(high, False)


def by_lex(low: str, high: str) -> Column:
    c = F.col("member")

    def bound(s: str, is_low: bool) -> Column:
        if s in "-+":
            return F.lit((s == "-") == is_low)
        if s[0] not in "[(":
            raise ValueError(f"a range of members starts with [ or (: {s}")
        if is_low:
            return c >= s[1:] if s[0] == "[" else c > s[1:]
        return c <= s[1:] if s[0] == "[" else c < s[1:]

    return bound(low, True) & bound(high, False)


def count(zsets: DataFrame, key: str, held: Column) -> DataFrame:
    return zsets.where((F.col("key") == key) & held).agg(F.count(F.lit(1)).alias("n"))


def _order(reverse: bool) -> list[Column]:
    return [F.col("score").desc(), F.col("member").desc()] if reverse else [F.col("score").asc(), F.col("member").asc()]


def range_by_rank(zsets: DataFrame, key: str, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """Members from one rank to another, negative ones from the end. A range from an end is a top-k."""
    own = zsets.where(F.col("key") == key).select("member", "score")
    if start >= 0 and stop >= 0:
        head = own.orderBy(*_order(reverse)).limit(stop + 1)
        return head.offset(start) if start else head
    if start < 0 and stop < 0 and start <= stop:
        tail = own.orderBy(*_order(not reverse)).limit(-start)
        return (tail.offset(-stop - 1) if stop < -1 else tail).orderBy(*_order(reverse))
    if start == 0 and stop == -1:
        return own.orderBy(*_order(reverse))
    n = own.count()
    first, last = max(0, start + n if start < 0 else start), min(n - 1, stop + n if stop < 0 else stop)
    if first > last:
        return own.limit(0)
    return own.orderBy(*_order(reverse)).limit(last + 1).offset(first)


def range_where(zsets: DataFrame, key: str, held: Column, reverse: bool = False, limit: tuple[int, int] | None = None) -> DataFrame:
    """Members in a range of scores or members, in order."""
    out = zsets.where((F.col("key") == key) & held).select("member", "score").orderBy(*_order(reverse))
    return out if limit is None else out.offset(limit[0]).limit(limit[1]) if limit[0] else out.limit(limit[1])


def remove_where(zsets: DataFrame, key: str, held: Column) -> DataFrame:
    return zsets.where(~((F.col("key") == key) & F.coalesce(held, F.lit(False))))


def remove_by_rank(zsets: DataFrame, key: str, start: int, stop: int) -> DataFrame:
    gone = range_by_rank(zsets, key, start, stop).select(F.lit(key).alias("key"), "member")
    return remove(zsets, gone)


def ranked(zsets: DataFrame, reverse: bool = False) -> DataFrame:
    """Every member's rank in its key."""
    return zsets.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*_order(reverse))) - 1)


def top(zsets: DataFrame, n: int, reverse: bool = True) -> DataFrame:
    """The first n of every key: a limit per group that runs before the shuffle."""
    return ranked(zsets, reverse).where(F.col("rank") < n)


def pop(zsets: DataFrame, keys: Sequence[str], count: int = 1, highest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(popped, rest): from the first of the keys that has members."""
    place = F.array_position(F.array(*map(F.lit, keys)), F.col("key"))
    first = zsets.where(F.col("key").isin(list(keys))).agg(F.min_by("key", place).alias("key")).where("key is not null")
    own = zsets.join(F.broadcast(first), "key", "left_semi")
    popped = own.orderBy(*_order(highest)).limit(count)
    return popped, remove(zsets, popped)


_FOLD = {"SUM": F.sum, "MIN": F.min, "MAX": F.max}


def _weighted(zsets: DataFrame, keys: Sequence[str], weights: Sequence[float] | None) -> DataFrame:
    weight = F.lit(None).cast("double")
    for k, w in zip(keys, weights or [1.0] * len(keys), strict=True):
        weight = F.when(F.col("key") == k, F.lit(float(w))).otherwise(weight)
    return zsets.where(F.col("key").isin(list(keys))).withColumn("score", F.col("score") * weight)


def union(zsets: DataFrame, keys: Sequence[str], weights: Sequence[float] | None = None, fold: str = "SUM") -> DataFrame:
    return _weighted(zsets, keys, weights).groupBy("member").agg(_FOLD[fold.upper()]("score").alias("score"))


def intersection(zsets: DataFrame, keys: Sequence[str], weights: Sequence[float] | None = None, fold: str = "SUM") -> DataFrame:
    both = _weighted(zsets, keys, weights).groupBy("member").agg(_FOLD[fold.upper()]("score").alias("score"), F.count_distinct("key").alias("n"))
    return both.where(F.col("n") == len(set(keys))).select("member", "score")


def difference(zsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Members of the first key alone, with its scores."""
    own = F.max(F.when(F.col("key") == keys[0], F.col("score")))
    other = F.max(F.col("key").isin(list(keys[1:]) or [""]))
    return zsets.where(F.col("key").isin(list(keys))).groupBy("member").agg(own.alias("score"), other.alias("other")).where("score is not null and not other").select("member", "score")


def intersection_size(zsets: DataFrame, keys: Sequence[str], limit: int = 0) -> DataFrame:
    size = intersection(zsets, keys).agg(F.count(F.lit(1)).alias("card"))
    return size.select(F.least("card", F.lit(limit)).alias("card")) if limit else size


def random_members(zsets: DataFrame, key: str, count: int, seed: int = 0) -> DataFrame:
    own = zsets.where(F.col("key") == key)
    return own.orderBy(F.xxhash64(F.lit(seed), F.col("member").cast("string")), "member").limit(abs(count)).select("member", "score")


def scan(zsets: DataFrame, key: str, after: object = None, match: str | None = None, count: int = 10) -> DataFrame:
    own = zsets.where(F.col("key") == key).select("member", "score")
    page = (own if after is None else own.where(F.col("member") > F.lit(after))).orderBy("member").limit(count)
    return page.where(glob(F.col("member").cast("string"), match)) if match else page
