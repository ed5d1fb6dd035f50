"""Geo sets: sorted sets whose score is a 52-bit cell, kept with their coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import geo as G


def add(rows: DataFrame) -> DataFrame:
    """(key, member, lon, lat) with its cell as score; coordinates become the cell's centre."""
    valid = F.col("lon").between(-180, 180) & F.col("lat").between(-G.LATITUDE_LIMIT, G.LATITUDE_LIMIT)
    cell = F.when(valid, G.encode(F.col("lon"), F.col("lat"))).otherwise(F.raise_error(F.lit("invalid longitude, latitude pair")).cast("bigint"))
    x, y = G.decode(F.col("score"))
    return rows.withColumn("score", cell).withColumns({"lon": x, "lat": y})


def positions(places: DataFrame, key: str, members: Sequence[str]) -> DataFrame:
    asked = places.sparkSession.createDataFrame(list(enumerate(members)), "ordinal int, member string")
    own = places.where((F.col("key") == key) & F.col("member").isin(list(members))).select("member", "lon", "lat")
    return asked.join(own, "member", "left").select("ordinal", "member", "lon", "lat").orderBy("ordinal")


def distance(places: DataFrame, key: str, one: str, two: str, unit: str = "m") -> DataFrame:
    """Rounded to four decimals; no row unless both are there."""
    own = places.where((F.col("key") == key) & F.col("member").isin(one, two))
    at = lambda m, c: F.max(F.when(F.col("member") == m, F.col(c))).alias(f"{c}{'1' if m == one else '2'}")
    both = own.agg(*[at(m, c) for m in dict.fromkeys((one, two)) for c in ("lon", "lat")])
    second = "1" if one == two else "2"
    d = G.haversine(F.col("lon1"), F.col("lat1"), F.col(f"lon{second}"), F.col(f"lat{second}"), G.SET_RADIUS) / G.UNITS[unit]
    return both.where(f"lon1 is not null and lon{second} is not null").select(F.round(d, 4).alias("distance"))


def hashes(places: DataFrame) -> DataFrame:
    return places.withColumn("geohash", G.geohash(F.col("lon"), F.col("lat")))


def _centre(places: DataFrame, key: str, member: str) -> tuple[float, float]:
    found = places.where((F.col("key") == key) & (F.col("member") == member)).select("lon", "lat").first()
    if found is None:
        raise KeyError(member)
    return found["lon"], found["lat"]


def search(
    places: DataFrame,
    key: str,
    *,
    member: str | None = None,
    lonlat: tuple[float, float] | None = None,
    radius: float | None = None,
    box: tuple[float, float] | None = None,
    unit: str = "m",
    order: str | None = None,
    count: int | None = None,
    any_order: bool = False,
) -> DataFrame:
    """member, distance (in the unit), score, lon, lat of what lies in a radius or a box.

    A count without any_order implies nearest first; DESC turns both keys around. Ties go by member.
    """
    x, y = lonlat if lonlat is not None else _centre(places, key, member)
    scale = G.UNITS[unit]
    lon, lat = F.col("lon"), F.col("lat")
    held: Column = G.within_radius(lon, lat, x, y, radius * scale, G.SET_RADIUS) if radius is not None else G.within_box(lon, lat, x, y, box[0] * scale, box[1] * scale)
    found = places.where((F.col("key") == key) & held).select(
        "member", (G.haversine(F.lit(float(x)), F.lit(float(y)), lon, lat, G.SET_RADIUS) / scale).alias("distance"), "score", "lon", "lat"
    )
    if order is None and count is not None and not any_order:
        order = "ASC"
    if order is not None:
        found = found.orderBy(*[c.desc() if order.upper() == "DESC" else c.asc() for c in (F.col("distance"), F.col("member"))])
    return found if count is None else found.limit(count)


def search_store(places: DataFrame, destination: str, key: str, store_distance: bool = False, **options) -> DataFrame:
    """The search result as a sorted set: cells or distances as scores."""
    found = search(places, key, **options)
    return found.select(F.lit(destination).alias("key"), "member", (F.col("distance") if store_distance else F.col("score").cast("double")).alias("score"))
