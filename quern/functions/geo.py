"""Geographic expressions: haversine distance, interleaved cells, geohash, shapes."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two radii in metres, units, latitude limit of cells.
SET_RADIUS, SEARCH_RADIUS = 6372797.560856, 6371000.0
UNITS = {"m": 1.0, "km": 1000.0, "mi": 1609.34, "ft": 0.3048}
LATITUDE_LIMIT = 85.05112878
STEPS = 26
_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float) -> Column:
    """Metres between two points."""
    a, b = F.radians(lat1), F.radians(lat2)
    u, v = F.sin((b - a) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return 2.0 * radius * F.asin(F.sqrt(u * u + F.cos(a) * F.cos(b) * v * v))


def within_radius(lon: Column, lat: Column, x: float, y: float, metres: float, radius: float) -> Column:
    """A latitude band that scans can use, and the exact distance."""
    import math

    band = math.degrees(metres / radius) * 1.000001
    return lat.between(y - band, y + band) & (haversine(F.lit(float(x)), F.lit(float(y)), lon, lat, radius) <= metres)


def within_box(lon: Column, lat: Column, x: float, y: float, width: float, height: float, radius: float = SET_RADIUS) -> Column:
    """Inside a box of so many metres around a point."""
    up = haversine(lon, F.lit(float(y)), lon, lat, radius) <= height / 2
    along = haversine(F.lit(float(x)), lat, lon, lat, radius) <= width / 2
    return up & along


def _cell_axis(x: Column, low: float, high: float) -> Column:
    return F.least(F.floor((x - low) / (high - low) * (1 << STEPS)), F.lit((1 << STEPS) - 1)).cast("long")


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x with x computed once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _step(x: Column, shift: int, mask: int, left: bool) -> Column:
    moved = F.shiftleft if left else F.shiftright
    return _let(x, lambda v: v.bitwiseOR(moved(v, shift)).bitwiseAND(F.lit(mask)))


def _spread(x: Column) -> Column:
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = _step(x, shift, mask, True)
    return x


def _gather(x: Column) -> Column:
    x = x.bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = _step(x, shift, mask, False)
    return x


def _interleaved(lon: Column, lat: Column, limit: float) -> Column:
    return _spread(_cell_axis(lat, -limit, limit)).bitwiseOR(F.shiftleft(_spread(_cell_axis(lon, -180.0, 180.0)), 1))


def encode(lon: Column, lat: Column) -> Column:
    """52-bit cell: longitude bits over latitude bits, interleaved."""
    return _interleaved(lon, lat, LATITUDE_LIMIT)


def decode(cell: Column) -> tuple[Column, Column]:
    """(lon, lat) of a cell's centre."""
    y, x = _gather(cell), _gather(F.shiftright(cell, 1))
    axis = lambda i, low, high: low + (i + 0.5) / (1 << STEPS) * (high - low)
    return axis(x, -180.0, 180.0), axis(y, -LATITUDE_LIMIT, LATITUDE_LIMIT)


def geohash(lon: Column, lat: Column) -> Column:
    """Eleven characters: ten of the standard hash on latitudes to 90 degrees, then 0."""

    def char(bits: Column, i: int) -> Column:
        return F.substring(F.lit(_ALPHABET), (F.shiftright(bits, 52 - 5 * (i + 1)).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))

    return _let(_interleaved(lon, lat, 90.0), lambda bits: F.concat(*[char(bits, i) for i in range(10)], F.lit("0")))


def parse_wkt(text: str) -> tuple[str, list[list[tuple[float, float]]]]:
    m = re.fullmatch(r"\s*(POINT|POLYGON)\s*\((.*)\)\s*", text, re.IGNORECASE | re.DOTALL)
    if not m:
        raise ValueError(f"not a point or polygon: {text}")
    rings = re.findall(r"\(([^()]*)\)", m[2]) if m[1].upper() == "POLYGON" else [m[2]]
    return m[1].upper(), [[tuple(map(float, p.split())) for p in ring.split(",")] for ring in rings]


def _inside(x: float, y: float, rings: list[list[tuple[float, float]]]) -> bool:
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            if cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return True  # the border belongs to the shape
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def _crosses(one: list[tuple[float, float]], two: list[tuple[float, float]]) -> bool:
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    for a, b in zip(one, one[1:] + one[:1], strict=True):
        for c, d in zip(two, two[1:] + two[:1], strict=True):
            if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                return True
    return False


def covers(outer: str, inner: str) -> bool:
    kind, rings = parse_wkt(outer)
    inner_kind, parts = parse_wkt(inner)
    if kind == "POINT":
        return inner_kind == "POINT" and rings == parts
    if not all(_inside(x, y, rings) for x, y in parts[0]):
        return False
    return inner_kind == "POINT" or not any(_crosses(r, parts[0]) for r in rings)


def shape_predicate(relation: str, wkt: str) -> Callable[[Column], Column]:
    """WITHIN: the column's shape lies in wkt; CONTAINS: it contains wkt."""
    parse_wkt(wkt)
    test = (lambda s: covers(wkt, s)) if relation == "WITHIN" else (lambda s: covers(s, wkt))

    def safe(s: str | None) -> bool:
        try:
            return s is not None and test(s)
        except ValueError:
            return False

    @F.pandas_udf("boolean")
    def matches(shapes: pd.Series) -> pd.Series:
        return shapes.map(safe).astype(bool)

    return matches
