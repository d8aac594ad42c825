"""Scalar expressions over columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def rounded(x: Column, digits: int) -> Column:
    """x rounded as SQL's engines do, by the double x * 10^digits; Spark's round goes by the decimal digits and takes 0.575 up where its double times 100 is below 57.5."""
    return F.round(x * 10.0**digits) / 10.0**digits


def degrees_of(dy: Column, dx: Column) -> Column:
    """degrees(atan2(dy, dx)), rounded right next to the diagonals: the angle there is pi / 4 or 3 pi / 4, in two parts, and a small rest. The JVM's atan2 may be off by
    the last digit, which puts a direction just beside a diagonal on it."""
    a, b = F.abs(dy), F.abs(dx)
    rest = F.atan2(a - b, a + b)
    size = F.when(dx < 0, 2.356194490192345 + (9.184850993605148e-17 - rest)).otherwise(0.7853981633974483 + (3.061616997868383e-17 + rest))
    return F.when(dy < 0, -F.degrees(size)).otherwise(F.degrees(size))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


HAVERSINE_SQL = "2 * 6371000.0::DOUBLE * atan2(sqrt({a}), sqrt(1 - ({a})))"


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return HAVERSINE_SQL.format(a=a)


def angle_diff(a: Column, b: Column) -> Column:
    d = F.abs(a - b) % 360
    return F.least(d, 360 - d)


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes in columns a_x1, ... and b_x1, ...; 0 without a union."""
    c = lambda side, x: F.col(f"{side}.{x}")
    area = lambda s: (c(s, "x2") - c(s, "x1")) * (c(s, "y2") - c(s, "y1"))
    w = F.greatest(F.lit(0.0), F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1")))
    h = F.greatest(F.lit(0.0), F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1")))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


IOU_SQL = """CASE WHEN {u} > 0 THEN {i} / ({u}) ELSE 0 END"""


def iou_sql(a: str, b: str) -> str:
    i = f"greatest(0.0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    u = f"({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {i}"
    return IOU_SQL.format(u=u, i=i)


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    """0 where a norm is 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def normalised(v: str) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def lookup(x: Column, table: dict) -> Column:
    """The value of a fixed small table, NULL if there is none."""
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), x)


def gauss(x: Column, mean: float | Column, sigma: float | Column) -> Column:
    return F.exp(-F.pow(x - mean, 2) / (2 * F.pow(F.lit(sigma) if isinstance(sigma, float) else sigma, 2)))
