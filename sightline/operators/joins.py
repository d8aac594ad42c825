"""Join helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within_seconds(left: DataFrame, right: DataFrame, keys: list[str], after: str, before: str, gap: float) -> DataFrame:
    """left and right (aliases a, b) with equal keys and 0 < b.before - a.after <= gap.

    The range side is cut into buckets of `gap` seconds; each right row stands in its own bucket and in the
    one before, so the join is an equi-join on keys and bucket, whatever the key's skew in time. Both sides are sorted by time within keys and bucket, which the join asks for in part anyway, so that
    a left row's pairs come one after another by time: files of many pairs are then smaller."""
    a = left.withColumn("__bucket", F.floor(F.col(after) / gap))
    own = F.floor(F.col(before) / gap)
    b = right.withColumn("__bucket", F.explode(F.array(own, own - 1)))
    on: Column = F.col("a.__bucket") == F.col("b.__bucket")
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    wait = F.col(f"b.{before}") - F.col(f"a.{after}")
    by = ["__bucket", *keys]
    # Spark drops a sort right under a join; it keeps one whose rows are counted.
    a, b = (x.repartition(*by).sortWithinPartitions(*by, t).observe(f"sorted {uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows")) for x, t in ((a, after), (b, before)))
    return a.alias("a").join(b.alias("b"), on & (wait > 0) & (wait <= gap))


def within_window(left: DataFrame, right: DataFrame, keys: list[str], after: str, before: str, low: list[float], high: list[float]) -> DataFrame:
    """left and right (aliases a, b) with equal keys, b.before > a.after and low <= b.before - a.after <= high, where the last key is the place of a pair's bounds in `low` and `high`.

    Each place has buckets of the length of its own window. A left row stands in the bucket where its window begins, a right row in its own and in the one before, so
    half of the pairs of an equi-join on keys and bucket lie in the window, whatever the number of places."""
    place, slack = keys[-1], 1e-3  # seconds: more than sums of a time and a bound are rounded by
    at = lambda values, side="": F.element_at(F.array(*[F.lit(float(x)) for x in values]), F.col(f"{side}{place}") + 1)
    width = at([h - x + 2 * slack for x, h in zip(low, high, strict=True)])
    a = left.withColumn("__cell", F.xxhash64(*keys, F.floor((F.col(after) + at([x - slack for x in low])) / width)))
    own = F.floor(F.col(before) / width)
    b = right.withColumn("__cell", F.explode(F.array(F.xxhash64(*keys, own), F.xxhash64(*keys, own - 1))))
    # One whole number is sorted and joined by; the keys are compared for each pair, in a form that is not taken for more columns to sort by.
    on: Column = F.col("a.__cell") == F.col("b.__cell")
    wait = F.col(f"b.{before}") - F.col(f"a.{after}")
    on = on & (wait > 0) & (wait >= at(low, "a.")) & (wait <= at(high, "a."))
    for k in keys:
        on = on & (F.least(f"a.{k}", f"b.{k}") == F.greatest(f"a.{k}", f"b.{k}"))
    return a.alias("a").join(b.alias("b"), on)


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], least: float) -> DataFrame:
    """left and right (aliases a, b) with equal keys whose boxes (x1, y1, x2, y2) may have an overlap over union above `least`, a number from 0 to 1; the caller still checks it.

    Corners of such boxes lie apart by 1 - least of the longest side at most. A left box is in the cell of its corner, of twice that reach, and a right one looks into the
    two cells at reach along each axis, so a box meets those around it, however many its keys have."""
    c = F.col
    side = lambda df: df.select((c("x2") - c("x1")).alias("w"), (c("y2") - c("y1")).alias("h"))
    most = side(left).union(side(right)).agg(F.max("w"), F.max("h")).first()  # one row
    cells = []
    for name, length in zip(("x1", "y1"), most, strict=True):
        reach = max(1e-6, (1 - least) * (length or 0.0) * 1.000001)
        cell = lambda x, reach=reach: F.floor(x / (2 * reach))
        left = left.withColumn(f"__{name}", cell(c(name)))
        right = right.withColumn(f"__{name}", F.explode(F.sequence(cell(c(name) - reach), cell(c(name) + reach))))
        cells.append(f"__{name}")
    on = F.lit(True)
    for k in [*keys, *cells]:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return left.alias("a").join(right.alias("b"), on)


def best(df: DataFrame, keys: list[str], order: Column, *columns: str) -> DataFrame:
    """For each key the columns of the row with the greatest order; aggregates before it shuffles."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("__b")).select(*keys, "__b.*")


def nearest_other(det: DataFrame, kind: str, other: str) -> DataFrame:
    """(event_id, nearest, apart_s): for each detection of camera `kind` the one of camera `other` of its vehicle that is nearest in time. Both windows only
    ever grow, so a vehicle's rows are gone through once forwards and once backwards."""
    det = det.where(F.col("camera").isin(kind, other))
    met = F.when(F.col("camera") == other, F.struct("t", "event_id"))
    forwards = Window.partitionBy("vehicle").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    backwards = Window.partitionBy("vehicle").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max_by(met, F.struct(met["t"], -met["event_id"])).over(forwards)
    c = det.withColumns({"last": last, "next": F.min(met).over(backwards)}).where(F.col("camera") == kind)
    before, after = F.col("t") - F.col("last.t"), F.col("next.t") - F.col("t")
    earlier = F.col("last").isNotNull() & (F.col("next").isNull() | (before <= after))
    return c.select("event_id", F.when(earlier, F.col("last.event_id")).otherwise(F.col("next.event_id")).alias("nearest"), F.round(F.when(earlier, before).otherwise(after), 3).alias("apart_s"))
