"""Queries on joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions.expressions import haversine_m, haversine_sql
from sightline.operators.joins import best, within_seconds
from sightline.registry import query
from sightline.sources.tables import CAMERAS, DET, TRACKLETS, cameras, detections, read, tracklets

GAP = 600.0


@query("J1: detections with their track, left outer", "SELECT l_orderkey, l_linenumber, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def track_left_join(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"))
    return read(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", "status")


@query("J14: new keys only", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join_new_keys(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query(
    "J25: for each part the supplier that shares most order lines",
    "SELECT l_partkey, l_suppkey AS supplier, n FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) AS r FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE r = 1",
)
def best_overlap(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return best(n.withColumnRenamed("l_suppkey", "supplier"), ["l_partkey"], F.struct("n", -F.col("supplier")), "supplier", "n")


@query("J12: consecutive stays", f'WITH {TRACKLETS} SELECT vehicle, camera AS source, lead(camera) OVER w AS target, round(lead(start) OVER w - "end", 3) AS gap_s FROM tracklets WINDOW w AS (PARTITION BY vehicle ORDER BY start, camera)')
def consecutive_join(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("vehicle").orderBy("start", "camera")
    return tracklets(spark, d).select("vehicle", F.col("camera").alias("source"), F.lead("camera").over(w).alias("target"), F.round(F.lead("start").over(w) - F.col("end"), 3).alias("gap_s"))


@query(
    "as-of join: the last purchase up to each click of the same vehicle",
    f"WITH {DET}, c AS (SELECT * FROM det WHERE camera = 'click'), p AS (SELECT * FROM det WHERE camera = 'purchase') SELECT c.event_id, max(p.t) IS NOT NULL AS found, round(c.t - max(p.t), 3) AS wait_s FROM c LEFT JOIN p ON c.vehicle = p.vehicle AND p.t <= c.t GROUP BY c.event_id, c.t",
)
def asof_join(spark: SparkSession, d: str) -> DataFrame:
    """One window over both kinds of rows, with no pair of them: the last purchase up to each click."""
    det = detections(spark, d).where(F.col("camera").isin("click", "purchase"))
    rank = F.when(F.col("camera") == "purchase", 0).otherwise(1)
    w = Window.partitionBy("vehicle").orderBy("t", rank).rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("camera") == "purchase", F.col("t"))).over(w)
    return det.withColumn("last", last).where("camera = 'click'").select("event_id", F.col("last").isNotNull().alias("found"), F.round(F.col("t") - F.col("last"), 3).alias("wait_s"))


_SCENES = TRACKLETS + ", s AS (SELECT *, vehicle % 10 AS scene FROM tracklets)"


@query(
    "candidate pairs by scene, order and time range alone",
    f"""WITH {_SCENES} SELECT a.vehicle AS source, a.camera AS source_camera, b.vehicle AS target, b.camera AS target_camera, a.day, round(b.start - a."end", 3) AS gap_s, a.vehicle = b.vehicle AS same
FROM s a JOIN s b ON a.scene = b.scene AND a.camera <> b.camera AND b.start > a."end" AND b.start - a."end" <= {GAP}""",
)
def range_join_edges(spark: SparkSession, d: str) -> DataFrame:
    s = tracklets(spark, d).withColumn("scene", F.col("vehicle") % 10)
    pairs = within_seconds(s, s, ["scene"], "end", "start", GAP).where(F.col("a.camera") != F.col("b.camera"))
    return pairs.select(F.col("a.vehicle").alias("source"), F.col("a.camera").alias("source_camera"), F.col("b.vehicle").alias("target"), F.col("b.camera").alias("target_camera"), F.col("a.day").alias("day"), F.round(F.col("b.start") - F.col("a.end"), 3).alias("gap_s"), (F.col("a.vehicle") == F.col("b.vehicle")).alias("same"))


@query(
    "J9 J11: edges through plate and appearance gates; a longer gap asks for more",
    f"""WITH {_SCENES}, e AS (SELECT a.vehicle AS source, b.vehicle AS target, a.camera AS source_camera, b.camera AS target_camera, a.day, b.start - a."end" AS gap, nullif(a.k % 4, 0) AS pa, nullif(b.k % 4, 0) AS pb, abs(a.confidence - b.confidence) AS diff
 FROM s a JOIN s b ON a.scene = b.scene AND a.camera <> b.camera AND b.start > a."end" AND b.start - a."end" <= {GAP})
SELECT source, source_camera, target, target_camera, day, round(1 - diff, 6) AS appearance FROM e WHERE (pa IS NULL OR pb IS NULL OR pa = pb) AND 1 - diff >= CASE WHEN gap > 100 THEN least(0.85, 0.7 + 0.1) ELSE 0.7 END""",
)
def gated_edges(spark: SparkSession, d: str) -> DataFrame:
    s = tracklets(spark, d).withColumn("scene", F.col("vehicle") % 10)
    pairs = within_seconds(s, s, ["scene"], "end", "start", GAP).where(F.col("a.camera") != F.col("b.camera"))
    plate = lambda x: F.nullif(F.col(f"{x}.k") % 4, F.lit(0))
    gap, look = F.col("b.start") - F.col("a.end"), 1 - F.abs(F.col("a.confidence") - F.col("b.confidence"))
    gate = (plate("a").isNull() | plate("b").isNull() | (plate("a") == plate("b"))) & (look >= F.when(gap > 100, F.least(F.lit(0.85), F.lit(0.8))).otherwise(0.7))
    return pairs.where(gate).select(F.col("a.vehicle").alias("source"), F.col("a.camera").alias("source_camera"), F.col("b.vehicle").alias("target"), F.col("b.camera").alias("target_camera"), F.col("a.day").alias("day"), F.round(look, 6).alias("appearance"))


@query("J17: cameras within a radius, nearest first", f"WITH {CAMERAS}, r AS (SELECT camera, name, {haversine_sql('42.0::DOUBLE', '-90.0::DOUBLE', 'lat', 'lon')} AS m FROM cameras) SELECT camera, name, round(m, 3) AS metres FROM r WHERE m <= 4000")
def radius_search(spark: SparkSession, d: str) -> DataFrame:
    m = haversine_m(F.lit(42.0), F.lit(-90.0), F.col("lat"), F.col("lon"))
    return cameras(spark, d).withColumn("m", m).where("m <= 4000").orderBy("m").select("camera", "name", F.round("m", 3).alias("metres"))


@query("F11: cameras by id, direction, scene and box", f"WITH {CAMERAS} SELECT camera, camera IN (3, 7, 12) AS by_id, heading BETWEEN 45 AND 135 AS by_direction, scene = 2 AS by_scene, lat BETWEEN 41.99 AND 42.01 AND lon BETWEEN -89.98 AND -89.94 AS by_box FROM cameras WHERE camera IN (3, 7, 12) OR heading BETWEEN 45 AND 135 OR scene = 2 OR (lat BETWEEN 41.99 AND 42.01 AND lon BETWEEN -89.98 AND -89.94)")
def camera_filters(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    checks = {"by_id": c("camera").isin(3, 7, 12), "by_direction": c("heading").between(45, 135), "by_scene": c("scene") == 2, "by_box": c("lat").between(41.99, 42.01) & c("lon").between(-89.98, -89.94)}
    return cameras(spark, d).withColumns(checks).where("by_id or by_direction or by_scene or by_box").select("camera", *checks)


@query(
    "F13: tracklets by identity, camera, plate and type that overlap an interval",
    f"""WITH {TRACKLETS} SELECT vehicle, camera, day FROM tracklets WHERE "end" >= 1704672000 AND start <= 1704844800 AND vehicle BETWEEN 10 AND 120 AND camera IN ('click', 'view', 'error') AND vehicle % 4 <> 0 AND vehicle % 7 <> 0""",
)
def overlap_filter(spark: SparkSession, d: str) -> DataFrame:
    """The plate is known where the vehicle isn't divisible by 4, its type is not that of pedestrians."""
    t = tracklets(spark, d).where((F.col("end") >= 1_704_672_000) & (F.col("start") <= 1_704_844_800))
    return t.where(F.col("vehicle").between(10, 120) & F.col("camera").isin("click", "view", "error") & (F.col("vehicle") % 4 != 0) & (F.col("vehicle") % 7 != 0)).orderBy("start").select("vehicle", "camera", "day")


@query("F14 F15 F16: identities seen by at least two cameras three times", f"WITH {DET} SELECT vehicle, count(*) AS n, count(DISTINCT camera) AS cameras FROM det WHERE confidence >= 0.5 GROUP BY vehicle HAVING count(DISTINCT camera) >= 2 AND count(*) >= 3")
def having_multi_camera(spark: SparkSession, d: str) -> DataFrame:
    return detections(spark, d).where("confidence >= 0.5").groupBy("vehicle").agg(F.count("*").alias("n"), F.countDistinct("camera").alias("cameras")).where("cameras >= 2 and n >= 3")


@query(
    "J19: best edge of each unordered pair, either orientation",
    "WITH e AS (SELECT o_custkey % 50 AS a, o_orderkey % 50 AS b, o_totalprice AS score FROM orders) SELECT least(a, b) AS low, greatest(a, b) AS high, round(max(score), 2) AS score FROM e WHERE a <> b GROUP BY 1, 2",
)
def best_edge_of_pair(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "orders").select((F.col("o_custkey") % 50).alias("a"), (F.col("o_orderkey") % 50).alias("b"), F.col("o_totalprice").alias("score"))
    return e.where("a <> b").groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.round(F.max("score"), 2).alias("score"))
