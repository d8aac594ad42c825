"""Queries on projections, scalar expressions, predicates and text matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions.expressions import angle_diff, clamp, degrees_of, haversine_m, haversine_sql, iou, iou_sql, lookup
from sightline.registry import query
from sightline.sources.tables import BOXES, CAMERAS, DET, OFFSETS, boxes, cameras, detections, read

@query("S6 F17: column pruning, confidence pushdown", f"WITH {DET} SELECT event_id, camera, round(confidence, 6) AS confidence FROM det WHERE confidence >= 0.3")
def scan_prune_filter(spark: SparkSession, d: str) -> DataFrame:
    return detections(spark, d).where(F.col("confidence") >= 0.3).select("event_id", "camera", F.round("confidence", 6).alias("confidence"))


_IDS_SQL = """ids AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'INST_' || event_id WHEN event_id % 11 = 0 THEN 'SYN_TRACK_c00' || event_id % 5 || '_V' || lpad(CAST(user_id AS VARCHAR), 4, '0')
 WHEN event_id % 13 = 0 THEN 'x_V' || user_id || '_y' ELSE 'SYN_c00' || event_id % 5 || '_V' || lpad(CAST(user_id AS VARCHAR), 4, '0') || '_' || lpad(CAST(event_id AS VARCHAR), 6, '0') END AS id FROM events)"""


@query(
    "P1 P2 P3 P4: detection and track ids, identity",
    f"""WITH {_IDS_SQL}, parsed AS (SELECT *, regexp_extract(id, '^([A-Z0-9]+)_(c\\d+)_(V\\d+)_(\\d+)$', 1) AS source, regexp_extract(id, '^([A-Z0-9]+)_(c\\d+)_(V\\d+)_(\\d+)$', 3) AS v1,
 regexp_extract(id, '^([A-Z0-9]+)_TRACK_(c\\d+)_(V\\d+)$', 3) AS v2, list_filter(string_split(id, '_'), lambda x: regexp_full_match(x, 'V\\d+')) AS segments FROM ids)
SELECT event_id, id, nullif(source, '') AS source, coalesce(nullif(v1, ''), nullif(v2, ''), segments[1], '') AS identity FROM parsed""",
)
def id_parse(spark: SparkSession, d: str) -> DataFrame:
    user, event = F.lpad(F.col("user_id").cast("string"), 4, "0"), F.col("event_id")
    made = F.when(event % 7 == 0, F.concat(F.lit("INST_"), event)).when(event % 11 == 0, F.concat(F.lit("SYN_TRACK_c00"), event % 5, F.lit("_V"), user)).when(event % 13 == 0, F.concat(F.lit("x_V"), "user_id", F.lit("_y"))).otherwise(F.concat(F.lit("SYN_c00"), event % 5, F.lit("_V"), user, F.lit("_"), F.lpad(event.cast("string"), 6, "0")))
    ids = read(spark, d, "events").select("event_id", made.alias("id"))
    target, track = r"^([A-Z0-9]+)_(c\d+)_(V\d+)_(\d+)$", r"^([A-Z0-9]+)_TRACK_(c\d+)_(V\d+)$"
    part = lambda pattern, n: F.nullif(F.regexp_extract("id", pattern, n), F.lit(""))
    segment = F.get(F.filter(F.split("id", "_"), lambda x: x.rlike(r"^V\d+$")), F.lit(0))
    return ids.select("event_id", "id", part(target, 1).alias("source"), F.coalesce(part(target, 3), part(track, 3), segment, F.lit("")).alias("identity"))


@query(
    "P8 P9: timestamp parsing in three formats, formatting with a dash for NULL",
    """WITH raw AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN strftime(ts, '%Y/%m/%d %H:%M:%S') ELSE 'at ' || event_id END AS s FROM events)
SELECT event_id, coalesce(strftime(coalesce(try_strptime(s, '%Y-%m-%d %H:%M:%S'), try_strptime(s, '%Y-%m-%dT%H:%M:%S'), try_strptime(s, '%Y/%m/%d %H:%M:%S')), '%H:%M:%S'), '--') AS clock FROM raw""",
)
def ts_parse_format(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_id") % 4
    formats = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss"]
    raw = F.coalesce(*[F.when(kind == i, F.date_format("ts", f)) for i, f in enumerate(formats)], F.concat(F.lit("at "), "event_id"))
    parsed = F.coalesce(*[F.try_to_timestamp("s", F.lit(f)) for f in formats])
    return read(spark, d, "events").select("event_id", raw.alias("s")).select("event_id", F.coalesce(F.date_format(parsed, "HH:mm:ss"), F.lit("--")).alias("clock"))


@query(
    "P11 P12: frame to time and to a clock string",
    """WITH f AS (SELECT event_id, event_id % 2000 + 1 AS frame, CASE WHEN event_type = 'error' THEN 8 ELSE 10 END AS fps FROM events)
SELECT event_id, CAST((frame - 1) * 1000000 // fps AS BIGINT) AS offset_us, lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock FROM (SELECT *, frame // fps AS s FROM f)""",
)
def frame_to_ts(spark: SparkSession, d: str) -> DataFrame:
    frame, fps = F.col("event_id") % 2000 + 1, F.when(F.col("event_type") == "error", 8).otherwise(10)
    s = F.floor(frame / fps).cast("int")
    return read(spark, d, "events").select("event_id", F.floor((frame - 1) * 1_000_000 / fps).cast("long").alias("offset_us"), F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s / 60).cast("int") % 60, s % 60).alias("clock"))


_OFFSETS_SQL = "offsets(camera, offset_s) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in OFFSETS.items()) + ")"


@query("P13 P14: local to global time, alignment flag", f"WITH {DET}, {_OFFSETS_SQL} SELECT event_id, round(t + coalesce(offset_s, 0), 3) AS global_t, offset_s IS NOT NULL AS aligned FROM det LEFT JOIN offsets USING (camera)")
def clock_align(spark: SparkSession, d: str) -> DataFrame:
    offset = lookup(F.col("camera"), OFFSETS)
    return detections(spark, d).select("event_id", F.round(F.col("t") + F.coalesce(offset, F.lit(0.0)), 3).alias("global_t"), offset.isNotNull().alias("aligned"))


@query(
    "P15 P16 P50 P51: distances, headings and travel times of camera pairs of a scene",
    f"""WITH {CAMERAS}, p AS (SELECT a.camera AS a, b.camera AS b, {haversine_sql("a.lat", "a.lon", "b.lat", "b.lon")} AS m, least(abs(a.heading - b.heading) % 360, 360 - abs(a.heading - b.heading) % 360) AS turn
 FROM cameras a JOIN cameras b ON a.scene = b.scene AND a.camera <> b.camera)
SELECT a, b, round(m, 3) AS metres, turn, round(m / (40 / 3.6), 3) AS eta_s, round(m / (80 / 3.6), 3) AS fastest_s, round(m / (20 / 3.6), 3) AS slowest_s FROM p""",
)
def haversine_pairs(spark: SparkSession, d: str) -> DataFrame:
    cams = cameras(spark, d)
    pairs = cams.alias("x").join(cams.alias("y"), (F.col("x.scene") == F.col("y.scene")) & (F.col("x.camera") != F.col("y.camera")))
    m = haversine_m(F.col("x.lat"), F.col("x.lon"), F.col("y.lat"), F.col("y.lon"))
    at = lambda kmh: F.round(m / (kmh / 3.6), 3)
    return pairs.select(F.col("x.camera").alias("a"), F.col("y.camera").alias("b"), F.round(m, 3).alias("metres"), angle_diff(F.col("x.heading"), F.col("y.heading")).alias("turn"), at(40).alias("eta_s"), at(80).alias("fastest_s"), at(20).alias("slowest_s"))


@query("P20 P21: overlap of the boxes of neighbouring frames of a track", f"WITH {BOXES} SELECT a.track, a.frame, round({iou_sql('a', 'b')}, 6) AS iou FROM boxes a JOIN boxes b ON a.track = b.track AND b.frame = a.frame + 1")
def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    pairs = b.alias("a").join(b.alias("b"), (F.col("a.track") == F.col("b.track")) & (F.col("b.frame") == F.col("a.frame") + 1))
    return pairs.select(F.col("a.track").alias("track"), F.col("a.frame").alias("frame"), F.round(iou("a", "b"), 6).alias("iou"))


@query(
    "P23 A17: boxes over the frame size of their camera",
    f"""WITH {BOXES}, size AS (SELECT camera, max(CAST(floor(x2) AS BIGINT)) AS w, max(CAST(floor(y2) AS BIGINT)) AS h FROM boxes GROUP BY camera)
SELECT track, frame, round((x1 + x2) / 2 / w, 6) AS cx, round((y1 + y2) / 2 / h, 6) AS cy, round((x2 - x1) / w, 6) AS nw, round((y2 - y1) / h, 6) AS nh FROM boxes JOIN size USING (camera)""",
)
def bbox_norm(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    size = b.groupBy("camera").agg(F.max(F.floor("x2")).alias("w"), F.max(F.floor("y2")).alias("h"))
    r = lambda x, name: F.round(x, 6).alias(name)
    x1, y1, x2, y2, w, h = (F.col(c) for c in ("x1", "y1", "x2", "y2", "w", "h"))
    return b.join(F.broadcast(size), "camera").select("track", "frame", r((x1 + x2) / 2 / w, "cx"), r((y1 + y2) / 2 / h, "cy"), r((x2 - x1) / w, "nw"), r((y2 - y1) / h, "nh"))


@query(
    "P24 P25: movement sector of a track from its first to its last box, sides of entry and exit",
    f"""WITH {BOXES}, e AS (SELECT track, arg_min((x1 + x2) / 2, {{'f': frame, 'x': x1, 'y': y1}}) AS ax, arg_min((y1 + y2) / 2, {{'f': frame, 'x': x1, 'y': y1}}) AS ay, arg_max((x1 + x2) / 2, {{'f': frame, 'x': x1, 'y': y1}}) AS bx, arg_max((y1 + y2) / 2, {{'f': frame, 'x': x1, 'y': y1}}) AS "by" FROM boxes GROUP BY track),
a AS (SELECT *, degrees(atan2(-("by" - ay), bx - ax)) AS angle FROM e)
SELECT track, CASE WHEN ax = bx AND ay = "by" THEN 'unknown' WHEN angle >= -45 AND angle < 45 THEN 'east' WHEN angle >= 45 AND angle < 135 THEN 'north' WHEN angle >= -135 AND angle < -45 THEN 'south' ELSE 'west' END AS direction,
 CASE WHEN ax / 1070 < 0.33 THEN 'left' WHEN ax / 1070 < 0.66 THEN 'centre' ELSE 'right' END AS entry, CASE WHEN bx / 1070 < 0.33 THEN 'left' WHEN bx / 1070 < 0.66 THEN 'centre' ELSE 'right' END AS exit FROM a""",
)
def direction_sector(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    at = F.struct("frame", "x1", "y1")
    e = b.groupBy("track").agg(F.min_by(cx, at).alias("ax"), F.min_by(cy, at).alias("ay"), F.max_by(cx, at).alias("bx"), F.max_by(cy, at).alias("by"))
    angle = degrees_of(-(F.col("by") - F.col("ay")), F.col("bx") - F.col("ax"))
    still = (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by"))
    sector = F.when(still, "unknown").when((angle >= -45) & (angle < 45), "east").when((angle >= 45) & (angle < 135), "north").when((angle >= -135) & (angle < -45), "south").otherwise("west")
    side = lambda x: F.when(F.col(x) / 1070 < 0.33, "left").when(F.col(x) / 1070 < 0.66, "centre").otherwise("right")
    return e.select("track", sector.alias("direction"), side("ax").alias("entry"), side("bx").alias("exit"))


@query("P44: argmax over a probability array with a threshold", "SELECT vec_id, CASE WHEN list_max(embedding) >= 0.3 THEN CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) END AS best FROM embeddings")
def argmax_threshold(spark: SparkSession, d: str) -> DataFrame:
    top = F.array_max("embedding")
    return read(spark, d, "embeddings").select("vec_id", F.when(top >= 0.3, F.array_position("embedding", top) - 1).alias("best"))


@query(
    "P38: type by aspect",
    f"""WITH {BOXES} SELECT track, frame, CASE WHEN r >= 2.5 THEN 'bus' WHEN r >= 1.8 THEN 'sedan' WHEN r >= 1.2 THEN 'suv' WHEN r >= 0.8 THEN 'van' ELSE 'other' END AS kind
FROM (SELECT *, (x2 - x1) * (y2 - y1) AS a, (x2 - x1) / (y2 - y1) AS r FROM boxes)""",
)
def aspect_type(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return boxes(spark, d).select("track", "frame", F.when(w / h >= 2.5, "bus").when(w / h >= 1.8, "sedan").when(w / h >= 1.2, "suv").when(w / h >= 0.8, "van").otherwise("other").alias("kind"))


@query(
    "P33 P34 P36: freshness against a given time, quality fusion",
    f"""WITH {DET} SELECT event_id, round(least(greatest(exp(-abs(t - 1706572800) / 3600), 0), 1), 6) AS freshness,
 round(least(greatest(0.3 / (1 + exp(-(k * 10 - 100) / 80.0)) + 0.3 * confidence + 0.2 * (1 - confidence) + 0.2 * (k % 10) / 10.0, 0), 1), 6) AS quality FROM det""",
)
def freshness_quality(spark: SparkSession, d: str) -> DataFrame:
    c, k = F.col("confidence"), F.col("k")
    fresh = clamp(F.exp(-F.abs(F.col("t") - 1_706_572_800) / 3600))
    quality = clamp(0.3 / (1 + F.exp(-(k * 10 - 100) / 80.0)) + 0.3 * c + 0.2 * (1 - c) + 0.2 * (k % 10) / 10.0)
    return detections(spark, d).select("event_id", F.round(fresh, 6).alias("freshness"), F.round(quality, 6).alias("quality"))


@query(
    "P42: plate cleaning and pattern",
    """WITH raw AS (SELECT c_custkey, 'AB' || chr(65 + CAST(c_custkey % 26 AS INT)) || '-' || lpad(CAST(c_custkey AS VARCHAR), CAST(3 + c_custkey % 4 AS INT), '0') || '.' || c_nationkey AS raw FROM customer)
SELECT c_custkey, nullif(regexp_extract(regexp_replace(raw, '[^A-Z0-9]', '', 'g'), '(AB[E-Z][A-Z0-9]{4,5})$', 1), '') AS plate FROM raw""",
)
def plate_clean(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    raw = F.concat(F.lit("AB"), F.chr(65 + key % 26), F.lit("-"), F.expr("lpad(cast(c_custkey as string), cast(3 + c_custkey % 4 as int), '0')"), F.lit("."), "c_nationkey")
    clean = F.regexp_replace(raw, "[^A-Z0-9]", "")
    return read(spark, d, "customer").select("c_custkey", F.nullif(F.regexp_extract(clean, "(AB[E-Z][A-Z0-9]{4,5})$", 1), F.lit("")).alias("plate"))


@query("J10: null-tolerant inequality, missing tokens as NULL", f"WITH {DET}, x AS (SELECT event_id, CASE WHEN k % 5 = 0 THEN NULL ELSE k % 3 END AS a, nullif(CASE WHEN k % 4 = 0 THEN 'unknown' ELSE camera END, 'unknown') AS c FROM det) SELECT event_id FROM x WHERE (a IS NULL OR a = 1) AND (c IS NULL OR c <> 'click')")
def null_tolerant_filter(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    x = detections(spark, d).select("event_id", F.when(k % 5 != 0, k % 3).alias("a"), F.when(k % 4 != 0, F.col("camera")).alias("c"))
    return x.where((F.col("a").isNull() | (F.col("a") == 1)) & (F.col("c").isNull() | (F.col("c") != "click"))).select("event_id")


@query("F10: substring search, first 20 and the total, by one scan", "WITH hit AS (SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '7')) SELECT c_custkey, c_name, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY c_custkey LIMIT 20")
def substring_search(spark: SparkSession, d: str) -> DataFrame:
    """Each partition keeps its first 20 and its count; what is put together is 20 rows and a number for each."""
    hit = read(spark, d, "customer").where(F.lower("c_name").contains("7")).select("c_custkey", "c_name")
    own = hit.withColumn("p", F.spark_partition_id())
    part = own.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("c_custkey"))).groupBy("p").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("r") <= 20, F.struct("c_custkey", "c_name"))).alias("first"))
    both = part.agg(F.sum("n").alias("total"), F.slice(F.sort_array(F.flatten(F.collect_list("first"))), 1, 20).alias("first"))
    return both.select("total", F.explode("first").alias("x")).select("x.*", "total")

