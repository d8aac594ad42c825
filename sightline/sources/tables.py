"""Domain views over the tables: detections, tracklets, boxes and cameras."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Clock offsets of cameras in seconds; a camera without one is not aligned.
OFFSETS = {"click": 0.0, "error": 1.64, "purchase": 29.955, "signup": 165.568}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str | Column) -> Column:
    """Seconds since 1970 of a timestamp without time zone."""
    return F.unix_micros(F.to_utc_timestamp(F.col(ts) if isinstance(ts, str) else ts, F.current_timezone())) / F.lit(1e6)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, vehicle, camera, ts, t (seconds), confidence, k."""
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("vehicle"),
        F.col("event_type").alias("camera"),
        "ts",
        (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / F.lit(1e6)).alias("t"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


DET = """det AS (SELECT event_id, user_id AS vehicle, event_type AS camera, ts, epoch_us(ts) / 1e6 AS t, least(value / 500, 1.0) AS confidence,
 CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""


def tracklets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each vehicle, camera and day: start, end, n, confidence, k of the first detection."""
    det = detections(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86400))
    return det.groupBy("vehicle", "camera", "day").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.min_by("k", F.struct("t", "event_id")).alias("k"))


TRACKLETS = (
    DET
    + """, tracklets AS (SELECT vehicle, camera, day, min(t) AS start, max(t) AS "end", count(*) AS n, avg(confidence) AS confidence, arg_min(k, {'t': t, 'e': event_id}) AS k
 FROM (SELECT *, CAST(floor(t / 86400) AS BIGINT) AS day FROM det) GROUP BY vehicle, camera, day)"""
)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as boxes of a track (the order) in frames (line numbers)."""
    x, y = F.col("l_partkey") % 1000, F.col("l_suppkey") % 700
    w, h = 20 + F.col("l_quantity"), F.col("l_quantity") * (1 + F.col("l_discount") * 5)
    line = read(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("track"), F.col("l_linenumber").alias("frame"), F.col("l_linestatus").alias("camera"), F.col("l_returnflag").alias("colour"), x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + w).alias("x2"), (y + 10 + h).alias("y2"))


BOXES = """boxes AS (SELECT l_orderkey AS track, l_linenumber AS frame, l_linestatus AS camera, l_returnflag AS colour,
 CAST(l_partkey % 1000 AS DOUBLE) AS x1, CAST(l_suppkey % 700 AS DOUBLE) AS y1, l_partkey % 1000 + 20 + l_quantity AS x2,
 l_suppkey % 700 + 10 + l_quantity * (1 + l_discount * 5) AS y2 FROM lineitem)"""


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as cameras of scenes (regions), with made-up coordinates and lane directions."""
    key = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(key.alias("camera"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("scene"), (F.lit(42.0) + key % 5 * 0.004).alias("lat"), (F.lit(-90.0) + key * 0.003).alias("lon"), (key * 45 % 360).cast("double").alias("heading"))


CAMERAS = """cameras AS (SELECT n_nationkey AS camera, n_name AS name, n_regionkey AS scene, 42.0::DOUBLE + n_nationkey % 5 * 0.004::DOUBLE AS lat,
 -90.0::DOUBLE + n_nationkey * 0.003::DOUBLE AS lon, CAST(n_nationkey * 45 % 360 AS DOUBLE) AS heading FROM nation)"""


def picked(values: list, index: Column) -> Column:
    """The value at a place of a fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sql_text(value: str | float | bool | None) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)


def picked_sql(values: list, index: str) -> str:
    return f"list_value({', '.join(map(sql_text, values))})[CAST({index} AS INT) + 1]"


#: Query texts as users type them, and endings.
TEXTS = [
    "蓝色背包的男人", "白色面包车", "苏E12345 轿车", "黑色越野车", "深色小车", "红色大巴车和电动车", "穿红色衣服的女人", "背红色书包的女人", "浅色大家伙", "戴帽子的人",
    "黑裤子男人", "一辆重型货车", "小电驴", "suv", "银灰轿车", "金属色客车", "戴墨镜的行人", "白色小货车", "暖色 truck", "由北向南的皮卡", "car 向北", "粉色三轮车", "", "夜里的车", "pickup red 朝东 fast",
]
ENDINGS = ["", " 蓝裤子", " 手提包", " 苏F00A1Z", " 白色", " 旧 van", " 冷色公交"]


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): a query text for each part."""
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(key.alias("id"), F.trim(F.concat(picked(TEXTS, key % len(TEXTS)), picked(ENDINGS, F.floor(key / len(TEXTS)) % len(ENDINGS)))).alias("text"))


QUERY_TEXTS = f"texts AS (SELECT p_partkey AS id, trim({picked_sql(TEXTS, f'p_partkey % {len(TEXTS)}')} || {picked_sql(ENDINGS, f'p_partkey // {len(TEXTS)} % {len(ENDINGS)}')}) AS text FROM part)"

#: Attributes of made-up instances: each a list whose values go round over the order lines.
ATTRIBUTES: dict[str, tuple[str, list]] = {
    "target_type": ("l_partkey % 7", ["vehicle", "vehicle", "vehicle", "non_motor_vehicle", "pedestrian", "vehicle", "non_motor_vehicle"]),
    "color": ("l_partkey % 11", ["白色", "乳白", "黑色", "深蓝", "红色", "unknown", None, "银灰", "金色", "灰色", "咖啡色"]),
    "vehicle_type": ("l_suppkey % 13", ["轿车", "两厢车", "SUV", "suv", "重型货车", "卡车", "公交车", "unknown", None, "电动车", "三蹦子", "面包车", "大巴"]),
    "gender": ("l_orderkey % 5", ["male", "female", None, "unknown", "male"]),
    "clothing_color": ("l_orderkey % 6", ["红色", "蓝色", None, "unknown", "黑色", "白色"]),
    "accessory": ("l_linenumber % 4", ["帽子", "眼镜", None, "unknown"]),
    "bag": ("l_linenumber % 3", [True, False, None]),
    "plate": ("l_suppkey % 9", ["苏E12345", None, "苏F00A1Z", "苏E12345", None, "苏G99999", "苏E1234", "苏E54321", None]),
    "lane": ("l_suppkey % 5", ["eastbound", "westbound", "northbound", "southbound", None]),
}


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, line, attributes...) of made-up instances."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), *[picked(values, F.expr(place)).alias(name) for name, (place, values) in ATTRIBUTES.items()])


INSTANCES = "inst AS (SELECT l_orderkey AS id, l_linenumber AS line, " + ", ".join(f"{picked_sql(values, place)} AS {name}" for name, (place, values) in ATTRIBUTES.items()) + " FROM lineitem)"
