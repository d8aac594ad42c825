"""Streaming queries run to the end of the input (availableNow), and order-dependent operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators.ordered import constrained_union, identity_f1
from sightline.plans.vectors import ranked
from sightline.registry import query
from sightline.session import shared_folder
from sightline.sources.tables import detections, read
from sightline.streaming.registry import Registry, kept_by
from sightline.streaming.sessions import frame_tracklets, session_states, track_objects, tracklet_sessions


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.readStream.schema(read(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _drained(stream: DataFrame, mode: str, path: str | None = None) -> DataFrame:
    """What a stream has written when its input is used up, in the shared folder. With the path of an earlier run it goes on from there."""
    spark = stream.sparkSession
    path = path or f"{shared_folder(spark)}/sightline-stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(f"{path}/rows")


@query(
    "X2 X6: tracklets by streaming session windows; at the end of the input the open ones are closed",
    """WITH e AS (SELECT user_id AS vehicle, event_type AS camera, ts, least(value / 500, 1.0) AS confidence, epoch_us(ts) / 1e6 AS t FROM events), c AS (SELECT *, CASE WHEN t - lag(t) OVER w >= 21600 THEN 1 ELSE 0 END AS cut FROM e WINDOW w AS (PARTITION BY vehicle, camera ORDER BY t)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY vehicle, camera ORDER BY t ROWS UNBOUNDED PRECEDING) AS seg FROM c) SELECT vehicle, camera, round(min(t), 3) AS start_s, round(max(t) + 21600, 3) AS end_s, count(*) AS n, round(avg(confidence), 9) AS confidence FROM s GROUP BY vehicle, camera, seg""",
)
def tracklet_stream(spark: SparkSession, d: str) -> DataFrame:
    """A second source has one row after all others once the first is used up: it moves the watermark past every session."""
    base = f"{shared_folder(spark)}/sightline-stream-{uuid.uuid4().hex}"
    schema = "vehicle long, camera string, ts timestamp_ntz, confidence double"
    spark.createDataFrame([], schema).write.parquet(f"{base}/end")

    def sessions() -> DataFrame:
        rows = _events(spark, d).select(F.col("user_id").alias("vehicle"), F.col("event_type").alias("camera"), "ts", F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"))
        return tracklet_sessions(rows.unionByName(spark.readStream.schema(schema).parquet(f"{base}/end")))

    _drained(sessions(), "append", base)
    spark.sql("select -1L vehicle, '' camera, timestamp_ntz'9000-01-01 00:00:00' ts, 0D confidence").write.mode("append").parquet(f"{base}/end")
    out = _drained(sessions(), "append", base).where("vehicle >= 0")
    second = lambda c: F.round(F.unix_micros(c) / F.lit(1e6), 3)
    return out.select("vehicle", "camera", second("start").alias("start_s"), second("end").alias("end_s"), "n", F.round("confidence", 9).alias("confidence"))


@query(
    "X2: tracklets by each camera's clock of frames: one ends with the first frame without it",
    """WITH b AS (SELECT l_suppkey % 20 AS camera, l_orderkey % 500 AS frame, l_partkey % 5 AS track, l_discount AS confidence FROM lineitem), c AS (SELECT camera, frame, dense_rank() OVER (PARTITION BY camera ORDER BY frame) AS step FROM (SELECT DISTINCT camera, frame FROM b)),
i AS (SELECT camera, track, frame, step, step - row_number() OVER (PARTITION BY camera, track ORDER BY step) AS island FROM (SELECT DISTINCT camera, track, frame, step FROM b JOIN c USING (camera, frame)))
SELECT camera, track, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n, round(avg(confidence), 9) AS confidence FROM i JOIN b USING (camera, track, frame) GROUP BY camera, track, island""",
)
def frame_clock_tracklets(spark: SparkSession, d: str) -> DataFrame:
    """When the boxes are used up, a second source moves each camera's clock two frames on: an empty one, and one that shows it is whole."""
    base = f"{shared_folder(spark)}/sightline-stream-{uuid.uuid4().hex}"
    schema = "camera long, frame long, track long, confidence double"
    spark.createDataFrame([], schema).write.parquet(f"{base}/end")
    lines = read(spark, d, "lineitem")

    def tracklets() -> DataFrame:
        rows = spark.readStream.schema(lines.schema).option("pathGlobFilter", "lineitem.parquet").parquet(d)
        boxes = rows.select((F.col("l_suppkey") % 20).alias("camera"), (F.col("l_orderkey") % 500).alias("frame"), (F.col("l_partkey") % 5).alias("track"), F.col("l_discount").alias("confidence"))
        return frame_tracklets(boxes.unionByName(spark.readStream.schema(schema).parquet(f"{base}/end")))

    _drained(tracklets(), "append", base)
    ends = lines.select((F.col("l_suppkey") % 20).alias("camera")).distinct()
    ends.select("camera", F.explode(F.array(F.lit(1 << 40), F.lit((1 << 40) + 1))).alias("frame"), F.lit(None).cast("long").alias("track"), F.lit(None).cast("double").alias("confidence")).write.mode("append").parquet(f"{base}/end")
    return _drained(tracklets(), "append", base).select("camera", "track", "first_frame", "last_frame", "n", F.round("confidence", 9).alias("confidence"))


@query(
    "X3: a registry kept by upserts and deletes of a stream",
    "WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS event, max(event_id) AS seq, arg_max(value, event_id) AS value FROM events GROUP BY user_id) SELECT user_id AS key, seq, round(value, 6) AS value FROM l WHERE event <> 'error'",
)
def registry_upserts(spark: SparkSession, d: str) -> DataFrame:
    """An `error` deletes."""
    path = f"{shared_folder(spark)}/sightline-registry-{uuid.uuid4().hex}"
    registry = Registry(spark, path, ["key"], "seq", "key long, seq long, value double, gone boolean")
    kept_by(_events(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "value", (F.col("event_type") == "error").alias("gone")), registry)
    return registry.table().select("key", "seq", F.round("value", 6).alias("value"))


@query("X4: the sessions that a bound of 100 keeps, by last access", "SELECT user_id AS session, max(event_id) AS last FROM events GROUP BY user_id ORDER BY last DESC LIMIT 100")
def kept_sessions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy(F.col("user_id").alias("session")).agg(F.max("event_id").alias("last")).orderBy(F.desc("last")).limit(100)


@query("X4: sessions through the state machine")
def session_fsm(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(x) for x in ("searched", "confirmed", "traced", "reported")]), (F.col("event_id") % 4 + 1).cast("int"))
    rows = _events(spark, d).select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), name.alias("event"))
    out = _drained(session_states(rows), "update")
    return out.groupBy("session").agg(F.max_by(F.struct("state", "refused"), "__batch").alias("s")).select("session", "s.*")


@query("X1: multi-object tracking of boxes by camera")
def tracker_stream(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.readStream.schema(read(spark, d, "lineitem").schema).option("pathGlobFilter", "lineitem.parquet").parquet(d)
    x, y, w = (F.col("l_partkey") % 1000).cast("double"), (F.col("l_suppkey") % 700).cast("double"), F.col("l_quantity") + 20
    rows = lines.select(F.concat(F.lit("c"), F.col("l_orderkey") % 997).alias("camera"), (F.floor(F.col("l_orderkey") / 997) * 8 + F.col("l_linenumber")).alias("frame"), x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + w).alias("y2"))
    return _drained(track_objects(rows), "append").drop("__batch", "batch")


@query("G16: constrained union of similar detections in each scene")
def union_find(spark: SparkSession, d: str) -> DataFrame:
    # Neighbours of one scene only, so that a node has one scene.
    same = ranked(spark, d, 40).where("q % 7 = g % 7")
    edges = same.select((F.col("q") % 7).alias("scene"), F.col("q").alias("a"), (F.col("q") % 5).alias("camera_a"), F.col("g").alias("b"), (F.col("g") % 5).alias("camera_b"), F.col("s").alias("score"))
    return constrained_union(edges)


@query("A30 J21: identity F1 by optimal assignment in each scene")
def idf1_assignment(spark: SparkSession, d: str) -> DataFrame:
    counts = detections(spark, d).groupBy((F.col("vehicle") % 10).alias("scene"), F.col("vehicle").alias("gt"), (F.col("vehicle") % 10 * 1000 + F.col("k") % 7).alias("pred")).agg(F.count("*").alias("n"))
    return identity_f1(counts)
