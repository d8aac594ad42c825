"""Queries on sources and sinks: what is written to the shared folder is read back by the library's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.registry import query
from sightline.session import shared_folder
from sightline.sources import datastore as store
from sightline.sources.tables import read


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/sightline-{name}-{uuid.uuid4().hex}"


def result_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Detections with attributes as maps and vectors for some, and their tracks."""
    e = read(spark, d, "events")
    track = F.concat(F.lit("T"), "user_id")
    attributes = F.map_from_arrays(F.array(F.lit("color"), F.lit("k")), F.array("event_type", F.get_json_object("props", "$.k")))
    det = e.select(
        F.concat(F.lit("D"), "event_id").alias("target_id"),
        track.alias("track_id"),
        F.col("event_type").alias("camera_id"),
        F.concat(F.lit("S0"), F.col("user_id") % 5).alias("scene_id"),
        F.col("event_id").cast("int").alias("frame_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.lit("vehicle").alias("target_type"),
        F.col("value").alias("confidence"),
        F.array("value", "value").alias("bbox"),
        F.when(F.col("event_id") % 3 != 0, attributes).alias("attributes"),
        F.lit(None).cast("string").alias("keyframe_path"),
        F.when(F.col("event_id") % 4 == 0, F.array("value", F.lit(1.0))).alias("clip_image_vector"),
    )
    tracks = e.select(track.alias("track_id"), F.lit("vehicle").alias("target_type")).distinct()
    return det, tracks


@query(
    "J16 S1 S2 S9 S10 S22: results written to the column store and read back, attributes decoded, vectors by id",
    "SELECT 'D' || event_id AS target_id, 'S0' || user_id % 5 AS scene_id, value AS confidence, CASE WHEN event_id % 3 <> 0 THEN event_type END AS color, CASE WHEN event_id % 3 <> 0 THEN json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 4 = 0 THEN value END AS vector FROM events",
)
def store_rows(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "store")
    store.build(*result_rows(spark, d), path)
    rows = store.decoded(store.load_detections(spark, path, with_vectors=True))
    return rows.select("target_id", "scene_id", "confidence", F.col("attributes")["color"].alias("color"), F.col("attributes")["k"].alias("k"), F.col("clip_image_vector")[0].alias("vector"))


@query(
    "S4 S5 S12 A16: states of a store and of what stands in its place, counts kept beside the data, equality of what was read",
    "SELECT false AS before, true AS after, 'none' AS source_before, 'datastore' AS source_after, count(*) AS detections, count(DISTINCT user_id) AS tracks, count(DISTINCT event_type) AS cameras, true AS same FROM events",
)
def store_states(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "store")
    det, tracks = result_rows(spark, d)
    before, label = store.available(spark, path), store.source_label(spark, path)
    store.build(det, tracks, path)
    again = store.load_detections(spark, path, with_vectors=True)
    same = store.same_rows(det.withColumn("attributes", F.to_json("attributes")), again)
    stats = store.load_stats(spark, path)
    return stats.select(F.lit(before).alias("before"), F.lit(store.available(spark, path)).alias("after"), F.lit(label).alias("source_before"), F.lit(store.source_label(spark, path)).alias("source_after"), "detections", "tracks", "cameras", F.lit(same).alias("same"))


@query("S7: counts and frames of each scene of a store, from the files' footers", "SELECT 'S0' || user_id % 5 AS scene_id, count(*) AS detections, CAST(min(event_id) AS INT) AS first_frame, CAST(max(event_id) AS INT) AS last_frame FROM events GROUP BY 1")
def store_footers(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "store")
    store.build(*result_rows(spark, d), path)
    return store.counts_by_scene(spark, path)


@query(
    "S8 S11: records of mixed types written and read: what is absent, null or a value, and of which type",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'value' WHEN 1 THEN 'null' ELSE 'absent' END AS color_state, CASE WHEN event_id % 5 = 0 THEN event_type END AS color,
 CASE event_id % 5 WHEN 0 THEN 'BIGINT' WHEN 1 THEN 'STRING' WHEN 2 THEN 'ARRAY<BIGINT>' END AS size_kind, CASE WHEN event_id % 5 = 0 THEN user_id END AS size FROM events""",
)
def mixed_records(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "records")
    n = F.col("event_id") % 5
    text = F.when(n == 0, F.format_string('{"color": "%s", "size": %d}', "event_type", "user_id")).when(n == 1, '{"size": "big", "color": null}').when(n == 2, '{"size": [1, 2]}').when(n == 3, "{}").otherwise("no object")
    store.write_records(read(spark, d, "events").select("event_id", text.alias("record")), path, "event_id")
    return store.read_records(spark, path).select("event_id", store.state_of("color").alias("color_state"), store.field("color").alias("color"), store.kind_of("size").alias("size_kind"), store.field("size", "long").alias("size"))


@query("S3 S5: a JSON document of results, read where no store stands", "SELECT 'N' || n_nationkey AS target_id, n_name AS camera_id, n_regionkey / 10.0 AS confidence, 'json' AS source FROM nation")
def json_results(spark: SparkSession, d: str) -> DataFrame:
    """The document is that of a dimension, since one JSON document is one task's input."""
    path = _folder(spark, "json")
    rows = read(spark, d, "nation").select(F.struct(F.concat(F.lit("N"), "n_nationkey").alias("target_id"), F.col("n_name").alias("camera_id"), (F.col("n_regionkey") / 10.0).alias("confidence")).alias("x"))
    rows.agg(F.to_json(F.struct(F.collect_list("x").alias("detections"))).alias("value")).coalesce(1).write.text(path)
    found = store.load_detections(spark, f"{path}/none", path)
    return found.select("target_id", "camera_id", "confidence", F.lit(store.source_label(spark, f"{path}/none", path)).alias("source"))


@query(
    "S13 P22: MOT ground truth with malformed lines, boxes cut at the frame",
    "WITH b AS (SELECT l_orderkey AS frame, l_partkey % 90 AS id, l_suppkey % 300 - 20.0 AS x, l_partkey % 200 - 10.0 AS y, l_quantity AS w FROM lineitem WHERE l_linenumber % 5 <> 0) SELECT CAST(frame AS INT) AS frame, CAST(id AS INT) AS id, least(greatest(x, 0), 250)::DOUBLE AS x1, least(greatest(y, 0), 180)::DOUBLE AS y1, least(greatest(x + w, 0), 250)::DOUBLE AS x2, least(greatest(y + w, 0), 180)::DOUBLE AS y2 FROM b WHERE least(x + w, 250) > greatest(x, 0) AND least(y + w, 180) > greatest(y, 0)",
)
def mot_truth(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "mot")
    line = read(spark, d, "lineitem")
    text = F.concat_ws(",", "l_orderkey", (F.col("l_partkey") % 90), (F.col("l_suppkey") % 300 - 20), (F.col("l_partkey") % 200 - 10), "l_quantity", "l_quantity", F.lit("1,-1,-1,-1"))
    line.select(F.when(F.col("l_linenumber") % 5 == 0, "not a line").otherwise(text).alias("value")).write.text(path)
    return store.read_mot(spark, path, 250, 180)


@query("S14: global ground truth, by commas or by blanks", "SELECT CAST(l_suppkey AS INT) AS camera, CAST(l_partkey AS INT) AS id, CAST(l_linenumber AS INT) AS frame, l_quantity::DOUBLE AS x, 1.0::DOUBLE AS y, 2.5::DOUBLE AS w, 3.0::DOUBLE AS h FROM lineitem WHERE l_orderkey % 4 <> 0")
def global_truth(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "truth")
    parts = [F.col(c).cast("string") for c in ("l_suppkey", "l_partkey", "l_linenumber", "l_quantity")]
    rest = [F.lit(x) for x in ("1", "2.5", "3", "0")]
    value = F.when(F.col("l_orderkey") % 4 == 0, "too short").when(F.col("l_orderkey") % 4 == 1, F.concat_ws(",", *parts, *rest)).otherwise(F.concat_ws("  ", *parts, *rest))
    read(spark, d, "lineitem").select(value.alias("value")).write.text(path)
    return store.read_global_truth(spark, path)


@query(
    "S15 S18: clock offsets of scenes and cameras from text files, the first scene's where a scene has none",
    "WITH p AS (SELECT n_regionkey AS scene, n_nationkey % 8 AS camera, min(n_nationkey) / 4.0 AS value FROM nation WHERE n_nationkey % 3 <> 0 GROUP BY ALL), s AS (SELECT scene, camera FROM (SELECT unnest(range(0, 5)) AS scene), (SELECT unnest(range(0, 9)) AS camera)), f AS (SELECT camera, arg_min(value, scene) AS other FROM p GROUP BY camera) SELECT 'S0' || s.scene AS scene, 'c00' || s.camera AS camera, coalesce(value, other)::DOUBLE AS value FROM s LEFT JOIN p USING (scene, camera) LEFT JOIN f USING (camera)",
)
def clock_offsets(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "offsets")
    p = read(spark, d, "nation").where("n_nationkey % 3 <> 0").groupBy(F.col("n_regionkey").alias("scene"), (F.col("n_nationkey") % 8).alias("camera")).agg((F.min("n_nationkey") / 4.0).alias("value"))
    line = F.concat(F.lit("c00"), "camera", F.lit(" "), "value")
    lines = p.select(F.concat(F.lit("S0"), "scene").alias("scene"), F.explode(F.array(line, F.concat(F.lit("# "), line), F.concat(line, F.lit(" later")), F.lit("broken"))).alias("value"))
    lines.where("value not like '% later'").write.partitionBy("scene").text(path)
    scenes = spark.range(45).select(F.concat(F.lit("S0"), F.floor(F.col("id") / 9)).alias("scene"), F.concat(F.lit("c00"), F.col("id") % 9).alias("camera"))
    return store.offsets_with_fallback(store.read_pairs(spark, path), scenes)


@query(
    "S15: frame counts of cameras, whole or from first to last frame, and the cameras of each scene, from text files",
    """WITH f AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 3 ELSE s_suppkey * 2 + 1 END AS frames FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT 'S0' || (k % 5) AS scene, count(*) AS cameras, CAST(sum(frames) AS BIGINT) AS frames, string_agg('c' || k, ',' ORDER BY 'c' || k) AS names FROM f GROUP BY 1""",
)
def camera_frames(spark: SparkSession, d: str) -> DataFrame:
    counts, lists = _folder(spark, "frames"), _folder(spark, "cameras")
    k = F.col("s_suppkey")
    s = read(spark, d, "supplier")
    name = F.concat(F.lit("c"), k)
    span = F.when(k % 7 == 0, F.concat(name, F.lit(" some"))).when(k % 2 == 0, F.concat_ws(" ", name, k * 3)).otherwise(F.concat_ws(" ", name, k, k * 3))
    s.select(span.alias("value")).union(spark.sql("select '# a comment'")).write.text(counts)
    scene = F.concat(F.lit("S0"), k % 5)
    s.select(F.when(k % 2 == 0, F.concat_ws("  ", name, scene)).otherwise(F.concat_ws(" ", scene, name)).alias("value")).write.text(lists)
    both = store.read_frame_counts(spark, counts).join(store.read_camera_list(spark, lists), "camera")
    names = F.array_join(F.sort_array(F.collect_list("camera")), ",")  # the cameras of one scene
    return both.groupBy("scene").agg(F.count("*").alias("cameras"), F.sum("frames").alias("frames"), names.alias("names"))


@query("S16: baseline detections of a CSV file from a confidence on", "SELECT 'c' || l_suppkey AS camera, CAST(l_linenumber AS INT) AS frame, l_quantity::DOUBLE AS x1, l_discount AS confidence FROM lineitem WHERE l_discount >= 0.03")
def baseline_csv(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "csv")
    line = read(spark, d, "lineitem")
    rows = line.select(F.concat(F.lit("c"), "l_suppkey").alias("camera"), F.col("l_linenumber").alias("frame"), F.col("l_quantity").alias("x1"), F.lit(0).alias("y1"), F.lit(1).alias("x2"), F.lit(1).alias("y2"), F.lit("car").alias("label"), F.col("l_discount").alias("confidence"))
    rows.write.option("header", True).csv(path)
    return store.read_baseline(spark, path, 0.03).select("camera", "frame", "x1", "confidence")


@query(
    "S17: cameras and adjacency of a configuration, neighbours counted",
    "SELECT a.n_name AS camera_id, a.n_regionkey AS scene, count(b.n_nationkey) AS neighbours FROM nation a LEFT JOIN nation b ON b.n_regionkey = a.n_regionkey AND b.n_nationkey > a.n_nationkey GROUP BY ALL",
)
def configured_topology(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "topology")
    n = read(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("scene"), F.col("n_nationkey").alias("key"))
    later = n.select("scene", F.col("name").alias("b"), F.col("key").alias("other"))
    near = n.join(later, "scene").where("other > key").groupBy("name").agg(F.sort_array(F.collect_list("b")).alias("near"))
    # A configuration file of a few hundred cameras: one document in one row.
    camera = F.struct(F.col("name").alias("camera_id"), F.col("scene").cast("string").alias("scene"))
    beside = F.struct("name", F.coalesce("near", F.array().cast("array<string>")))
    document = F.struct(F.collect_list(camera).alias("cameras"), F.map_from_entries(F.collect_list(beside)).alias("adjacency"))
    n.join(near, "name", "left").agg(F.to_json(document).alias("value")).write.text(path)
    cams, near = store.topology(store.read_configuration(spark, path))
    n = near.groupBy(F.col("a").alias("camera")).agg(F.count("*").alias("n"))
    return cams.join(n, "camera", "left").select(F.col("camera").alias("camera_id"), F.col("scene").cast("int").alias("scene"), F.coalesce("n", F.lit(0).cast("long")).alias("neighbours"))


@query("S19: tracklets as JSON and back", "SELECT user_id AS vehicle, event_type AS camera, count(*) AS n FROM events GROUP BY ALL")
def tracklet_json(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "tracklets")
    store.save_tracklets(read(spark, d, "events").groupBy(F.col("user_id").alias("vehicle"), F.col("event_type").alias("camera")).agg(F.count("*").alias("n")), path)
    return spark.read.schema("vehicle long, camera string, n long").json(path)


@query(
    "S20: unit vectors verified: how many, how many are missing, how many have another length, with some spoilt on purpose",
    "SELECT count(*) AS n, count(*) FILTER (vec_id % 50 = 9) AS empty, count(*) FILTER (vec_id % 50 = 7 AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) > 0) AS bad FROM embeddings",
)
def vector_index_check(spark: SparkSession, d: str) -> DataFrame:
    unit = store.vector_index(read(spark, d, "embeddings"), "embedding")
    spoilt = F.when(F.col("vec_id") % 50 == 7, F.transform("embedding", lambda x: x * 2)).when(F.col("vec_id") % 50 != 9, F.col("embedding"))
    return store.verified(unit.withColumn("embedding", spoilt), "embedding")
