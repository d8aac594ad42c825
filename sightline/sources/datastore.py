"""The column store of results (detections, tracks), its JSON fallback, and text sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "1"
VERSION_KEY = "sightline.schema_version"

DETECTIONS = (
    "target_id string, track_id string, camera_id string, scene_id string, frame_id int, timestamp string, target_type string, confidence double, "
    "bbox array<double>, attributes string, keyframe_path string, clip_image_vector array<double>"
)
TRACKS = "track_id string, target_type string, scene_id string, frame_range array<int>, camera_ids array<string>, detection_count int, vehicle_id int, attributes string"


def build(detections: DataFrame, tracks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet (zstd) tables, detections by scene, vectors in a table of their own, and a table of counts.

    attributes may be a struct or a map; it is kept as JSON text, so rows of mixed types fit."""
    kinds = dict(detections.dtypes)
    if kinds.get("attributes", "string") != "string":
        detections = detections.withColumn("attributes", F.to_json("attributes"))
    if dict(tracks.dtypes).get("attributes", "string") != "string":
        tracks = tracks.withColumn("attributes", F.to_json("attributes"))
    vectors = detections.where(F.col("clip_image_vector").isNotNull()).select("target_id", "clip_image_vector")
    detections.drop("clip_image_vector").write.mode(mode).option("compression", "zstd").partitionBy("scene_id").parquet(f"{path}/detections")
    tracks.write.mode(mode).option("compression", "zstd").parquet(f"{path}/tracks")
    vectors.write.mode(mode).option("compression", "zstd").parquet(f"{path}/vectors")
    stats = detections.agg(F.count("*").alias("detections"), F.countDistinct("track_id").alias("tracks"), F.countDistinct("camera_id").alias("cameras"))
    stats.withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.mode(mode).parquet(f"{path}/meta")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything stands at a path of any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def available(spark: SparkSession, path: str) -> bool:
    """Whether a store of this version stands at path."""
    if not exists(spark, f"{path}/meta"):
        return False
    row = spark.read.parquet(f"{path}/meta").first()
    return row is not None and row["schema_version"] == SCHEMA_VERSION


def source_label(spark: SparkSession, path: str | None, json_path: str | None = None) -> str:
    """Datastore, json or none."""
    if path and available(spark, path):
        return "datastore"
    return "json" if json_path and exists(spark, json_path) and spark.read.text(json_path).head(1) else "none"


def load_detections(spark: SparkSession, path: str | None, json_path: str | None = None, with_vectors: bool = False) -> DataFrame | None:
    """From the store if it is valid, else from a JSON document of results, else None. Vectors join by id only if asked for."""
    kind = source_label(spark, path, json_path)
    if kind == "datastore":
        found = spark.read.parquet(f"{path}/detections")
        return found.join(spark.read.parquet(f"{path}/vectors"), "target_id", "left") if with_vectors else found
    if kind == "json":
        rows = spark.read.option("multiLine", True).schema(f"detections array<struct<{_struct(DETECTIONS)}>>").json(json_path)
        return rows.select(F.explode("detections").alias("d")).select("d.*")
    return None


def counts_by_scene(spark: SparkSession, path: str) -> DataFrame:
    """(scene_id, detections, first_frame, last_frame) from the footers of the data files alone: the aggregate is pushed into the scan, which then reads no row group."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    found = own.read.parquet(f"{path}/detections").groupBy("scene_id")
    return found.agg(F.count("*").alias("detections"), F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"))


def write_records(records: DataFrame, path: str, key: str, text: str = "record") -> None:
    """(key, JSON text of an object) as (key, VARIANT, present keys). Values keep the type that each record gives them, so columns of mixed types need no common one;
    the keys tell a value of null from one that isn't there. Text that isn't an object has NULL for both."""
    body = F.try_parse_json(text)
    keys = F.json_object_keys(text)
    records.select(key, F.when(keys.isNotNull(), body).alias("record"), F.sort_array(keys).alias("present")).write.parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The rows of write_records; field() takes values out of them."""
    return spark.read.parquet(path)


def field(name: str, kind: str = "string") -> Column:
    """A record's value of a name as a kind (NULL where it isn't of that kind, is null, or isn't there)."""
    return F.try_variant_get("record", f"$.{name}", kind)


def state_of(name: str) -> Column:
    """`absent`, `null` or `value`, for a name in a record."""
    there = F.array_contains("present", name)
    return F.when(~F.coalesce(there, F.lit(False)), "absent").when(F.is_variant_null(F.try_variant_get("record", f"$.{name}", "variant")), "null").otherwise("value")


def kind_of(name: str) -> Column:
    """The type of a record's value as SQL text."""
    return F.schema_of_variant(F.try_variant_get("record", f"$.{name}", "variant"))


def load_stats(spark: SparkSession, path: str) -> DataFrame:
    """The counts kept beside the data; no data file is read."""
    return spark.read.parquet(f"{path}/meta").drop("schema_version")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as bags of rows."""
    return a.exceptAll(b.select(a.columns)).isEmpty() and b.select(a.columns).exceptAll(a).isEmpty()


def _struct(ddl: str) -> str:
    return ", ".join(f"{c.split(' ', 1)[0]}: {c.split(' ', 1)[1]}" for c in ddl.split(", "))


def read_mot(spark: SparkSession, path: str, width: float | None = None, height: float | None = None) -> DataFrame:
    """MOT ground truth; malformed lines are dropped; boxes as corners, cut at the frame if its size is given; boxes outside of it go."""
    raw = spark.read.schema("frame int, id int, left double, top double, w double, h double, conf double, x double, y double, z double").option("mode", "DROPMALFORMED").csv(path)
    rows = raw.where("frame is not null and id is not null").select("frame", "id", F.col("left").alias("x1"), F.col("top").alias("y1"), (F.col("left") + F.col("w")).alias("x2"), (F.col("top") + F.col("h")).alias("y2"))
    if width is None or height is None:
        return rows
    cut = lambda c, most: F.least(F.greatest(c, F.lit(0.0)), F.lit(float(most))).alias(c)
    return rows.select("frame", "id", cut("x1", width), cut("y1", height), cut("x2", width), cut("y2", height)).where("x2 > x1 and y2 > y1")


def read_global_truth(spark: SparkSession, path: str) -> DataFrame:
    """Camera, id, frame and box, by commas or blanks."""
    part = F.split(F.trim(F.regexp_replace("value", "[,\\s]+", " ")), " ")
    rows = spark.read.text(path).where(F.size(part) >= 7)
    return rows.select(*[part[i].cast("int").alias(n) for i, n in enumerate(("camera", "id", "frame"))], *[part[i + 3].cast("double").alias(n) for i, n in enumerate("xywh")])


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """(scene, part): the blank-separated parts of each line that is neither empty nor a comment; scene is that of a folder `scene=...`, else the file's name without ending."""
    line = F.trim("value")
    folder = F.regexp_extract(F.col("_metadata.file_path"), "/scene=([^/]+)/", 1)
    scene = F.when(folder != "", folder).otherwise(F.regexp_extract(F.col("_metadata.file_name"), "^([^.]+)", 1))
    return spark.read.text(path).select(scene.alias("scene"), line.alias("line")).where("line <> '' and line not like '#%'").select("scene", F.split("line", "\\s+").alias("part"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(scene, camera, value) of lines `camera value` of many files; lines whose value isn't a number are left out."""
    rows = _parts(spark, path).where(F.size("part") >= 2).select("scene", F.col("part")[0].alias("camera"), F.col("part")[1].try_cast("double").alias("value"))
    return rows.where("value is not null")


def read_frame_counts(spark: SparkSession, path: str) -> DataFrame:
    """(camera, frames) of lines `camera frames` or `camera first last`; others are left out."""
    p = F.col("part")
    number = lambda i: F.try_element_at(p, F.lit(i + 1)).try_cast("long")
    frames = F.when(F.size(p) >= 3, number(2) - number(1) + 1).otherwise(number(1))
    return _parts(spark, path).where(F.size(p) >= 2).select(p[0].alias("camera"), frames.alias("frames")).where("frames is not null")


def read_camera_list(spark: SparkSession, path: str) -> DataFrame:
    """(scene, camera) of lines `camera scene` or `scene camera`; a scene begins with S, else it is the last part."""
    p = F.col("part")
    scenes, others = F.filter(p, lambda x: x.startswith("S")), F.filter(p, lambda x: ~x.startswith("S"))
    return _parts(spark, path).where(F.size(p) >= 2).select(F.when(F.size(scenes) > 0, scenes[0]).otherwise(F.element_at(p, -1)).alias("scene"), F.when(F.size(others) > 0, F.get(others, F.lit(0))).otherwise(p[0]).alias("camera"))


def read_baseline(spark: SparkSession, path: str, least: float = 0.3) -> DataFrame:
    """Detections of a CSV file with confidence of `least` or more."""
    return spark.read.schema("camera string, frame int, x1 double, y1 double, x2 double, y2 double, label string, confidence double").option("header", True).csv(path).where(F.col("confidence") >= least)


CONFIGURATION = "cameras array<struct<camera_id: string, name: string, scene: string, latitude: double, longitude: double, direction: string>>, adjacency map<string, array<string>>"


def read_configuration(spark: SparkSession, path: str) -> DataFrame:
    """A row of CONFIGURATION for each YAML (or JSON) file of cameras and adjacency. Files are parsed in tasks, by PyYAML; where it isn't
    installed, only JSON, which is YAML too, can be read."""
    import json

    def parse(batches):
        import pandas as pd

        try:
            from yaml import safe_load
        except ImportError:
            safe_load = json.loads
        for pdf in batches:
            yield pd.DataFrame({"body": [json.dumps(safe_load(bytes(x).decode()) or {}, default=str) for x in pdf["content"]]})

    files = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "body string")
    return files.select(F.from_json("body", CONFIGURATION).alias("c")).select("c.*")


def topology(config: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cameras, adjacency) of read_configuration's rows; a camera without an id is left out."""
    c = config.select(F.explode("cameras").alias("c")).select("c.*").where("camera_id <> ''")
    cams = c.select(F.col("camera_id").alias("camera"), F.coalesce("name", "camera_id").alias("name"), "scene", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "direction")
    return cams, config.select(F.explode("adjacency").alias("a", "near")).select("a", F.explode("near").alias("b"))


def offsets_with_fallback(pairs: DataFrame, scenes: DataFrame) -> DataFrame:
    """(scene, camera, value) for each scene and camera: the scene's own value, else that of the first scene (by name) that has the camera."""
    first = pairs.groupBy("camera").agg(F.min_by("value", "scene").alias("other"))
    own = scenes.join(pairs, ["scene", "camera"], "left").join(first, "camera", "left")
    return own.select("scene", "camera", F.coalesce("value", "other").alias("value"))


def decoded(df: DataFrame, column: str = "attributes") -> DataFrame:
    """JSON text as a map; text that isn't JSON gives NULL."""
    return df.withColumn(column, F.from_json(column, "map<string, string>"))


def verified(index: DataFrame, column: str) -> DataFrame:
    """One row of checks: rows, rows without a vector, rows whose length is neither 0 nor 1."""
    from sightline.functions.expressions import dot

    n = F.sqrt(dot(column, column))
    return index.agg(F.count("*").alias("n"), F.count_if(F.col(column).isNull()).alias("empty"), F.count_if((n > 1e-9) & (F.abs(n - 1) > 1e-6)).alias("bad"))


def save_tracklets(df: DataFrame, path: str) -> None:
    """S19 (the reader is spark.read.json)."""
    df.write.mode("overwrite").json(path)


def vector_index(df: DataFrame, column: str) -> DataFrame:
    """Unit vectors; a zero vector stays zero."""
    from sightline.functions.expressions import normalised

    return df.withColumn(column, normalised(column))
