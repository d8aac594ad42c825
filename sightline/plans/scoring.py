"""Queries on edge scores and score fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.expressions import clamp
from sightline.operators.scores import ASKED_WEIGHTS, WEIGHTS, consistency, plate_score, redistributed, spatial_score, temporal_score
from sightline.registry import query
from sightline.sources.tables import DET, TRACKLETS, detections, picked, picked_sql, tracklets

_EDGES = TRACKLETS + """, o AS (SELECT *, lead(start) OVER w AS next_start, lead(k) OVER w AS next_k, lead(confidence) OVER w AS next_confidence FROM tracklets WINDOW w AS (PARTITION BY vehicle ORDER BY start, camera)),
e AS (SELECT vehicle, camera, day, next_start - "end" AS gap, CASE WHEN k % 5 = 0 THEN NULL ELSE (k + 1) * 100.0 END AS distance, nullif(k % 4, 0) AS pa, nullif(next_k % 4, 0) AS pb,
 CASE WHEN k % 2 = 0 THEN (1 - abs(confidence - next_confidence)) END AS reid, abs(k * 45 - next_k * 45) % 360 AS turn FROM o WHERE next_start IS NOT NULL)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive stays with what the scores need: gap, distance (maybe unknown), plates, appearance, turn."""
    from pyspark.sql import Window

    w = Window.partitionBy("vehicle").orderBy("start", "camera")
    o = tracklets(spark, d).withColumns({f"next_{c}": F.lead(c).over(w) for c in ("start", "k", "confidence")}).where("next_start is not null")
    k = F.col("k")
    return o.select("vehicle", "camera", "day", (F.col("next_start") - F.col("end")).alias("gap"), F.when(k % 5 != 0, (k + 1) * 100.0).alias("distance"), F.nullif(k % 4, F.lit(0)).alias("pa"), F.nullif(F.col("next_k") % 4, F.lit(0)).alias("pb"), F.when(k % 2 == 0, 1 - F.abs(F.col("confidence") - F.col("next_confidence"))).alias("reid"), (F.abs(k * 45 - F.col("next_k") * 45) % 360).alias("turn"))


_TEMPORAL = """CASE WHEN gap < 0 THEN 0 WHEN distance IS NULL THEN exp(-pow(gap - 120, 2) / (2 * pow(400.0, 2)))
 WHEN gap < distance / (80 / 3.6) THEN exp(-pow(gap - distance / (80 / 3.6), 2) / (2 * pow(greatest(0.3 * distance / (80 / 3.6), 10), 2)))
 WHEN gap > distance / (20 / 3.6) THEN exp(-pow(gap - distance / (20 / 3.6), 2) / (2 * pow(greatest(0.5 * distance / (20 / 3.6), 30), 2))) ELSE 1 END"""
_SPATIAL = """CASE WHEN distance IS NULL THEN 0.5 WHEN gap <= 0 THEN 0 WHEN distance / gap * 3.6 BETWEEN 20 AND 80 THEN 0.7 + 0.3 * exp(-pow(distance / gap * 3.6 - 50, 2) / (2 * pow(15.0, 2))) ELSE 0.7 * exp(-pow(distance / gap * 3.6 - 50, 2) / (2 * pow(15.0, 2))) END"""
_PLATE = "CASE WHEN pa IS NULL OR pb IS NULL THEN 0.5 WHEN pa = pb THEN 1 ELSE 0 END"
_TURN = "CASE WHEN least(turn, 360 - turn) < 45 THEN 1 WHEN least(turn, 360 - turn) < 135 THEN 0.5 ELSE 0 END"


@query("C8: temporal plausibility of a gap", f"WITH {_EDGES} SELECT vehicle, camera, day, round({_TEMPORAL}, 6) AS score FROM e")
def temporal_score_query(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).select("vehicle", "camera", "day", F.round(temporal_score(F.col("gap"), F.col("distance")), 6).alias("score"))


@query("C9: spatial plausibility by speed", f"WITH {_EDGES} SELECT vehicle, camera, day, round({_SPATIAL}, 6) AS score FROM e")
def spatial_score_query(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).select("vehicle", "camera", "day", F.round(spatial_score(F.col("gap"), F.col("distance")), 6).alias("score"))


@query(
    "C3: weights of missing evidence shared out, with weights of a caller",
    f"""WITH {_EDGES}, s AS (SELECT *, {_TEMPORAL} AS temporal, {_SPATIAL} AS spatial, {_PLATE} AS plate, pa IS NOT NULL AND pb IS NOT NULL AS has_plate, reid IS NOT NULL AS has_reid FROM e),
w AS (SELECT *, 0.55 + CASE WHEN has_plate THEN 0.35 ELSE 0 END + CASE WHEN has_reid THEN 0.10 ELSE 0 END AS kept FROM s)
SELECT vehicle, camera, day, round((CASE WHEN has_plate THEN 0.35 * plate ELSE 0 END + 0.40 * temporal + 0.15 * spatial + CASE WHEN has_reid THEN 0.10 * reid ELSE 0 END) / kept, 9) AS score,
 concat_ws(',', CASE WHEN NOT has_plate THEN 'plate' END, CASE WHEN NOT has_reid THEN 'reid' END) AS dropped FROM w""",
)
def reweighted_score(spark: SparkSession, d: str) -> DataFrame:
    gap, distance = F.col("gap"), F.col("distance")
    parts = {"plate": F.when(F.col("pa").isNotNull() & F.col("pb").isNotNull(), plate_score(F.col("pa"), F.col("pb"))), "temporal": temporal_score(gap, distance), "topology": spatial_score(gap, distance), "reid": F.col("reid")}
    score, dropped = redistributed(parts, WEIGHTS)
    return edges(spark, d).select("vehicle", "camera", "day", F.round(score, 9).alias("score"), dropped.alias("dropped"))


#: What queries ask for and rows show, each in turn.
_WANTED = {"color": (["red", None, "white", None, ""], 5), "vehicle_type": (["sedan", None, None, "van"], 4), "direction": (["eastbound", None, None], 3)}
_OWN = {"color": ["red", "white", None, "black"], "vehicle_type": ["sedan", "van", ""], "direction": ["eastbound", "westbound", None, "eastbound", "northbound", None, "eastbound"]}


@query(
    "C13: consistency over the dimensions that each row's query asks for, NULL if none is asked, and the score from it",
    f"""WITH {DET}, x AS (SELECT event_id, confidence, {", ".join(f"nullif({picked_sql(w, f'event_id % {n}')}, '') AS q_{name}, nullif({picked_sql(_OWN[name], f'k % {len(_OWN[name])}')}, '') AS {name}" for name, (w, n) in _WANTED.items())} FROM det),
c AS (SELECT *, ({" + ".join(f"CASE WHEN q_{name} IS NULL THEN 0 WHEN {name} IS NULL THEN {w} * 0.5 WHEN {name} = q_{name} THEN {w} ELSE 0 END" for name, w in ASKED_WEIGHTS.items())}) / nullif({" + ".join(f"CASE WHEN q_{name} IS NULL THEN 0 ELSE {w} END" for name, w in ASKED_WEIGHTS.items())}, 0)::DOUBLE AS consistency FROM x)
SELECT event_id, round(consistency, 6) AS consistency, round(CASE WHEN consistency IS NULL THEN confidence ELSE 0.6 * confidence + 0.4 * (0.7 * consistency + 0.3 * confidence) END, 6) AS score FROM c""",
)
def consistency_score(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("confidence")
    pairs = {name: (picked(w, F.col("event_id") % n), picked(_OWN[name], F.col("k") % len(_OWN[name]))) for name, (w, n) in _WANTED.items()}
    own = detections(spark, d).withColumn("consistency", consistency(pairs))
    score = F.when(F.col("consistency").isNull(), c).otherwise(0.6 * c + 0.4 * (0.7 * F.col("consistency") + 0.3 * c))
    return own.select("event_id", F.round("consistency", 6).alias("consistency"), F.round(score, 6).alias("score"))


@query(
    "C15: rerank by vector, attributes, quality and freshness, top n",
    f"""WITH {DET}, s AS (SELECT event_id, 0.4 * confidence + 0.3 * (CASE WHEN k % 2 = 0 THEN 1 WHEN k % 3 = 0 THEN 0.5 ELSE 0 END) + 0.2 * (k % 10) / 10.0 + 0.1 * least(exp(-abs(t - 1706572800) / 3600), 1) AS s FROM det)
SELECT event_id, round(s, 6) AS score FROM s ORDER BY round(s, 6) DESC, event_id LIMIT 100""",
)
def rerank_fusion(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    s = 0.4 * F.col("confidence") + 0.3 * F.when(k % 2 == 0, 1.0).when(k % 3 == 0, 0.5).otherwise(0.0) + 0.2 * (k % 10) / 10.0 + 0.1 * clamp(F.exp(-F.abs(F.col("t") - 1_706_572_800) / 3600))
    return detections(spark, d).select("event_id", F.round(s, 6).alias("score")).orderBy(F.desc("score"), "event_id").limit(100)


@query(
    "C17 C18: min-max fusion within a candidate set, NULL kept",
    f"""WITH {DET}, x AS (SELECT event_id, vehicle, confidence, CASE WHEN k % 4 <> 0 THEN k END AS itm FROM det), m AS (SELECT *, min(itm) OVER (PARTITION BY vehicle) AS lo, max(itm) OVER (PARTITION BY vehicle) AS hi FROM x)
SELECT event_id, round(coalesce(0.5 * confidence + 0.5 * CASE WHEN itm IS NULL THEN NULL WHEN hi = lo THEN 0.5 ELSE (itm - lo) / (hi - lo)::DOUBLE END, confidence), 6) AS score FROM m""",
)
def minmax_fusion(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("vehicle")
    x = detections(spark, d).withColumn("itm", F.when(F.col("k") % 4 != 0, F.col("k"))).withColumns({"lo": F.min("itm").over(w), "hi": F.max("itm").over(w)})
    scaled = F.when(F.col("itm").isNotNull(), F.when(F.col("hi") == F.col("lo"), 0.5).otherwise((F.col("itm") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    return x.select("event_id", F.round(F.coalesce(0.5 * F.col("confidence") + 0.5 * scaled, F.col("confidence")), 6).alias("score"))


_ASKED = f"""{DET}, q AS (SELECT event_id, confidence, camera, k, CASE WHEN k % 4 <> 3 THEN list_value('click', 'view', NULL)[CAST(k % 3 AS INT) + 1] END AS want_camera, CASE WHEN k % 4 = 3 THEN k % 3 ELSE 0 END AS words, CASE WHEN event_id % 5 <> 0 THEN (k * 13 % 100) / 100.0 END AS clip FROM det)"""


@query(
    "C14: retrieval score by consistency, else by keywords, else by confidence; with vectors if any row has one",
    f"""WITH {_ASKED}, a AS (SELECT *, CASE WHEN want_camera IS NOT NULL THEN 0.7 * (camera = want_camera)::INT + 0.3 * confidence WHEN words > 0 THEN least(0.5 + 0.15 * words + 0.3 * confidence, 0.99) ELSE confidence END AS attr FROM q)
SELECT event_id, round(CASE WHEN (SELECT count(clip) FROM q) > 0 THEN 0.6 * coalesce(clip, 0) + 0.4 * attr ELSE attr END, 6) AS score FROM a""",
)
def retrieval_score(spark: SparkSession, d: str) -> DataFrame:
    from sightline.sources.tables import picked

    k, c = F.col("k"), F.col("confidence")
    q = detections(spark, d).select("event_id", "confidence", "camera", F.when(k % 4 != 3, picked(["click", "view", None], k % 3)).alias("want"), F.when(k % 4 == 3, k % 3).otherwise(0).alias("words"), F.when(F.col("event_id") % 5 != 0, (k * 13 % 100) / 100.0).alias("clip"))
    attr = F.when(F.col("want").isNotNull(), 0.7 * (F.col("camera") == F.col("want")).cast("int") + 0.3 * c).when(F.col("words") > 0, F.least(0.5 + 0.15 * F.col("words") + 0.3 * c, F.lit(0.99))).otherwise(c)
    any_clip = q.agg((F.count("clip") > 0).alias("any"))  # one row
    both = q.withColumn("attr", attr).join(F.broadcast(any_clip), F.lit(True))
    return both.select("event_id", F.round(F.when(F.col("any"), 0.6 * F.coalesce("clip", F.lit(0.0)) + 0.4 * F.col("attr")).otherwise(F.col("attr")), 6).alias("score"))


@query(
    "C16: share of the attributes asked for that match, half for a part of the word, 1 if none is asked for",
    """WITH x AS (SELECT p_partkey, lower(p_brand) AS brand, lower(p_type) AS type, CASE WHEN p_partkey % 4 <> 0 THEN lower('Brand#' || (p_partkey % 3 + 1)) END AS want_brand, CASE WHEN p_partkey % 5 <> 0 THEN list_value('tin', 'small', 'x')[CAST(p_partkey % 3 AS INT) + 1] END AS want_type FROM part)
SELECT p_partkey, round(coalesce((coalesce(CASE WHEN brand = want_brand THEN 1.0 WHEN contains(brand, want_brand) OR contains(want_brand, brand) THEN 0.5 ELSE 0 END * (want_brand IS NOT NULL)::INT, 0) + coalesce(CASE WHEN type = want_type THEN 1.0 WHEN contains(type, want_type) OR contains(want_type, type) THEN 0.5 ELSE 0 END * (want_type IS NOT NULL)::INT, 0)) / nullif((want_brand IS NOT NULL)::INT + (want_type IS NOT NULL)::INT, 0)::DOUBLE, 1.0), 6) AS share FROM x""",
)
def attribute_share(spark: SparkSession, d: str) -> DataFrame:
    from sightline.sources.tables import picked, read

    key = F.col("p_partkey")
    x = read(spark, d, "part").select("p_partkey", F.lower("p_brand").alias("brand"), F.lower("p_type").alias("type"), F.when(key % 4 != 0, F.concat(F.lit("brand#"), key % 3 + 1)).alias("want_brand"), F.when(key % 5 != 0, picked(["tin", "small", "x"], key % 3)).alias("want_type"))
    pairs = [(F.col("brand"), F.col("want_brand")), (F.col("type"), F.col("want_type"))]
    match = lambda own, want: F.when(want.isNull(), 0.0).when(own == want, 1.0).when(own.contains(want) | want.contains(own), 0.5).otherwise(0.0)
    asked = sum((w.isNotNull().cast("int") for _, w in pairs), F.lit(0))
    return x.select("p_partkey", F.round(F.coalesce(sum((match(o, w) for o, w in pairs), F.lit(0.0)) / F.nullif(asked, F.lit(0)), F.lit(1.0)), 6).alias("share"))
