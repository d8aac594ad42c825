"""Queries on evaluation: consistency against chance, set overlaps, retrieval measures, tracking measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions.expressions import iou_sql
from sightline.operators.ordered import best_matches, frame_matches
from sightline.plans.vectors import _RANKED, hit_measures
from sightline.registry import query
from sightline.sources.tables import DET, detections, read

_LABELS = f"{DET}, lab AS (SELECT vehicle, camera, k % 6 AS label, event_id FROM det)"


@query(
    "A26 A27: share of the dominant label within a camera, identities with one dominant label, and what chance gives for their cameras and for pairs",
    f"""WITH {_LABELS}, c AS (SELECT vehicle, camera, label, count(*) AS n FROM lab GROUP BY ALL), many AS (SELECT vehicle FROM lab GROUP BY vehicle HAVING count(DISTINCT camera) >= 2), d AS (SELECT vehicle, camera, arg_max(label, {{'n': n, 'l': -label}}) AS top, max(n) / sum(n)::DOUBLE AS share FROM c JOIN many USING (vehicle) GROUP BY ALL),
v AS (SELECT vehicle, count(DISTINCT top) = 1 AS same, count(*) AS k FROM d GROUP BY vehicle), p AS (SELECT top, count(*) / (SELECT count(*) FROM d)::DOUBLE AS p FROM d GROUP BY top), ks AS (SELECT k, count(*) AS n FROM v GROUP BY k)
SELECT round((SELECT avg(share) FROM d), 6) AS within_share, round((SELECT avg(same::INT) FROM v), 6) AS across_share, round((SELECT sum(n * pow(p, k)) / (SELECT count(*) FROM v) FROM ks, p), 6) AS chance, round((SELECT sum(p * p) FROM p), 6) AS chance_of_pairs""",
)
def consistency_and_chance(spark: SparkSession, d: str) -> DataFrame:
    lab = detections(spark, d).select("vehicle", "camera", (F.col("k") % 6).alias("label"))
    c = lab.groupBy("vehicle", "camera", "label").agg(F.count("*").alias("n"))
    per = c.groupBy("vehicle", "camera").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("top"), (F.max("n") / F.sum("n")).alias("share"))
    many = per.withColumn("k", F.count("*").over(Window.partitionBy("vehicle"))).where("k >= 2")
    v = many.groupBy("vehicle").agg((F.min("top") == F.max("top")).alias("same"), F.count("*").alias("k"))
    shares = many.groupBy("top").agg(F.count("*").alias("m"))
    total = shares.agg(F.sum("m").alias("all"), F.collect_list("m").alias("ms"))  # one row; as many numbers as labels
    sizes = v.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("same").cast("int")).alias("same"))
    both = sizes.agg(F.sum("n").alias("n"), F.sum("same").alias("same"), F.collect_list(F.struct("k", "n")).alias("ks"))
    one = many.agg(F.avg("share").alias("within")).join(F.broadcast(total), F.lit(True)).join(F.broadcast(both), F.lit(True))  # single rows
    p = F.transform("ms", lambda m: m / F.col("all"))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    chance = add(F.transform("ks", lambda s: s["n"] * add(F.transform(p, lambda x: F.pow(x, s["k"]))))) / F.col("n")
    return one.select(F.round("within", 6).alias("within_share"), F.round(F.col("same") / F.col("n"), 6).alias("across_share"), F.round(chance, 6).alias("chance"), F.round(add(F.transform(p, lambda x: x * x)), 6).alias("chance_of_pairs"))


_SETS = f"{DET}, g AS (SELECT DISTINCT vehicle, camera FROM det WHERE confidence >= 0.3), p AS (SELECT DISTINCT vehicle, camera FROM det WHERE k % 3 <> 0), j AS (SELECT vehicle, count(g.camera) AS ng, count(p.camera) AS np, count(g.camera) FILTER (p.camera IS NOT NULL) AS shared FROM g FULL JOIN p USING (vehicle, camera) GROUP BY vehicle)"


def camera_sets(spark: SparkSession, d: str) -> DataFrame:
    """(vehicle, ng, np, shared): sizes of the true and of the found set of cameras, and of what they share."""
    det = detections(spark, d)
    truth, guess = (det.where(c).select("vehicle", "camera").distinct().withColumn(n, F.lit(1)) for c, n in (("confidence >= 0.3", "g"), ("k % 3 <> 0", "p")))
    return truth.join(guess, ["vehicle", "camera"], "full").groupBy("vehicle").agg(F.count("g").alias("ng"), F.count("p").alias("np"), F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("shared"))


@query("A29: means of camera exact match, recall and precision of identities", f"WITH {_SETS} SELECT round(avg((ng = shared AND np = shared)::INT), 6) AS exact, round(avg(coalesce(shared / nullif(ng, 0)::DOUBLE, 0)), 6) AS recall, round(avg(coalesce(shared / nullif(np, 0)::DOUBLE, 0)), 6) AS precision FROM j")
def camera_exact_match(spark: SparkSession, d: str) -> DataFrame:
    share = lambda n: F.round(F.avg(F.coalesce(F.col("shared") / F.nullif(F.col(n), F.lit(0)), F.lit(0.0))), 6)
    return camera_sets(spark, d).agg(F.round(F.avg(((F.col("ng") == F.col("shared")) & (F.col("np") == F.col("shared"))).cast("int")), 6).alias("exact"), share("ng").alias("recall"), share("np").alias("precision"))


@query(
    "A38: cross-camera identities: precision, recall and F1, a hit sharing at least two cameras",
    f"WITH {_SETS}, s AS (SELECT count(*) FILTER (ng >= 2) AS truth, count(*) FILTER (np >= 2) AS found, count(*) FILTER (ng >= 2 AND np >= 2 AND shared >= 2) AS hits FROM j) SELECT truth, found, hits, round(hits / nullif(found, 0)::DOUBLE, 6) AS precision, round(hits / nullif(truth, 0)::DOUBLE, 6) AS recall, round(2.0 * hits / nullif(truth + found, 0), 6) AS f1 FROM s",
)
def cross_camera_identities(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    s = camera_sets(spark, d).agg(F.count_if(c("ng") >= 2).alias("truth"), F.count_if(c("np") >= 2).alias("found"), F.count_if((c("ng") >= 2) & (c("np") >= 2) & (c("shared") >= 2)).alias("hits"))
    over = lambda x: F.nullif(x, F.lit(0).cast("long"))
    return s.select("truth", "found", "hits", F.round(c("hits") / over(c("found")), 6).alias("precision"), F.round(c("hits") / over(c("truth")), 6).alias("recall"), F.round(2.0 * c("hits") / over(c("truth") + c("found")), 6).alias("f1"))


@query(
    "A32: precision, recall and F1 of the first 10, average precision, reciprocal rank and normalised gain, means over queries",
    f"""WITH {_RANKED}, t AS (SELECT q, rank, (ql = gl)::INT AS hit, sum((ql = gl)::INT) OVER (PARTITION BY q) AS rel, sum((ql = gl)::INT) OVER (PARTITION BY q ORDER BY rank ROWS UNBOUNDED PRECEDING) AS seen FROM ranked),
m AS (SELECT q, max(rel) AS rel, sum(hit) FILTER (rank <= 10) / 10.0 AS p, coalesce(sum(hit) FILTER (rank <= 10) / nullif(max(rel), 0)::DOUBLE, 0) AS r, coalesce(sum(CASE WHEN hit = 1 THEN seen / rank::DOUBLE END) / nullif(max(rel), 0), 0) AS ap, coalesce(1.0 / min(rank) FILTER (hit = 1), 0) AS rr, sum(hit / log2(rank + 1)) FILTER (rank <= 10) AS dcg FROM t GROUP BY q),
i AS (SELECT *, (SELECT sum(1 / log2(x + 1)) FROM range(1, 11) AS t(x) WHERE x <= rel) AS ideal FROM m)
SELECT round(avg(p), 6) AS p10, round(avg(r), 6) AS r10, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f10, round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr, round(avg(coalesce(dcg / ideal, 0)), 6) AS ndcg10 FROM i""",
)
def retrieval_measures(spark: SparkSession, d: str) -> DataFrame:
    c, k = F.col, 10
    top = F.filter("ranks", lambda x: x <= k)
    gain = F.aggregate(top, F.lit(0.0), lambda s, x: s + 1 / F.log2(x + 1.0))
    m = hit_measures(spark, d).select("rel", F.size(top).alias("in"), F.coalesce("ap", F.lit(0.0)).alias("ap"), F.coalesce(1.0 / F.get("ranks", F.lit(0)), F.lit(0.0)).alias("rr"), gain.alias("dcg"))
    ideal = F.aggregate(F.slice(F.array(*[1 / F.log2(F.lit(x + 1.0)) for x in range(1, k + 1)]), 1, F.least(c("rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, x: s + x)
    p, r = c("in") / k, F.coalesce(c("in") / F.nullif(c("rel"), F.lit(0).cast("long")), F.lit(0.0))
    mean = lambda x, n: F.round(F.avg(x), 6).alias(n)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return m.agg(mean(p, "p10"), mean(r, "r10"), mean(f, "f10"), mean(c("ap"), "map"), mean(c("rr"), "mrr"), mean(F.coalesce(c("dcg") / F.nullif(ideal, F.lit(0.0)), F.lit(0.0)), "ndcg10"))


def truth_and_found(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Boxes of a camera and frame: what is there (id), and what a detector with gaps and shifts finds (found)."""
    line = read(spark, d, "lineitem")
    x, y, w = (F.col("l_partkey") % 1000).cast("double"), (F.col("l_suppkey") % 700).cast("double"), 40 + F.col("l_quantity")
    base = line.select((F.col("l_suppkey") % 20).alias("camera"), (F.col("l_orderkey") % 500).alias("frame"), (F.col("l_partkey") % 97).alias("id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row"), F.col("l_partkey").alias("part"), x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + w).alias("y2"))
    truth = base.select("camera", "frame", "row", "id", "x1", "y1", "x2", "y2")
    shift = F.col("part") % 23
    found = base.where("part % 7 <> 0").select("camera", "frame", F.col("row").alias("det"), (F.col("id") + F.when(F.col("part") % 11 == 0, 1000).otherwise(0)).alias("found"), *[(F.col(c) + shift).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return truth, found


_TRUTH = """base AS (SELECT l_suppkey % 20 AS camera, l_orderkey % 500 AS frame, l_partkey % 97 AS id, l_orderkey * 8 + l_linenumber AS row, l_partkey AS part, CAST(l_partkey % 1000 AS DOUBLE) AS x1, CAST(l_suppkey % 700 AS DOUBLE) AS y1, l_partkey % 1000 + 40 + l_quantity AS x2, l_suppkey % 700 + 40 + l_quantity AS y2 FROM lineitem),
fnd AS (SELECT camera, frame, row AS det, id + CASE WHEN part % 11 = 0 THEN 1000 ELSE 0 END AS found, x1 + part % 23 AS x1, y1 + part % 23 AS y1, x2 + part % 23 AS x2, y2 + part % 23 AS y2 FROM base WHERE part % 7 <> 0)"""


@query(
    "J13: the best overlap above 0.3 with a true box of the same camera and frame",
    f"WITH {_TRUTH}, m AS (SELECT b.det, a.row, a.id, round({iou_sql('a', 'b')}, 6) AS iou FROM fnd b JOIN base a ON a.camera = b.camera AND a.frame = b.frame) SELECT det, arg_max(id, {{'i': iou, 'r': row, 'id': id}}) AS id, max(iou) AS iou FROM m WHERE iou > 0.3 GROUP BY det",
)
def best_iou_match(spark: SparkSession, d: str) -> DataFrame:
    truth, found = truth_and_found(spark, d)
    return best_matches(truth, found, ["camera", "frame"], 0.3)


@query("A37: tracking measures of each camera: matches, misses, false positives, switches, fragmentations, mostly tracked and lost")
def mot_measures(spark: SparkSession, d: str) -> DataFrame:
    """Each frame is matched by itself, so frames spread over all tasks; what needs their order is windows over each identity."""
    truth, found = truth_and_found(spark, d)
    m = frame_matches(truth.select("camera", "frame", F.col("id"), "x1", "y1", "x2", "y2"), found.select("camera", "frame", F.col("found").alias("id"), "x1", "y1", "x2", "y2"))
    w = Window.partitionBy("camera", "gt").orderBy("frame", "part")
    seen = m.where("gt is not null").withColumns({"hit": F.col("pred").isNotNull(), "last": F.last("pred", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "was": F.lag(F.col("pred").isNotNull()).over(w)})
    change = F.coalesce(F.col("was") != F.col("hit"), F.lit(False)) & F.coalesce(F.col("was") | F.col("last").isNotNull(), F.lit(False))
    by_id = seen.groupBy("camera", "gt").agg(F.count_if("hit").alias("hits"), F.count("*").alias("n"), F.count_if(F.col("hit") & (F.col("last") != F.col("pred"))).alias("switches"), F.count_if(change).alias("fragments"))
    share = F.col("hits") / F.col("n")
    per = by_id.groupBy("camera").agg(F.sum("hits").alias("idtp"), F.sum(F.col("n") - F.col("hits")).alias("idfn"), F.sum("switches").alias("switches"), F.sum("fragments").alias("fragmentations"), F.count_if(share > 0.8).alias("mostly_tracked"), F.count_if(share < 0.2).alias("mostly_lost"), F.count("*").alias("identities"))
    extra = m.where("gt is null").groupBy("camera").agg(F.count("*").alias("idfp"))
    c = F.col
    both = per.join(extra, "camera", "left").withColumn("idfp", F.coalesce("idfp", F.lit(0).cast("long")))
    return both.withColumn("idf1", F.round(2 * c("idtp") / (2 * c("idtp") + c("idfp") + c("idfn")), 6))
