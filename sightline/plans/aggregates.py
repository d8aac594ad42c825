"""Queries on aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.expressions import dot
from sightline.registry import query
from sightline.sources.tables import BOXES, DET, TRACKLETS, boxes, detections, read, tracklets


@query(
    "A2 A3 A24 A46: vote over known labels, ties to the first seen",
    "SELECT track, colour FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY n DESC, first, colour DESC) AS r FROM (SELECT l_orderkey AS track, l_returnflag AS colour, count(*) AS n, min(l_linenumber) AS first FROM lineitem GROUP BY ALL)) WHERE r = 1",
)
def mode_vote(spark: SparkSession, d: str) -> DataFrame:
    votes = boxes(spark, d).groupBy("track", "colour").agg(F.count("*").alias("n"), F.min("frame").alias("first"))
    return votes.groupBy("track").agg(F.max_by("colour", F.struct("n", -F.col("first"), "colour")).alias("colour"))


@query("A1 A8 A10: tracklets of detections", f'WITH {TRACKLETS} SELECT vehicle, camera, day, round("end" - start, 3) AS duration_s, n, round(confidence, 9) AS confidence, k FROM tracklets')
def tracklet_agg(spark: SparkSession, d: str) -> DataFrame:
    return tracklets(spark, d).select("vehicle", "camera", "day", F.round(F.col("end") - F.col("start"), 3).alias("duration_s"), "n", F.round("confidence", 9).alias("confidence"), "k")


@query(
    "A9: summary of each camera's tracklet: duration, mean quality to four digits, ids in order of time",
    f"WITH {DET}, x AS (SELECT *, CAST(floor(t / 86400) AS BIGINT) AS day, (k % 10) / 10.0::DOUBLE AS quality FROM det) SELECT vehicle, camera, day, count(*) AS n, round(avg(quality), 4) AS quality, string_agg(event_id, ',' ORDER BY t, event_id) AS ids FROM x GROUP BY vehicle, camera, day",
)
def tracklet_summary(spark: SparkSession, d: str) -> DataFrame:
    x = detections(spark, d).withColumns({"day": F.floor(F.col("t") / 86400), "quality": F.col("k") % 10 / 10.0})
    ids = F.transform(F.sort_array(F.collect_list(F.struct("t", "event_id"))), lambda r: r["event_id"].cast("string"))  # those of one day
    return x.groupBy("vehicle", "camera", "day").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 4).alias("quality"), F.array_join(ids, ",").alias("ids"))


@query(
    "A4 A5 A39: centroid of unit vectors, normalised again",
    """WITH u AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
p AS (SELECT label, i, avg(v[i]) AS x FROM u, range(1, 65) AS t(i) GROUP BY label, i), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM p GROUP BY label)
SELECT label, CAST(i - 1 AS INT) AS pos, round(x / n, 6) AS x FROM p JOIN n USING (label)""",
)
def centroid_norm(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    unit = e.withColumn("n", F.sqrt(dot("embedding", "embedding"))).where("n > 0").select("label", F.transform("embedding", lambda x: x.cast("double") / F.col("n")).alias("v"))
    mean = unit.select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("x"))
    norm = mean.groupBy("label").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return mean.join(norm, "label").select("label", "pos", F.round(F.col("x") / F.col("n"), 6).alias("x"))


@query(
    "A12: confidence histogram of each camera, five half-open bins, zero bins kept",
    f"WITH {DET}, bins(bin) AS (VALUES (0), (1), (2), (3), (4)), b AS (SELECT camera, least(CAST(floor(confidence * 5) AS INT), 4) AS bin FROM det WHERE confidence > 0) SELECT c.camera, bin, count(b.bin) AS n FROM (SELECT DISTINCT camera FROM det) c JOIN bins ON true LEFT JOIN b USING (camera, bin) GROUP BY c.camera, bin",
)
def histogram_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    bin_ = F.least(F.floor(F.col("confidence") * 5), F.lit(4)).cast("int")
    counts = detections(spark, d).groupBy("camera").agg(*[F.count_if((F.col("confidence") > 0) & (bin_ == i)).alias(f"n{i}") for i in range(5)])
    return counts.select("camera", F.posexplode(F.array(*[f"n{i}" for i in range(5)])).alias("bin", "n"))


@query("A11 A16: totals and distinct counts", f"WITH {DET} SELECT count(*) AS total, count(*) FILTER (camera = 'click') AS clicks, count(DISTINCT vehicle) AS vehicles, count(DISTINCT camera) AS cameras FROM det")
def counts_by_type(spark: SparkSession, d: str) -> DataFrame:
    return detections(spark, d).agg(F.count("*").alias("total"), F.count_if(F.col("camera") == "click").alias("clicks"), F.countDistinct("vehicle").alias("vehicles"), F.countDistinct("camera").alias("cameras"))


@query("A13: counts for every member of a dimension", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def zero_fill_dim(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return read(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("A14: rows nested under a key, as ordered text", "SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS lines FROM lineitem GROUP BY l_orderkey")
def nested_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["l_linenumber"], r["l_partkey"])), ",").alias("lines"))


@query(
    "A44: positions of the rows of each camera and frame, and how many such pairs there are",
    "WITH p AS (SELECT l_suppkey % 20 AS camera, l_orderkey % 500 AS frame, string_agg(l_orderkey * 8 + l_linenumber, ',' ORDER BY l_orderkey * 8 + l_linenumber) AS positions FROM lineitem GROUP BY ALL) SELECT *, (SELECT count(*) FROM p) AS pairs FROM p",
)
def frame_positions(spark: SparkSession, d: str) -> DataFrame:
    position = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    keys = [(F.col("l_suppkey") % 20).alias("camera"), (F.col("l_orderkey") % 500).alias("frame")]
    line = read(spark, d, "lineitem")
    rows = line.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(position)), lambda x: x.cast("string")), ",").alias("positions"))  # the boxes of one frame
    pairs = line.select(*keys).distinct().agg(F.count("*").alias("pairs"))  # one row
    return rows.join(F.broadcast(pairs), F.lit(True))


@query("A19: means of sub-scores, NULL if there is none", f"WITH {DET} SELECT vehicle, round(avg(confidence), 9) AS appearance, round(avg(CASE WHEN k % 3 = 0 THEN k / 100.0 END), 9) AS plate FROM det GROUP BY vehicle")
def evidence_means(spark: SparkSession, d: str) -> DataFrame:
    return detections(spark, d).groupBy("vehicle").agg(F.round(F.avg("confidence"), 9).alias("appearance"), F.round(F.avg(F.when(F.col("k") % 3 == 0, F.col("k") / 100.0)), 9).alias("plate"))


@query("A20: geometric mean of scores, floor 0.01, missing 0.3", f"WITH {DET} SELECT vehicle, round(exp(avg(ln(greatest(coalesce(CASE WHEN k % 10 <> 0 THEN confidence END, 0.3), 0.01)))), 6) AS confidence FROM det GROUP BY vehicle")
def geometric_confidence(spark: SparkSession, d: str) -> DataFrame:
    score = F.coalesce(F.when(F.col("k") % 10 != 0, F.col("confidence")), F.lit(0.3))
    return detections(spark, d).groupBy("vehicle").agg(F.round(F.exp(F.avg(F.log(F.greatest(score, F.lit(0.01))))), 6).alias("confidence"))


@query("A43: most frequent values and their share, by one scan", f"WITH {DET} SELECT k, count(*) AS n, round(count(*) / (SELECT count(*) FROM det)::DOUBLE, 6) AS share FROM det GROUP BY k ORDER BY n DESC, k LIMIT 10")
def value_distribution(spark: SparkSession, d: str) -> DataFrame:
    """The total is the row that a rollup adds to the counts; it sorts first, and the first eleven rows hold it and the ten most frequent."""
    n = detections(spark, d).rollup("k").agg(F.count("*").alias("n"), F.grouping("k").alias("g")).orderBy(F.desc("g"), F.desc("n"), "k").limit(11)
    top = n.agg(F.sort_array(F.collect_list(F.struct(F.col("g"), -F.col("n"), "k"))).alias("rows"), F.max(F.when(F.col("g") == 1, F.col("n"))).alias("total"))  # eleven rows
    each = top.select("total", F.explode("rows").alias("r")).where("r.g = 0")
    return each.select(F.col("r.k").alias("k"), (-F.col("r.col2")).alias("n"), F.round(-F.col("r.col2") / F.col("total"), 6).alias("share"))


@query(
    "A28: set overlap of truth and prediction, micro and macro",
    f"""WITH {DET}, g AS (SELECT DISTINCT vehicle, camera FROM det WHERE confidence >= 0.3), p AS (SELECT DISTINCT vehicle, camera FROM det WHERE k % 3 <> 0),
j AS (SELECT coalesce(g.vehicle, p.vehicle) AS vehicle, count(g.camera) FILTER (p.camera IS NOT NULL) AS tp, count(*) FILTER (g.camera IS NULL) AS fp, count(*) FILTER (p.camera IS NULL) AS fn FROM g FULL JOIN p ON g.vehicle = p.vehicle AND g.camera = p.camera GROUP BY 1)
SELECT round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1, round(avg(2.0 * tp / (2 * tp + fp + fn)), 6) AS macro_f1 FROM j""",
)
def set_f1(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d)
    truth, guess = (det.where(c).select("vehicle", "camera").distinct().withColumn(n, F.lit(1)) for c, n in (("confidence >= 0.3", "g"), ("k % 3 <> 0", "p")))
    j = truth.join(guess, ["vehicle", "camera"], "full").groupBy("vehicle").agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    f1 = lambda tp, fp, fn: 2.0 * tp / (2 * tp + fp + fn)
    c = F.col
    return j.agg(F.round(f1(F.sum("tp"), F.sum("fp"), F.sum("fn")), 6).alias("micro_f1"), F.round(F.avg(f1(c("tp"), c("fp"), c("fn"))), 6).alias("macro_f1"))


@query(
    "A40: centre and padded bounds of each camera's track, both ways",
    f"WITH {BOXES} SELECT camera, round(avg((x1 + x2) / 2), 4) AS cx, round(avg((y1 + y2) / 2), 4) AS cy, round(min(x1) - 0.01, 4) AS west, round(max(x2) + 0.01, 4) AS east, round(min(y1) - 0.01, 4) AS south, round(max(y2) + 0.01, 4) AS north FROM boxes GROUP BY camera",
)
def map_bounds(spark: SparkSession, d: str) -> DataFrame:
    middle = lambda low, high: F.round(F.avg((F.col(low) + F.col(high)) / 2), 4)
    edge = lambda x, pad: F.round(x + pad, 4)
    return boxes(spark, d).groupBy("camera").agg(middle("x1", "x2").alias("cx"), middle("y1", "y2").alias("cy"), edge(F.min("x1"), -0.01).alias("west"), edge(F.max("x2"), 0.01).alias("east"), edge(F.min("y1"), -0.01).alias("south"), edge(F.max("y2"), 0.01).alias("north"))


@query(
    "A35: area under the curve by rank sums, ties one half",
    f"""WITH {DET}, s AS (SELECT confidence AS x, k % 3 = 0 AS y FROM det), v AS (SELECT x, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n FROM s GROUP BY x),
c AS (SELECT *, sum(n) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) - n AS below FROM v) SELECT round(sum(p * (below + 0.5 * n)) / (sum(p) * sum(n))::DOUBLE, 6) AS auc FROM c""",
)
def auc(spark: SparkSession, d: str) -> DataFrame:
    """Scores are counted in buckets first; only one row for each of BUCKETS buckets enters a running sum, and ranks within a
    bucket are taken by windows of its own, so that no window holds all rows."""
    from pyspark.sql import Window

    buckets = 4096
    v = detections(spark, d).groupBy(F.col("confidence").alias("x")).agg(F.count_if(F.col("k") % 3 == 0).alias("p"), F.count_if(F.col("k") % 3 != 0).alias("n")).withColumn("b", F.floor(F.col("x") * buckets))
    per = v.groupBy("b").agg(F.sum("n").alias("nb"))
    before = per.select("b", (F.sum("nb").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("nb")).alias("base"))  # at most 4097 rows
    inner = F.sum("n").over(Window.partitionBy("b").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    c = v.withColumn("inner", inner).join(before, "b")
    return c.agg(F.round(F.sum(F.col("p") * (F.col("base") + F.col("inner") + 0.5 * F.col("n"))) / (F.sum("p") * F.sum("n")), 6).alias("auc"))


@query(
    "A1 A25: whole tracklets: mode of a label, first and last place, mean vector, first, middle and last frame",
    f"""WITH {BOXES}, t AS (SELECT track, min(frame) AS lo, max(frame) AS hi, count(*) AS n, arg_min(x1, {{'f': frame, 'x': x1}}) AS first_x, arg_max(x1, {{'f': frame, 'x': x1}}) AS last_x, round(avg(x1), 4) AS mean_x, round(avg(y1), 4) AS mean_y FROM boxes GROUP BY track),
v AS (SELECT track, colour, count(*) AS n, min(frame) AS first FROM boxes GROUP BY ALL), m AS (SELECT track, arg_max(colour, {{'n': n, 'f': -first, 'c': colour}}) AS colour FROM v GROUP BY track),
r AS (SELECT b.track, arg_min(frame, {{'d': abs(frame - (lo + hi) // 2), 'f': frame}}) AS middle FROM boxes b JOIN t USING (track) GROUP BY b.track)
SELECT track, t.n, m.colour, first_x, last_x, mean_x, mean_y, lo || ',' || middle || ',' || hi AS keyframes FROM t JOIN m USING (track) JOIN r USING (track)""",
)
def tracklet_build(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    at = F.struct("frame", "x1")
    t = b.groupBy("track").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"), F.count("*").alias("n"), F.min_by("x1", at).alias("first_x"), F.max_by("x1", at).alias("last_x"), F.round(F.avg("x1"), 4).alias("mean_x"), F.round(F.avg("y1"), 4).alias("mean_y"))
    v = b.groupBy("track", "colour").agg(F.count("*").alias("m"), F.min("frame").alias("first"))
    mode = v.groupBy("track").agg(F.max_by("colour", F.struct("m", -F.col("first"), "colour")).alias("colour"))
    middle = F.floor((F.col("lo") + F.col("hi")) / 2)
    near = b.join(t.select("track", "lo", "hi"), "track").groupBy("track").agg(F.min_by("frame", F.struct(F.abs(F.col("frame") - middle), "frame")).alias("middle"))
    return t.join(mode, "track").join(near, "track").select("track", "n", "colour", "first_x", "last_x", "mean_x", "mean_y", F.concat_ws(",", "lo", "middle", "hi").alias("keyframes"))


@query(
    "A6 A7: mean vector as it is, and the unit vector of the mean of two models, zero if it vanishes",
    """WITH p AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x, avg(embedding[65 - i]::DOUBLE) AS y FROM embeddings, range(1, 65) AS t(i) GROUP BY label, i), n AS (SELECT label, sqrt(sum(pow((x + y) / 2, 2))) AS n FROM p GROUP BY label)
SELECT label, CAST(i - 1 AS INT) AS pos, round(x, 6) AS mean, round(CASE WHEN n > 1e-8 THEN (x + y) / 2 / n ELSE 0 END, 6) AS both FROM p JOIN n USING (label)""".replace("AS both", "AS ensemble"),
)
def mean_and_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """The second model's vector is the first one's backwards."""
    parts = read(spark, d, "embeddings").select("label", F.posexplode(F.arrays_zip(F.col("embedding").alias("x"), F.reverse("embedding").alias("y"))).alias("pos", "e"))
    p = parts.groupBy("label", "pos").agg(F.avg(F.col("e.x").cast("double")).alias("x"), F.avg(F.col("e.y").cast("double")).alias("y"))
    half = (F.col("x") + F.col("y")) / 2
    n = p.groupBy("label").agg(F.sqrt(F.sum(half * half)).alias("n"))
    return p.join(n, "label").select("label", "pos", F.round("x", 6).alias("mean"), F.round(F.when(F.col("n") > 1e-8, half / F.col("n")).otherwise(0.0), 6).alias("ensemble"))


@query(
    "A15: sessions of every state, states without one too, and how many are of low confidence",
    f"WITH {DET}, s(state) AS (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('closed')) SELECT state, count(event_id) AS n, count(*) FILTER (confidence < 0.2) AS low FROM s LEFT JOIN det ON camera = state GROUP BY state",
)
def session_counts(spark: SparkSession, d: str) -> DataFrame:
    n = detections(spark, d).groupBy(F.col("camera").alias("state")).agg(F.count("*").alias("n"), F.count_if(F.col("confidence") < 0.2).alias("low"))
    states = spark.createDataFrame([(s,) for s in ("click", "error", "purchase", "signup", "view", "closed")], "state string")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return states.join(n, "state", "left").select("state", zero("n"), zero("low"))


@query(
    "A45: share of each class, the largest one, unknown below a tenth",
    "WITH c AS (SELECT l_orderkey, l_suppkey % 12 AS class, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), s AS (SELECT l_orderkey, max(q) AS top, sum(q) + 150 AS all_q, arg_max(class, {'q': q, 'c': -class}) AS class FROM c GROUP BY l_orderkey) SELECT l_orderkey, round(top / all_q, 6) AS share, CASE WHEN top / all_q >= 0.1 THEN CAST(class AS VARCHAR) ELSE 'unknown' END AS class FROM s",
)
def class_shares(spark: SparkSession, d: str) -> DataFrame:
    """150 stands for what belongs to no class."""
    c = read(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_suppkey") % 12).alias("class")).agg(F.sum("l_quantity").alias("q"))
    s = c.groupBy("l_orderkey").agg(F.max("q").alias("top"), (F.sum("q") + 150).alias("all"), F.max_by("class", F.struct("q", -F.col("class"))).alias("class"))
    share = F.col("top") / F.col("all")
    return s.select("l_orderkey", F.round(share, 6).alias("share"), F.when(share >= 0.1, F.col("class").cast("string")).otherwise("unknown").alias("class"))


@query(
    "A41: report of labelled rows: a summary and one row for each segment",
    f"""WITH {TRACKLETS}, s AS (SELECT vehicle, count(*) AS n, count(DISTINCT camera) AS cameras, round(sum("end" - start), 3) AS seconds FROM tracklets GROUP BY vehicle) SELECT vehicle, 'cameras' AS label, CAST(cameras AS DOUBLE) AS value FROM s UNION ALL SELECT vehicle, 'seconds', seconds FROM s UNION ALL SELECT vehicle, 'segment ' || camera, round(sum("end" - start), 3) FROM tracklets GROUP BY vehicle, camera""",
)
def report_rows(spark: SparkSession, d: str) -> DataFrame:
    t = tracklets(spark, d).withColumn("s", F.col("end") - F.col("start"))
    s = t.groupBy("vehicle").agg(F.countDistinct("camera").alias("cameras"), F.round(F.sum("s"), 3).alias("seconds"))
    summary = s.select("vehicle", F.explode(F.array(F.struct(F.lit("cameras").alias("label"), F.col("cameras").cast("double").alias("value")), F.struct(F.lit("seconds").alias("label"), F.col("seconds").alias("value")))).alias("x")).select("vehicle", "x.*")
    return summary.union(t.groupBy("vehicle", F.concat(F.lit("segment "), "camera").alias("label")).agg(F.round(F.sum("s"), 3).alias("value")))
