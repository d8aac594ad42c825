"""Queries on windows, ranking and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions import vocabulary as v
from sightline.functions.expressions import lookup
from sightline.registry import query
from sightline.sources.tables import DET, TRACKLETS, detections, picked, picked_sql, read, tracklets


@query(
    "W14 X6: gap segmentation, new segment after 6 hours, at least 2 detections",
    f"""WITH {DET}, g AS (SELECT *, CASE WHEN t - lag(t) OVER w > 21600 THEN 1 ELSE 0 END AS cut FROM det WINDOW w AS (PARTITION BY vehicle ORDER BY t, event_id)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY vehicle ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM g)
SELECT vehicle, CAST(seg AS BIGINT) AS seg, count(*) AS n, round(max(t) - min(t), 3) AS duration_s FROM s GROUP BY vehicle, seg HAVING count(*) >= 2""",
)
def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("vehicle").orderBy("t", "event_id")
    cut = F.when(F.col("t") - F.lag("t").over(w) > 21600, 1).otherwise(0)
    s = detections(spark, d).withColumn("cut", cut).withColumn("seg", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("vehicle", "seg").agg(F.count("*").alias("n"), F.round(F.max("t") - F.min("t"), 3).alias("duration_s")).where("n >= 2")


@query(
    "W9 W10: identity timeline, gaps and running cursor",
    f"""WITH {TRACKLETS} SELECT vehicle, camera, day, n, row_number() OVER w AS pos, round(lead(start) OVER w - "end", 3) AS gap_s,
 round(sum("end" - start) OVER (PARTITION BY vehicle ORDER BY start, camera ROWS UNBOUNDED PRECEDING), 3) AS cursor_s FROM tracklets WINDOW w AS (PARTITION BY vehicle ORDER BY start, camera)""",
)
def timeline(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("vehicle").orderBy("start", "camera")
    return tracklets(spark, d).select("vehicle", "camera", "day", "n", F.row_number().over(w).cast("long").alias("pos"), F.round(F.lead("start").over(w) - F.col("end"), 3).alias("gap_s"), F.round(F.sum(F.col("end") - F.col("start")).over(w.rowsBetween(Window.unboundedPreceding, 0)), 3).alias("cursor_s"))


@query("W1: top k of all", f"WITH {DET} SELECT event_id, round(confidence, 6) AS confidence FROM det ORDER BY confidence DESC, event_id LIMIT 50")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    return detections(spark, d).orderBy(F.desc("confidence"), "event_id").limit(50).select("event_id", F.round("confidence", 6).alias("confidence"))


@query("W12: the 15 cameras with the most detections", "SELECT l_suppkey AS camera, count(*) AS detections FROM lineitem GROUP BY l_suppkey ORDER BY detections DESC, camera LIMIT 15")
def busiest_cameras(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("camera")).agg(F.count("*").alias("detections")).orderBy(F.desc("detections"), "camera").limit(15)


def recent(sessions: DataFrame, limit: int = 10) -> DataFrame:
    """The sessions (query_id, query_text, state, candidates, created_at, updated_at: texts) that were changed last, at least 1 and at most 100 of them."""
    changed = F.coalesce(F.nullif("updated_at", F.lit("")), F.nullif("created_at", F.lit("")), F.lit(""))
    first = sessions.withColumn("__at", changed).orderBy(F.desc("__at"), "query_id").limit(max(1, min(limit, 100)))
    updated = F.coalesce("updated_at", F.lit(""))
    time = F.when(F.length(updated) >= 16, F.substring(updated, 12, 5)).otherwise("")
    text = F.coalesce(F.nullif("query_text", F.lit("")), F.lit("(无查询词)"))
    summary = F.concat(text, F.lit(" — 候选 "), F.coalesce("candidates", F.lit(0)).cast("string"), F.lit(" 条"))
    return first.select("query_id", time.alias("time"), updated.alias("timestamp"), F.coalesce(lookup(F.col("state"), v.STATE_NAMES), "state", F.lit("")).alias("type"), summary.alias("summary"), "state")


_STATES = ["searched", "confirmed", "idle", None, "tracing"]
_WORDS = ["红车", None, "", "白色面包车"]
_RECENT = f"""s AS (SELECT user_id AS query_id, max(event_id) AS e, count(*) AS n, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_at, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS created FROM events GROUP BY user_id),
x AS (SELECT query_id, {picked_sql(_WORDS, "e % 4")} AS query_text, {picked_sql(_STATES, "e % 5")} AS state, CASE WHEN e % 3 <> 0 THEN n END AS candidates, CASE WHEN e % 7 <> 0 THEN last_at END AS updated_at, created AS created_at FROM s)"""


@query(
    "W13: what was changed last, the limit of 500 that is asked for held to 100",
    f"""WITH {_RECENT} SELECT query_id, CASE WHEN length(coalesce(updated_at, '')) >= 16 THEN updated_at[12:16] ELSE '' END AS time, coalesce(updated_at, '') AS timestamp,
 coalesce(MAP {{{", ".join(f"'{k}': '{w}'" for k, w in v.STATE_NAMES.items())}}}[state], state, '') AS type, coalesce(nullif(query_text, ''), '(无查询词)') || ' — 候选 ' || coalesce(candidates, 0) || ' 条' AS summary, state
FROM x ORDER BY coalesce(nullif(updated_at, ''), created_at, '') DESC, query_id LIMIT 100""",
)
def recent_activities(spark: SparkSession, d: str) -> DataFrame:
    text = lambda ts: F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    s = read(spark, d, "events").groupBy(F.col("user_id").alias("query_id")).agg(F.max("event_id").alias("e"), F.count("*").alias("n"), text(F.max("ts")).alias("at"), text(F.min("ts")).alias("created_at"))
    e = F.col("e")
    return recent(s.select("query_id", picked(_WORDS, e % 4).alias("query_text"), picked(_STATES, e % 5).alias("state"), F.when(e % 3 != 0, F.col("n")).alias("candidates"), F.when(e % 7 != 0, F.col("at")).alias("updated_at"), "created_at"), 500)


@query("W2 W5: top k of each group", f"WITH {DET} SELECT camera, event_id, rank FROM (SELECT camera, event_id, row_number() OVER (PARTITION BY camera ORDER BY confidence DESC, event_id) AS rank FROM det) WHERE rank <= 10")
def top_k_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("camera").orderBy(F.desc("confidence"), "event_id")
    return detections(spark, d).select("camera", "event_id", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 10")


@query(
    "W6: best row of each track by score, then the first k; rows without a track are never merged",
    f"""WITH {DET}, x AS (SELECT *, CASE WHEN k % 10 = 0 THEN NULL ELSE vehicle END AS track FROM det), r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(track, -1 - event_id) ORDER BY confidence DESC, event_id) AS rn FROM x)
SELECT event_id, track, round(confidence, 6) AS confidence FROM r WHERE rn = 1 ORDER BY confidence DESC, event_id LIMIT 100""",
)
def dedup_top_k(spark: SparkSession, d: str) -> DataFrame:
    x = detections(spark, d).withColumn("track", F.when(F.col("k") % 10 != 0, F.col("vehicle")))
    best = x.groupBy(F.coalesce("track", -1 - F.col("event_id")).alias("g")).agg(F.max_by(F.struct("event_id", "track", "confidence"), F.struct("confidence", -F.col("event_id"))).alias("b")).select("b.*")
    return best.orderBy(F.desc("confidence"), "event_id").limit(100).select("event_id", "track", F.round("confidence", 6).alias("confidence"))


@query(
    "W15: k of n uniform by position in each track",
    f"WITH {DET}, p AS (SELECT vehicle, event_id, row_number() OVER (PARTITION BY vehicle ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY vehicle) AS n FROM det) SELECT vehicle, event_id FROM p WHERE i % greatest(1, n // 5) = 0 AND i // greatest(1, n // 5) < 5",
)
def sample_uniform(spark: SparkSession, d: str) -> DataFrame:
    own = Window.partitionBy("vehicle")
    p = detections(spark, d).select("vehicle", "event_id", (F.row_number().over(own.orderBy("t", "event_id")) - 1).alias("i"), F.count("*").over(own).alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 5))
    return p.where((F.col("i") % step == 0) & (F.floor(F.col("i") / step) < 5)).select("vehicle", "event_id")


@query(
    "W11 W18: speed of a stay, camera switches",
    f"""WITH {DET}, s AS (SELECT vehicle, camera, k, t, lag(camera) OVER (PARTITION BY vehicle ORDER BY t, event_id) AS before FROM det)
SELECT vehicle, CAST(sum(CASE WHEN camera <> before THEN 1 ELSE 0 END) AS BIGINT) AS switches, round((arg_max(k, t) - arg_min(k, t)) / nullif(max(t) - min(t), 0), 9) AS speed FROM s GROUP BY vehicle""",
)
def stay_speed(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("camera").over(Window.partitionBy("vehicle").orderBy("t", "event_id"))
    s = detections(spark, d).withColumn("before", before)
    speed = (F.max_by("k", "t") - F.min_by("k", "t")) / F.nullif(F.max("t") - F.min("t"), F.lit(0.0))
    return s.groupBy("vehicle").agg(F.sum(F.when(F.col("camera") != F.col("before"), 1).otherwise(0)).alias("switches"), F.round(speed, 9).alias("speed"))


SEED = 42


@query(
    "W16: hold-out of one camera of each identity that has several, in an order given by a seed",
    f"WITH {DET}, c AS (SELECT DISTINCT vehicle, camera FROM det) SELECT vehicle, camera, row_number() OVER (PARTITION BY vehicle ORDER BY md5({SEED} || '_' || camera || '_' || vehicle), camera) = 1 AND count(*) OVER (PARTITION BY vehicle) > 1 AS held_out FROM c",
)
def camera_holdout(spark: SparkSession, d: str) -> DataFrame:
    return held_out_cameras(detections(spark, d).select("vehicle", "camera").distinct())


def held_out_cameras(c: DataFrame, seed: int = SEED) -> DataFrame:
    """(vehicle, camera, held_out) of distinct (vehicle, camera)."""
    own = Window.partitionBy("vehicle")
    w = own.orderBy(F.md5(F.concat_ws("_", F.lit(str(seed)), "camera", F.col("vehicle").cast("string"))), "camera")
    return c.select("vehicle", "camera", ((F.row_number().over(w) == 1) & (F.count("*").over(own) > 1)).alias("held_out"))


@query(
    "U6: checks of a split: identities on both sides, cameras of an identity on both sides",
    f"WITH {DET}, c AS (SELECT DISTINCT vehicle, camera FROM det), h AS (SELECT vehicle, camera, row_number() OVER (PARTITION BY vehicle ORDER BY md5({SEED} || '_' || camera || '_' || vehicle), camera) = 1 AND count(*) OVER (PARTITION BY vehicle) > 1 AS held_out FROM c) SELECT 'identities' AS leak, count(*) AS n FROM (SELECT vehicle FROM h WHERE held_out INTERSECT SELECT vehicle FROM h WHERE NOT held_out) UNION ALL SELECT 'cameras', count(*) FROM (SELECT vehicle, camera FROM h WHERE held_out INTERSECT SELECT vehicle, camera FROM h WHERE NOT held_out)",
)
def split_leaks(spark: SparkSession, d: str) -> DataFrame:
    h = held_out_cameras(detections(spark, d).select("vehicle", "camera").distinct())
    one, other = h.where("held_out"), h.where("not held_out")
    count = lambda columns, name: one.select(*columns).intersect(other.select(*columns)).agg(F.count("*").alias("n")).select(F.lit(name).alias("leak"), "n")
    return count(["vehicle"], "identities").union(count(["vehicle", "camera"], "cameras"))


@query("U1: union of sources with counts", "SELECT source, count(*) AS n FROM (SELECT 'orders' AS source FROM orders UNION ALL SELECT 'lines' FROM lineitem UNION ALL SELECT 'customers' FROM customer) GROUP BY source")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    parts = [read(spark, d, t).select(F.lit(name).alias("source")) for t, name in (("orders", "orders"), ("lineitem", "lines"), ("customer", "customers"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source").agg(F.count("*").alias("n"))


@query(
    "U2: what is there, and the new rows whose key is not there yet",
    "SELECT c_custkey AS key, 'old' AS part FROM customer UNION ALL SELECT DISTINCT o_orderkey % 3000, 'new' FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_orderkey % 3000)",
)
def union_new_rows(spark: SparkSession, d: str) -> DataFrame:
    old = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit("old").alias("part"))
    new = read(spark, d, "orders").select((F.col("o_orderkey") % 3000).alias("key")).distinct().join(old, "key", "left_anti")
    return old.unionByName(new.select("key", F.lit("new").alias("part")))


@query("U3 U4: intersect and except of id sets", "SELECT 'both' AS part, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'none', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def intersect_except(spark: SparkSession, d: str) -> DataFrame:
    a, b = read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").select("o_custkey")
    count = lambda df, part: df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    return count(a.intersect(b), "both").unionByName(count(a.subtract(b), "none"))


@query("U5: an edge list made symmetric", "WITH e AS (SELECT n_nationkey AS a, (n_nationkey + 7) % 25 AS b FROM nation) SELECT a, b FROM e UNION SELECT b, a FROM e")
def symmetrise(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") + 7) % 25).alias("b"))
    return e.union(e.select("b", "a")).distinct()
