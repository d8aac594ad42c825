"""Queries on the camera graph: a fixed dimension of at most a few hundred cameras, whatever the detections' size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.expressions import haversine_m, haversine_sql
from sightline.registry import query
from sightline.session import written
from sightline.sources.tables import CAMERAS, cameras, read

HOPS = 10
_ADJ = """adj AS MATERIALIZED (SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey AND (b.n_nationkey = (a.n_nationkey + 1) % 25 OR (a.n_regionkey = b.n_regionkey AND (a.n_nationkey + b.n_nationkey) % 3 = 0)))"""


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    """Directed: the next camera of the ring, and some of the same scene. One partition, as the dimension is small, so that its joins move nothing."""
    n = read(spark, d, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("ra")), n.select(F.col("n_nationkey").alias("b"), F.col("n_regionkey").alias("rb"))
    ring = n.select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") + 1) % 25).alias("b"))
    scene = a.join(b, F.col("ra") == F.col("rb")).where("a <> b and (a + b) % 3 = 0").select("a", "b")
    return ring.union(scene).coalesce(1).distinct()


def chained(x: DataFrame, y: DataFrame) -> DataFrame:
    """The best of x, and of x followed by y: (a, b, cost, way); cost, then way decides."""
    on = y.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("cost").alias("more"), F.col("way").alias("rest"))
    longer = x.join(on, "b").where("a <> c").select("a", F.col("c").alias("b"), (F.col("cost") + F.col("more")).alias("cost"), F.concat("way", "rest").alias("way"))
    return x.union(longer).coalesce(1).groupBy("a", "b").agg(F.min(F.struct("cost", "way")).alias("m")).select("a", "b", "m.cost", "m.way")


def shortest_ways(edges: DataFrame, steps: int) -> DataFrame:
    """(a, b, cost, way) of the cheapest ways of up to `steps` edges (a, b, cost); way: the nodes after a. Ways are doubled, so log2(steps)
    joins do; none is listed but the best of each pair."""
    power = edges.select("a", "b", "cost", F.array("b").alias("way"))
    out, n = None, 1
    while n <= steps:
        if steps & n:
            out = power if out is None else chained(out, power)
        n *= 2
        if n <= steps:
            power = written(chained(power, power), "ways")  # read twice by the next doubling
    return out


def hops(adj: DataFrame, limit: int = HOPS) -> DataFrame:
    """(a, b, hops) for all pairs within `limit` steps, the least number of steps."""
    return shortest_ways(adj.select("a", "b", F.lit(1).alias("cost")), limit).select("a", "b", F.col("cost").alias("hops"))


_HOPS = f"RECURSIVE {_ADJ}, walk AS (SELECT a, b, 1 AS hops FROM adj UNION SELECT walk.a, adj.b, hops + 1 FROM walk JOIN adj ON walk.b = adj.a WHERE hops < {HOPS} AND walk.a <> adj.b)"


@query("G1 G8: reachability within ten hops, the number of hops and of cameras between", f"WITH {_HOPS} SELECT a, b, min(hops) AS hops, min(hops) - 1 AS between FROM walk GROUP BY a, b")
def reachability(spark: SparkSession, d: str) -> DataFrame:
    return hops(adjacency(spark, d)).withColumn("between", F.col("hops") - 1)


@query("G3: neighbours at exactly two hops", f"WITH {_HOPS} SELECT a, b FROM walk GROUP BY a, b HAVING min(hops) = 2")
def n_hop(spark: SparkSession, d: str) -> DataFrame:
    return hops(adjacency(spark, d), 2).where("hops = 2").select("a", "b")


_METRES = "CASE WHEN (a * 7 + b) % 11 <> 0 THEN abs(a - b) * 100 + a * b % 37 END"


def metres(a, b):
    """Made-up lengths; some are unknown."""
    return F.when((a * 7 + b) % 11 != 0, F.abs(a - b) * 100 + a * b % 37)


def _doubled_sql(steps: int) -> str:
    """The same doubling as a chain of views p0, p1, ... over the edges `p`."""
    join = lambda name, x, y: f"{name} AS MATERIALIZED (SELECT a, b, min(s) AS s FROM (SELECT a, b, s FROM {x} UNION ALL SELECT x.a, y.b, {{'cost': x.s.cost + y.s.cost, 'way': x.s.way || y.s.way}} FROM {x} x JOIN {y} y ON x.b = y.a WHERE x.a <> y.b) GROUP BY a, b)"
    out, last, power, n = [], None, "p0", 1
    while n <= steps:
        if steps & n:
            if last is None:
                last = power
            else:
                out.append(join(f"q{n}", last, power))
                last = f"q{n}"
        n *= 2
        if n <= steps:
            out.append(join(f"p{n}", power, power))
            power = f"p{n}"
    return ", ".join(out) + f", ways AS (SELECT * FROM {last})"


@query(
    "G2 G4: shortest ways in metres, unknown parts counting nothing on the way; the edge's own length first, NULL if a part is unknown",
    f"""WITH {_ADJ}, p0 AS MATERIALIZED (SELECT a, b, {{'cost': CAST(coalesce({_METRES}, 0) AS BIGINT), 'way': [b]}} AS s FROM adj), {_doubled_sql(24)},
steps AS (SELECT a AS start, b AS goal, unnest(list_zip(list_prepend(a, s.way[:-2]), s.way)) AS e FROM ways), known AS (SELECT start, goal, bool_and({_METRES.replace("a ", "e[1] ").replace("(a", "(e[1]").replace(" b", " e[2]").replace("+ b)", "+ e[2])")} IS NOT NULL) AS k FROM steps GROUP BY ALL)
SELECT ways.a, ways.b, array_to_string(list_prepend(ways.a, s.way), '>') AS way, CASE WHEN adj.a IS NOT NULL THEN {_METRES.replace("a ", "ways.a ").replace("(a", "(ways.a").replace(" b", " ways.b").replace("+ b)", "+ ways.b)")} WHEN k THEN s.cost END AS metres FROM ways JOIN known ON start = ways.a AND goal = ways.b LEFT JOIN adj ON adj.a = ways.a AND adj.b = ways.b""",
)
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """Ways of up to 24 edges, which all simple ways of 25 cameras are."""
    adj = adjacency(spark, d)
    a, b = F.col("a"), F.col("b")
    ways = shortest_ways(adj.select("a", "b", F.coalesce(metres(a, b), F.lit(0)).cast("long").alias("cost")), 24)
    nodes = F.col("nodes")
    unknown = F.exists(F.sequence(F.lit(1), F.size("way")), lambda i: metres(F.element_at(nodes, i), F.element_at(nodes, i + 1)).isNull())
    own = adj.withColumn("edge", F.lit(True))
    length = F.when(F.col("edge"), metres(a, b).cast("long")).when(~unknown, F.col("cost"))
    ways = ways.withColumn("nodes", F.concat(F.array("a"), "way"))
    return ways.join(own, ["a", "b"], "left").select("a", "b", F.array_join(F.transform(nodes, lambda x: x.cast("string")), ">").alias("way"), length.alias("metres"))


_PATHS = lambda steps: f"""RECURSIVE {_ADJ}, path AS (SELECT a, b, [a, b] AS nodes, 1 AS n FROM adj UNION ALL SELECT path.a, adj.b, list_append(nodes, adj.b), n + 1 FROM path JOIN adj ON path.b = adj.a WHERE n < {steps} AND NOT list_contains(nodes, adj.b))"""


def simple_paths(adj: DataFrame, steps: int) -> list[DataFrame]:
    """For each number of edges up to `steps` the simple paths (a, b, nodes)."""
    edge = adj.select(F.col("a").alias("x"), F.col("b").alias("y"))
    out = [edge.select(F.col("x").alias("a"), F.col("y").alias("b"), F.array("x", "y").alias("nodes"))]
    for _ in range(steps - 1):
        out.append(out[-1].join(edge, F.col("b") == F.col("x")).where(~F.array_contains("nodes", F.col("y"))).select("a", F.col("y").alias("b"), F.array_append("nodes", F.col("y")).alias("nodes")))
    return out


@query("G7: simple paths of up to six edges, at least one and at most five counted", f"WITH {_PATHS(6)} SELECT a, b, greatest(1, least(count(*), 5)) AS paths FROM path GROUP BY a, b")
def path_count(spark: SparkSession, d: str) -> DataFrame:
    found = None
    for part in simple_paths(adjacency(spark, d), 6):
        counted = part.groupBy("a", "b").agg(F.count("*").alias("n"))
        found = counted if found is None else found.union(counted)
    return found.groupBy("a", "b").agg(F.greatest(F.lit(1).cast("long"), F.least(F.sum("n"), F.lit(5).cast("long"))).alias("paths"))


@query(
    "G12: maximal chains: simple paths of four edges, or shorter ones that no edge extends",
    f"WITH {_PATHS(4)} SELECT array_to_string(nodes, '>') AS chain FROM path p WHERE n = 4 OR NOT EXISTS (SELECT 1 FROM adj WHERE adj.a = p.b AND NOT list_contains(p.nodes, adj.b))",
)
def maximal_chains(spark: SparkSession, d: str) -> DataFrame:
    adj = adjacency(spark, d)
    paths = simple_paths(adj, 4)
    more = adj.select(F.col("a").alias("x"), F.col("b").alias("y"))
    out = paths[-1].select("nodes")
    for part in paths[:-1]:
        out = out.union(part.join(more, (F.col("b") == F.col("x")) & ~F.array_contains("nodes", F.col("y")), "left_anti").select("nodes"))
    return out.select(F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("chain"))


@query(
    "G13: the way of each camera from a start by steps of hops, each met once, from the neighbour with the best score so far",
    f"""WITH {_ADJ}, s0 AS (SELECT n_nationkey AS start, n_nationkey AS pos, 0.0::DOUBLE AS score FROM nation)"""
    + "".join(
        f""", s{i} AS MATERIALIZED (SELECT start, adj.b AS pos, max(score + (adj.a * 3 + adj.b) % 7 / 7.0) AS score FROM s{i - 1} JOIN adj ON adj.a = s{i - 1}.pos WHERE NOT EXISTS (SELECT 1 FROM ({" UNION ALL ".join(f"SELECT start, pos FROM s{j}" for j in range(i))}) m WHERE m.start = s{i - 1}.start AND m.pos = adj.b) GROUP BY ALL)"""
        for i in range(1, 5)
    )
    + " SELECT start, pos AS camera, hops, round(score, 6) AS score FROM (" + " UNION ALL ".join(f"SELECT start, pos, {i} AS hops, score FROM s{i}" for i in range(1, 5)) + ")",
)
def best_scored_ways(spark: SparkSession, d: str) -> DataFrame:
    adj = adjacency(spark, d)
    edge = adj.select(F.col("a").alias("at"), F.col("b").alias("to"), ((F.col("a") * 3 + F.col("b")) % 7 / 7.0).alias("gain"))
    front = read(spark, d, "nation").select(F.col("n_nationkey").alias("start"), F.col("n_nationkey").alias("at"), F.lit(0.0).alias("score"))
    met, out = front.select("start", "at"), None
    for i in range(1, 5):
        step = front.join(edge, "at").groupBy("start", F.col("to").alias("at")).agg(F.max(F.col("score") + F.col("gain")).alias("score"))
        front = step.join(met, ["start", "at"], "left_anti").coalesce(1)
        found = front.select("start", F.col("at").alias("camera"), F.lit(i).alias("hops"), F.round("score", 6).alias("score"))
        out, met = (found if out is None else out.union(found)), met.union(front.select("start", "at")).coalesce(1)
    return out


@query("G6: degrees and neighbours, edges without a return", f"WITH {_ADJ} SELECT a, count(*) AS degree, string_agg(b, ',' ORDER BY b) AS neighbours, CAST(sum((NOT EXISTS (SELECT 1 FROM adj r WHERE r.a = adj.b AND r.b = adj.a))::INT) AS BIGINT) AS one_way FROM adj GROUP BY a")
def topology_degrees(spark: SparkSession, d: str) -> DataFrame:
    adj = adjacency(spark, d)
    back = adj.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1).alias("back"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda x: x.cast("string")), ",")
    return adj.join(back, ["a", "b"], "left").groupBy("a").agg(F.count("*").alias("degree"), listed.alias("neighbours"), F.sum(F.col("back").isNull().cast("int")).alias("one_way"))


_SCENES = "cam AS (SELECT n_regionkey AS scene, n_nationkey AS camera, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation)"


@query(
    "G17: made topologies of each scene: complete, path and grid of three columns",
    f"WITH {_SCENES}, p AS (SELECT x.scene, x.camera AS a, y.camera AS b, x.i AS i, y.i AS j FROM cam x JOIN cam y USING (scene) WHERE x.i <> y.i) SELECT 'complete' AS kind, a, b FROM p UNION ALL SELECT 'path', a, b FROM p WHERE abs(i - j) = 1 UNION ALL SELECT 'grid', a, b FROM p WHERE (abs(i - j) = 1 AND i // 3 = j // 3) OR abs(i - j) = 3",
)
def made_topologies(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("scene").orderBy("camera")) - 1
    cam = read(spark, d, "nation").select(F.col("n_regionkey").alias("scene"), F.col("n_nationkey").alias("camera")).withColumn("i", i)
    p = cam.select("scene", F.col("camera").alias("a"), "i").join(cam.select("scene", F.col("camera").alias("b"), F.col("i").alias("j")), "scene").where("i <> j")
    near, row = F.abs(F.col("i") - F.col("j")), F.floor(F.col("i") / 3) == F.floor(F.col("j") / 3)
    kinds = F.array(F.lit("complete"), F.when(near == 1, "path"), F.when(((near == 1) & row) | (near == 3), "grid"))
    return p.select(F.explode(F.array_compact(kinds)).alias("kind"), "a", "b")


@query(
    "G18: checks of a topology: edges to unknown cameras, edges without a return, cameras that the first does not reach",
    f"""WITH {_HOPS}, bad AS (SELECT a, b FROM adj UNION ALL VALUES (3, 99), (98, 4)) SELECT 'dangling' AS problem, count(*) AS n FROM bad WHERE a NOT IN (SELECT n_nationkey FROM nation) OR b NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'one_way', count(*) FROM adj WHERE NOT EXISTS (SELECT 1 FROM adj r WHERE r.a = adj.b AND r.b = adj.a) UNION ALL SELECT 'unreached', count(*) FROM nation WHERE n_nationkey <> 0 AND n_nationkey NOT IN (SELECT b FROM walk WHERE a = 0)""",
)
def topology_checks(spark: SparkSession, d: str) -> DataFrame:
    adj = adjacency(spark, d)
    known = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    bad = adj.union(spark.createDataFrame([(3, 99), (98, 4)], "a int, b int"))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    ends = bad.join(known.withColumn("ka", F.lit(True)), F.col("a") == F.col("k"), "left").drop("k").join(known.withColumn("kb", F.lit(True)), F.col("b") == F.col("k"), "left")
    one_way = adj.join(adj.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    unreached = known.where("k <> 0").join(hops(adj).where("a = 0").select(F.col("b").alias("k")), "k", "left_anti")
    return count(ends.where("ka is null or kb is null"), "dangling").union(count(one_way, "one_way")).union(count(unreached, "unreached"))


@query(
    "G19: cameras as GeoJSON features, as text",
    f"""WITH {CAMERAS} SELECT camera, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || printf('%.6f', lon) || ',' || printf('%.6f', lat) || ']}},"properties":{{"name":"' || name || '","scene":' || scene || '}}}}' AS feature FROM cameras""",
)
def geo_features(spark: SparkSession, d: str) -> DataFrame:
    text = F.format_string('{"type":"Feature","geometry":{"type":"Point","coordinates":[%.6f,%.6f]},"properties":{"name":"%s","scene":%d}}', "lon", "lat", "name", "scene")
    return cameras(spark, d).select("camera", text.alias("feature"))


@query(
    "J23: the three nearest camera pairs of each pair of scenes, both ways",
    f"""WITH {CAMERAS}, p AS (SELECT a.camera AS a, b.camera AS b, a.scene AS sa, b.scene AS sb, {haversine_sql("a.lat", "a.lon", "b.lat", "b.lon")} AS m FROM cameras a JOIN cameras b ON a.scene < b.scene), r AS (SELECT *, row_number() OVER (PARTITION BY sa, sb ORDER BY round(m, 6), a, b) AS r FROM p)
SELECT a, b, round(m, 3) AS metres FROM r WHERE r <= 3 UNION ALL SELECT b, a, round(m, 3) FROM r WHERE r <= 3""",
)
def scene_bridges(spark: SparkSession, d: str) -> DataFrame:
    """Each camera is sent to the other scenes by name, so the pairs come from an equi-join by scene."""
    from pyspark.sql import Window

    cam = cameras(spark, d)
    scenes = cam.select("scene").distinct().agg(F.collect_list("scene").alias("all"))  # one row, as many numbers as scenes
    sent = cam.join(F.broadcast(scenes), F.lit(True)).withColumn("to", F.explode("all")).where("scene < to").select(F.col("camera").alias("a"), F.col("scene").alias("sa"), "to", F.col("lat").alias("la"), F.col("lon").alias("lo"))
    p = sent.join(cam.select(F.col("camera").alias("b"), F.col("scene").alias("to"), "lat", "lon"), "to").withColumn("m", haversine_m(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon")))
    r = p.withColumn("r", F.row_number().over(Window.partitionBy("sa", "to").orderBy(F.round("m", 6), "a", "b"))).where("r <= 3").select("a", "b", F.round("m", 3).alias("metres"))
    return r.union(r.select("b", "a", "metres"))
