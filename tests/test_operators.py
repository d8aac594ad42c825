"""Operators on small fixtures with values worked out by hand."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions.expressions import angle_diff, haversine_m, iou
from sightline.operators.joins import nearest_other, within_seconds
from sightline.operators.ordered import assignment, connected, constrained_union, frame_matches, identity_f1
from sightline.operators.scores import WEIGHTS, direction_score, redistributed, spatial_score, temporal_score
from sightline.operators.topology import RoadTopology
from sightline.sources.datastore import available, build, load_detections, load_stats, read_baseline, read_global_truth, read_mot, read_pairs, same_rows
from sightline.streaming.sessions import TRANSITIONS, Track, overlaps


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("gap", "distance", "expected"), [(120.0, None, 1.0), (520.0, None, np.exp(-0.5)), (100.0, 1000.0, 1.0), (-1.0, 1000.0, 0.0)])
def test_temporal(spark, gap, distance, expected):
    assert value(spark, temporal_score(F.lit(gap), F.lit(distance).cast("double"))) == pytest.approx(expected)


def test_spatial_direction_angle(spark):
    assert value(spark, spatial_score(F.lit(72.0), F.lit(1000.0))) == pytest.approx(1.0)
    assert value(spark, spatial_score(F.lit(0.0), F.lit(1000.0))) == 0
    assert [value(spark, direction_score(F.lit(x))) for x in (0, 45, 135)] == [1.0, 0.5, 0.0]
    assert value(spark, angle_diff(F.lit(350), F.lit(10))) == 20
    assert value(spark, haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(np.pi * 6_371_000)


def test_weights_of_missing_parts(spark):
    parts = {"plate": F.lit(None).cast("double"), "temporal": F.lit(1.0), "topology": F.lit(1.0), "reid": F.lit(None).cast("double")}
    score, dropped = redistributed(parts, WEIGHTS)
    assert value(spark, score) == pytest.approx(1.0) and value(spark, dropped) == "plate,reid"


def test_iou(spark):
    df = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0), (5.0, 5.0, 15.0, 15.0))], "a struct<x1: double, y1: double, x2: double, y2: double>, b struct<x1: double, y1: double, x2: double, y2: double>")
    assert df.select(iou("a", "b").alias("x")).first().x == pytest.approx(25 / 175)


def test_range_join_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), float(t), float(t + w)) for k, t, w in zip(rng.integers(0, 3, 80), rng.uniform(0, 3000, 80), rng.uniform(0, 50, 80), strict=True)]
    df = spark.createDataFrame(rows, "k int, start double, end double")
    found = within_seconds(df, df, ["k"], "end", "start", 300.0).count()
    assert found == sum(a[0] == b[0] and 0 < b[1] - a[2] <= 300 for a in rows for b in rows)


def test_assignment_equals_brute_force():
    rng = np.random.default_rng(2)
    for n, m in itertools.product(range(1, 5), range(1, 5)):
        gain = rng.integers(0, 9, (n, m)).astype(float)
        best = max(sum(gain[i, j] for i, j in zip(rows, cols, strict=True)) for k in [min(n, m)] for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
        assert sum(gain[i, j] for i, j in assignment(gain)) == best


def test_constrained_union_refuses_one_camera_twice(spark):
    edges = spark.createDataFrame([(0, 1, 1, 2, 2, 0.9), (0, 2, 2, 3, 1, 0.8), (0, 3, 1, 4, 2, 0.7)], "scene long, a long, camera_a long, b long, camera_b long, score double")
    assert {r.node: r.cluster for r in constrained_union(edges).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}


def test_identity_and_mot(spark):
    counts = spark.createDataFrame([(0, 1, 10, 3), (0, 1, 11, 2), (0, 2, 10, 4)], "scene long, gt long, pred long, n long")
    row = identity_f1(counts).first()
    assert (row.idtp, row.idf1) == (6, round(6 / 9, 6))


def test_frames_are_matched_each_by_itself(spark):
    box = "camera long, frame long, id long, x1 double, y1 double, x2 double, y2 double"
    truth = spark.createDataFrame([(0, 1, 1, 0.0, 0.0, 10.0, 10.0), (0, 1, 2, 20.0, 0.0, 30.0, 10.0), (0, 2, 1, 0.0, 0.0, 10.0, 10.0)], box)
    found = spark.createDataFrame([(0, 1, 7, 1.0, 0.0, 11.0, 10.0), (0, 3, 8, 0.0, 0.0, 10.0, 10.0)], box)
    assert {(r.frame, r.gt, r.pred) for r in frame_matches(truth, found).collect()} == {(1, 1, 7), (1, 2, None), (2, 1, None), (3, None, 8)}


def test_connected_parts_and_their_merging_against_plain_versions(spark):
    rng = np.random.default_rng(3)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (50, 2)) if a != b} | {(i, i + 1) for i in range(100, 140)})
    label = {n: n for e in pairs for n in e}
    for _ in range(200):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    assert all(r.part == label[r.a] == label[r.b] for r in connected(df, "a", "b").collect())
    score = {e: float(rng.integers(0, 9)) for e in pairs}
    edges = spark.createDataFrame([(0, a, a % 5, b, b % 5, score[a, b]) for a, b in pairs], "scene long, a long, camera_a long, b long, camera_b long, score double")
    group, cameras = {n: n for n in label}, {n: {n % 5} for n in label}
    for a, b in sorted(pairs, key=lambda e: (-score[e], e)):
        x, y = sorted((group[a], group[b]))
        if x != y and not cameras[x] & cameras[y]:
            cameras[x] |= cameras[y]
            group = {n: x if g == y else g for n, g in group.items()}
    assert {r.node: r.cluster for r in constrained_union(edges).collect()} == group


def test_road_topology():
    roads = RoadTopology({("a", "b"): 5.0, ("b", "c"): 5.0, ("a", "c"): 20.0, ("c", "d"): None, ("b", "d"): 9.0})
    assert roads.hops("a") == {"a": 0, "b": 1, "c": 1, "d": 2} and roads.hops("a", 1) == {"a": 0, "b": 1, "c": 1} and roads.hops("d", 0) == {"d": 0}
    assert roads.way("a", "c") == ["a", "b", "c"] and roads.metres("a", "c") == 20.0 and roads.metres("a", "d") is None and roads.way("d", "a") is None
    assert roads.paths("a", "d") == 3 and roads.paths("a", "nowhere") == 1 and roads.paths("d", "a") == 1 and roads.paths("a", "d", most=2) == 2


def test_store_round_trip(spark, tmp_path):
    det = spark.createDataFrame([("a", "t1", "c1", "S1", 1, "x", "vehicle", 0.5, [1.0], {"color": "red"}, None, [0.1]), ("b", "t1", "c2", "S1", 2, "y", "vehicle", 0.6, None, None, None, None)], "target_id string, track_id string, camera_id string, scene_id string, frame_id int, timestamp string, target_type string, confidence double, bbox array<double>, attributes map<string, string>, keyframe_path string, clip_image_vector array<double>")
    tracks = spark.createDataFrame([("t1", "vehicle")], "track_id string, target_type string")
    path = f"file://{tmp_path}/store"
    assert not available(spark, path) and load_detections(spark, path) is None
    build(det, tracks, path)
    assert available(spark, path)
    assert same_rows(det.withColumn("attributes", F.to_json("attributes")), load_detections(spark, path, with_vectors=True))
    assert load_stats(spark, path).first().asDict() == {"detections": 2, "tracks": 1, "cameras": 2}


def test_text_sources(spark, tmp_path):
    (tmp_path / "gt.txt").write_text("1,7,10,20,5,6,1,-1,-1,-1\nbad\n")
    (tmp_path / "all.txt").write_text("1 5 3 10 20 30 40 1\n2,6,4,1,2,3,4,1\n")
    (tmp_path / "S01.txt").write_text("c001 0\nc002 1.640\n")
    (tmp_path / "b.csv").write_text("camera,frame,x1,y1,x2,y2,label,confidence\nc1,1,0,0,1,1,car,0.2\nc1,2,0,0,1,1,car,0.4\n")
    at = lambda n: f"file://{tmp_path}/{n}"
    assert [tuple(r) for r in read_mot(spark, at("gt.txt")).collect()] == [(1, 7, 10.0, 20.0, 15.0, 26.0)]
    assert {r.camera for r in read_global_truth(spark, at("all.txt")).collect()} == {1, 2}
    assert {(r.scene, r.camera, r.value) for r in read_pairs(spark, at("S01.txt")).collect()} == {("S01", "c001", 0.0), ("S01", "c002", 1.64)}
    assert read_baseline(spark, at("b.csv")).count() == 1


def test_tracker_parts():
    t = Track(1, [0, 0, 10, 10])
    for i in range(1, 4):
        t.predict()
        t.update([i, 0, 10 + i, 10])
    t.predict()
    assert abs(t.box()[0] - 4) < 0.7 and t.hits == 4
    assert overlaps(np.array([[0, 0, 10, 10]]), np.array([[5, 5, 15, 15]]))[0, 0] == pytest.approx(25 / 175)
    assert TRANSITIONS["reported"] == set()


def test_settings():
    from sightline.config import Settings

    own = Settings({"a": {"b": 1, "on": False, "names": ["x"]}, "t": "text"}, {"SIGHTLINE_A__B": "7", "SIGHTLINE_A__ON": "true", "SIGHTLINE_A__NAMES": "p, q"})
    assert (own.get("a.b"), own.get("a.on"), own.get("a.names"), own.get("t"), own.get("a.none", 3), own.get("t.deeper")) == (7, True, ["p", "q"], "text", 3, None)


def test_query_parser_on_texts_with_known_answers(spark):
    from sightline.plans.query_text import parse_queries

    def parsed(text):
        return parse_queries(spark.createDataFrame([(text,)], "text string").withColumn("own", F.col("text"))).first()

    plate = parsed("找苏E12345这辆车")
    assert (plate.query_type, plate.plate, plate.target_type, plate.color) == ("plate", "苏E12345", "vehicle", None)
    bag = parsed("背红色书包的女人")
    assert (bag.target_type, bag.gender, bag.bag, bag.bag_color) == ("pedestrian", "female", "true", "红色")
    vague = parsed("深色大车")
    assert (vague.color, vague.vehicle_type, vague.color_candidates, vague.type_candidates) == ("深色", "大车", ["黑色", "灰色", "棕色", "蓝色"], ["卡车", "公交车"])
    longest = parsed("白色小轿车旁的电动车")
    assert (longest.target_type, longest.color, longest.vehicle_type) == ("vehicle", "白色", "轿车")
    assert parsed("随便").query_type == "general"


def test_session_machine_against_a_plain_one(spark, small):
    from sightline.registry import QUERIES
    from sightline.sources.tables import read

    rows = read(spark, small, "events").select("user_id", "event_id").collect()
    names, expected = ("searched", "confirmed", "traced", "reported"), {}
    for r in sorted(rows, key=lambda r: r.event_id):
        now, refused = expected.get(r.user_id, ("created", 0))
        event = names[r.event_id % 4]
        expected[r.user_id] = (event, refused) if event in TRANSITIONS[now] else (now, refused + 1)
    assert {r.session: (r.state, r.refused) for r in QUERIES["session_fsm"](spark, small).collect()} == expected


def test_tracker_stream_against_a_plain_loop(spark, tmp_path):
    from sightline.streaming.sessions import track_objects

    rng = np.random.default_rng(7)
    schema = "camera string, frame long, x1 double, y1 double, x2 double, y2 double"
    rows = []
    for camera in ("a", "b"):
        at = rng.uniform(0, 300, (3, 2))
        for frame in range(12):
            at += rng.uniform(-1, 4, (3, 2))
            rows += [(camera, frame, float(x), float(y), float(x) + 40, float(y) + 30) for x, y in at if rng.uniform() > 0.15]
    # The second file has later frames and one that comes too late.
    for part, keep in (("1", lambda r: r[1] < 6), ("2", lambda r: r[1] >= 6)):
        spark.createDataFrame([r for r in rows if keep(r)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    late = [("a", 2, 0.0, 0.0, 40.0, 30.0)]
    spark.createDataFrame(late, schema).coalesce(1).write.parquet(f"{tmp_path}/in/3")
    out = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    track_objects(stream).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(lambda b, n: out.extend(tuple(r) for r in b.collect())).start().awaitTermination()
    expected = []
    for camera in ("a", "b"):
        number, tracks = 0, []
        for frame in sorted({r[1] for r in rows if r[0] == camera}):
            boxes = sorted([list(r[2:]) for r in rows if r[:2] == (camera, frame)])
            for t in tracks:
                t.predict()
            pairs = sorted(((float(overlaps(t.box()[None], np.array([b]))[0, 0]), -i * len(boxes) - j, i, j) for i, t in enumerate(tracks) for j, b in enumerate(boxes)), reverse=True)
            met, free = set(), set(range(len(boxes)))
            for score, _, i, j in pairs:
                if score >= 0.3 and i not in met and j in free:
                    met.add(i)
                    free.discard(j)
                    tracks[i].update(boxes[j])
            for j in sorted(free):
                number += 1
                tracks.append(Track(number, boxes[j]))
            tracks = [t for t in tracks if t.age <= 30]
            expected += [(camera, frame, t.number, *map(float, t.box())) for t in tracks if t.hits >= 3]
    found, expected = sorted(out), sorted(expected)
    assert [r[:3] for r in found] == [r[:3] for r in expected] and expected
    assert np.allclose([r[3:] for r in found], [r[3:] for r in expected], atol=1e-3)


def _vectors(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    label = rng.integers(0, 12, n)
    m = centres[label] + 0.25 * rng.normal(size=(n, 16))
    m[7] = m[3]  # an equal one
    m[11] = 0
    rows = [(i, int(label[i]), [float(x) for x in m[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), m, label


def _plain_cosines(m):
    norm = np.sqrt((m * m).sum(1))
    u = m / np.where(norm > 0, norm, 1)[:, None]
    return np.round(u @ u.T, 9) + 0.0


def test_index_is_exact_and_skips_cells(spark, monkeypatch):
    from sightline.operators import vectors

    monkeypatch.setattr(vectors, "CELL", 40)
    e, m, _ = _vectors(spark)
    s = _plain_cosines(m)
    index = vectors.build_index(e, 20)
    assert sum(n for _, n, _, _ in index.cells()) == 600
    for k, apart in ((5, None), (5, 3), (700, None)):
        found, visited = vectors.search_index(index, e.where("vec_id % 50 = 0 or vec_id in (3, 11)"), k, apart)
        got = {}
        for r in found.collect():
            got.setdefault(r.q, {})[r.rank] = r.g
        for q in [*range(0, 600, 50), 3, 11]:
            others = [g for g in range(600) if (g % apart != q % apart if apart else g != q)]
            best = sorted(others, key=lambda g: (-s[q, g], g))[:k]
            assert [got[q][i + 1] for i in range(len(best))] == best
        looked = {r.q: r.visited for r in visited.collect()}
        if k == 5:
            assert sum(looked[q] for q in range(0, 600, 50)) < 0.5 * 12 * len(index.cells())
    none = e.limit(0)
    assert vectors.search_index(vectors.build_index(none), e, 3)[0].count() == 0
    assert vectors.search_index(index, none, 3)[0].count() == 0


def test_hit_ranks_by_counting(spark, monkeypatch):
    from sightline.operators import vectors

    monkeypatch.setattr(vectors, "CELL", 40)
    e, m, label = _vectors(spark)
    s = _plain_cosines(m)
    queries = e.where("vec_id % 40 = 0 or vec_id = 3")
    for apart in (None, 5):
        expected = set()
        for q in [*range(0, 600, 40), 3]:
            order = sorted((g for g in range(600) if (g % apart != q % apart if apart else g != q)), key=lambda g: (-s[q, g], g))
            hits = [r + 1 for r, g in enumerate(order) if label[g] == label[q]]
            expected |= {(q, r, i + 1) for i, r in enumerate(hits)}
        assert {tuple(r) for r in vectors.hit_ranks(queries, e, apart).collect()} == expected
    alone = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [0.5, 0.5])], "vec_id long, label int, embedding array<double>")
    assert {tuple(r) for r in vectors.hit_ranks(alone, alone).collect()} == {(1, None, None), (2, None, None)}
    assert vectors.hit_ranks(alone.limit(1), alone.limit(1)).count() == 0


def test_k_reciprocal_against_a_plain_version(spark):
    from sightline.operators import vectors

    e, m, _ = _vectors(spark, 200, 4)
    s, k, n = _plain_cosines(m), 6, 200
    near = [sorted((g for g in range(n) if g != i), key=lambda g: (-s[i, g], g))[:k] for i in range(n)]
    sets = []
    for i in range(n):
        own = set(near[i])
        for j in near[i]:
            if 3 * len(own & set(near[j])) >= 2 * len(near[j]):
                own |= set(near[j])
        sets.append(own)
    expected = {}
    for q in range(0, n, 25):
        score = {g: round(0.5 * s[q, g] + 0.5 * len(sets[q] & sets[g]) / len(sets[q] | sets[g]), 9) for g in range(n) if g != q}
        expected[q] = sorted(score, key=lambda g: (-score[g], g))[:10]
    got = {}
    for r in vectors.reranked(e.where("vec_id % 25 = 0"), e, vectors.build_index(e), k, 10).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.g)
    assert got == expected


def _labelled(spark, n=400, anchors=23, seed=2):
    rng = np.random.default_rng(seed)
    label = rng.random(n) < 0.3
    x = np.round(rng.normal(size=(n, 3)) + label[:, None] * np.array([1.0, 0.3, 0.0]), 2)
    anchor = rng.integers(0, anchors, n)
    rows = [(int(a), bool(y), *map(float, v)) for a, y, v in zip(anchor, label, x, strict=True)]
    return spark.createDataFrame(rows, "anchor long, label boolean, a double, b double, c double"), anchor, label, x


def _plain_training(anchor, label, x, epochs, rate, margin, ranking):
    """Every pair is made, and gradients are taken by hand."""
    w, m, v = np.zeros(4), np.zeros(4), np.zeros(4)
    pairs = [(i, j) for i in range(len(label)) for j in range(len(label)) if label[i] and not label[j] and anchor[i] == anchor[j]]
    for t in range(1, epochs + 1):
        s = x @ w[:3] + w[3]
        error = 1 / (1 + np.exp(-s)) - label
        slope = np.append(error @ x, error.sum()) / len(label)
        for i, j in pairs:
            if margin - (s[i] - s[j]) > 0:
                slope[:3] += ranking * (x[j] - x[i]) / len(pairs)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def test_edge_scorer_against_plain_training(spark):
    from sightline.operators import learned

    df, anchor, label, x = _labelled(spark)
    model = learned.train_edge_scorer(df, "anchor", "label", ["a", "b", "c"], epochs=12, rate=0.1, margin=0.5, ranking=0.7)
    assert np.allclose(np.append(model.weights, model.bias), _plain_training(anchor, label, x, 12, 0.1, 0.5, 0.7), atol=1e-9)
    assert model.losses[-1][0] < model.losses[0][0] and model.losses[-1][1] < model.losses[0][1]
    p = 1 / (1 + F.exp(-model.logit()))
    auc = learned.area_under_curve(df.withColumn("p", p), "p", "label").first().auc
    s = np.round(1 / (1 + np.exp(-(x @ model.weights + model.bias))), 4)
    pos, neg = s[label], s[~label]
    assert auc == pytest.approx(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)), abs=1e-3)
    assert auc > 0.7
    none = learned.train_edge_scorer(df.limit(0), "anchor", "label", ["a"], epochs=2)
    assert none.weights.tolist() == [0.0] and learned.area_under_curve(df.limit(0), "a", "label").first().auc is None


def test_hinges_without_pairs():
    from sightline.operators.learned import hinge_counts

    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        group, label, score = rng.integers(0, 4, n), rng.random(n) < 0.5, rng.integers(-3, 4, n) / 2
        near, loss, pairs = hinge_counts(group, label, score, 0.5)
        both = [(i, j) for i in range(n) for j in range(n) if label[i] and not label[j] and group[i] == group[j]]
        wide = [(i, j) for i, j in both if 0.5 - (score[i] - score[j]) > 0]
        assert pairs == len(both) and loss == pytest.approx(sum(0.5 - (score[i] - score[j]) for i, j in wide))
        assert near.tolist() == [sum(k in p for p in wide) for k in range(n)]


def test_nearest_other_is_linear_in_one_vehicle(spark):
    n = 100_000
    t = (F.col("id") * 7919 % n).cast("double")
    det = spark.range(n).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("vehicle"), F.when(F.col("id") % 3 == 0, "purchase").otherwise("click").alias("camera"), t.alias("t"))
    began = time.perf_counter()
    got = {r.event_id: (r.nearest, r.apart_s) for r in nearest_other(det, "click", "purchase").collect()}
    assert time.perf_counter() - began < 60 and len(got) == n - (n + 2) // 3
    at = {i * 7919 % n: i for i in range(n)}
    for i in range(1, 3000, 7):
        if i % 3:
            p = i * 7919 % n
            k = next(k for k in range(n) if any(at.get(x, 1) % 3 == 0 for x in (p - k, p + k)))
            assert got[i] == (next(at[x] for x in (p - k, p + k) if at.get(x, 1) % 3 == 0), float(k))


def test_union_in_rounds_against_taking_edges_one_by_one(spark):
    rng = np.random.default_rng(9)
    camera = {n: int(rng.integers(0, 6)) for n in range(80)}
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (260, 2)) if a != b} | {(60, n) for n in range(61, 80)} | {(n, n + 1) for n in range(60, 79)})
    rows = [(n % 2 * 0, a, camera[a], b, camera[b], float(rng.integers(0, 7)) / 7) for n, (a, b) in enumerate(pairs)]
    parent, cams = {n: n for n in camera}, {n: {c} for n, c in camera.items()}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for _, a, _, b, _, _ in sorted(rows, key=lambda r: (-r[5], r[1], r[3])):
        x, y = sorted((root(a), root(b)))
        if x != y and not cams[x] & cams[y]:
            parent[y] = x
            cams[x] |= cams[y]
    edges = spark.createDataFrame(rows, "scene long, a long, camera_a long, b long, camera_b long, score double").repartition(4)
    met = {n for r in rows for n in (r[1], r[3])}
    assert {r.node: r.cluster for r in constrained_union(edges).collect()} == {n: root(n) for n in met}
    alone = edges.where("a = 60 and camera_a = camera_b")
    assert all(r.node == r.cluster for r in constrained_union(alone).collect())


def test_registry_goes_on_after_a_restart(spark, tmp_path):
    from sightline.streaming.registry import Registry, kept_by

    schema = "key long, seq long, camera string, gone boolean"
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 40)), i, f"c{int(rng.integers(0, 4))}", bool(rng.random() < 0.2)) for i in range(600)]
    source, path = f"{tmp_path}/in", f"file://{tmp_path}/registry"
    fresh = lambda: Registry(spark, path, ["key"], "seq", schema, buckets=3, compact_every=3)
    assert fresh().table().count() == 0
    for part in range(7):
        # Batches come out of order too: a key's greatest seq counts, whenever it comes.
        spark.createDataFrame(rows[part::7], schema).coalesce(1).write.mode("append").parquet(source)
        kept_by(spark.readStream.schema(schema).parquet(source), fresh())
        seen = [r for p in range(part + 1) for r in rows[p::7]]
        last = {}
        for r in sorted(seen, key=lambda r: r[1]):
            last[r[0]] = r
        expected = {r[:3] for r in last.values() if not r[3]}
        assert {tuple(r) for r in fresh().table().collect()} == expected
    assert {tuple(r) for r in fresh().of(camera="c1").collect()} == {r for r in expected if r[2] == "c1"}
    registry = fresh()
    assert registry._whole("base") == [2, 5] and len(registry._whole("delta")) == 7
    registry.upsert(spark.createDataFrame(rows[6::7], schema), 6)  # a batch that runs again
    assert {tuple(r) for r in registry.table().collect()} == expected


def test_counts_and_configurations_of_text_files(spark, tmp_path):
    from sightline.sources.datastore import read_camera_list, read_configuration, read_frame_counts, topology

    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "S01.txt").write_text("c001 1955\n# c9 1\n\nc002 11 20\nc003 many\nc004\n")
    assert {tuple(r) for r in read_frame_counts(spark, f"{tmp_path}/n").collect()} == {("c001", 1955), ("c002", 10)}
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "list_cam.txt").write_text("c001 S01\nS02 c005\nc007 other\n#\nlone\n")
    assert {tuple(r) for r in read_camera_list(spark, f"{tmp_path}/l").collect()} == {("S01", "c001"), ("S02", "c005"), ("other", "c007")}
    pytest.importorskip("yaml")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "cameras.yaml").write_text("cameras:\n- camera_id: c001\n  scene: S01\n  latitude: 42.5\n- name: no id\nadjacency:\n  c001: [c002, c003]\n  c002: []\n")
    cams, near = topology(read_configuration(spark, f"{tmp_path}/c"))
    assert [tuple(r) for r in cams.collect()] == [("c001", "c001", "S01", 42.5, None, None)]
    assert {tuple(r) for r in near.collect()} == {("c001", "c002"), ("c001", "c003")}


def test_consistency_over_what_is_asked(spark):
    from sightline.operators.scores import consistency

    asked = {"color": ("red", "red"), "vehicle_type": (None, "van"), "direction": ("eastbound", None)}
    lit = lambda x: F.lit(x).cast("string")
    score = lambda pairs: value(spark, consistency({n: (lit(q), lit(own)) for n, (q, own) in pairs.items()}))
    assert score(asked) == pytest.approx((0.4 + 0.2 * 0.5) / 0.6)
    assert score({**asked, "color": ("red", "white")}) == pytest.approx(0.1 / 0.6)
    assert score({"color": (None, "red"), "vehicle_type": ("", "van"), "direction": (None, None)}) is None


def test_recent_sessions_are_held_to_a_hundred(spark):
    from sightline.plans.windows import recent

    rows = [(i, None if i % 2 else "car", "searched", i, f"2024-01-01T10:{i % 60:02d}:00", f"2024-02-01T{i % 24:02d}:00:00" if i % 3 else "") for i in range(150)]
    s = spark.createDataFrame(rows, "query_id long, query_text string, state string, candidates int, created_at string, updated_at string")
    for limit, n in ((500, 100), (0, 1), (-3, 1), (7, 7)):
        got = recent(s, limit).collect()
        assert len(got) == n and got[0].timestamp == "2024-02-01T23:00:00" and got[0].time == "23:00" and got[0].type == "检索"


def test_counts_come_from_footers(spark, tmp_path):
    from sightline.sources.datastore import counts_by_scene

    rows = spark.range(1000).select((F.col("id") % 3).cast("string").alias("scene_id"), F.col("id").cast("int").alias("frame_id"))
    rows.write.partitionBy("scene_id").parquet(f"{tmp_path}/detections")
    found = counts_by_scene(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)" in plan.replace("PushedAggregation: [COUNT(1)", "PushedAggregation: [COUNT(*)")
    assert {(str(r.scene_id), r.detections, r.first_frame, r.last_frame) for r in found.collect()} == {("0", 334, 0, 999), ("1", 333, 1, 997), ("2", 333, 2, 998)}


def test_records_keep_null_apart_from_absent(spark, tmp_path):
    from sightline.sources.datastore import field, kind_of, read_records, state_of, write_records

    texts = ['{"a": null, "b": 1}', '{"b": "x"}', '{"a": [1, "y"], "b": {"c": true}}', "{}", "[1]", "not json", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, record string")
    write_records(rows, f"{tmp_path}/r", "id")
    got = read_records(spark, f"{tmp_path}/r").select("id", state_of("a").alias("a"), state_of("b").alias("b"), kind_of("b").alias("kind"), field("b", "long").alias("n"), F.to_json("record").alias("text")).orderBy("id").collect()
    assert [r.a for r in got] == ["null", "absent", "value", "absent", "absent", "absent", "absent"]
    assert [r.b for r in got] == ["value", "value", "value", "absent", "absent", "absent", "absent"]
    assert [r.kind for r in got[:3]] == ["BIGINT", "STRING", "OBJECT<c: BOOLEAN>"] and [r.n for r in got[:3]] == [1, None, None]
    assert got[0].text == '{"a":null,"b":1}' and got[1].text == '{"b":"x"}' and got[4].text is None


def test_frame_clock_over_several_batches(spark, tmp_path):
    from sightline.streaming.sessions import frame_tracklets

    schema = "camera long, frame long, track long, confidence double"
    batches = [[(1, 1, 7, 0.5), (1, 1, 8, 0.5), (1, 2, 7, 1.0), (2, 5, 7, 0.1)], [(1, 2, 8, 0.7), (1, 4, 7, 0.0), (1, 1, 9, 1.0)], [(1, 9, 8, 0.3), (2, 6, 3, 0.2)], [(c, f, None, None) for c in (1, 2) for f in (99, 100)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = frame_tracklets(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        put = stream.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
        put.foreachBatch(lambda b, n: b.write.mode("append").parquet(f"{tmp_path}/out")).start().awaitTermination()
    got = {(r.camera, r.track, r.first_frame, r.last_frame, r.n, round(r.confidence, 6)) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, 8, 1, 2, 2, 0.6), (1, 7, 1, 4, 3, 0.5), (1, 8, 9, 9, 1, 0.3), (2, 7, 5, 5, 1, 0.1), (2, 3, 6, 6, 1, 0.2)}
