import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.config import SplitConfig, TrackerConfig, fingerprint
from strandline.functions import geometry as g
from strandline.functions import vectors
from strandline.operators import attributes, labels, motion, overlap, rasters, series, splits, tracker
from strandline.operators.assignment import assign, assigned
from strandline.sources import files


def scan_switches(values, persistent):
    """Switch positions by a scan with a current value."""
    current, out = None, []
    for i, v in enumerate(values):
        if persistent(i) and v != current:
            if current is not None:
                out.append(i)
            current = v
    return out


def most_common_first(window):
    return max(dict.fromkeys(window), key=window.count) if window else None


@pytest.mark.parametrize("block", [65536, 60])
def test_switches_equal_a_scan_over_any_blocks(spark, block):
    rng = random.Random(4)
    rows, want = [], {"jersey": set(), "team": set()}
    for track in range(12):
        n = rng.choice([1, 4, 30, 130, 200])
        numbers = [rng.choice([None, 7, 7, 7, 9]) if i % 60 < 30 else rng.choice([9, 9, 9, 4, None]) for i in range(n)]
        entropies = [rng.choice([0.1, 0.1, 0.1, 0.2, 0.5]) for _ in range(n)]
        teams = [rng.choice([None, 0, 0]) if i % 80 < 40 else rng.choice([1, 1, None]) for i in range(n)]
        rows += [(track, i, a, e, t) for i, (a, e, t) in enumerate(zip(numbers, entropies, teams))]

        def number(i):
            w = [x for x in numbers[i : i + 20] if x is not None] if i + 1 < n and entropies[i + 1] <= 0.2 else []
            return numbers[i] is not None and entropies[i] <= 0.2 and w.count(numbers[i]) >= 5 and most_common_first(w) == numbers[i]

        def team(i):
            w = teams[i : i + 50]
            return teams[i] is not None and w.count(teams[i]) >= 5 and most_common_first(w) == teams[i]

        want["jersey"] |= {(track, i) for i in scan_switches(numbers, number)}
        want["team"] |= {(track, i) for i in scan_switches(teams, team)}
    df = spark.createDataFrame(rows, "track_id long, idx int, jersey int, entropy double, team int")
    config = SplitConfig(block=block)
    got = splits.switches(splits.number_persistence(df, config), "jersey").collect()
    assert {(r["track_id"], r["idx"]) for r in got} == want["jersey"]
    got = splits.switches(splits.team_persistence(df, config), "team").collect()
    assert {(r["track_id"], r["idx"]) for r in got} == want["team"] and want["team"]


def test_positions_over_blocks(spark):
    df = spark.createDataFrame([(k % 3, k) for k in range(0, 500, 7)], "key long, at long")
    got = series.positions(df, "key", "at", block=40).collect()
    for key in range(3):
        own = sorted((r["at"], r["idx"]) for r in got if r["key"] == key)
        assert [i for _, i in own] == list(range(len(own)))


def test_pieces_and_ids(spark):
    obs = spark.createDataFrame([(t, i) for t, n in ((1, 60), (2, 30), (5, 100)) for i in range(n)], "track_id long, idx int")
    own = splits.as_series(obs)
    cuts = spark.createDataFrame([([1], 1, 30, 30), ([2], 2, 25, 25), ([5], 5, 60, 70), ([5], 5, 80, 40)], "seq array<long>, track_id long, idx int, cut int")
    got = splits.pieces(splits.lengths(own, splits.TRACK), cuts, 20, splits.TRACK).select("track_id", "frag_no", "start_idx", "end_idx").collect()
    # Track 2 has one long piece only; the cuts of track 5 are out of order, so its pieces overlap.
    assert {tuple(r) for r in got} == {(1, 0, 0, 29), (1, 1, 30, 59), (5, 0, 0, 69), (5, 2, 40, 99)}
    after = splits.split(own, cuts, 20).groupBy("parent_id", "track_id").agg(F.count("*").alias("n")).collect()
    assert {tuple(r) for r in after} == {(1, 6, 30), (1, 7, 30), (2, 2, 30), (5, 8, 70), (5, 9, 60)}
    empty = splits.split_two_stage(spark.createDataFrame([], "track_id long, idx int, frame_idx long, x1 double, y1 double, x2 double, y2 double, jersey int, entropy double, team int"))
    assert empty.count() == 0


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, m = rng.integers(0, 5, 2)
        cost = rng.integers(0, 12, (n, m)) / 10
        limit = 0.8
        pairs = assign(cost, limit)
        assert len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs})
        best = 0.0
        for k in range(min(n, m) + 1):
            for rows in itertools.combinations(range(n), k):
                for columns in itertools.permutations(range(m), k):
                    best = min(best, sum(cost[i, j] - limit for i, j in zip(rows, columns)))
        assert sum(cost[i, j] - limit for i, j in pairs) == pytest.approx(best)


def test_frames_are_assigned_as_one_by_one(spark):
    rng = random.Random(11)
    rows = [(f, rng.randrange(6), 10 + rng.randrange(6), rng.random()) for f in range(60) for _ in range(rng.randrange(0, 9))] + [(99, 1, 1, float("nan")), (99, 2, 2, None)]
    rows = list({r[:3]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "frame_idx long, a long, b long, cost double").repartition(3)
    got = sorted(map(tuple, assigned(df, 0.7).collect()))
    want = []
    for f in range(60):
        own = [r for r in rows if r[0] == f and r[3] < 0.7]
        left, right = sorted({r[1] for r in own}), sorted({r[2] for r in own})
        cost = np.full((len(left), len(right)), np.inf)
        for _, a, b, c in own:
            cost[left.index(a), right.index(b)] = c
        want += [(f, left[i], right[j], cost[i, j]) for i, j in assign(cost, 0.7)]
    assert got == sorted(want) and len(got) > 60
    assert assigned(df.limit(0), 0.7).count() == 0


def test_motion_equals_matrix_form():
    rng = np.random.default_rng(1)
    steps = [np.array([10.0 + 3 * k, 20 - k, 40 + k % 3, 90.0]) + rng.normal(0, 1, 4) for k in range(40)]
    own = motion.Motion(tuple(steps[0]))
    a = np.eye(8) + np.eye(8, k=4)
    h = np.eye(4, 8)

    def noise(p, v, mean):
        s = mean[[2, 3, 2, 3]]
        return np.diag(np.concatenate([(p * s) ** 2, (v * s) ** 2]))

    mean = np.concatenate([steps[0], np.zeros(4)])
    cov = noise(2 * motion.POSITION, 10 * motion.VELOCITY, mean)
    for z in steps[1:]:
        cov = a @ cov @ a.T + noise(motion.POSITION, motion.VELOCITY, mean)
        mean = a @ mean
        s = h @ cov @ h.T + noise(motion.POSITION, motion.VELOCITY, mean)[:4, :4]
        y = z - h @ mean
        own.predict()
        assert own.gate(z) == pytest.approx(y @ np.linalg.solve(s, y))
        assert own.gate(z, "gaussian", True) == pytest.approx(y[:2] @ y[:2])
        own.update(z)
        gain = cov @ h.T @ np.linalg.inv(s)
        mean, cov = mean + gain @ y, cov - gain @ s @ gain.T
        assert np.allclose([x[0] for x in own.axes] + [x[1] for x in own.axes], mean)


def scene(tracker_, frames):
    out = []
    for boxes in frames:
        dets = [{"det_idx": k, "box": b, "score": s, "embedding": None} for k, (b, s) in enumerate(boxes)]
        out.append([t.id for t in tracker_.step(dets)])
    return out


def test_tracker_scenes():
    def at(x, score=0.9):
        return ((x, 0.0, x + 40, 80.0), score)

    apart = scene(tracker.Tracker(), [[at(5.0 * k), at(900 - 5.0 * k)] for k in range(20)])
    assert apart == [[1, 2]] * 20
    for gap, same in ((50, True), (51, True), (52, False), (53, False)):
        t = tracker.Tracker()
        scene(t, [[at(0)]] * 5 + [[]] * gap)
        assert (scene(t, [[at(0)]]) == [[1]]) is same, gap
    t = tracker.Tracker()
    assert scene(t, [[at(0)], [at(2, 0.5)], [at(4, 0.6)], [at(4, 0.2)], [at(4)]]) == [[1], [1], [], [], [1]]
    assert scene(tracker.Tracker(TrackerConfig(new_track_thresh=0.95)), [[at(0)]]) == [[]]


def test_tracker_batch_streams_over_batches(spark):
    rows = [(s, f, d, 100.0 * d + f, 0.0, 100.0 * d + f + 40, 80.0, 0.9) for s in range(3) for f in range(30) for d in range(4)]
    det = spark.createDataFrame(rows, "sequence_id long, frame_idx long, det_idx int, x1 double, y1 double, x2 double, y2 double, score double")
    got = tracker.tracked(det).collect()
    assert len(got) == len(rows) and {(r["det_idx"], r["tracker_id"]) for r in got} == {(d, d + 1) for d in range(4)}
    assert tracker.tracked(det.limit(0)).count() == 0


def test_geometry_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0), (5.0, 5.0, 5.0, 5.0), (-20.0, -5.0, -3.0, 7.0)], "x1 double, y1 double, x2 double, y2 double")
    one = g.Box(*[F.lit(v) for v in (0.0, 0.0, 10.0, 10.0)])
    r = df.select(g.iou(g.box(), one).alias("a"), g.iou_inclusive(g.box(), one).alias("b"), g.clamped(g.box(), F.lit(8), F.lit(8)).x2.alias("c"), g.expanded(g.box(), 0.5).x1.alias("d")).collect()
    assert r[0]["a"] == pytest.approx(1) and r[0]["b"] == 1 and r[0]["c"] == 8 and r[0]["d"] == -10
    assert r[1]["a"] == 0 and r[1]["c"] is None and r[2]["c"] is None


def test_vector_heads(spark):
    df = spark.createDataFrame([([1000.0, 0.0], [[1.0, 2.0], [3.0, 6.0]], None), ([], [], [1])], "v array<double>, t array<array<double>>, x array<int>")
    one, none = df.select(vectors.softmax(F.col("v")), vectors.mean_vector(F.col("t")), vectors.listed(F.col("x"), "int"), vectors.sigmoid(F.lit(0.0))).collect()
    assert tuple(one) == ([1.0, 0.0], [2.0, 4.0], [], 0.5) and tuple(none)[:3] == ([], None, [1])


def test_numbers_and_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("00", "7 ", "100", "-1", "", "x9", None, "99999999999")], "label string")
    assert [r[0] for r in df.select(attributes.parsed_number(F.col("label"))).collect()] == [0, 7, None, None, None, None, None, None]
    values = [0.2, 1.234e-05, 1.23e-5, 0.123456, 123.4, 12345.6, 0.0, 1.0, 0.00012346]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(labels.significant(F.col("v"))).collect()] == [f"{v:.4g}" for v in values]
    assert df.limit(1).select(labels.label(F.lit(3), F.lit(None), F.lit(7), F.lit(None).cast("double"))).first()[0] == "3|X|7:X"


def test_entropy_of_certainty_keeps_its_sign(spark):
    """A confidence of 1 has entropy -0.0, which SQL and ``%g`` write as -0."""
    df = spark.createDataFrame([(1.0,), (0.5,)], "conf double").selectExpr("-conf * ln(conf) as entropy")
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (None,)], "v double")
    text = labels.label(F.lit(7), F.lit(1), F.lit(2), F.col("entropy"))
    assert [r[0] for r in df.select(text).collect()] == ["7|1|2:-0", "7|1|2:0.3466"]
    assert [r[0] for r in zeros.select(labels.significant(F.col("v"))).collect()] == ["0", "-0", None]


def test_cascade_with_stub_models(spark):
    import pandas as pd

    obs = spark.createDataFrame([(1, i, [float(i == 5) * 9, 1.0]) for i in range(6)], "track_id long, idx int, embedding array<double>")
    box = "struct<x1:int,y1:int,x2:int,y2:int>"
    person = F.struct(*[F.col("idx").alias(c) for c in ("x1", "y1", "x2", "y2")], F.lit(None).cast(rasters.RASTER).alias("crop"))
    crops = obs.select("track_id", "idx", person.alias("person"), F.lit(None).cast(box).alias("torso"))
    legibility = attributes.model(lambda: lambda s: s.map(lambda x: 0.9 if x != 2 else 0.1), "double")
    read = attributes.model(lambda: lambda s: pd.DataFrame({"label": s.astype(str), "char_confs": [[0.9, 0.5]] * len(s)}), "label string, char_confs array<double>")
    got = {r["idx"]: (r["jersey"], r["confidence"]) for r in attributes.predict_numbers(obs, crops, lambda p: legibility(p["x1"]), lambda t: read(t["person"]["x1"])).collect()}
    assert got == {0: (0, 0.9), 1: (1, 0.9), 2: (None, 0.0), 3: (3, 0.9), 4: (4, 0.9), 5: (None, 0.0)}


def test_annotation_files(spark, tmp_path):
    (tmp_path / "seq1").mkdir()
    doc = {"images": [{"image_id": "1", "file_name": "a.jpg"}], "annotations": [{"image_id": "1", "category_id": 2, "bbox_image": {"x": 1, "y": 2, "w": 3, "h": 4}}, {"image_id": "1", "category_id": 4}]}
    (tmp_path / "seq1" / "labels.json").write_text(json.dumps(doc))
    for name in ("a.jpg", "b.jpg", "c.png"):
        (tmp_path / "seq1" / name).write_bytes(b"x")
    boxes = files.annotated_boxes(files.read_annotations(spark, str(tmp_path / "seq1" / "labels.json")))
    joined = files.frame_detections(files.frames(spark, str(tmp_path)), boxes).orderBy("frame_idx").collect()
    assert [(r["frame_idx"], r["filename"], r["x2"], r["gt_track_id"]) for r in joined] == [(0, "a.jpg", 4.0, -1), (1, "b.jpg", None, None)]
    doc["annotations"][0]["image_id"] = "9"
    (tmp_path / "seq1" / "labels.json").write_text(json.dumps(doc))
    again = files.read_annotations(spark, str(tmp_path / "seq1" / "labels.json"))
    assert files.annotated_boxes(again, strict=False).count() == 0
    with pytest.raises(Exception, match="unlisted"):
        files.annotated_boxes(again).collect()


def test_cached_tables_follow_settings(spark, tmp_path):
    df = spark.createDataFrame([(1, 2)], "sequence_id long, v long")
    made = []

    def build():
        made.append(1)
        return df

    for config in (SplitConfig(), SplitConfig(), SplitConfig(lookback=9)):
        assert files.cached(spark, str(tmp_path), "t", (config,), build).count() == 1
    # What a run that failed has left behind isn't read.
    (tmp_path / f"t-{fingerprint(SplitConfig())}" / "_SUCCESS").unlink()
    assert files.cached(spark, str(tmp_path), "t", (SplitConfig(),), build).count() == 1 and len(made) == 3
    text = spark.createDataFrame([("007", 1)], "sequence_id string, v long")
    for _ in range(2):
        assert tuple(files.cached(spark, str(tmp_path), "text", (), lambda: text, None).first()) == ("007", 1)
    assert fingerprint(SplitConfig()) != fingerprint(SplitConfig(lookback=9))


def test_overlap_helpers(spark):
    m = spark.createDataFrame([(0, 1, 1, 0.2), (0, 2, 2, 0.9)], "frame_idx long, a long, b long, cost double")
    kept, rows, columns = overlap.within_limit(m, m.select("frame_idx", "a"), m.select("frame_idx", "b"), 0.5)
    assert (kept.count(), rows.first()["a"], columns.first()["b"]) == (1, 2, 2)
    trk = spark.createDataFrame([(0, 0, 0.0, 0.0, 10.0, 10.0), (0, 1, 50.0, 0.0, 60.0, 10.0)], "frame_idx long, trk_idx int, x1 double, y1 double, x2 double, y2 double")
    det = spark.createDataFrame([(0, k, 0.0, 0.0, 10.0, 10.0, [1.0 * k]) for k in (4, 3)], "frame_idx long, det_idx int, x1 double, y1 double, x2 double, y2 double, embedding array<double>")
    got = {r["trk_idx"]: (r["det_idx"], r["embedding"]) for r in overlap.last_embeddings(trk, det, 1).collect()}
    assert got == {0: (3, [3.0]), 1: (None, [0.0])}


def test_scaled_box_by_hand(spark):
    df = spark.createDataFrame([(10.0, 20.0, 20.0, 60.0)], "x1 double, y1 double, x2 double, y2 double")
    assert tuple(df.select(*g.scaled(g.box())).first()) == pytest.approx((4.0, -4.0, 26.0, 84.0))
    assert tuple(df.select(*g.scaled(g.box(), 0.5)).first()) == pytest.approx((7.5, 10.0, 22.5, 70.0))


def test_unmatched_sides_of_composed_matchings(spark):
    first = spark.createDataFrame([(0, 1, 5), (0, 2, 6)], "frame_idx long, a long, b long")
    second = spark.createDataFrame([(0, 5, 9), (1, 6, 8)], "frame_idx long, b long, c long")
    rows = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "frame_idx long, a long")
    columns = spark.createDataFrame([(0, 9), (0, 7), (1, 8)], "frame_idx long, c long")
    a, c = overlap.unmatched(first, second, rows, columns)
    assert sorted(map(tuple, a.collect())) == [(0, 2), (0, 3)] and sorted(map(tuple, c.collect())) == [(0, 7), (1, 8)]


def crossing(embedded=True):
    """Two persons that swap places while hidden; only their looks tell them apart."""
    rows = []
    for f in range(40):
        for d, look in enumerate(([1.0, 0.0, 0.1], [0.0, 1.0, 0.1])):
            if 18 <= f < 22 and d == 1:
                continue
            x = (120.0, 100.0)[d] if f < 20 else (106.0, 114.0)[d]
            rows.append((0, f, d, x, 50.0, x + 40, 130.0, 0.9, look if embedded else None))
    return rows


def test_tracking_by_appearance_in_batch_and_stream(spark, tmp_path):
    kind = "sequence_id long, frame_idx long, det_idx int, x1 double, y1 double, x2 double, y2 double, score double, embedding array<double>"
    looks, none = (spark.createDataFrame(crossing(e), kind) for e in (True, False))
    ids = {name: {(r["frame_idx"], r["det_idx"]): r["tracker_id"] for r in tracker.tracked(df).collect()} for name, df in (("looks", looks), ("none", none))}
    assert {ids["looks"][f, 0] for f in (0, 39)} == {1} and {ids["looks"][f, 1] for f in (0, 39)} == {2}
    assert ids["looks"] != ids["none"]
    from strandline.streaming import online

    for f in (0, 1):  # two files: the state goes from one trigger to the next
        looks.filter(F.expr(f"frame_idx div 20 = {f}")).coalesce(1).write.parquet(f"{tmp_path}/in/{f}")
    stream = spark.readStream.schema(looks.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = online.drained(online.tracked_stream(stream), "looks")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tracker.tracked(looks).collect()))


def test_stream_equals_batch_on_the_events(spark):
    from strandline.plans.queries import QUERIES

    batch, stream = (QUERIES[q](spark, "/root/testdata/sf0.001") for q in ("tracker_batch", "tracker_stream"))
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.collect())) != []


def test_tracker_forgets_what_cannot_return():
    rng = random.Random(5)
    t = tracker.Tracker(TrackerConfig(track_buffer=3))
    for k in range(300):
        x = rng.randrange(0, 5000, 500)
        t.step([{"det_idx": 0, "box": (x, 0.0, x + 40, 80.0), "score": 0.9, "embedding": None}])
        assert len(t.removed) <= len(t.tracked) + len(t.lost) < 12
    assert t.next_id > 100


def test_other_modes_of_persistence(spark):
    rows = [(1, i, 7, 0.1 if i % 2 else 0.5, None if i % 3 else 0) for i in range(40)]
    df = spark.createDataFrame(rows, "track_id long, idx int, jersey int, entropy double, team int")
    own = splits.number_persistence(df, SplitConfig(entropy_mode="own")).collect()
    assert {r["idx"] for r in own} == {i for i in range(40) if i % 2 and sum(1 for k in range(i, min(i + 20, 40)) if k % 2) >= 5}
    assert splits.number_persistence(df).count() == 0
    teams = {n: {r["idx"] for r in splits.team_persistence(df, SplitConfig(null_is_category=n)).collect()} for n in (True, False)}
    assert teams[False] == {i for i in range(0, 40, 3) if len(range(i, 40, 3)) >= 5} and teams[True] < teams[False]


def test_object_documents_and_frames_on_disk(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 7), (1, 1, None)], "track_id long, idx int, jersey int")
    assert [json.loads(r["json"]) for r in labels.documents(df).orderBy("idx").collect()] == [{"track_id": 1, "idx": 0, "jersey": 7}, {"track_id": 1, "idx": 1}]
    labels.write_frames(df.withColumn("sequence_id", F.lit("s")), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/sequence_id=s").count() == 2
