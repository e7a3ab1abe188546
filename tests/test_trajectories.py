"""Rasters, teams, and the whole run from annotations to labelled frames."""

import itertools
import json
import random
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.operators import attributes, rasters, series, teams
from strandline.plans import trajectories
from strandline.sources import files


def png(pixels):
    """A PNG file of rows, columns and three channels."""
    def part(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w, _ = pixels.shape
    rows = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def test_frames_are_ranked_by_path_and_decoded_once(spark, tmp_path):
    rng = np.random.default_rng(1)
    pictures = {}
    for seq, names in (("a", ["10.png", "2.png", "1.png"]), ("b", ["x.png"])):
        (tmp_path / seq).mkdir()
        for name in names:
            pictures[seq, name] = rng.integers(0, 256, (20, 30, 3), np.uint8)
            (tmp_path / seq / name).write_bytes(png(pictures[seq, name]))
    (tmp_path / "a" / "3.png").write_bytes(b"no image")
    frames = files.frames(spark, str(tmp_path), "png")
    assert sorted((r["sequence_id"], r["frame_idx"], r["filename"]) for r in frames.collect()) == [("a", 0, "1.png"), ("a", 1, "10.png"), ("a", 2, "2.png"), ("a", 3, "3.png"), ("b", 0, "x.png")]
    plan = frames._jdf.queryExecution().executedPlan().toString()
    assert "Window [row_number" not in plan
    plain = F.regexp_replace("path", "^file:/+", "")
    own = rasters.images(spark, str(tmp_path), "png").withColumn("path", plain).join(frames.withColumn("path", plain), "path").select("sequence_id", "frame_idx", "filename", "image")
    read = {(r["sequence_id"], r["filename"]): r["image"] for r in own.collect()}
    assert read.keys() == pictures.keys()
    for k, image in read.items():
        assert (rasters.as_array(image)[:, :, ::-1] == pictures[k]).all()  # Spark's channels are blue, green, red
    boxes = spark.createDataFrame([("a", 0, 1, 0, 2, 3, 9, 14), ("a", 0, 2, 0, 0, 0, 30, 20), ("b", 0, 3, 0, 29, 19, 30, 20), ("c", 0, 4, 0, 0, 0, 1, 1)], "sequence_id string, frame_idx long, track_id long, idx int, crop_x1 int, crop_y1 int, crop_x2 int, crop_y2 int")
    crops = {r["track_id"]: rasters.as_array(r["crop"]) for r in rasters.cut_out(boxes, own, ["sequence_id", "frame_idx"], ["track_id", "idx"]).collect()}
    first, last = pictures["a", "1.png"], pictures["b", "x.png"]
    assert (crops[1][:, :, ::-1] == first[3:14, 2:9]).all() and (crops[2][:, :, ::-1] == first).all() and (crops[3][0, 0, ::-1] == last[19, 29]).all() and set(crops) == {1, 2, 3}


def many_persons(spark, image, n=20):
    boxes = [("s", 0, t, 0, 50.0 * t, 20.0, 50.0 * t + 40, 120.0, 0.9, "player", [float(t % 2)] * 4) for t in range(n)]
    kind = "sequence_id string, frame_idx long, track_id long, idx int, x1 double, y1 double, x2 double, y2 double, score double, role string, embedding array<double>"
    images = spark.createDataFrame([("s", 0, 1000, 700, image)], f"sequence_id string, frame_idx long, width int, height int, image {rasters.RASTER}")
    return spark.createDataFrame(boxes, kind), images


def test_bytes_grow_with_crops_and_filters_see_none(spark, tmp_path):
    """One image of 2.1 MB with 20 persons: what is written is the crops, 0.24 MB; the filter works on keys and embeddings."""
    image = {"height": 700, "width": 1000, "channels": 3, "data": bytes(np.random.default_rng(2).integers(0, 256, 2_100_000, np.uint8))}
    observations, images = many_persons(spark, image)
    torsos = attributes.person_torsos(observations, images)
    torsos.write.parquet(f"{tmp_path}/torsos")
    assert 200_000 < sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 400_000
    shown = spark.read.parquet(f"{tmp_path}/torsos")
    torso = attributes.torso_of(F.col("person"), F.col("torso"))
    pixels = rasters.as_array(image)
    for r in shown.select("track_id", "torso", torso.alias("t")).collect():
        x = 50 * r["track_id"]
        assert tuple(r["torso"]) == (0, 20, 40, 80) and (rasters.as_array(r["t"]["crop"]) == pixels[40:100, x : x + 40]).all() and r["t"]["person"]["x1"] == x
    filtered = attributes.without_outliers(observations.select("track_id", "idx", "embedding").join(shown.select("track_id", "idx"), ["track_id", "idx"], "left_semi"))
    assert "binary" not in filtered._jdf.queryExecution().analyzed().output().toString()

    def legibility(person):
        return F.when(F.length(person["crop"]["data"]) == 40 * 100 * 3, 0.9).otherwise(0.0)

    numbered = attributes.predict_numbers(observations, shown, legibility, lambda t: F.struct(F.length(t["crop"]["data"]).cast("string").alias("label"), F.array(F.lit(0.9), F.lit(0.1)).alias("char_confs")))
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert numbered.count() == 20 and {r["jersey"] for r in numbered.collect()} == {None}  # 7200 is no number
    assert plan.count("crop") > 0


def test_missing_images_and_decoders(spark):
    observations, images = many_persons(spark, None, 3)
    got = attributes.person_torsos(observations, images).collect()
    assert len(got) == 3 and all(r["person"]["crop"] is None for r in got)
    torso = attributes.torso_of(F.col("person"), F.col("torso"))
    assert {r["d"] for r in attributes.person_torsos(observations, images).select(torso["crop"]["data"].alias("d")).collect()} == {None}
    coded = images.withColumn("image", F.lit(b"\x07"))

    def decode(content):
        return np.full((700, 1000, 1), content[0], np.uint8)

    got = attributes.person_torsos(observations, coded, decode=decode).collect()
    assert {r["person"]["crop"]["data"] for r in got} == {bytes([7]) * 4000}
    assert attributes.person_torsos(observations.limit(0), images).count() == 0 == attributes.person_torsos(observations, images.limit(0)).count()


def test_models_see_full_batches(spark):
    rng = random.Random(3)
    for size, lengths in itertools.product((1, 3, 32), ([], [0], [5, 0, 70, 1, 1, 31], [rng.randrange(40) for _ in range(30)])):
        values = iter(range(10**6))
        came = [pd.Series([next(values) for _ in range(n)], dtype=int) for n in lengths]
        got = list(attributes.batched(iter(came), size))
        assert [x for b in got for x in b] == list(range(sum(lengths))) and all(len(b) == size for b in got[:-1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        sizes = attributes.model(lambda: lambda batch: pd.Series([len(batch)] * len(batch)), "long", 32)
        rows = spark.range(0, 100, 1, 1).select("id", sizes(F.col("id")).alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r["id"] for r in rows] == list(range(100)) and [r["n"] for r in rows] == [32] * 96 + [4] * 4


def test_weights_are_shipped_by_content(spark, tmp_path):
    for name, body in (("one.bin", b"\x03\x04"), ("same.bin", b"\x03\x04"), ("other.bin", b"\x05"), ("none.bin", b"")):
        (tmp_path / name).write_bytes(body)
    one, same, other, none = (files.artefact(spark, f"file://{tmp_path}/{n}.bin") for n in ("one", "same", "other", "none"))
    assert one == same != other and one.name.endswith(".bin") and len(one.name) == 68

    def load(weights):
        def score():
            body = weights.open()
            return lambda values: values * (body[0] if len(body) else 0)

        return score

    row = spark.range(7, 8).select(*[attributes.model(load(w), "long")(F.col("id")).alias(n) for n, w in (("one", one), ("other", other), ("none", none))]).first()
    assert tuple(row) == (21, 35, 0)
    assert files.fingerprint((one.name,)) == files.fingerprint((same.name,)) != files.fingerprint((other.name,))


def looks(spark, sequences, parts=4):
    rng = np.random.default_rng(3)
    rows = []
    for s in range(sequences):
        for t in range(5):
            for i in range(20):
                rows.append((f"s{s}", t, i, "player" if t < 4 else "referee", [float(x) for x in rng.normal(100 * s + 10 * (t % 2), 0.5, 6)]))
    rows += [("one", 0, 0, "player", [1.0] * 6), ("none", 0, 0, "referee", [1.0] * 6), ("same", 1, 0, "player", [1.0] * 6), ("same", 1, 1, "player", [1.0] * 6), ("blind", 1, 0, "player", None)]
    return spark.createDataFrame(rows, "sequence_id string, track_id long, idx int, role string, embedding array<double>").repartition(parts)


def test_teams_are_clusters_within_each_sequence(spark):
    """Two sequences whose looks lie far apart: each has two teams of its own."""
    df = looks(spark, 2)
    got = teams.team_clusters(df).collect()
    assert len(got) == df.count()
    by = {}
    for r in got:
        by.setdefault((r["sequence_id"], r["track_id"]), set()).add(r["team"])
    for s in ("s0", "s1"):
        assert by[s, 0] == by[s, 2] != by[s, 1] == by[s, 3] and by[s, 4] == {None} and by[s, 0] | by[s, 1] == {0, 1}
    assert by["one", 0] == by["same", 1] == {0} and by["none", 0] == by["blind", 1] == {None}
    assert teams.team_clusters(df.limit(0)).count() == 0


def test_rounds_of_grouped_means_equal_a_plain_version(spark):
    rng = np.random.default_rng(8)
    points = {g: rng.normal(0, 3, (n, 3)) for g, n in (("a", 150), ("b", 40), ("c", 3))}
    rows = [(g, i, [float(x) for x in v]) for g, own in points.items() for i, v in enumerate(own)]
    df = spark.createDataFrame(rows, "group string, id long, v array<double>").repartition(6)
    starts = teams.seeded(df, 4, 3)
    given = {(r["group"], r["start"]): np.array(r["centres"]) for r in starts.collect()}
    assert {k: len(v) for k, v in given.items()} == {(g, s): min(4, len(points[g])) for g in points for s in range(3)}
    assert all(any((p == c).all() for p in points[g]) for (g, _), own in given.items() for c in own)
    assert len({given["a", s].tobytes() for s in range(3)}) == 3
    for r in teams.grouped_means(df, starts, 5, -1.0).collect():
        own, centres = points[r["group"]], given[r["group"], r["start"]]
        for _ in range(5):
            at = ((own[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            centres = np.array([own[at == c].mean(axis=0) if (at == c).any() else centres[c] for c in range(len(centres))])
        assert np.allclose(centres, r["centres"]) and np.isclose(((own[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum(), r["cost"])


def test_reduction_is_by_the_principal_components_of_a_group(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (200, 5)) * [9, 5, 2, 0.1, 0.1] + 50
    flat = np.outer(rng.normal(0, 1, 30), [1.0, 2, 0, 0, 1])
    rows = [(g, i, [float(v) for v in row]) for g, own in (("x", x), ("flat", flat)) for i, row in enumerate(own)]
    df = spark.createDataFrame(rows, "group string, id long, v array<double>").repartition(3)
    got = teams.reduced(df, 3, 12).collect()
    for g, own in (("x", x), ("flat", flat)):
        z = np.array([r["v"] for r in sorted(got, key=lambda r: r["id"]) if r["group"] == g])
        sizes = np.linalg.svd(own - own.mean(axis=0), compute_uv=False)[:3]
        assert np.allclose(np.linalg.norm(z, axis=0), sizes, rtol=0.02, atol=1e-6)


@pytest.mark.parametrize("keys", [["k"], []])
def test_ranks_by_any_order(spark, keys):
    rng = random.Random(6)
    rows = [("h" if i % 3 else "abc"[i % 5 % 3], f"{rng.randrange(200):03d}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, name string, n long").repartition(7)
    got = series.ranked(df, keys, [-F.length("name"), F.col("name"), -F.col("n")]).collect()
    want = {}
    for k in {r[0] if keys else None for r in rows}:
        own = sorted((r for r in rows if not keys or r[0] == k), key=lambda r: (r[1], -r[2]))
        want |= {r[2]: i for i, r in enumerate(own)}
    assert {r["n"]: r["idx"] for r in got} == want and len(got) == 3000
    assert series.ranked(df.limit(0), keys, [F.col("name")]).count() == 0


def scene(spark, tmp_path, sequences):
    """Two players and a referee stand still; in every sequence one player's number changes half way, so its track is split."""
    persons = [(1, 100, "player"), (2, 400, "player"), (3, 700, "referee")]
    for seq in sequences:
        (tmp_path / seq).mkdir()
        doc = {
            "images": [{"image_id": str(f), "file_name": f"{f:03d}.jpg"} for f in range(80)],
            "annotations": [{"image_id": str(f), "category_id": 1, "track_id": t, "bbox_image": {"x": x, "y": 50, "w": 40, "h": 100}, "attributes": {"role": role, "team": "left"}} for f in range(80) for t, x, role in persons],
        }
        (tmp_path / seq / "labels.json").write_text(json.dumps(doc))
    docs = files.read_annotations(spark, f"{tmp_path}/*/labels.json")
    frames = files.listed_frames(docs)
    coded = F.concat(F.col("sequence_id"), F.lit(" "), F.col("frame_idx").cast("string")).cast("binary")
    images = frames.select("sequence_id", "frame_idx", F.lit(800).alias("width"), F.lit(200).alias("height"), coded.alias("image"))

    def decode(content):
        """Pixels show the number that is worn, and the shirt."""
        seq, frame = content.decode().split()
        pixels = np.zeros((200, 800, 2), np.uint8)
        pixels[:, 400:, 0], pixels[:, :400, 0], pixels[:, 700:, 0] = 4, 7 if int(frame) < 40 else 9, 7
        pixels[:, :, 1], pixels[:, 400:, 1] = 10 * int(seq[-1]), 10 * int(seq[-1]) + 3
        return pixels

    def read(crops: pd.DataFrame) -> pd.DataFrame:
        numbers = [str(rasters.as_array(r)[0, 0, 0]) for r in crops.to_dict("records")]
        return pd.DataFrame({"label": numbers, "char_confs": [[0.99, 0.5]] * len(crops)})

    def shirt(crops: pd.DataFrame) -> pd.Series:
        return pd.Series([[float(rasters.as_array(r)[0, 0, 1])] * 3 for r in crops.to_dict("records")])

    models = attributes.Models(
        legibility=lambda person: F.lit(0.9),
        read=lambda torso: F.pandas_udf(read, "label string, char_confs array<double>")(torso["crop"]),
        features=lambda torso: F.pandas_udf(shirt, "array<double>")(torso["crop"]),
        pose=lambda person: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(0.9).alias("score")) for n, x, y in (("ls", 10.0, 20.0), ("rh", 30.0, 60.0))]),
        weights=("reader 1",),
    )
    return frames, files.annotated_boxes(docs), images, models, decode


def test_from_annotations_to_labelled_frames(spark, tmp_path):
    """Two sequences whose ids meet: pieces, ids and teams are those of their own sequence."""
    frames, boxes, images, models, decode = scene(spark, tmp_path, ["seq0", "seq1"])
    folder = f"{tmp_path}/cache"
    got = trajectories.labelled_frames(frames, boxes, images, models, decode=decode, cache=folder).collect()
    assert len(got) == 480
    by = {}
    for r in got:
        by.setdefault((r["sequence_id"], r["parent_id"], r["track_id"]), []).append(r)
    assert {k: (len(v), {r["x1"] for r in v}, {r["jersey"] for r in v}) for k, v in by.items()} == {
        (s, *ids): what for s in ("seq0", "seq1")
        for ids, what in {(1, 4): (40, {100.0}, {7}), (1, 5): (40, {100.0}, {9}), (2, 2): (80, {400.0}, {4}), (3, 3): (80, {700.0}, {7})}.items()
    }
    teams_of = {k: {r["team"] for r in v} for k, v in by.items()}
    for s in ("seq0", "seq1"):
        assert teams_of[s, 3, 3] == {None} and teams_of[s, 1, 4] == teams_of[s, 1, 5] != teams_of[s, 2, 2] and teams_of[s, 1, 4] | teams_of[s, 2, 2] == {0, 1}
    one = min(by["seq1", 1, 5], key=lambda r: r["frame_idx"])
    assert one["frame_idx"] == 40 and one["label"] == f"5|{one['team']}|9:0.00995" and one["role"] == "player"
    torsos = attributes.person_torsos(spark.createDataFrame([("seq0", 0, 1, 0, -10.0, 5.0, 30.0, 95.0)], "sequence_id string, frame_idx long, track_id long, idx int, x1 double, y1 double, x2 double, y2 double"), images, models.pose, decode=decode)
    assert tuple(torsos.first()["torso"]) == (5, 15, 30, 60)
    # The dear steps are found again under the same settings and weights, not under others.
    stages = sorted(p.name for p in (tmp_path / "cache").iterdir())
    broken = attributes.Models(None, None, None, None, models.weights)
    again = trajectories.labelled_frames(frames, boxes, images, broken, cache=folder).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr) and sorted(p.name for p in (tmp_path / "cache").iterdir()) == stages
    with pytest.raises(Exception, match="TypeError"):  # other weights: not found, so built, which fails
        trajectories.labelled_frames(frames, boxes, images, attributes.Models(None, None, None, None, ("reader 2",)), cache=folder)
