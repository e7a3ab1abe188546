"""Predicted boxes of seen and unseen frames, and cameras that move."""

import random

import numpy as np
import pytest

from strandline.functions.geometry import expanded, iou_inclusive
from strandline.operators import prediction
from strandline.operators.motion import POSITION, VELOCITY, Motion, measured

KIND = "sequence_id string, track_id long, frame_idx long, x1 double, y1 double, x2 double, y2 double"


def walk(rng, n):
    x, y = rng.uniform(0, 500), rng.uniform(0, 300)
    return [(x + 3 * f + rng.gauss(0, 1), y + rng.gauss(0, 1), x + 3 * f + 40 + rng.gauss(0, 1), y + 90 + rng.gauss(0, 1)) for f in range(n)]


def test_identity_warps_equal_the_scalar_filters():
    rng = random.Random(1)
    boxes = walk(rng, 40)
    one, other = Motion(measured(*boxes[0])), prediction.Coupled(measured(*boxes[0]))
    for k, b in enumerate(boxes[1:]):
        for f in (one, other):
            if k % 5 == 4:
                f.stop_growth()
            f.predict()
        other.warp([1, 0, 0, 0, 1, 0])
        assert np.allclose(one.corners(), other.corners())
        if k % 4:
            one.update(measured(*b))
            other.update(measured(*b))
    assert np.allclose([a[0] for a in one.axes] + [a[1] for a in one.axes], other.mean)
    assert np.allclose(np.diag(other.covariance), [a[2] for a in one.axes] + [a[4] for a in one.axes]) and np.allclose(np.diag(other.covariance, 4), [a[3] for a in one.axes])


def plain(rows, last, warps):
    """The filter in matrix form, written out; rows by frame."""
    out, mean = {}, None
    for f in range(min(rows), last + 1):
        if mean is None:
            z = np.array(measured(*rows[f]))
            s = np.array([z[2], z[3], z[2], z[3]])
            mean, cov = np.concatenate([z, np.zeros(4)]), np.diag(np.concatenate([2 * POSITION * s, 10 * VELOCITY * s]) ** 2)
            out[f] = (*rows[f], True)
            continue
        if f - 1 not in rows:
            mean[6:] = 0
        s = mean[[2, 3, 2, 3]]
        step = np.block([[np.eye(4), np.eye(4)], [np.zeros((4, 4)), np.eye(4)]])
        mean, cov = step @ mean, step @ cov @ step.T + np.diag(np.concatenate([POSITION * s, VELOCITY * s]) ** 2)
        if f in warps:
            m = np.array(warps[f]).reshape(2, 3)
            turn = np.zeros((8, 8))
            for k in range(4):
                turn[2 * k : 2 * k + 2, 2 * k : 2 * k + 2] = m[:, :2]
            mean, cov = turn @ mean, turn @ cov @ turn.T
            mean[:2] += m[:, 2]
        x, y, w, h = mean[:4]
        out[f] = (x - w / 2, y - h / 2, x + w / 2, y + h / 2, f in rows)
        if f in rows:
            h = np.eye(4, 8)
            own = h @ cov @ h.T + np.diag((POSITION * mean[[2, 3, 2, 3]]) ** 2)
            gain = cov @ h.T @ np.linalg.inv(own)
            mean, cov = mean + gain @ (np.array(measured(*rows[f])) - h @ mean), cov - gain @ own @ gain.T
    return out


@pytest.mark.parametrize("moving", [False, True])
def test_predictions_equal_a_plain_filter(spark, moving):
    rng = random.Random(7)
    rows, warps = [], {}
    for seq in ("a", "b"):
        for track in (1, 2):
            start = rng.randrange(0, 9)
            rows += [(seq, track, start + f, *b) for f, b in enumerate(walk(rng, 40)) if f == 0 or not 12 <= f < 20 and rng.random() < 0.8]
        turn = 0.01 if seq == "a" else -0.02
        warps[seq] = {f: [float(np.cos(turn)), float(-np.sin(turn)), 0.5, float(np.sin(turn)), float(np.cos(turn)), -1.0] for f in range(0, 60) if f % 3} if moving else {}
    odd = [("a", 1, None, 1.0, 1.0, 2.0, 2.0), ("a", 2, 3, None, 1.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows + odd, KIND).repartition(4)
    cameras = spark.createDataFrame([(s, f, w) for s, own in warps.items() for f, w in own.items()], "sequence_id string, frame_idx long, warp array<double>") if moving else None
    got = prediction.predicted_boxes(df, ["sequence_id", "track_id"], 6, cameras, ["sequence_id"] if moving else []).collect()
    found = {}
    for r in got:
        found.setdefault((r["sequence_id"], r["track_id"]), {})[r["frame_idx"]] = (r["x1"], r["y1"], r["x2"], r["y2"], r["seen"])
    for key in {r[:2] for r in rows}:
        own = {r[2]: r[3:] for r in rows if r[:2] == key}
        want = plain(own, max(own) + 6, warps[key[0]])
        assert found[key].keys() == want.keys() and all(np.allclose(found[key][f][:4], want[f][:4]) and found[key][f][4] == want[f][4] for f in want)
    assert prediction.predicted_boxes(df.limit(0), ["sequence_id", "track_id"], 6, cameras, ["sequence_id"] if moving else []).count() == 0


def test_distances_may_grow_the_boxes_first(spark):
    one = spark.createDataFrame([(0, 1, 0.0, 0.0, 10.0, 10.0)], "frame_idx long, id int, x1 double, y1 double, x2 double, y2 double")
    other = spark.createDataFrame([(0, 7, 12.0, 0.0, 22.0, 10.0), (1, 8, 0.0, 0.0, 10.0, 10.0)], one.schema)
    apart = prediction.predicted_distance(one, other).collect()
    near = prediction.predicted_distance(one, other, lambda a, b: iou_inclusive(expanded(a, 0.5), expanded(b, 0.5))).collect()
    assert [(r["l_id"], r["r_id"], r["distance"]) for r in apart] == [(1, 7, 1.0)] and 0 < near[0]["distance"] < 1


def test_zooming_cameras_keep_scalar_filters():
    """A camera that moves and zooms gives four scalar filters what it gives the coupled one, also after it turns later."""
    rng = np.random.default_rng(3)
    first = measured(10.0, 20.0, 50.0, 120.0)
    one, other = Motion(first), prediction.Coupled(first)
    for k in range(12):
        sx, sy, dx, dy = 1 + rng.normal() / 50, 1 + rng.normal() / 50, *rng.normal(size=2) * 5
        one.predict(), other.predict()
        prediction.zoomed(one, [sx, 0.0, dx, 0.0, sy, dy])
        other.warp([sx, 0.0, dx, 0.0, sy, dy])
        assert np.allclose(one.corners(), other.corners())
        if k % 3:
            x, y = rng.normal(size=2) * 9
            seen = measured(10 + x, 20 + y, 50 + x, 120 + y)
            one.update(seen), other.update(seen)
    later = prediction.Coupled.of(one)
    assert np.allclose(later.mean, other.mean) and np.allclose(later.covariance, other.covariance)
