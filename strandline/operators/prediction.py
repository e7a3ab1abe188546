"""Predicted boxes: where the filter expects a track in every frame, seen or not, also under a moving camera.

Without a camera the filter is the four scalar ones of ``motion``. A camera that moves and zooms keeps the axes apart, so it
does with them too; one that turns or shears mixes them, and from such a frame on the whole eight-state filter runs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.geometry import Box, iou_inclusive
from strandline.operators.motion import POSITION, VELOCITY, Motion, measured
from strandline.operators.overlap import prefixed


class Coupled:
    """Center, width and height and their velocities as one state: ``mean`` (8) and ``covariance`` (8, 8)."""

    def __init__(self, z):
        self.mean = np.array([*z, 0, 0, 0, 0], float)
        self.covariance = np.diag(np.square([*(2 * POSITION * self._sizes()), *(10 * VELOCITY * self._sizes())]))

    @classmethod
    def of(cls, motion: Motion) -> Coupled:
        """The same state with terms between the axes, none of them yet."""
        state = cls.__new__(cls)
        x, v, p00, p01, p11 = np.array(motion.axes).T
        state.mean = np.concatenate([x, v])
        state.covariance = np.block([[np.diag(p00), np.diag(p01)], [np.diag(p01), np.diag(p11)]])
        return state

    def _sizes(self) -> np.ndarray:
        return self.mean[[2, 3, 2, 3]]

    def stop_growth(self):
        self.mean[6:] = 0

    def predict(self):
        step = np.eye(8) + np.eye(8, k=4)
        noise = np.diag(np.square([*(POSITION * self._sizes()), *(VELOCITY * self._sizes())]))
        self.mean, self.covariance = step @ self.mean, step @ self.covariance @ step.T + noise

    def warp(self, rows):
        """Move with the camera: ``rows`` are those of a 2 by 3 matrix; its linear part turns centers, sizes and velocities."""
        m = np.asarray(rows, float).reshape(2, 3)
        turn = np.kron(np.eye(4), m[:, :2])
        self.mean, self.covariance = turn @ self.mean, turn @ self.covariance @ turn.T
        self.mean[:2] += m[:, 2]

    def update(self, z):
        own = self.covariance[:4, :4] + np.diag(np.square(POSITION * self._sizes()))
        gain = self.covariance[:, :4] @ np.linalg.pinv(own)
        self.mean, self.covariance = self.mean + gain @ (np.asarray(z, float) - self.mean[:4]), self.covariance - gain @ own @ gain.T

    def corners(self):
        x, y, w, h = self.mean[:4]
        return x - w / 2, y - h / 2, x + w / 2, y + h / 2


def zoomed(motion: Motion, rows) -> None:
    """Move with a camera whose map has no terms between the axes."""
    sx, _, dx, _, sy, dy = rows
    for a, s, d in zip(motion.axes, (sx, sy, sx, sy), (dx, dy, 0.0, 0.0)):
        x, v, p00, p01, p11 = a
        a[:] = s * x + d, s * v, s * s * p00, s * s * p01, s * s * p11


PREDICTED = "{keys}, frame_idx long, x1 double, y1 double, x2 double, y2 double, seen boolean"


def every_frame(observations: DataFrame, keys: list[str], ahead: int = 0) -> DataFrame:
    """``keys, frame_idx``, box and ``seen``: each track's frames from its first to ``ahead`` behind its last, boxes null where it isn't seen."""
    after = F.coalesce(F.lead("frame_idx").over(Window.partitionBy(*keys).orderBy("frame_idx")), F.col("frame_idx") + ahead + 1)
    rows = observations.select(*keys, F.col("frame_idx").cast("long").alias("at"), *[F.col(c).cast("double").alias(c) for c in Box._fields], after.cast("long").alias("after"))
    rows = rows.select(*keys, "at", *Box._fields, F.explode(F.sequence("at", F.greatest(F.col("at"), F.col("after") - 1))).alias("frame_idx"))
    seen = F.col("frame_idx") == F.col("at")
    return rows.select(*keys, "frame_idx", *[F.when(seen, F.col(c)).alias(c) for c in Box._fields], seen.alias("seen"))


def predicted_boxes(observations: DataFrame, keys: list[str] = ["track_id"], ahead: int = 50, cameras: DataFrame | None = None, camera_keys: list[str] = []) -> DataFrame:
    """``keys, frame_idx``, box and ``seen``: the box that the filter predicts for each frame of a track, before it sees it.

    In the first frame it is the observed box. The track's frames go on, unseen, for ``ahead`` frames behind its last. After a
    frame in which it wasn't seen a box keeps its size, as a lost track does. ``cameras`` has ``camera_keys, frame_idx`` and
    ``warp``, the six numbers of a 2 by 3 matrix by rows, applied to the prediction of that frame; a frame without one
    has a still camera. Observations with a null corner or frame are left out; of several in a frame each counts.
    Like ``filtered_series`` a track is one task's work, streamed in order of frames with one state in memory.
    """
    clean = observations.dropna(subset=[*keys, "frame_idx", *Box._fields])
    rows = every_frame(clean, keys, ahead)
    warp = F.lit(None).cast("array<double>").alias("warp")
    if cameras is not None:
        if camera_keys:
            rows = rows.join(clean.select(*keys, *camera_keys).distinct(), keys) if set(camera_keys) - set(keys) else rows
        rows = rows.join(cameras.select(*camera_keys, F.col("frame_idx").cast("long"), F.col("warp").cast("array<double>").alias("warp")), [*camera_keys, "frame_idx"], "left")
        warp = F.col("warp")
    n, kinds = len(keys), {f.name: f.dataType.simpleString() for f in rows.select(*keys).schema}

    def run(batches):
        track, state, seen_before = None, None, True
        for batch in batches:
            out = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(n + 7))):
                own, corners, seen, turn = row[:n], row[n + 1 : n + 5], row[n + 5], row[n + 6]
                if state is None or own != track:
                    track, state = own, Motion(measured(*corners))
                    out.append(corners)
                else:
                    if not seen_before:
                        state.stop_growth()
                    state.predict()
                    if turn is not None and type(state) is Motion and not (turn[1] or turn[3]):
                        zoomed(state, turn)
                    elif turn is not None:
                        state = Coupled.of(state) if type(state) is Motion else state
                        state.warp(turn)
                    out.append(tuple(map(float, state.corners())))
                    if seen:
                        state.update(measured(*corners))
                seen_before = seen
            boxes = [pa.array(c, pa.float64()) for c in zip(*out)] if out else [pa.array([], pa.float64())] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], *boxes, batch.column(n + 5)], names=[*keys, "frame_idx", *Box._fields, "seen"])

    ordered = rows.select(*keys, "frame_idx", *Box._fields, "seen", warp).repartition(*keys).sortWithinPartitions(*keys, "frame_idx")
    return ordered.mapInArrow(run, PREDICTED.format(keys=", ".join(f"`{k}` {t}" for k, t in kinds.items())))


def predicted_distance(predicted: DataFrame, boxes: DataFrame, measure: Callable[[Box, Box], Column] = iou_inclusive, keys: list[str] = ["frame_idx"]) -> DataFrame:
    """Pairs of a predicted (``l_``) and another (``r_``) box of one frame with ``distance``, one less their overlap.

    ``measure`` may grow the boxes first. All pairs of a frame come, also those that don't overlap.
    """
    pairs = prefixed(predicted, "l_", keys).join(prefixed(boxes, "r_", keys), keys)
    corners = [Box(*[F.col(p + c) for c in Box._fields]) for p in ("l_", "r_")]
    return pairs.withColumn("distance", 1 - measure(*corners))
