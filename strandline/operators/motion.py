"""Constant-velocity Kalman filter of boxes.

The eight-state filter (center, size and their velocities) has no terms between axes: it is four scalar
filters of two states each, kept here as plain numbers ``x, v, p00, p01, p11``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSITION, VELOCITY = 1 / 20, 1 / 160


class Motion:
    """Filtered center, width and height of one object; axes are x, y, w, h."""

    __slots__ = ("axes",)

    def __init__(self, measured):
        w, h = measured[2], measured[3]
        self.axes = [[z, 0.0, (2 * POSITION * s) ** 2, 0.0, (10 * VELOCITY * s) ** 2] for z, s in zip(measured, (w, h, w, h))]

    @classmethod
    def from_axes(cls, axes) -> Motion:
        motion = cls.__new__(cls)
        motion.axes = [list(a) for a in axes]
        return motion

    def sizes(self):
        w, h = self.axes[2][0], self.axes[3][0]
        return w, h, w, h

    def stop_growth(self):
        self.axes[2][1] = self.axes[3][1] = 0.0

    def predict(self):
        for a, s in zip(self.axes, self.sizes()):
            x, v, p00, p01, p11 = a
            a[:] = x + v, v, p00 + 2 * p01 + p11 + (POSITION * s) ** 2, p01 + p11, p11 + (VELOCITY * s) ** 2

    def update(self, measured):
        for a, s, z in zip(self.axes, self.sizes(), measured):
            x, v, p00, p01, p11 = a
            total = p00 + (POSITION * s) ** 2
            k0, k1 = (p00 / total, p01 / total) if total else (0.0, 0.0)
            y = z - x
            a[:] = x + k0 * y, v + k1 * y, p00 - k0 * k0 * total, p01 - k0 * k1 * total, p11 - k1 * k1 * total

    def gate(self, measured, metric: str = "maha", only_position: bool = False) -> float:
        """Squared distance of a measurement: Mahalanobis, or Euclidean with 'gaussian'."""
        n = 2 if only_position else 4
        parts = list(zip(self.axes, self.sizes(), measured))[:n]
        if metric == "gaussian":
            return sum((z - a[0]) ** 2 for a, _, z in parts)
        return sum((z - a[0]) ** 2 / (a[2] + (POSITION * s) ** 2) for a, s, z in parts if a[2] + (POSITION * s) ** 2)

    def corners(self):
        (x, y, w, h) = (a[0] for a in self.axes)
        return x - w / 2, y - h / 2, x + w / 2, y + h / 2


def measured(x1, y1, x2, y2):
    return (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1


FILTERED = "track_id long, idx int, cx double, cy double, w double, h double, vx double, vy double, gate double"


def _filter(batches):
    """Rows in order of track and position; only the current track's state is held."""
    track, motion = None, None
    for batch in batches:
        out = []
        for own, idx, *corners in zip(*(batch.column(k).to_pylist() for k in range(6))):
            z = measured(*corners)
            gate = None
            if motion is None or own != track:
                track, motion = own, Motion(z)
            else:
                motion.predict()
                gate = motion.gate(z)
                motion.update(z)
            x, y, w, h = motion.axes
            out.append((own, idx, x[0], y[0], w[0], h[0], x[1], y[1], gate))
        kinds = [pa.int64(), pa.int32(), *[pa.float64()] * 7]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 9, kinds)], names=["track_id", "idx", "cx", "cy", "w", "h", "vx", "vy", "gate"])


def filtered_series(observations: DataFrame) -> DataFrame:
    """Every observation's filtered box, velocity and squared gating distance (null for a series' first one).

    The recursion depends on every box before, so a series is one task's work; it is streamed in sorted order,
    with one state in memory, however long it is. Boxes with a null corner are ignored.
    """
    rows = observations.select(F.col("track_id").cast("long"), F.col("idx").cast("int"), *[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]).dropna()
    return rows.repartition("track_id").sortWithinPartitions("track_id", "idx").mapInArrow(_filter, FILTERED)


def smoothed(series: DataFrame, momentum: float = 0.9) -> DataFrame:
    """``track_id, idx, feature``: exponential moving average of unit vectors, renormalised at every step.

    A zero vector counts as it is. Streamed like ``filtered_series``.
    """

    def run(batches):
        track, state = None, None
        for batch in batches:
            out = []
            for own, vector in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                state = average(state if own == track else None, vector, momentum)
                track = own
                out.append(state)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], names=["track_id", "idx", "feature"])

    rows = series.select(F.col("track_id").cast("long"), F.col("idx").cast("int"), "embedding").dropna()
    return rows.repartition("track_id").sortWithinPartitions("track_id", "idx").mapInArrow(run, "track_id long, idx int, feature array<double>")


def unit(v: list[float]) -> list[float]:
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v] if n else list(v)


def average(state: list[float] | None, vector: list[float], momentum: float) -> list[float]:
    vector = unit(vector)
    return vector if state is None else unit([momentum * a + (1 - momentum) * b for a, b in zip(state, vector)])
