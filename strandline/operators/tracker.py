"""Multi-object tracking: one state per sequence, advanced frame by frame.

A frame is matched to the tracks in rounds of growing boxes, on overlap with the last observed boxes and on
appearance, then its weak detections on overlap alone. The same ``Tracker`` serves batches and streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.config import TrackerConfig
from strandline.operators.assignment import assign
from strandline.operators.motion import Motion, average, measured, unit

TRACKED, LOST, REMOVED = 1, 2, 4


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairwise intersection over union of pixel boxes (n, 4) and (m, 4), corners included."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    side = np.minimum(a[:, None, 2:], b[None, :, 2:]) - np.maximum(a[:, None, :2], b[None, :, :2]) + 1
    both = np.clip(side, 0, None).prod(axis=2)
    area = [(x[:, 2] - x[:, 0] + 1) * (x[:, 3] - x[:, 1] + 1) for x in (a, b)]
    return both / (area[0][:, None] + area[1][None, :] - both)


def grown(boxes: np.ndarray, e: float) -> np.ndarray:
    size = boxes[:, 2:] - boxes[:, :2]
    by = np.floor((2 * e * size + size) / 2)
    return np.concatenate([boxes[:, :2] - by, boxes[:, 2:] + by], axis=1)


class Track:
    __slots__ = ("id", "state", "motion", "last", "feature", "look", "score", "start", "seen", "det")

    def __init__(self, track_id, det, frame):
        self.id, self.state, self.start = track_id, TRACKED, frame
        self.motion, self.feature, self.look = Motion(measured(*det["box"])), None, None
        self._take(det, frame)

    def _take(self, det, frame, momentum: float = 0.9):
        self.last, self.score, self.seen, self.det, self.state = det["box"], det["score"], frame, det["det_idx"], TRACKED
        if det.get("embedding") is not None:
            self.feature = average(self.feature, det["embedding"], momentum)
            self.look = unit(self.feature)

    @classmethod
    def from_row(cls, row: tuple) -> Track:
        """A track from what ``row`` gave."""
        t = cls.__new__(cls)
        t.id, t.state, t.start, t.seen, t.det, t.score = row[:6]
        t.last, t.motion = tuple(row[6]), Motion.from_axes(row[7])
        t.feature = None if row[8] is None else list(row[8])
        t.look = None if t.feature is None else unit(t.feature)
        return t

    def row(self) -> tuple:
        """Its fields as plain values, in the order of ``TRACK_STATE``."""
        return (self.id, self.state, self.start, self.seen, self.det, float(self.score), [float(x) for x in self.last], [[float(x) for x in a] for a in self.motion.axes], None if self.feature is None else [float(x) for x in self.feature])

    def match(self, det, frame, momentum):
        self.motion.update(measured(*det["box"]))
        self._take(det, frame, momentum)


class Tracker:
    """State of one sequence. ``step`` takes a frame's detections and gives its tracked objects."""

    def __init__(self, config: TrackerConfig = TrackerConfig()):
        self.config, self.frame, self.next_id = config, 0, 1
        self.tracked: list[Track] = []
        self.lost: list[Track] = []
        self.removed: set[int] = set()
        #: What the last frame changed: (id, state, reason), by id.
        self.changes: list[tuple[int, int, str | None]] = []

    def _distance(self, tracks, dets, expand, appearance):
        """Overlap distances, lowered by appearance; in a frame where a feature is missing, by overlap alone."""
        c = self.config
        cost = 1 - overlaps(grown(np.array([t.last for t in tracks]).reshape(-1, 4), expand), grown(np.array([d["box"] for d in dets]).reshape(-1, 4), expand))
        if appearance and c.with_reid and cost.size and all(t.feature is not None for t in tracks) and all(d.get("embedding") is not None for d in dets):
            looks = np.maximum(0.0, 1 - np.array([t.look for t in tracks]) @ np.array([unit(d["embedding"]) for d in dets]).T) / 2
            looks[(looks > c.appearance_thresh) | (cost > c.proximity_thresh)] = 1.0
            cost = np.minimum(cost, looks)
        return cost

    def _round(self, tracks, dets, expand, limit, appearance):
        """Match; the tracks and detections that are left."""
        if not tracks or not dets:
            return tracks, dets
        pairs = assign(self._distance(tracks, dets, expand, appearance), limit)
        for i, j in pairs:
            tracks[i].match(dets[j], self.frame, self.config.feature_momentum)
        rows, columns = {i for i, _ in pairs}, {j for _, j in pairs}
        return [t for i, t in enumerate(tracks) if i not in rows], [d for j, d in enumerate(dets) if j not in columns]

    def step(self, dets: list[dict]) -> list[Track]:
        c = self.config
        self.frame += 1
        here = {t.id for t in self.tracked}
        before = self._standing()
        pool = self.tracked + [t for t in self.lost if t.id not in here]
        for t in pool:
            if t.state != TRACKED:
                t.motion.stop_growth()
            t.motion.predict()
        high = [d for d in dets if d["score"] > c.track_thresh]
        low = [d for d in dets if c.track_low_thresh < d["score"] < c.track_thresh]
        for k in range(c.rounds):
            left, high = self._round(pool, high, c.first_expand + c.expand_step * k, c.match_thresh, True)
            pool = [t for t in left if t.state == TRACKED]
        left, _ = self._round(pool, low, c.low_expand, c.low_match_thresh, False)
        newly_lost = [t for t in left if t.state == TRACKED]
        for t in newly_lost:
            t.state = LOST
        new = []
        for d in high:
            if d["score"] >= c.new_track_thresh:
                new.append(Track(self.next_id, d, self.frame))
                self.next_id += 1
        expired = set()
        for t in self.lost:
            if t.state != TRACKED and self.frame - t.seen > c.lost_frames:
                t.state = REMOVED
                expired.add(t.id)
        revived = [t for t in self.lost if t.state == TRACKED]
        self.tracked = [t for t in self.tracked if t.state == TRACKED] + new + revived
        here = {t.id for t in self.tracked}
        # What expires now stays for one more frame; an id that has expired once isn't kept when lost again.
        self.lost = [t for t in self.lost + newly_lost if t.id not in here and t.id not in self.removed]
        kept = self._standing()
        self._drop_duplicates()
        after = self._standing()
        gone = [(k, REMOVED, "duplicate" if k in kept else "expired") for k in before.keys() - after.keys()]
        self.changes = sorted([(k, state, None) for k, state in after.items() if before.get(k) != state] + gone)
        # Ids aren't given twice, so only those that may still be lost again have to be known.
        self.removed = (self.removed | expired) & {t.id for side in (self.tracked, self.lost) for t in side}
        return self.tracked

    def _standing(self) -> dict[int, int]:
        """The state of each track that is held."""
        return {t.id: LOST for t in self.lost} | {t.id: TRACKED for t in self.tracked}

    def _drop_duplicates(self):
        if not self.tracked or not self.lost:
            return
        boxes = [np.array([t.motion.corners() for t in side]).reshape(-1, 4) for side in (self.tracked, self.lost)]
        drop: tuple[set, set] = set(), set()
        for i, j in np.argwhere(1 - overlaps(*boxes) < self.config.duplicate_distance):
            p, q = self.tracked[i], self.lost[j]
            drop[1].add(q.id) if p.seen - p.start > q.seen - q.start else drop[0].add(p.id)
        self.tracked = [t for t in self.tracked if t.id not in drop[0]]
        self.lost = [t for t in self.lost if t.id not in drop[1]]

    def state(self) -> list[tuple]:
        """The tracks of now and the lost ones in order, each with its list and whether it has expired before."""
        return [(k, p, t.id in self.removed, *t.row()) for k, side in enumerate((self.tracked, self.lost)) for p, t in enumerate(side)]

    @classmethod
    def restored(cls, config: TrackerConfig, frame: int, next_id: int, state: list[tuple]) -> Tracker:
        """The tracker that had this frame, next id and ``state``."""
        tracker = cls(config)
        tracker.frame, tracker.next_id = frame, next_id
        for side, _, expired, *row in sorted(state, key=lambda r: r[:2]):
            track = Track.from_row(tuple(row))
            (tracker.lost if side else tracker.tracked).append(track)
            if expired:
                tracker.removed.add(track.id)
        return tracker

    def rows(self, sequence, frame_idx: int, dets: list[dict]) -> Iterator[tuple]:
        for k, t in enumerate(self.step(dets)):
            yield (sequence, frame_idx, k, t.id, *map(float, t.motion.corners()), float(t.score), int(t.det))


#: A track as a row, typed, so that state outlives the code that wrote it.
TRACK_STATE = "side int, place int, expired boolean, id long, state int, start long, seen long, det int, score double, last array<double>, axes array<array<double>>, feature array<double>"

TRACKED_ROWS = "sequence_id long, frame_idx long, out_idx int, tracker_id long, x1 double, y1 double, x2 double, y2 double, score double, det_idx int"
NAMES = [c.split()[0] for c in TRACKED_ROWS.split(", ")]
KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.float64()] * 5, pa.int32()]


def as_dets(rows: list[dict]) -> list[dict]:
    """A frame's detections in order, from the structs of ``by_frame``."""
    return [{"det_idx": r["det_idx"], "box": (r["x1"], r["y1"], r["x2"], r["y2"]), "score": r["score"], "embedding": r["embedding"]} for r in rows if r["x1"] is not None]


#: Objects and, with a ``state``, the changes of tracks.
LIFE_ROWS = TRACKED_ROWS + ", state string, reason string"
STATES = {TRACKED: "tracked", LOST: "lost", REMOVED: "removed"}


def life_rows(tracker: Tracker, sequence, frame_idx: int, dets: list[dict]) -> Iterator[tuple]:
    """A frame's objects, then what it changed, as rows of ``LIFE_ROWS``."""
    for row in tracker.rows(sequence, frame_idx, dets):
        yield (*row, None, None)
    for own, state, reason in tracker.changes:
        yield (sequence, frame_idx, None, own, *[None] * 6, STATES[state], reason)


def _track(config, life: bool):
    kinds = KINDS + [pa.string(), pa.string()] if life else KINDS
    names = NAMES + ["state", "reason"] if life else NAMES

    def run(batches):
        sequence, tracker, first = None, None, True
        for batch in batches:
            out: list[tuple] = []
            for own, frame, dets in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if first or own != sequence:
                    sequence, tracker, first = own, Tracker(config), False
                out += life_rows(tracker, own, frame, as_dets(dets)) if life else tracker.rows(own, frame, as_dets(dets))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=names)

    return run


def by_frame(detections: DataFrame) -> DataFrame:
    """One row per frame of ``sequence_id, frame_idx`` with its detections in order; a null box stands for none."""
    embedding = F.col("embedding") if "embedding" in detections.columns else F.lit(None).cast("array<double>")
    det = F.struct("det_idx", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2", "score")], embedding.alias("embedding"))
    return detections.groupBy(F.col("sequence_id").cast("long"), F.col("frame_idx").cast("long")).agg(F.array_sort(F.collect_list(det)).alias("dets"))


def tracked(detections: DataFrame, config: TrackerConfig = TrackerConfig(), life: bool = False) -> DataFrame:
    """Tracked objects of all sequences. A frame without detections needs a row with a null box to be counted.

    Tracking is sequential, so a sequence is one task's work; frames are streamed in order and only the
    tracks' states are held. Sequences run in parallel. An empty table gives no rows. With ``life`` the same pass also
    gives what became of the tracks (``LIFE_ROWS``), for ``objects`` and ``intervals``.
    """
    frames = by_frame(detections).repartition("sequence_id").sortWithinPartitions("sequence_id", "frame_idx")
    return frames.mapInArrow(_track(config, life), LIFE_ROWS if life else TRACKED_ROWS)


def objects(rows: DataFrame) -> DataFrame:
    """The objects among ``LIFE_ROWS``."""
    return rows.filter("state is null").select(*NAMES)


def intervals(rows: DataFrame) -> DataFrame:
    """``sequence_id, tracker_id, state, from_frame, until_frame, reason``: the life of each track, from ``LIFE_ROWS``.

    A track is ``tracked`` or ``lost`` from a frame until the one where that changes, which isn't part of it; null: it
    lasts to the end of what was tracked. The last row of a track that went is ``removed``, with its frame, and why:
    ``expired`` (lost for too long, or lost again after that) or ``duplicate`` (of an older one). A track
    that goes in the frame in which it would begin has no life.
    """
    own = Window.partitionBy("sequence_id", "tracker_id").orderBy("frame_idx")
    changes = rows.filter("state is not null")
    return changes.select("sequence_id", "tracker_id", "state", F.col("frame_idx").alias("from_frame"), F.lead("frame_idx").over(own).alias("until_frame"), "reason")
