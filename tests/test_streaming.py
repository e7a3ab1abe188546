"""The online tracker: typed state, late frames, sequences that end, and the lives of tracks."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.config import TrackerConfig
from strandline.operators import tracker
from strandline.streaming import online

KIND = "sequence_id long, frame_idx long, det_idx int, x1 double, y1 double, x2 double, y2 double, score double, embedding array<double>"
CONFIG = TrackerConfig(track_buffer=12)


def walkers(sequences=3, frames=40, seed=1):
    """Persons that walk, hide, come back or not; frames without any have a row with a null box."""
    rng = random.Random(seed)
    rows = []
    for s in range(sequences):
        people = [(rng.randrange(0, 900), rng.randrange(0, 500), rng.choice([-4, 3, 5]), rng.randrange(5, 15), rng.randrange(18, 40)) for _ in range(6)]
        for f in range(frames):
            own = []
            for k, (x, y, v, hide, again) in enumerate(people):
                if not hide <= f < again and not 30 <= f < 33:
                    own.append((s, f, len(own), x + v * f + 0.0, y + 0.0, x + v * f + 40.0, y + 90.0, rng.choice([0.9, 0.8, 0.5]), [float(k == j) for j in range(6)]))
            rows += own or [(s, f, 0, None, None, None, None, None, None)]
    return rows


def kept(rows):
    return sorted(map(tuple, rows), key=repr)


def test_state_returns_as_it_was():
    rng = random.Random(2)
    one, other = tracker.Tracker(CONFIG), tracker.Tracker(CONFIG)
    by = {}
    for r in walkers(1, 60, 5):
        by.setdefault(r[1], []).append({"det_idx": r[2], "box": r[3:7], "score": r[7], "embedding": r[8]} if r[3] is not None else None)
    for f, dets in sorted(by.items()):
        dets = [d for d in dets if d]
        assert list(one.rows(0, f, dets)) == list(other.rows(0, f, dets)) and one.changes == other.changes
        state = other.state()
        rng.shuffle(state)
        other = tracker.Tracker.restored(CONFIG, other.frame, other.next_id, state)
    assert one.next_id > 6


def test_intervals_give_the_tracked_rows_back(spark):
    """SQL over the intervals and the frames alone finds in which frames each track was an object."""
    df = spark.createDataFrame(walkers(), KIND)
    every = tracker.tracked(df, CONFIG, life=True).cache()
    assert kept(tracker.objects(every).collect()) == kept(tracker.tracked(df, CONFIG).collect())
    tracker.intervals(every).createOrReplaceTempView("intervals")
    df.select("sequence_id", "frame_idx").distinct().createOrReplaceTempView("all_frames")
    back = spark.sql("select f.sequence_id, frame_idx, tracker_id from all_frames f join intervals i on f.sequence_id = i.sequence_id and frame_idx >= from_frame and frame_idx < coalesce(until_frame, 1 << 40) where state = 'tracked'")
    assert kept(back.collect()) == kept(tracker.objects(every).select("sequence_id", "frame_idx", "tracker_id").collect()) != []
    rows = tracker.intervals(every).collect()
    assert {r["state"] for r in rows} == {"tracked", "lost", "removed"} and {r["reason"] for r in rows if r["state"] == "removed"} == {"expired"}
    assert all(r["until_frame"] is None and r["reason"] for r in rows if r["state"] == "removed") and all(r["reason"] is None for r in rows if r["state"] != "removed")
    for r in rows:  # a lost track goes after the buffer and the frame it stays for
        if r["state"] == "lost" and any(q["state"] == "removed" and (q["sequence_id"], q["tracker_id"], q["from_frame"]) == (r["sequence_id"], r["tracker_id"], r["until_frame"]) for q in rows):
            assert r["until_frame"] - r["from_frame"] >= CONFIG.lost_frames
    assert tracker.intervals(tracker.tracked(df.limit(0), CONFIG, life=True)).count() == 0


def test_duplicates_end_with_their_reason():
    t = tracker.Tracker(TrackerConfig())
    look = {"score": 0.9, "embedding": None}
    t.step([{"det_idx": 0, "box": (0.0, 0.0, 40.0, 80.0), **look}])
    assert t.changes == [(1, tracker.TRACKED, None)]
    t.step([])
    assert t.changes == [(1, tracker.LOST, None)]
    t.tracked.append(tracker.Track(9, {"det_idx": 0, "box": (0.0, 0.0, 40.0, 80.0), **look}, 0))
    t.step([{"det_idx": 0, "box": (0.0, 0.0, 40.0, 80.0), **look}])
    assert t.changes == [(1, tracker.REMOVED, "duplicate"), (9, tracker.TRACKED, None)][: len(t.changes)] and not t.lost and [x.id for x in t.tracked] == [9]


@pytest.mark.parametrize("delay", [0, 6])
def test_frames_in_any_order_within_the_delay_equal_a_batch(spark, tmp_path, delay):
    """Files bring frames shuffled within the delay, and parts of frames; the last frames are tracked when the sequence ends."""
    rows = walkers()
    rng = random.Random(delay)
    order = {(s, f): f + (rng.random() * (delay - 1) if delay else 0) for s, f in {r[:2] for r in rows}}
    place = {k: i for i, k in enumerate(sorted(order, key=lambda k: (order[k], k[0])))}
    files: dict[int, list] = {}
    for r in rows:
        at = place[r[:2]] // 40 if delay else r[1] // 14
        files.setdefault(at, []).append(r)
    for n, own in sorted(files.items()):
        if not delay:
            rng.shuffle(own)
        spark.createDataFrame(own, KIND).coalesce(1).write.parquet(f"{tmp_path}/in/{n:02d}")
        time.sleep(0.05)
    df = spark.createDataFrame(rows, KIND)
    batch = tracker.tracked(df, CONFIG, life=True)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    found = online.tracked_stream(stream, CONFIG, delay, quiet=3 if delay else None, life=True)
    if not delay:
        assert kept(online.drained(found, "any").collect()) == kept(batch.collect())
        return
    query = found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="300 milliseconds").start(f"{tmp_path}/out")
    want = kept(batch.collect())
    try:
        for _ in range(80):
            time.sleep(0.5)
            done = spark.read.schema(found.schema).parquet(f"{tmp_path}/out") if (tmp_path / "out" / "_spark_metadata").exists() else None
            if done is not None and done.count() >= len(want):
                break
        time.sleep(2)
        sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    finally:
        query.stop()
    assert kept(spark.read.schema(found.schema).parquet(f"{tmp_path}/out").collect()) == want
    # State: at most the waiting frames, the tracks and the clock of each sequence; none when all have ended.
    assert 0 < max(sizes) < 3 * (2 * delay + 40) and sizes[-1] == 0


def test_frames_that_come_too_late_are_dropped(spark, tmp_path):
    rows = [r for r in walkers(1, 20) if r[1] != 5]
    late = [r for r in walkers(1, 20) if r[1] == 5]
    for n, own in enumerate((rows, late)):
        spark.createDataFrame(own, KIND).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        time.sleep(0.05)
    df = spark.createDataFrame(rows, KIND)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = online.drained(online.tracked_stream(stream, CONFIG), "late")
    assert kept(got.collect()) == kept(tracker.tracked(df, CONFIG).collect())
    odd = spark.createDataFrame([(None, 1, 0, 1.0, 1.0, 2.0, 2.0, 0.9, None), (1, None, 0, 1.0, 1.0, 2.0, 2.0, 0.9, None)], KIND)
    odd.write.parquet(f"{tmp_path}/odd/0")
    assert online.drained(online.tracked_stream(spark.readStream.schema(odd.schema).parquet(f"{tmp_path}/odd/*"), CONFIG), "odd").count() == 0


class _Store:
    """State in memory that counts what is written."""

    def __init__(self):
        self.value, self.map, self.written = None, {}, 0

    getValueState = getListState = getMapState = lambda self, *_: _Store()
    exists = lambda self: self.value is not None
    get = lambda self: self.value
    put = update = lambda self, value: setattr(self, "value", value)
    clear = lambda self: setattr(self, "value", None)
    keys = lambda self: [*self.map]
    containsKey = lambda self, key: key in self.map
    getValue = lambda self, key: self.map[key]
    removeKey = lambda self, key: self.map.pop(key)

    def updateValue(self, key, value):
        self.written += 1
        self.map[key] = value


def test_frames_of_a_trigger_reach_the_state_store_only_beyond_the_bound(monkeypatch):
    rows = [(f, k, 100.0 * k + 3 * f, 50.0, 100.0 * k + 3 * f + 40, 130.0, 0.9, None) for f in range(40) for k in range(3)]
    frame = pd.DataFrame(rows, columns=["frame_idx", *online._FIELDS])
    frame = frame.sample(frac=1, random_state=1)
    found = {}
    for held, delay in ((10_000, 0), (7, 0), (10_000, 9)):
        monkeypatch.setattr(online, "HELD", held)
        monkeypatch.setattr(online, "GIVEN", 5)
        tracker = online.OnlineTracker(TrackerConfig(), delay, None, False)
        tracker.init(_Store())
        out = pd.concat(tracker.handleInputRows((4,), iter([frame.iloc[k : k + 11] for k in range(0, 120, 11)]), None))
        found[held, delay] = [tuple(r) for r in out.itertuples(index=False)], tracker.waiting.written, len(tracker.waiting.map)
    every, none, left = found[10_000, 0]
    assert len(every) == 120 and none == left == 0
    assert found[7, 0][0] == every and found[7, 0][1] > 0 and found[7, 0][2] == 0
    assert found[10_000, 9][0] == [r for r in every if r[1] <= 30] and found[10_000, 9][1:] == (9, 9)


def test_rounds_without_tracks_or_detections_measure_nothing(monkeypatch):
    """Once a frame's detections are matched, no further round measures distances; a restored track keeps its look."""
    calls = []
    plain = tracker.Tracker._distance
    monkeypatch.setattr(tracker.Tracker, "_distance", lambda self, tracks, dets, *more: calls.append((len(tracks), len(dets))) or plain(self, tracks, dets, *more))
    t = tracker.Tracker()
    for f in range(5):
        t.step([{"det_idx": 0, "box": (10.0 + f, 10.0, 50.0 + f, 90.0), "score": 0.9, "embedding": [3.0, 4.0]}])
    assert calls == [(1, 1)] * 4
    back = tracker.Tracker.restored(t.config, t.frame, t.next_id, t.state())
    assert back.tracked[0].look == t.tracked[0].look
