"""Online tracking and sessions on Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandline.config import TrackerConfig
from strandline.operators.tracker import LIFE_ROWS, NAMES, TRACK_STATE, TRACKED_ROWS, Tracker, as_dets, life_rows
from strandline.session import own_tables


CLOCK = "frame long, next_id long, newest long, tracked_to long"
DETECTION = "det_idx int, x1 double, y1 double, x2 double, y2 double, score double, embedding array<double>"
_FIELDS = [c.split()[0] for c in DETECTION.split(", ")]
#: Rows of a sequence that a trigger holds in memory before they go to the state store, and rows of a batch given back.
HELD, GIVEN = 50_000, 5_000


class OnlineTracker(StatefulProcessor):
    """The tracker of a sequence as typed state: its clock, its tracks, and the frames that wait for earlier ones.

    A frame is tracked when one ``delay`` frames newer is there, all in order. Up to ``HELD`` rows of a trigger stay in
    memory and go to the tracker from there; what is beyond, and what has to wait for later triggers, is in the state store,
    whatever a trigger brings. Memory is those rows, a batch, a frame and the tracks. After ``quiet_ms`` without rows a timer tracks what waits, and the sequence ends.
    """

    def __init__(self, config: TrackerConfig, delay: int, quiet_ms: int | None, life: bool):
        self.config, self.delay, self.quiet_ms, self.life = config, delay, quiet_ms, life
        self.names = NAMES + ["state", "reason"] if life else NAMES

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", CLOCK)
        self.tracks = handle.getListState("tracks", TRACK_STATE)
        self.waiting = handle.getMapState("waiting", "frame_idx long", f"dets array<struct<{DETECTION.replace(' ', ':').replace(',:', ',')}>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clock, held, n = self._clock(), {}, 0
        for batch in rows:
            frames, dets = batch["frame_idx"].tolist(), zip(*(batch[c].tolist() for c in _FIELDS))
            for frame, det in zip(frames, dets):
                if frame > clock["tracked_to"]:  # else too late: a later frame has been tracked
                    held.setdefault(frame, []).append(_det(det))
                    n += 1
            clock["newest"] = max(clock["newest"], *held) if held else clock["newest"]
            if n >= HELD:
                self._keep(held)
                held, n = {}, 0
        yield from self._track(int(key[0]), clock, clock["newest"] - self.delay, held)
        if self.quiet_ms is not None:
            for old in [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        clock = self._clock()
        yield from self._track(int(key[0]), clock, clock["newest"])
        self.tracks.clear()
        self.waiting.clear()
        self.clock.clear()

    def _clock(self) -> dict:
        names = [c.split()[0] for c in CLOCK.split(", ")]
        return dict(zip(names, self.clock.get())) if self.clock.exists() else dict(zip(names, (0, 1, -1, -1)))

    def _keep(self, held: dict[int, list[tuple]]) -> None:
        """Put frames, or more rows of frames, to those that wait in the state store."""
        for frame, dets in held.items():
            before = [*map(tuple, self.waiting.getValue((frame,))[0])] if self.waiting.containsKey((frame,)) else []
            self.waiting.updateValue((frame,), ([_det(d) for d in before] + dets,))

    def _track(self, sequence: int, clock: dict, last: int, held: dict[int, list[tuple]] = {}) -> Iterator[pd.DataFrame]:
        """Track the waiting and the held frames up to ``last`` in order, and keep the state and the later frames."""
        stored = {f[0] for f in self.waiting.keys()}
        self._keep({f: dets for f, dets in held.items() if f > last})
        ready = sorted(f for f in stored | held.keys() if f <= last)
        out: list[tuple] = []
        tracker = Tracker.restored(self.config, clock["frame"], clock["next_id"], [tuple(r) for r in self.tracks.get()] if self.tracks.exists() else [])
        for frame in ready:
            own = [*self.waiting.getValue((frame,))[0]] if frame in stored else []
            found = [dict(zip(_FIELDS, d)) for d in [*own, *held.get(frame, ())]]
            dets = sorted((d for d in found if d["x1"] is not None), key=lambda d: d["det_idx"])
            rows = life_rows(tracker, sequence, frame, as_dets(dets)) if self.life else tracker.rows(sequence, frame, as_dets(dets))
            out += rows
            if frame in stored:
                self.waiting.removeKey((frame,))
            clock["tracked_to"] = frame
            if len(out) >= GIVEN:
                yield self._frame(out)
                out = []
        if out:
            yield self._frame(out)
        self.clock.update((tracker.frame, tracker.next_id, clock["newest"], clock["tracked_to"]))
        self.tracks.clear()
        state = tracker.state()
        if state:
            self.tracks.put(state)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        """Rows as pandas holds them, whole numbers that may be missing too."""
        out = pd.DataFrame(rows, columns=self.names)
        return out.astype({"out_idx": "Int32", "det_idx": "Int32"})

    def close(self) -> None:
        pass


def _det(d: tuple) -> tuple:
    """A detection as the state store takes it: numbers, and null for what is missing."""
    number, *box, score, embedding = d
    box = [None if v is None or v != v else float(v) for v in box]
    return (None if number is None or number != number else int(number), *box, None if score is None or score != score else float(score), None if embedding is None else [float(x) for x in embedding])


def tracked_stream(detections: DataFrame, config: TrackerConfig = TrackerConfig(), delay: int = 0, quiet: int | None = None, life: bool = False) -> DataFrame:
    """Tracked objects of a stream of detections; the tracker of a sequence is typed state (``OnlineTracker``).

    Frames may come in any order within ``delay`` frames of the newest of their sequence, and parts of a frame in several
    triggers; what comes later than that is dropped. With delay 0 a trigger brings whole frames, in order between
    triggers. ``quiet`` (seconds): a sequence without rows for so long ends, its waiting frames are tracked and its state
    goes; one that starts again is a new one. Without, state stays and the last ``delay`` frames wait. A frame without
    detections needs a row with a null box, as in a batch; an ``embedding`` takes part as there. Rows with a null sequence or
    frame are left out. ``life`` is as in a batch. Typed state
    needs the RocksDB state store, which the session is set to. The state holds the tracks of now and those lost within the buffer, nothing older.
    """
    spark = detections.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    embedding = F.col("embedding") if "embedding" in detections.columns else F.lit(None)
    rows = detections.select(embedding.cast("array<double>").alias("embedding"), F.col("sequence_id").cast("long"), F.col("frame_idx").cast("long"), F.col("det_idx").cast("int"), *[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2", "score")])
    own = rows.dropna(subset=["sequence_id", "frame_idx"]).groupBy("sequence_id")
    processor = OnlineTracker(config, delay, None if quiet is None else 1000 * quiet, life)
    return own.transformWithStateInPandas(processor, LIFE_ROWS if life else TRACKED_ROWS, "Append", "None" if quiet is None else "ProcessingTime")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of each user: start, end and number of events; late rows beyond ``delay`` are dropped."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return stamped.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "total")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into a table of the shared folder, and read that table."""
    spark = stream.sparkSession
    folder = f"{own_tables(spark)}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
