"""From annotations to labelled frames: tracking, series, attributes, split, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.config import NumberConfig, SplitConfig, TrackerConfig
from strandline.functions.geometry import Box
from strandline.operators import attributes, labels, overlap, splits, tracker
from strandline.operators.series import positions, ranked
from strandline.session import written
from strandline.sources import files


def numbered_sequences(frames: DataFrame) -> DataFrame:
    """``sequence_id, sequence_no``: the sequences by name. One row per sequence is ordered as a whole, no frame is."""
    return frames.select("sequence_id").distinct().withColumn("sequence_no", (F.row_number().over(Window.orderBy("sequence_id")) - 1).cast("long"))


def tracked_observations(frames: DataFrame, boxes: DataFrame, config: TrackerConfig = TrackerConfig()) -> DataFrame:
    """Series of tracked boxes with what the best overlapping annotation says of them.

    ``frames`` has ``sequence_id, frame_idx, filename``; ``boxes`` is from ``annotated_boxes``, perhaps with an
    ``embedding``. Gives ``sequence_id, tracker_id, track_id, idx, frame_idx``, the box, ``score, class_id, embedding, role`` and
    the ground truth. ``tracker_id`` is the track's id in its sequence; ``track_id`` numbers all tracks of all sequences in
    order of both, so it is a key alone. A box that overlaps no annotation has class 0, role unknown and no embedding.
    """
    detected = written(files.frame_detections(frames, boxes).join(numbered_sequences(frames), "sequence_id"), "detections")
    named = detected.select("sequence_id", "sequence_no").distinct()
    found = tracker.tracked(detected.withColumn("sequence_id", F.col("sequence_no")), config).withColumnRenamed("sequence_id", "sequence_no")
    tracks = found.select("sequence_no", "frame_idx", F.col("out_idx").alias("trk_idx"), "tracker_id", *Box._fields, "score")
    right = detected.filter("x1 is not null")
    if "embedding" not in right.columns:
        right = right.withColumn("embedding", F.lit(None).cast("array<double>"))
    carry = ["class_id", "embedding", "gt_track_id", "gt_jersey", "gt_team", "gt_role"]
    matched = overlap.best_overlap(tracks, right.select("sequence_no", "frame_idx", "det_idx", *Box._fields, *carry), carry, keys=["sequence_no", "frame_idx"])
    rows = written(
        matched.join(named, "sequence_no").select(
            "sequence_id", "sequence_no", "tracker_id", "frame_idx", *Box._fields, "score",
            F.coalesce("class_id", F.lit(0)).alias("class_id"), "embedding",
            F.coalesce("gt_role", F.lit("unknown")).alias("role"), "gt_track_id", "gt_jersey", "gt_team",
        ), "matched",
    )
    own = ["sequence_no", "tracker_id"]
    numbers = ranked(rows.select(*own).distinct(), [], [F.col(c) for c in own], "track_id").withColumn("track_id", F.col("track_id") + 1)
    return positions(rows.join(numbers, own).drop("sequence_no"), "track_id", "frame_idx")


def labelled_frames(frames: DataFrame, boxes: DataFrame, images: DataFrame, models: attributes.Models, tracking: TrackerConfig = TrackerConfig(), number: NumberConfig = NumberConfig(), split: SplitConfig = SplitConfig(), decode=None, cache: str | None = None) -> DataFrame:
    """``sequence_id, frame_idx``, box, ``track_id, parent_id, jersey, team, role, label`` of every object after the split.

    Ids are those of an object's sequence: pieces of a split follow the largest id of their own sequence. Every step is
    an operator of its own; what several steps read is written once in between. With a folder ``cache`` the two dear steps,
    tracking and attributes, are kept there under their settings and the models' ``weights``, and found by the
    next run over the same data; other data need another folder. An empty table of boxes gives no rows.
    """
    spark = frames.sparkSession

    def kept(name: str, configs: tuple, build) -> DataFrame:
        return files.cached(spark, cache, name, configs, build, None) if cache else written(build(), name)

    series = kept("series", (tracking,), lambda: tracked_observations(frames, boxes, tracking))
    known = kept("attributes", (tracking, number, models.weights), lambda: attributes.predict_attributes(series, images, models, number, decode))
    columns = [F.col("tracker_id").alias("track_id"), F.col("track_id").alias("series_no"), "idx", "frame_idx", *Box._fields, "jersey", "entropy", "team"]
    after = splits.split_two_stage(known.select(*columns, "sequence_id", "role"), split, "series_no", ["sequence_id"])
    text = labels.label(F.col("track_id"), F.col("team"), F.col("jersey"), F.when(F.col("jersey").isNotNull(), F.col("entropy")))
    return after.select("sequence_id", "frame_idx", *Box._fields, "track_id", "parent_id", "jersey", "team", labels.known(F.col("role")).alias("role"), text.alias("label"))
