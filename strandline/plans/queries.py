"""Registered queries over the driver tables, one per operator. Their SQL is in ``strandline.plans.oracle``."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.config import SplitConfig
from strandline.functions import geometry as g
from strandline.functions import vectors
from strandline.operators import assignment, attributes, labels, motion, overlap, prediction, rasters, series, splits, teams, tracker
from strandline.plans import trajectories
from strandline.plans.oracle import ORACLE
from strandline.sources import adapters as src
from strandline.sources import files
from strandline.streaming import online

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(c, name: str):
    return F.round(c, 6).alias(name)


@query
def scan_category_filter(spark, sf_dir):
    return src.detections(spark, sf_dir).filter(F.col("category_id").isin(1, 2, 3)).select("frame_idx", "det_idx", "gt_track_id", "category_id", "jersey")


@query
def xywh_to_xyxy(spark, sf_dir):
    b = g.xywh_to_xyxy(*g.tlwh(g.box()))
    return src.detections(spark, sf_dir).select("frame_idx", "det_idx", *[c.alias(n) for c, n in zip(b, g.Box._fields)])


@query
def box_conversions(spark, sf_dir):
    b = g.box()
    named = zip((*g.tlwh(b)[2:], *g.center_size(b)[:2], g.center_aspect(b)[2], *g.scaled(b)), ("w", "h", "cx", "cy", "aspect", "sx1", "sy1", "sx2", "sy2"))
    return src.detections(spark, sf_dir).select("frame_idx", "det_idx", *[rounded(c, n) for c, n in named])


@query
def frame_index(spark, sf_dir):
    frames = src.detections(spark, sf_dir).select(F.expr("frame_idx div 100").alias("sequence_id"), "frame_idx").distinct()
    return series.positions(frames, "sequence_id", "frame_idx").select("sequence_id", "frame_idx", "idx")


@query
def frame_left_join_annotations(spark, sf_dir):
    det = src.detections(spark, sf_dir)
    boxes = det.filter(F.col("category_id").isin(2, 3)).select("frame_idx", "det_idx", "category_id")
    return det.select("frame_idx").distinct().join(boxes, "frame_idx", "left")


@query
def score_buckets(spark, sf_dir):
    return src.detections(spark, sf_dir).select("frame_idx", "det_idx", overlap.score_bucket(F.col("score")).alias("bucket"), (F.col("score") >= 0.4).alias("may_start"))


def _pairs(spark, sf_dir, measure, name):
    left, right = src.tracks(spark, sf_dir), src.detections(spark, sf_dir).select("frame_idx", "det_idx", "x1", "y1", "x2", "y2", "score")
    return overlap.box_pairs(left, right, measure, name).select("frame_idx", F.col("l_trk_idx").alias("trk_idx"), F.col("r_det_idx").alias("det_idx"), F.col("r_score").alias("score"), name)


@query
def iou_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir, g.iou, "iou").select("frame_idx", "trk_idx", "det_idx", rounded("iou", "iou"))


@query
def iou_pairs_inclusive(spark, sf_dir):
    return _pairs(spark, sf_dir, g.iou_inclusive, "iou").select("frame_idx", "trk_idx", "det_idx", rounded("iou", "iou"))


@query
def expanded_iou_pairs(spark, sf_dir):
    found = _pairs(spark, sf_dir, lambda a, b: g.iou_inclusive(g.expanded(a, 0.7), g.expanded(b, 0.7)), "iou")
    return found.select("frame_idx", "trk_idx", "det_idx", rounded("iou", "iou"))


@query
def best_overlap_match(spark, sf_dir):
    found = overlap.best_overlap(src.tracks(spark, sf_dir), src.detections(spark, sf_dir), [])
    return found.select("frame_idx", "trk_idx", "det_idx", rounded("iou", "iou"))


@query
def attribute_transfer(spark, sf_dir):
    return overlap.transferred(src.tracks(spark, sf_dir), src.detections(spark, sf_dir))


@query
def embedding_cosine_pairs(spark, sf_dir):
    emb = src.appearance(spark, sf_dir).select("track_id", "idx", "embedding")
    after = emb.select("track_id", (F.col("idx") - 1).alias("idx"), F.col("embedding").alias("next"))
    return emb.join(after, ["track_id", "idx"]).select("track_id", "idx", rounded(vectors.cosine_distance(F.col("embedding"), F.col("next")), "distance"))


def _costs(spark, sf_dir):
    pairs = _pairs(spark, sf_dir, g.iou_inclusive, "iou").withColumn("distance", 1 - F.col("iou"))
    return pairs.withColumn("cosine", F.abs(F.col("trk_idx") - F.col("det_idx")).cast("double") / 10)


@query
def fused_cost(spark, sf_dir):
    return _costs(spark, sf_dir).select("frame_idx", "trk_idx", "det_idx", rounded(overlap.fused_cost(F.col("distance"), F.col("cosine")), "cost"))


@query
def fuse_iou(spark, sf_dir):
    return _costs(spark, sf_dir).select("frame_idx", "trk_idx", "det_idx", rounded(overlap.fused_with_overlap(F.col("cosine"), F.col("distance")), "cost"))


@query
def fuse_score(spark, sf_dir):
    return _costs(spark, sf_dir).select("frame_idx", "trk_idx", "det_idx", rounded(overlap.fused_with_score(F.col("distance"), F.col("score")), "cost"))


@query
def duplicate_suppression(spark, sf_dir):
    boxes = ("x1", "y1", "x2", "y2")
    tracked = src.tracks(spark, sf_dir).select("frame_idx", F.col("trk_idx").alias("id"), *boxes, (F.col("trk_idx") * 7 % 5).alias("age"))
    lost = src.detections(spark, sf_dir).select("frame_idx", F.col("det_idx").alias("id"), *boxes, (F.col("det_idx") * 3 % 5).alias("age"))
    sides = overlap.suppressed(tracked, lost)
    return sides[0].select(F.lit("tracked").alias("side"), "frame_idx", "id").unionByName(sides[1].select(F.lit("lost").alias("side"), "frame_idx", "id"))


def _keyed(spark, sf_dir):
    det = src.detections(spark, sf_dir).withColumn("id", F.col("frame_idx") * 10 + F.col("det_idx"))
    return det.filter(F.col("category_id") < 3).select("id", F.lit("a").alias("side")), det.filter(F.col("score") > 0.5).select("id", F.lit("b").alias("side"))


@query
def ordered_union(spark, sf_dir):
    return overlap.ordered_union(*_keyed(spark, sf_dir), "id")


@query
def anti_difference(spark, sf_dir):
    return overlap.difference(*_keyed(spark, sf_dir), "id")


@query
def compose_matches(spark, sf_dir):
    det = src.detections(spark, sf_dir)
    first = overlap.best_overlap(src.tracks(spark, sf_dir), det, []).filter("det_idx is not null").select("frame_idx", F.col("trk_idx").alias("a"), F.col("det_idx").alias("b"))
    return overlap.composed(first, det.select("frame_idx", F.col("det_idx").alias("b"), F.col("gt_track_id").alias("c")))


@query
def optimal_assignment(spark, sf_dir):
    pairs = _costs(spark, sf_dir).select("frame_idx", F.col("trk_idx").alias("a"), F.col("det_idx").alias("b"), F.col("distance").alias("cost"))
    return assignment.assigned(pairs, 0.8).select("frame_idx", "a", "b", rounded("cost", "cost"))


def _sequences(det):
    return det.filter(F.col("category_id").isin(1, 2, 3)).withColumn("sequence_id", F.expr("frame_idx div 100"))


@query
def tracker_batch(spark, sf_dir):
    return tracker.tracked(_sequences(src.detections(spark, sf_dir)))


@query
def track_intervals(spark, sf_dir):
    """When each track was tracked and lost, and why it went."""
    return tracker.intervals(tracker.tracked(_sequences(src.detections(spark, sf_dir)), life=True))


def _event_stream(spark, sf_dir):
    """The events as a file stream; a stream takes single files only by a pattern."""
    schema = src.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


@query
def tracker_stream(spark, sf_dir):
    events = _event_stream(spark, sf_dir)
    return online.drained(online.tracked_stream(_sequences(events.selectExpr(*src._columns(src._DET, src.SPARK)))), "tracked")


@query
def sequence_sessions_stream(spark, sf_dir):
    """Sessions that are over for good: they ended an hour or more before the last event."""
    own = online.drained(online.sessions(_event_stream(spark, sf_dir)), "sessions")
    return own.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n_events", rounded("total", "total"))


@query
def annotation_reader(spark, sf_dir):
    """Annotation files, written from the detections, through the reader."""
    boxes = files.annotated_boxes(files.read_annotations(spark, f"{src.annotation_files(spark, sf_dir)}/*"))
    return boxes.select("filename", "x1", "y1", "x2", "y2", "score", "class_id", "gt_track_id", "gt_jersey", "gt_team", "gt_role")


def _stand_ins():
    """Models as expressions over a crop's place, for data without images."""

    def read(torso):
        return F.struct(((torso["person"]["x1"] / 180).cast("int") % 3).cast("string").alias("label"), F.array(F.lit(0.98), F.lit(0.9)).alias("char_confs"))

    def features(torso):
        side = F.when(torso["person"]["y1"] % 2 == 0, 50.0).otherwise(0.0)
        return F.array(*[(torso["person"]["x1"] * (k + 1) % 11 + side).cast("double") for k in range(4)])

    return attributes.Models(legibility=lambda person: F.when(person["y1"] % 5 == 0, 0.2).otherwise(0.9), read=read, features=features)


@query
def end_to_end(spark, sf_dir):
    """Annotation files to labelled frames: tracking, attributes in three phases, both splits, labels."""
    docs = files.read_annotations(spark, f"{src.annotation_files(spark, sf_dir)}/*")
    frames = files.listed_frames(docs)
    boxes = files.annotated_boxes(docs).withColumn("embedding", F.array(*[F.sin(F.col("gt_track_id") * (k + 1)) for k in range(8)]))
    images = frames.select("sequence_id", "frame_idx", F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.lit(None).cast(rasters.RASTER).alias("image"))
    return trajectories.labelled_frames(frames, boxes, images, _stand_ins())


@query
def kalman_filter_series(spark, sf_dir):
    out = motion.filtered_series(src.observations(spark, sf_dir))
    return out.select("track_id", "idx", *[rounded(c, c) for c in ("cx", "cy", "w", "h", "vx", "vy")])


@query
def gating_distance(spark, sf_dir):
    return motion.filtered_series(src.observations(spark, sf_dir)).select("track_id", "idx", rounded("gate", "gate"))


@query
def motion_fused_cost(spark, sf_dir):
    out = motion.filtered_series(src.observations(spark, sf_dir)).filter("gate is not null")
    cost = overlap.fused_with_motion(F.lit(0.5), F.col("gate"))
    return out.select("track_id", "idx", rounded(F.when(cost == float("inf"), -1.0).otherwise(cost), "cost"))


@query
def predicted_overlap(spark, sf_dir):
    """How far each track is from where the filter expects it, seen in the frames whose number could be read."""
    obs = src.observations(spark, sf_dir).withColumn("frame_idx", F.col("idx"))
    expected = prediction.predicted_boxes(obs.filter("jersey is not null"), ahead=0)
    found = prediction.predicted_distance(expected, obs.select("track_id", "frame_idx", "x1", "y1", "x2", "y2"), keys=["track_id", "frame_idx"])
    return found.select("track_id", F.col("frame_idx").cast("int").alias("idx"), F.col("l_seen").alias("seen"), rounded("distance", "distance"))


@query
def camera_warp(spark, sf_dir):
    """Predicted boxes under a camera that moves and zooms, differently in every frame."""
    obs = src.observations(spark, sf_dir).withColumn("frame_idx", F.col("idx"))
    frame, zero = F.col("frame_idx") % 7, F.lit(0.0)
    warp = F.array(1 + frame / 100, zero, frame - 3.0, zero, 1 - frame / 200, F.lit(2.0))
    cameras = obs.select("frame_idx").distinct().withColumn("warp", warp)
    expected = prediction.predicted_boxes(obs.filter("jersey is not null"), ahead=0, cameras=cameras)
    return expected.select("track_id", F.col("frame_idx").cast("int").alias("idx"), "seen", *[rounded(c, c) for c in ("x1", "y1", "x2", "y2")])


@query
def ema_embedding(spark, sf_dir):
    out = motion.smoothed(src.appearance(spark, sf_dir))
    return out.select("track_id", "idx", rounded(F.col("feature")[0], "f0"), rounded(F.col("feature")[63], "f63"))


@query
def series_collect(spark, sf_dir):
    wide = series.collected(src.observations(spark, sf_dir), ["frame_idx", "jersey"])
    return wide.select("track_id", F.size("series").alias("n"), F.array_join(F.transform("series", lambda s: s["frame_idx"].cast("string")), ",").alias("frames"))


@query
def series_slice(spark, sf_dir):
    return series.sliced(src.observations(spark, sf_dir), 5, 20).select("track_id", "idx", "frame_idx", "jersey")


@query
def frame_regroup(spark, sf_dir):
    obs = src.observations(spark, sf_dir).withColumn("frame_idx", F.expr("frame_idx div 10"))
    out = series.regrouped(obs, ["jersey"])
    return out.select("frame_idx", F.size("objects").alias("n"), F.array_join(F.transform("objects", lambda o: o["track_id"].cast("string")), ",").alias("tracks"))


@query
def frame_labels(spark, sf_dir):
    text = labels.label(F.col("track_id"), F.col("team"), F.col("jersey"), F.when(F.col("jersey").isNotNull(), F.col("entropy")))
    return src.observations(spark, sf_dir).select("track_id", "idx", labels.known(F.col("role")).alias("role"), text.alias("label"), labels.crop_name(F.col("track_id"), F.col("frame_idx"), F.col("jersey")).alias("crop_name"))


@query
def centroid_outlier_filter(spark, sf_dir):
    return attributes.without_outliers(src.appearance(spark, sf_dir)).select("track_id", "idx", rounded("distance", "distance"))


@query
def model_heads(spark, sf_dir):
    """What stands behind a model: a logit's probability, probabilities of classes, the mean of token vectors."""
    e = F.col("embedding")
    tokens = F.array(F.slice(e, 1, 8), F.slice(e, 9, 8))
    heads = {"legible": vectors.sigmoid(e[0]), "first_class": vectors.softmax(F.slice(e, 1, 4))[0], "mean_3": vectors.mean_vector(tokens)[3]}
    return src.appearance(spark, sf_dir).select("track_id", "idx", *[rounded(c, n) for n, c in heads.items()])


@query
def ocr_parse(spark, sf_dir):
    return src.readings(spark, sf_dir).select("track_id", "frame_idx", attributes.parsed_number(F.col("label")).alias("jersey"))


@query
def confidence_entropy(spark, sf_dir):
    return attributes.number_readings(src.readings(spark, sf_dir)).select("track_id", "frame_idx", rounded("confidence", "confidence"), rounded("entropy", "entropy"))


@query
def dense_backfill(spark, sf_dir):
    """Gaps come from the cascade: readings whose first character is uncertain count as illegible."""
    readings = attributes.legible(src.readings(spark, sf_dir), F.col("char_confs")[0])
    found = attributes.number_readings(readings).withColumnRenamed("frame_idx", "frame")
    obs = src.observations(spark, sf_dir).select("track_id", "idx", "frame_idx")
    at = found.join(obs, (obs["track_id"] == found["track_id"]) & (obs["frame_idx"] == found["frame"])).select(obs["track_id"], "idx", "jersey", "confidence", "entropy")
    return series.back_filled(obs, at).select("track_id", "idx", "jersey", rounded("confidence", "confidence"), rounded("entropy", "entropy"))


def _points():
    return F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{n}_x").alias("x"), F.col(f"{n}_y").alias("y"), F.col(f"{n}_s").alias("score")) for n in ("ls", "rs", "lh", "rh")])


@query
def torso_box_pose(spark, sf_dir):
    torso = g.torso_box(_points(), F.col("crop_w"), F.col("crop_h"))
    return src.poses(spark, sf_dir).withColumn("t", torso).select("crop_id", "t.*")


@query
def torso_box_heuristic(spark, sf_dir):
    return attributes.torso_crops(src.poses(spark, sf_dir).withColumn("points", _points())).select("crop_id", "from_pose", "torso.*")


@query
def crop_clamp(spark, sf_dir):
    return attributes.person_crops(src.detections(spark, sf_dir), 1280, 720).select("frame_idx", "det_idx", "crop_x1", "crop_y1", "crop_x2", "crop_y2")


@query
def systematic_sample(spark, sf_dir):
    return series.sampled(src.observations(spark, sf_dir).select("track_id", "idx", "frame_idx"), "track_id")


def _series(spark, sf_dir):
    return splits.as_series(src.observations(spark, sf_dir).select("track_id", "idx", "frame_idx", "x1", "y1", "x2", "y2", "jersey", "entropy", "team"))


@query
def number_persistence(spark, sf_dir):
    return splits.number_persistence(_series(spark, sf_dir)).select("track_id", "idx", "jersey")


@query
def number_switches(spark, sf_dir):
    return splits.switches(splits.number_persistence(_series(spark, sf_dir)), "jersey")


@query
def refined_switches(spark, sf_dir):
    return splits.number_cuts(_series(spark, sf_dir)).select("track_id", "idx", F.col("cut").alias("refined_idx"))


@query
def number_fragments(spark, sf_dir):
    own = _series(spark, sf_dir)
    return splits.pieces(splits.lengths(own, splits.TRACK), splits.number_cuts(own), SplitConfig().number_min_fragment, splits.TRACK).select("track_id", "frag_no", "start_idx", "end_idx")


@query
def number_split_ids(spark, sf_dir):
    return splits.split_by_number(_series(spark, sf_dir)).groupBy("parent_id", "track_id").agg(F.count(F.lit(1)).alias("n"), F.min("frame_idx").alias("first_frame"))


@query
def team_persistence(spark, sf_dir):
    return splits.team_persistence(_series(spark, sf_dir)).select("track_id", "idx", "team")


@query
def team_switches(spark, sf_dir):
    return splits.switches(splits.team_persistence(_series(spark, sf_dir)), "team")


@query
def team_fragments(spark, sf_dir):
    own = _series(spark, sf_dir)
    return splits.pieces(splits.lengths(own, splits.TRACK), splits.team_cuts(own), SplitConfig().team_min_fragment, splits.TRACK).select("track_id", "frag_no", "start_idx", "end_idx")


@query
def split_two_stage(spark, sf_dir):
    own = src.observations(spark, sf_dir).select("track_id", "idx", "frame_idx", "x1", "y1", "x2", "y2", "jersey", "entropy", "team")
    return splits.split_two_stage(own).select("parent_id", "track_id", "idx", "frame_idx", "jersey", "team")


@query
def split_summary(spark, sf_dir):
    own = _series(spark, sf_dir)
    return splits.split_summary(own, splits.split_by_number(own))


def _looks(spark, sf_dir):
    """Embeddings of two sequences, players and referees."""
    emb = src.appearance(spark, sf_dir).withColumn("role", F.when(F.col("idx") % 12 == 11, "referee").otherwise("player"))
    return emb.withColumn("sequence_id", F.col("track_id") % 2)


@query
def team_clustering(spark, sf_dir):
    return teams.team_clusters(_looks(spark, sf_dir))


@query
def team_rounds(spark, sf_dir):
    """Teams of each sequence after three rounds from the looks of its first and last player."""
    looks = _looks(spark, sf_dir)
    at = F.struct("track_id", "idx")
    ends = looks.filter("role = 'player'").groupBy("sequence_id").agg(F.array(F.min_by("embedding", at), F.max_by("embedding", at)).alias("centres"))
    return teams.teams_from(looks, ends, 3)


@query
def path_rank(spark, sf_dir):
    """Places of names in their sequence, by the names alone: no window over a whole sequence."""
    det = src.detections(spark, sf_dir)
    names = det.select(F.expr("frame_idx div 100").alias("sequence_id"), F.format_string("%s/f%03d.jpg", F.md5(F.col("det_idx").cast("string")), F.expr("frame_idx % 100")).alias("path"))
    return series.ranked(names, ["sequence_id"], [F.col("path")], "frame_idx")
