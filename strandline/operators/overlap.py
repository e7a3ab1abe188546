"""Spatial joins of boxes inside frames, association costs and matchings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.geometry import Box, box, iou, iou_inclusive

#: 95 percent quantiles of the chi-square distribution by degrees of freedom (fixed values).
CHI2_95 = {1: 3.8415, 2: 5.9915, 3: 7.8147, 4: 9.4877, 5: 11.070, 6: 12.592, 7: 14.067, 8: 15.507, 9: 16.919}


def prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


def box_pairs(left: DataFrame, right: DataFrame, measure: Callable[[Box, Box], Column], name: str, least: float = 0.0, keys: list[str] = ("frame_idx",)) -> DataFrame:
    """Pairs of a left and a right box of one frame with a measure above ``least``; columns get prefixes ``l_, r_``.

    Pairs stay inside a frame, whose boxes are few; the measure is part of the join.
    """
    keys = list(keys)
    pairs = prefixed(left, "l_", keys).join(prefixed(right, "r_", keys), keys)
    return pairs.withColumn(name, measure(box("l_"), box("r_"))).filter(F.col(name) > least)


def best_overlap(tracks: DataFrame, detections: DataFrame, carry: list[str], least: float = 0.5, keys: list[str] = ("frame_idx",)) -> DataFrame:
    """Each track box with the detection that overlaps it most, if that is more than ``least``; else nulls.

    Of equal overlaps the smallest ``det_idx`` wins. One left join inside the frames serves class, ground truth
    and embeddings (``carry``), and the best one is an aggregate that needs no further shuffle. ``trk_idx`` is
    unique in a frame.
    """
    keys = list(keys)
    right = detections.select(*[F.col(k).alias("k_" + k) for k in keys], F.col("det_idx").alias("c_det_idx"), *[F.col(c).alias("r_" + c) for c in Box._fields], *[F.col(c).alias("c_" + c) for c in carry])
    measure = iou(box(), box("r_"))
    near = tracks.join(right, [*[F.col(k) == F.col("k_" + k) for k in keys], measure > least], "left").withColumn("c_iou", measure)
    payload = F.struct(*[F.col("c_" + c).alias(c) for c in ("det_idx", "iou", *carry)])
    own = [c for c in tracks.columns if c not in (*keys, "trk_idx")]
    best = near.groupBy(*keys, "trk_idx").agg(*[F.any_value(c).alias(c) for c in own], F.max_by(payload, F.when(F.col("c_det_idx").isNotNull(), F.struct("c_iou", -F.col("c_det_idx")))).alias("best"))
    return best.select(*tracks.columns, "best.*")


def transferred(tracks: DataFrame, detections: DataFrame) -> DataFrame:
    """Class and ground truth of the best overlapping detection; class 0 and nulls without one."""
    out = best_overlap(tracks, detections, ["category_id", "gt_track_id", "jersey"])
    return out.select("frame_idx", "trk_idx", F.coalesce("category_id", F.lit(0)).alias("class_id"), "gt_track_id", F.col("jersey").alias("gt_jersey"))


def last_embeddings(tracks: DataFrame, detections: DataFrame, size: int) -> DataFrame:
    """The embedding of the best overlapping detection, or zeros."""
    zeros = F.array_repeat(F.lit(0.0), size)
    return best_overlap(tracks, detections, ["embedding"]).withColumn("embedding", F.coalesce("embedding", zeros))


def score_bucket(score: Column, low: float = 0.3, high: float = 0.6) -> Column:
    """'high' above ``high``, 'low' strictly between; a score equal to a threshold is in neither."""
    return F.when(score > high, "high").when((score > low) & (score < high), "low")


def fused_cost(overlap_distance: Column, cosine: Column, appearance_thresh: float = 0.2, proximity_thresh: float = 0.5) -> Column:
    """The smaller of overlap distance and half the cosine distance, which counts only for similar near boxes."""
    half = cosine / 2
    looks = F.when((half > appearance_thresh) | (overlap_distance > proximity_thresh) | half.isNull(), 1.0).otherwise(half)
    return F.least(overlap_distance, looks)


def fused_with_overlap(cost: Column, overlap_distance: Column) -> Column:
    return 1 - (1 - cost) * (1 + (1 - overlap_distance)) / 2


def fused_with_score(cost: Column, score: Column) -> Column:
    return 1 - (1 - cost) * score


def gated(cost: Column, distance: Column, dof: int = 4) -> Column:
    """The cost where the squared distance is within the 95 percent gate, else infinity."""
    return F.when(distance > CHI2_95[dof], F.lit(float("inf"))).otherwise(cost)


def fused_with_motion(cost: Column, distance: Column, weight: float = 0.98, dof: int = 4) -> Column:
    return gated(cost, distance, dof) * weight + distance * (1 - weight)


def suppressed(tracked: DataFrame, lost: DataFrame, limit: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """Both sides without near-equal boxes of the other: the younger goes, of equal ages the tracked one."""
    close = box_pairs(tracked, lost, lambda a, b: 1 - iou_inclusive(a, b), "distance", -1.0).filter(F.col("distance") < limit)
    older = F.col("l_age") > F.col("r_age")
    drop_lost = close.filter(older).select("frame_idx", F.col("r_id").alias("id")).distinct()
    drop_tracked = close.filter(~older).select("frame_idx", F.col("l_id").alias("id")).distinct()
    return tracked.join(drop_tracked, ["frame_idx", "id"], "left_anti"), lost.join(drop_lost, ["frame_idx", "id"], "left_anti")


def ordered_union(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All rows by key, those of ``first`` before those of ``second``."""
    every = first.withColumn("_from", F.lit(0)).unionByName(second.withColumn("_from", F.lit(1)))
    rest = [c for c in first.columns if c != key]
    return every.groupBy(key).agg(F.min_by(F.struct(*rest), "_from").alias("r")).select(key, "r.*")


def difference(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    return first.join(second.select(key).distinct(), key, "left_anti")


def composed(first: DataFrame, second: DataFrame) -> DataFrame:
    """Matchings ``frame_idx, a, b`` and ``frame_idx, b, c`` as one of ``a`` and ``c``."""
    return first.join(second, ["frame_idx", "b"]).select("frame_idx", "a", "c")


def unmatched(first: DataFrame, second: DataFrame, rows: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a composed matching leaves: the rows ``frame_idx, a`` and the columns ``frame_idx, c`` without a partner."""
    pairs = composed(first, second)
    return rows.join(pairs, ["frame_idx", "a"], "left_anti"), columns.join(pairs, ["frame_idx", "c"], "left_anti")


def within_limit(matches: DataFrame, rows: DataFrame, columns: DataFrame, limit: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matches ``frame_idx, a, b, cost`` of at most ``limit``, then the rows ``frame_idx, a`` and columns ``frame_idx, b`` they leave."""
    kept = matches.filter(F.col("cost") <= limit)
    return kept, rows.join(kept, ["frame_idx", "a"], "left_anti"), columns.join(kept, ["frame_idx", "b"], "left_anti")
