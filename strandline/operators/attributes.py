"""Attributes of observations: crops, outliers, legibility, numbers, teams; models are pluggable."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.config import NumberConfig
from strandline.functions.geometry import box, clamped, torso_box, torso_rows
from strandline.operators.rasters import cut_out, inner
from strandline.operators.series import back_filled
from strandline.operators.teams import team_clusters
from strandline.session import written


def batched(batches: Iterator[pd.Series], size: int) -> Iterator[pd.Series]:
    """The values of a series of batches in batches of ``size``, in order, over the ends of those that came; the last may be shorter."""
    waiting: list[pd.Series] = []
    have = 0
    for batch in batches:
        waiting.append(batch)
        have += len(batch)
        if have >= size:
            values = pd.concat(waiting, ignore_index=True) if len(waiting) > 1 else batch.reset_index(drop=True)
            whole = have - have % size
            for at in range(0, whole, size):
                yield values.iloc[at : at + size]
            waiting, have = [values.iloc[whole:]], have - whole
    if have:
        yield pd.concat(waiting, ignore_index=True)


def model(load: Callable[[], Callable[[pd.Series], pd.Series]], returns: str, size: int | None = None):
    """A column function that loads a model once per Python worker and scores batches with it.

    With ``size`` the model sees batches of so many values, whatever came from Spark: the values of a task are
    regrouped in order and only its last batch is shorter. Without, it sees Spark's batches. At most one of Spark's
    batches and one of the model's are held.
    """

    @F.pandas_udf(returns)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = load()
        for batch in batched(batches, size) if size else batches:
            yield score(batch)

    return scored


def person_crops(observations: DataFrame, width: int | Column, height: int | Column) -> DataFrame:
    """Observations with their whole-pixel box inside the image (``crop_*``); those without any are dropped."""
    inside = clamped(box(), *[x if isinstance(x, Column) else F.lit(x) for x in (width, height)])
    return observations.withColumns({f"crop_{n}": c for n, c in zip(box()._fields, inside)}).filter("crop_x1 is not null")


def torso_crops(crops: DataFrame, config: NumberConfig = NumberConfig()) -> DataFrame:
    """The torso box of each crop: from the pose, else the middle rows; crops with neither are dropped.

    ``crops`` has ``crop_w, crop_h`` and an array ``points`` of ``name, x, y, score``.
    """
    pads = (config.pad_left, config.pad_right, config.pad_top, config.pad_bottom)
    pose = torso_box(F.col("points"), F.col("crop_w"), F.col("crop_h"), pads, config.min_keypoint_score)
    top, end = torso_rows(F.col("crop_h"))
    plain = F.when((end > top) & (F.col("crop_w") > 0), F.struct(F.lit(0).alias("x1"), top.alias("y1"), F.col("crop_w").alias("x2"), end.alias("y2")))
    return crops.withColumn("from_pose", pose.isNotNull()).withColumn("torso", F.coalesce(pose, plain)).filter("torso is not null")


def without_outliers(series: DataFrame, k: float = 0.5, least: int = 3) -> DataFrame:
    """Rows whose embedding isn't further from its series' mean than ``k`` standard deviations above the mean distance.

    Series of fewer than ``least`` rows stay whole; a row without an embedding isn't judged and stays. Means are one vector
    for each series and task before the shuffle, and the statistics (one row per series) are joined back, so no
    series is gathered. Distances are written once, as they are read twice.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    means = series.filter("embedding is not null").groupBy("track_id").agg(Summarizer.mean(array_to_vector("embedding")).alias("m")).select("track_id", vector_to_array("m").alias("mean"))
    squares = F.zip_with("embedding", "mean", lambda a, b: (a - b) * (a - b))
    far = series.join(means, "track_id", "left").withColumn("distance", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x)))
    far = written(far.select(*series.columns, "distance"), "distances")
    stats = far.groupBy("track_id").agg(F.count("distance").alias("n"), F.avg("distance").alias("avg"), F.stddev_pop("distance").alias("std"))
    kept = far.join(stats, "track_id").filter(F.col("distance").isNull() | (F.col("n") < least) | (F.col("distance") - F.col("avg") <= F.col("std") * k))
    return kept.select(*series.columns, "distance")


def legible(crops: DataFrame, score: Column, threshold: float = 0.6) -> DataFrame:
    return crops.withColumn("legibility", score).filter(F.col("legibility") >= threshold)


def parsed_number(label: Column) -> Column:
    """The number 0 to 99 that a label holds, or null."""
    bare = F.trim(label)
    number = F.when(bare.rlike("^[0-9]+$"), bare.try_cast("int"))
    return F.when(number.between(0, 99), number)


def confidence(chars: Column) -> Column:
    """Mean of the characters' confidences without the closing one (if there is more than one)."""
    used = F.when(F.size(chars) > 1, F.slice(chars, 1, F.size(chars) - 1)).otherwise(chars)
    return F.try_divide(F.aggregate(used, F.lit(0.0), lambda a, x: a + x), F.size(used))


def entropy(p: Column) -> Column:
    return F.when(p > 0, -p * F.ln(p))


def number_readings(readings: DataFrame) -> DataFrame:
    """``jersey, confidence, entropy`` of labels and character confidences; an invalid label has null, 0 and 1."""
    number, sure = parsed_number(F.col("label")), confidence(F.col("char_confs"))
    return readings.withColumns({"jersey": number, "confidence": F.when(number.isNotNull(), sure).otherwise(0.0), "entropy": F.when(number.isNotNull(), entropy(sure)).otherwise(1.0)})


@dataclass(frozen=True)
class Models:
    """Column functions, e.g. from ``model``. A person is a struct of the crop's corners ``x1, y1, x2, y2`` in its image and
    its pixels, ``crop``, a raster; a torso one of the same corners (``person``), the torso's box in the crop (``box``) and
    the torso's pixels, ``crop``. Without ``pose`` the middle rows of a crop are its torso. ``weights`` names what the
    models were made of, e.g. hashes of their files: results are kept apart by it."""

    legibility: Callable[[Column], Column]
    read: Callable[[Column], Column]
    features: Callable[[Column], Column]
    pose: Callable[[Column], Column] | None = None
    weights: tuple[str, ...] = ()


CORNERS = ("x1", "y1", "x2", "y2")


def person_torsos(observations: DataFrame, images: DataFrame, pose: Callable[[Column], Column] | None = None, config: NumberConfig = NumberConfig(), decode: Callable | None = None) -> DataFrame:
    """``sequence_id, frame_idx, track_id, idx, person, torso`` of the observations that show something.

    ``images`` has ``sequence_id, frame_idx, width, height, image``: a raster, or bytes for ``decode``. Boxes are clamped
    on keys alone; then each image is decoded once and cut to them. ``person`` has the crop's corners and its pixels, the
    only ones that go on; ``torso`` is a box inside of them, whose pixels are cut when a model asks (``torso_of``).
    """
    keys, own = ["sequence_id", "frame_idx"], ["track_id", "idx"]
    placed = observations.select(*keys, *own, *CORNERS).join(images.select(*keys, "width", "height"), keys)
    boxes = person_crops(placed, F.col("width"), F.col("height"))
    places = [f"crop_{c}" for c in CORNERS]
    rows = cut_out(boxes, images, keys, [*own, *places], decode)
    person = F.struct(*[F.col(f"crop_{c}").alias(c) for c in CORNERS], "crop")
    rows = rows.select(*keys, *own, person.alias("person"), (F.col("crop_x2") - F.col("crop_x1")).alias("crop_w"), (F.col("crop_y2") - F.col("crop_y1")).alias("crop_h"))
    points = F.lit(None).cast("array<struct<name:string,x:double,y:double,score:double>>") if pose is None else pose(F.col("person"))
    return torso_crops(rows.withColumn("points", points), config).select(*keys, *own, "person", "torso")


def torso_of(person: Column, torso: Column) -> Column:
    """What a model sees of a torso: the person's corners, the torso's box in the crop, the pixels inside."""
    return F.struct(F.struct(*[person[c].alias(c) for c in CORNERS]).alias("person"), torso.alias("box"), inner(person["crop"], torso).alias("crop"))


def predict_numbers(observations: DataFrame, crops: DataFrame, legibility, read, config: NumberConfig = NumberConfig()) -> DataFrame:
    """The cascade: outlier filter, legibility, reading, back-fill. Observations without a reading have null, 0 and 1.

    ``observations`` has ``track_id, idx, embedding``, ``crops`` has ``track_id, idx, person, torso``; ``legibility`` maps a
    person to a score, ``read`` a torso to a struct ``label, char_confs`` (both column functions, e.g. from ``model``).
    The filter sees the observations that have a crop, by key and embedding; crops are joined with what it leaves, once.
    """
    keys = ["track_id", "idx"]
    if config.use_outlier_filter:
        looks = observations.select(*keys, "embedding").join(crops.select(*keys), keys, "left_semi")
        crops = crops.join(without_outliers(looks, config.outlier_std, config.outlier_min_samples).select(*keys), keys)
    if config.use_legibility:
        crops = legible(crops, legibility(F.col("person")), config.legibility_threshold)
    found = number_readings(crops.select(*keys, read(torso_of(F.col("person"), F.col("torso"))).alias("r")).select(*keys, "r.*"))
    return back_filled(observations, found.select(*keys, "jersey", "confidence", "entropy"))


def predict_attributes(observations: DataFrame, images: DataFrame, models: Models, config: NumberConfig = NumberConfig(), decode: Callable | None = None) -> DataFrame:
    """Observations with ``jersey, confidence, entropy, team``, in three phases.

    Crops are cut out and written once. Numbers are read from those that pass the outlier filter and are legible. Teams are
    clusters, within each sequence, of the features of all torsos, filtered or not. Then both go back to the observations:
    none has null, 0 and 1 for its number, and only players (``role``) have a team. ``track_id, idx`` is an observation.
    """
    shown = written(person_torsos(observations, images, models.pose, config, decode), "torsos")
    numbered = predict_numbers(observations, shown, models.legibility, models.read, config)
    keys = ["sequence_id", "track_id", "idx"]
    looks = shown.select(*keys, models.features(torso_of(F.col("person"), F.col("torso"))).alias("embedding"))
    teams = team_clusters(looks.join(observations.select(*keys, "role"), keys))
    return numbered.join(teams.filter("team is not null"), keys, "left")
