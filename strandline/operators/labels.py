"""What is shown of observations: labels, object documents and file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.rasters import as_png
from strandline.operators.series import positions, sampled
from strandline.sources import sinks


def significant(value: Column, digits: int = 4) -> Column:
    """A number with so many significant digits and no trailing zeros, as ``%g`` writes it, a negative zero with its sign; decimal ties go up."""
    text = F.format_string(f"%.{digits - 1}e", value.cast("double"))
    mantissa, power = F.get(F.split(text, "e"), F.lit(0)), F.get(F.split(text, "e"), F.lit(1)).cast("int")
    trimmed = F.regexp_replace(F.regexp_replace(mantissa, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    scientific = F.concat(trimmed, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    fixed = F.coalesce(*[F.when(power == p, F.format_string(f"%.{digits - 1 - p}f", value.cast("double"))) for p in range(-4, digits)])
    plain = F.when(fixed.contains("."), F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", "")).otherwise(fixed)
    return F.when(value == 0, F.format_string("%.0f", value.cast("double"))).when((power < -4) | (power >= digits), scientific).otherwise(plain)


def shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("X"))


def label(track: Column, team: Column, number: Column, entropy: Column) -> Column:
    """``track|team|number:entropy`` with X for what is missing."""
    return F.concat(track.cast("string"), F.lit("|"), shown(team), F.lit("|"), shown(number), F.lit(":"), F.coalesce(significant(entropy), F.lit("X")))


def known(value: Column) -> Column:
    """Null for empty and unknown attribute values."""
    return F.when((value != "") & (value != "unknown"), value)


def documents(series: DataFrame) -> DataFrame:
    """``track_id`` and one JSON object of ids and predicted attributes per observation."""
    return series.select("track_id", "idx", F.to_json(F.struct(*series.columns)).alias("json"))


def crop_name(track: Column, frame: Column, truth: Column) -> Column:
    return F.format_string("track%04d_frame%05d_gt%s.jpg", track, frame, F.coalesce(truth.cast("string"), F.lit("None")))


def write_frames(labelled: DataFrame, path: str) -> None:
    """Boxes and labels as Parquet, partitioned by sequence, for whatever draws them."""
    labelled.write.partitionBy("sequence_id").parquet(path)


def draw_frames(labelled: DataFrame, path: str, width: int = 1920, height: int = 1080, rate: int = 25) -> None:
    """One drawing ``<sequence_id>.svg`` per sequence below ``path``: its frames in order, boxes and labels as vectors.

    ``labelled`` has ``sequence_id, frame_idx, x1, y1, x2, y2, label``; a null box stands for a frame without any. A sequence is
    one object, so one task writes it, frame by frame; sequences are written in parallel. See ``sinks``.
    """
    spark = labelled.sparkSession
    spark.dataSource.register(sinks.Drawings)
    rows = labelled.select(F.col("sequence_id").cast("string"), F.col("frame_idx").cast("long"), *[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")], "label")
    dealt = rows.repartition("sequence_id").sortWithinPartitions("sequence_id", "frame_idx", "label")
    dealt.write.format("strandline_drawings").mode("append").option("width", width).option("height", height).option("rate", rate).save(path)


def save_crops(crops: DataFrame, path: str, most: int = 10) -> None:
    """At most ``most`` crops of each series as PNG files below ``path``, named by series, frame and truth.

    ``crops`` has ``track_id, idx, frame_idx, truth`` and ``crop``, a raster; the sample is systematic (``sampled``) over
    the crops there are, and only sampled ones are encoded. A crop without pixels isn't written.
    """
    spark = crops.sparkSession
    spark.dataSource.register(sinks.Files)
    keys = crops.select("track_id", "idx").withColumnRenamed("idx", "place")
    chosen = sampled(positions(keys, "track_id", "place"), "track_id", most).select("track_id", F.col("place").alias("idx"))
    name = F.regexp_replace(crop_name(F.col("track_id"), F.col("frame_idx"), F.col("truth")), r"\.jpg$", ".png")
    files = crops.join(chosen, ["track_id", "idx"]).select(name.alias("name"), as_png(F.col("crop")).alias("content")).filter("content is not null")
    files.write.format("strandline_files").mode("append").save(path)
