"""Reading annotation files and frame folders, and tables keyed by the settings that made them."""

from __future__ import annotations

import hashlib
import mmap
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.config import fingerprint
from strandline.functions.geometry import xywh_to_xyxy
from strandline.operators.series import ranked
from strandline.session import exists, own_folder

ANNOTATIONS = """images array<struct<image_id string, file_name string>>,
annotations array<struct<image_id string, category_id int, track_id long, bbox_image struct<x double, y double, w double, h double>,
attributes struct<jersey string, team string, role string>>>"""
PERSONS = (1, 2, 3)
_SHIPPED: set[tuple[str, str]] = set()


def frames(spark: SparkSession, folder: str, suffix: str = "jpg", content: bool = False) -> DataFrame:
    """``sequence_id, frame_idx, filename, path`` of the frames below ``folder``, one sequence per folder, in path order.

    With ``content`` the bytes come along, for a decoder in a later ``mapInArrow``; without, files are only listed.
    A folder's paths are ranked over ranges of paths, so a folder with a third of all frames isn't one task's work;
    bytes don't take part.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", "true").load(folder)
    named = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("sequence_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "path")
    placed = ranked(named, ["sequence_id"], [F.col("path")], "frame_idx")
    return placed.join(files.select("path", "content"), "path") if content else placed


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation documents (one JSON object per file) with a fixed schema and their ``sequence_id`` (the file's folder)."""
    docs = spark.read.schema(ANNOTATIONS).json(path, multiLine=True)
    return docs.withColumn("sequence_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def listed_frames(documents: DataFrame) -> DataFrame:
    """``sequence_id, frame_idx, filename`` of the images that annotation documents list, in the order of their names."""
    names = F.array_sort(F.transform("images", lambda i: i["file_name"]))
    return documents.select("sequence_id", F.posexplode(names).alias("frame_idx", "filename")).withColumn("frame_idx", F.col("frame_idx").cast("long"))


def annotated_boxes(documents: DataFrame, strict: bool = True) -> DataFrame:
    """Flat detections of annotation documents: persons only, corner boxes, score 1, missing attributes null.

    The image list is a map inside the document, so names are looked up without a shuffle. An annotation of
    an unlisted image stops the query if ``strict``, else it is left out.
    """
    named = documents.withColumn("names", F.map_from_entries(F.transform("images", lambda i: F.struct(i["image_id"], i["file_name"]))))
    persons = F.filter("annotations", lambda a: a["category_id"].isin(*PERSONS))
    rows = named.select("sequence_id", "names", F.posexplode(persons).alias("det_idx", "a"))
    filename = F.try_element_at("names", F.col("a.image_id"))
    if strict:
        filename = F.coalesce(filename, F.raise_error(F.concat(F.lit("annotation of unlisted image "), F.coalesce("a.image_id", F.lit("null")))).cast("string"))
    box = xywh_to_xyxy(*[F.col(f"a.bbox_image.{c}") for c in "xywh"])
    out = rows.select(
        "sequence_id",
        filename.alias("filename"),
        "det_idx",
        *[c.alias(n) for c, n in zip(box, ("x1", "y1", "x2", "y2"))],
        F.lit(1.0).alias("score"),
        F.col("a.category_id").alias("class_id"),
        F.coalesce("a.track_id", F.lit(-1)).alias("gt_track_id"),
        *[F.col(f"a.attributes.{c}").alias(f"gt_{c}") for c in ("jersey", "team", "role")],
    )
    return out.filter("filename is not null")


def frame_detections(frame_list: DataFrame, boxes: DataFrame) -> DataFrame:
    """Every frame with its boxes; frames without any have nulls, boxes of absent frames are dropped."""
    return frame_list.join(boxes, ["sequence_id", "filename"], "left")


@dataclass(frozen=True)
class Artefact:
    """A file that every executor has, named by its content: ``name`` starts with its SHA-256 and is fit for cache keys."""

    name: str

    def open(self) -> mmap.mmap | bytes:
        """Its content in a worker, mapped: the workers of an executor share the pages of one copy."""
        with open(SparkFiles.get(self.name), "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if os.fstat(f.fileno()).st_size else b""


def artefact(spark: SparkSession, path: str) -> Artefact:
    """Ship a file, e.g. a model's weights, from any path that Spark's file systems know. Equal content is shipped once."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    local = os.path.join(own_folder(), uuid.uuid4().hex)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).copyToLocalFile(at, spark._jvm.org.apache.hadoop.fs.Path(f"file://{local}"))
    with open(local, "rb") as f:
        digest = hashlib.file_digest(f, "sha256").hexdigest()
    name = digest + os.path.splitext(path)[1]
    named = os.path.join(own_folder(), name)
    os.replace(local, named)
    if (spark.sparkContext.applicationId, name) not in _SHIPPED:
        _SHIPPED.add((spark.sparkContext.applicationId, name))
        spark.sparkContext.addFile(named)
    return Artefact(name)


def cached(spark: SparkSession, folder: str, name: str, configs: tuple, build: Callable[[], DataFrame], partition_by: str | None = "sequence_id") -> DataFrame:
    """The table ``name`` made with ``configs``: read if it was written to its end, else built and written. Other settings are another path.

    A partition column comes back with the type that its values look like; None keeps all columns as they are.
    """
    path = f"{folder.rstrip('/')}/{name}-{fingerprint(*configs)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").partitionBy(*[c for c in (partition_by,) if c]).parquet(path)
    return spark.read.parquet(path)
