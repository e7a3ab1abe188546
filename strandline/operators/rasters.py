"""Pixels: images as rasters, cut to boxes once.

A raster is a struct ``height, width, channels, data``; ``data`` holds the rows from the top, each pixel's channels
together. An image is decoded once, in the task that has all of its boxes; from there only crops go on, and
whatever needs no pixels works on keys.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RASTER = "struct<height:int,width:int,channels:int,data:binary>"
_KIND = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())])

#: Bytes of crops that a task hands on together.
AT_ONCE = 8 << 20


def images(spark: SparkSession, folder: str, suffix: str = "jpg") -> DataFrame:
    """``path, image``: the images below a folder as rasters, by Spark's own image source; unreadable files are left out."""
    found = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", "true").load(folder)
    return found.select(F.col("image.origin").alias("path"), F.struct(F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data")).alias("image"))


def as_array(raster: dict) -> np.ndarray:
    return np.frombuffer(raster["data"], np.uint8).reshape(*[int(raster[k]) for k in ("height", "width", "channels")])


def arrays(rasters: pd.DataFrame) -> list[np.ndarray | None]:
    """Rasters as pandas brings them; those without pixels are None (their numbers come as NaN)."""
    return [as_array(r) if isinstance(r["data"], bytes) else None for r in rasters.to_dict("records")]


def as_raster(pixels: np.ndarray) -> dict:
    return {"height": pixels.shape[0], "width": pixels.shape[1], "channels": pixels.shape[2], "data": np.ascontiguousarray(pixels, np.uint8).tobytes()}


def _cut(pixels: np.ndarray | None, box: dict) -> dict | None:
    return None if pixels is None else as_raster(pixels[box["y1"] : box["y2"], box["x1"] : box["x2"]])


def cut_out(boxes: DataFrame, images: DataFrame, keys: list[str], own: list[str], decode: Callable[[bytes], np.ndarray] | None = None) -> DataFrame:
    """``keys, own`` and ``crop``, the raster inside ``crop_x1, crop_y1, crop_x2, crop_y2``, of each row of ``boxes``.

    ``images`` has ``keys`` and ``image``, a raster, or bytes that ``decode`` makes an array of rows, columns and
    channels of. Boxes lie inside their image, as ``person_crops`` leaves them. An image meets the list of its boxes,
    so its bytes are shuffled and decoded once, whatever their number. A null image gives null crops, a box
    of an image that isn't there is left out. Crops go on as soon as ``AT_ONCE`` bytes of them are there.
    """
    corners = ["x1", "y1", "x2", "y2"]
    box = F.struct(*[F.col(f"crop_{c}").cast("int").alias(c) for c in corners])
    lists = boxes.groupBy(*keys).agg(F.collect_list(F.struct(F.struct(*own).alias("own"), box.alias("box"))).alias("boxes"))
    joined = images.select(*keys, "image").join(lists, keys).select(*keys, "boxes", "image")
    kinds = {f.name: f.dataType.simpleString() for f in boxes.select(*keys, *own).schema}
    schema = ", ".join(f"`{n}` {t}" for n, t in kinds.items()) + f", crop {RASTER}"
    n = len(keys)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                image, listed = row.column(n + 1)[0].as_py(), row.column(n).flatten()
                pixels = None if image is None else as_array(image) if decode is None else decode(image)
                places, owned = listed.field("box").to_pylist(), listed.field("own")
                first, size, crops = 0, 0, []
                for k, place in enumerate(places):
                    crops.append(_cut(pixels, place))
                    size += len(crops[-1]["data"]) if crops[-1] else 0
                    if size >= AT_ONCE or k + 1 == len(places):
                        some = owned.slice(first, len(crops))
                        fixed = [pa.concat_arrays([row.column(i)] * len(crops)) for i in range(n)]
                        yield pa.RecordBatch.from_arrays([*fixed, *[some.field(c) for c in own], pa.array(crops, _KIND)], names=[*kinds, "crop"])
                        first, size, crops = k + 1, 0, []

    return joined.mapInArrow(run, schema)


def _inner(rasters: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
    fields = [f.name for f in _KIND]
    rows = [_cut(pixels, box) or dict.fromkeys(fields) for pixels, box in zip(arrays(rasters), boxes.to_dict("records"))]
    return pd.DataFrame(rows, columns=fields)


def inner(raster: Column, box: Column) -> Column:
    """The raster inside a box (struct of whole corners) of a raster; its fields are null where the raster is."""
    return F.pandas_udf(_inner, RASTER)(raster, box)


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of rows, columns and 1, 3 or 4 channels; three and four come as Spark reads them, blue first."""
    colour = {1: 0, 3: 2, 4: 6}[pixels.shape[2]]
    if pixels.shape[2] > 1:
        pixels = pixels[:, :, [2, 1, 0, 3][: pixels.shape[2]]]

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(pixels, np.uint8))
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def as_png(raster: Column) -> Column:
    """PNG files of rasters; null for one without pixels."""

    def files(rasters: pd.DataFrame) -> pd.Series:
        return pd.Series([None if pixels is None else png(pixels) for pixels in arrays(rasters)], dtype=object)

    return F.pandas_udf(files, "binary")(raster)
