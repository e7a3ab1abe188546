"""Boxes as column expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    """Corners of a box."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1


def box(prefix: str = "") -> Box:
    return Box(*[F.col(prefix + c) for c in Box._fields])


def xywh_to_xyxy(x, y, w, h) -> Box:
    return Box(x, y, x + w, y + h)


def tlwh(b: Box) -> tuple[Column, ...]:
    return b.x1, b.y1, b.width, b.height


def center_size(b: Box) -> tuple[Column, ...]:
    return b.x1 + b.width / 2, b.y1 + b.height / 2, b.width, b.height


def center_aspect(b: Box) -> tuple[Column, ...]:
    """Center, width over height, height; a flat box has a null aspect."""
    return b.x1 + b.width / 2, b.y1 + b.height / 2, F.try_divide(b.width, b.height), b.height


def iou(a: Box, b: Box) -> Column:
    """Intersection over union of continuous boxes; the small term keeps empty boxes at 0."""
    zero = F.lit(0.0)
    both = F.greatest(zero, F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) * F.greatest(zero, F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))
    return both / (a.width * a.height + b.width * b.height - both + F.lit(1e-6))


def iou_inclusive(a: Box, b: Box) -> Column:
    """Intersection over union of pixel boxes whose corners belong to them."""
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1) + 1
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1) + 1
    both = F.when((w > 0) & (h > 0), w * h).otherwise(0.0)
    return F.when(both > 0, both / ((a.width + 1) * (a.height + 1) + (b.width + 1) * (b.height + 1) - both)).otherwise(0.0)


def expanded(b: Box, e: float) -> Box:
    """A box grown on every side by a share of its extent, in whole pixels."""
    dx, dy = (F.floor((F.lit(float(2 * e)) * size + size) / 2).cast("double") for size in (b.width, b.height))
    return Box(b.x1 - dx, b.y1 - dy, b.x2 + dx, b.y2 + dy)


def scaled(b: Box, scale: float = 1.2) -> Box:
    """A box whose sides each move outwards by half of ``scale`` times its extent."""
    dx, dy = (size * (scale / 2) for size in (b.width, b.height))
    return Box(b.x1 - dx, b.y1 - dy, b.x2 + dx, b.y2 + dy)


def clamped(b: Box, width, height) -> Box:
    """Whole-pixel box inside an image; where nothing of it is inside, all corners are null."""
    x1, y1 = (F.greatest(F.lit(0), c.cast("int")) for c in (b.x1, b.y1))
    x2, y2 = F.least(width, b.x2.cast("int")), F.least(height, b.y2.cast("int"))
    inside = (x2 > x1) & (y2 > y1)
    return Box(*[F.when(inside, c) for c in (x1, y1, x2, y2)])


def torso_rows(height) -> tuple[Column, Column]:
    """First and end row of the part of a person crop that is taken without a pose."""
    return (height * F.lit(0.2)).cast("int"), (height * F.lit(0.8)).cast("int")


def torso_box(points: Column, width, height, pads=(5.0, 5.0, 5.0, 0.0), least_score: float = 0.3) -> Column:
    """Box (struct of ints) around the valid torso points, or null.

    ``points`` is an array of structs ``name, x, y, score`` with names ``ls, rs, lh, rh``. One shoulder and one
    hip at least must be valid. ``pads`` are left, right, top, bottom.
    """
    good = F.filter(points, lambda p: p["score"] >= least_score)
    enough = F.exists(good, lambda p: p["name"].isin("ls", "rs")) & F.exists(good, lambda p: p["name"].isin("lh", "rh"))
    xs, ys = F.transform(good, lambda p: p["x"]), F.transform(good, lambda p: p["y"])
    x1 = F.greatest(F.lit(0), (F.array_min(xs) - pads[0]).cast("int"))
    y1 = F.greatest(F.lit(0), (F.array_min(ys) - pads[2]).cast("int"))
    x2 = F.least(width, (F.array_max(xs) + pads[1]).cast("int"))
    y2 = F.least(height, (F.array_max(ys) + pads[3]).cast("int"))
    return F.when(enough & (x2 > x1) & (y2 > y1), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))
