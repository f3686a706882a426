"""Box geometry as Catalyst columns.  Boxes are four columns (x1, y1, x2, y2) in pixels, origin top left."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

CORE_SHARE = 0.8  # of a mapped box that must lie inside its crop
FIX_LIMIT = 1.0  # pixels that a fused box may be clipped by
LEAST_SIDE = 1.0
SMALL, MEDIUM = 32.0**2, 96.0**2  # area bounds


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))

    def named(self, prefix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}{n}") for n, c in zip(("x1", "y1", "x2", "y2"), self, strict=True)]

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def area(self) -> Column:
        return F.greatest(F.lit(0.0), self.width) * F.greatest(F.lit(0.0), self.height)

    @property
    def center(self) -> tuple[Column, Column]:
        return (self.x1 + self.x2) / 2, (self.y1 + self.y2) / 2


def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column) -> Box:
    return Box(x, y, x + w, y + h)


def xyxy_to_xywh(b: Box) -> tuple[Column, Column, Column, Column]:
    return b.x1, b.y1, b.width, b.height


def overlap(a: Box, b: Box) -> Column:
    """Area of the common part; nothing below zero."""
    return F.greatest(F.lit(0.0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) * F.greatest(F.lit(0.0), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))


def iou(a: Box, b: Box) -> Column:
    common = overlap(a, b)
    union = a.area + b.area - common
    return F.when(union > 0, common / union).otherwise(0.0)


def size_bucket(w: Column, h: Column) -> Column:
    return F.when(w * h < SMALL, "small").when(w * h < MEDIUM, "medium").otherwise("large")


def clip(b: Box, width: Column, height: Column) -> Box:
    def into(c: Column, high: Column | int) -> Column:
        return F.least(F.greatest(c, F.lit(0.0)), F.lit(high).cast("double"))

    return Box(into(b.x1, width), into(b.y1, height), into(b.x2, width), into(b.y2, height))


def largest_shift(a: Box, b: Box) -> Column:
    return F.greatest(*[F.abs(p - q) for p, q in zip(a, b, strict=True)])


class Letterbox(NamedTuple):
    scale: Column
    new_w: Column
    new_h: Column
    pad_x: Column
    pad_y: Column


def letterbox(w: Column, h: Column, target_w: int, target_h: int) -> Letterbox:
    """Scale to fit with rounded sides (half to even) and the left and top padding."""
    scale = F.least(F.lit(float(target_w)) / w, F.lit(float(target_h)) / h)
    new_w, new_h = (F.greatest(F.lit(1), F.bround(c * scale).cast("int")) for c in (w, h))
    return Letterbox(scale, new_w, new_h, F.floor((F.lit(target_w) - new_w) / 2).cast("int"), F.floor((F.lit(target_h) - new_h) / 2).cast("int"))


def to_letterbox(b: Box, p: Letterbox) -> Box:
    return Box(b.x1 * p.scale + p.pad_x, b.y1 * p.scale + p.pad_y, b.x2 * p.scale + p.pad_x, b.y2 * p.scale + p.pad_y)


def from_letterbox(b: Box, p: Letterbox) -> Box:
    return Box((b.x1 - p.pad_x) / p.scale, (b.y1 - p.pad_y) / p.scale, (b.x2 - p.pad_x) / p.scale, (b.y2 - p.pad_y) / p.scale)


def shift(b: Box, dx: Column, dy: Column) -> Box:
    return Box(b.x1 + dx, b.y1 + dy, b.x2 + dx, b.y2 + dy)


def restore_flip(b: Box, width: Column) -> Box:
    return Box(width - b.x2, b.y1, width - b.x1, b.y2)


def center_in(b: Box, core: Box) -> Column:
    """Half-open: left and top edges belong to the core."""
    cx, cy = b.center
    return (core.x1 <= cx) & (cx < core.x2) & (core.y1 <= cy) & (cy < core.y2)


def inside_share(b: Box, frame: Box) -> Column:
    return F.when(b.area > 0, overlap(b, frame) / b.area).otherwise(0.0)


def rotated_enclosure(b: Box, degrees: Column, width: Column, height: Column) -> Box:
    """Axis-parallel hull of the box turned about its centre, clipped; null if nothing is left."""
    cx, cy = b.center
    c, s = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
    half_w, half_h = (b.width * c + b.height * s) / 2, (b.width * s + b.height * c) / 2
    hull = clip(Box(cx - half_w, cy - half_h, cx + half_w, cy + half_h), width, height)
    some = (hull.x2 > hull.x1) & (hull.y2 > hull.y1)
    return Box(*(F.when(some, v) for v in hull))


def polygon_enclosure(xs: Column, ys: Column, border: int, width: Column, height: Column) -> tuple[Box, Column]:
    """Hull of a polygon moved by the border and clipped to the output size (null if empty), and whether it was clipped."""
    raw = Box(F.array_min(xs) - border, F.array_min(ys) - border, F.array_max(xs) - border, F.array_max(ys) - border)
    cut = clip(raw, width, height)
    some = (cut.x2 > cut.x1) & (cut.y2 > cut.y1)
    return Box(*(F.when(some, v) for v in cut)), largest_shift(raw, cut) > 0


def normalized(b: Box, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """Centre and size as shares of the image, after clipping."""
    c = clip(b, width, height)
    return (c.x1 + c.x2) / 2 / width, (c.y1 + c.y2) / 2 / height, c.width / width, c.height / height


class Slot(NamedTuple):
    index: Column
    content: Box
    scale_x: Column
    scale_y: Column


def packed_slot(index: Column, crop: Box, cell_w: int, cell_h: int) -> Slot:
    """Place of a crop on a 2 x 2 canvas: centred in its cell at a common scale."""
    left, top = (index % 2) * cell_w, F.floor(index / 2) * cell_h
    p = letterbox(crop.width, crop.height, cell_w, cell_h)
    x, y = left + p.pad_x, top + p.pad_y
    return Slot(index, Box(x.cast("double"), y.cast("double"), (x + p.new_w).cast("double"), (y + p.new_h).cast("double")), p.new_w / crop.width, p.new_h / crop.height)


def from_slot(b: Box, slot: Slot, crop: Box) -> Box:
    return Box(
        (b.x1 - slot.content.x1) / slot.scale_x + crop.x1,
        (b.y1 - slot.content.y1) / slot.scale_y + crop.y1,
        (b.x2 - slot.content.x1) / slot.scale_x + crop.x1,
        (b.y2 - slot.content.y1) / slot.scale_y + crop.y1,
    )


def inference_cost(crop_areas: Column, full_area: Column, calls: Column) -> Column:
    return calls + crop_areas / full_area
