"""Boxes as Column expressions; a box is four columns x0, y0, x1, y1."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the page that diversity is measured on, in pixels.
PAGE_WIDTH, PAGE_HEIGHT = 770, 1048


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*[F.col(prefix + x) for x in cls._fields])

    def named(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + x) for x, c in zip(self._fields, self, strict=True)]


def area(b: Box) -> Column:
    """Each side counts as 0 if it is negative."""
    return F.greatest(b.x1 - b.x0, F.lit(0)) * F.greatest(b.y1 - b.y0, F.lit(0))


def raw_area(b: Box) -> Column:
    return (b.x1 - b.x0) * (b.y1 - b.y0)


def intersection(a: Box, b: Box) -> Column:
    width = F.greatest(F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.lit(0))
    return width * F.greatest(F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0), F.lit(0))


def touching(a: Box, b: Box) -> Column:
    """Whether two boxes share area; cheaper than its size, and false at the first side that is past the other's."""
    return (a.y0 < b.y1) & (b.y0 < a.y1) & (a.x0 < b.x1) & (b.x0 < a.x1)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, 0 where the union is 0; the areas of the boxes themselves aren't clamped."""
    shared = intersection(a, b).cast("double")
    return F.coalesce(F.try_divide(shared, raw_area(a) + raw_area(b) - shared), F.lit(0.0))


def scaled(b: Box, width: Column, height: Column, to_width: int = PAGE_WIDTH, to_height: int = PAGE_HEIGHT) -> Box:
    """To another page size, truncated; the factor is worked out before it is applied."""
    fx, fy = F.lit(float(to_width)) / width, F.lit(float(to_height)) / height
    return Box(*[(v * f).cast("int") for v, f in zip(b, (fx, fy, fx, fy), strict=True)])


def normalised(b: Box, width: Column, height: Column) -> Box:
    """To 0..1000, truncated."""
    sizes = (width, height, width, height)
    return Box(*[(v.cast("double") / s * 1000).cast("int") for v, s in zip(b, sizes, strict=True)])


def unnormalised(b: Box, width: Column, height: Column, whole: bool = True) -> Box:
    """From 0..1000 to pixels, truncated if whole."""
    found = [s * (v.cast("double") / 1000) for v, s in zip(b, (width, height, width, height), strict=True)]
    return Box(*[x.cast("int") if whole else x for x in found])


def from_relative(b: Box, width: Column, height: Column) -> Box:
    """From shares of the page to whole pixels."""
    return Box(*[(v * s).cast("int") for v, s in zip(b, (width, height, width, height), strict=True)])


def from_percent(b: Box, width: Column, height: Column) -> Box:
    return Box(*[v / 100.0 * s for v, s in zip(b, (width, height, width, height), strict=True)])


def from_size(left: Column, top: Column, width: Column, height: Column) -> Box:
    return Box(left, top, left + width, top + height)


def from_centre(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Box:
    """From centre and size as shares of the page to pixels."""
    return Box((cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height)


def to_centre(b: Box, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    return (b.x0 + b.x1) / 2.0 / width, (b.y0 + b.y1) / 2.0 / height, (b.x1 - b.x0) / width.cast("double"), (b.y1 - b.y0) / height.cast("double")


def centre(b: Box, width: int = PAGE_WIDTH, height: int = PAGE_HEIGHT) -> tuple[Column, Column]:
    """The centre as shares of the page, the second counted from below."""
    return (b.x0 + b.x1) / 2.0 / width, 1 - (b.y0 + b.y1) / 2.0 / height


def cell(b: Box, grid: int = 4, width: int = PAGE_WIDTH, height: int = PAGE_HEIGHT) -> tuple[Column, Column]:
    """Column and row of the grid cell of the centre; past the far edge is the last, and past the near edge wraps around."""
    x = ((b.x0 + b.x1) / 2.0 / width * grid).cast("int")
    y = ((b.y0 + b.y1) / 2.0 / height * grid).cast("int")
    return F.pmod(F.least(x, F.lit(grid - 1)), F.lit(grid)), F.pmod(F.least(y, F.lit(grid - 1)), F.lit(grid))


def zoomed(b: Box, factor: Column) -> Box:
    return Box(*[v * factor for v in b])


def pasted(b: Box, scale: Column, dx: Column, dy: Column) -> Box:
    """The box on a page that is scaled and moved."""
    return Box(b.x0 * scale + dx, b.y0 * scale + dy, b.x1 * scale + dx, b.y1 * scale + dy)


def rotated(b: Box, degrees: Column, width: Column, height: Column, clockwise: bool = False) -> Box:
    """The bounds of the box turned around the middle of the page."""
    angle = F.radians(degrees)
    cos, sin = F.cos(angle), F.sin(angle) * (-1 if clockwise else 1)
    mx, my = width / 2.0, height / 2.0
    corners = [(x - mx, y - my) for x in (b.x0, b.x1) for y in (b.y0, b.y1)]
    xs = [x * cos - y * sin + mx for x, y in corners]
    ys = [x * sin + y * cos + my for x, y in corners]
    return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def truncated(b: Box) -> Box:
    """The box in whole pixels, cut towards zero."""
    return Box(*[v.cast("int") for v in b])


def clipped(b: Box, width: Column, height: Column) -> Box:
    """Where the far corner leaves the page, both far sides move to a pixel inside at most."""
    outside = (b.x1 > width) | (b.y1 > height)
    return Box(b.x0, b.y0, F.when(outside, F.least(b.x1, width - 1)).otherwise(b.x1), F.when(outside, F.least(b.y1, height - 1)).otherwise(b.y1))


def well_formed(b: Box, most: int = 1000) -> Column:
    """Whether the box is ordered and inside 0..most."""
    return (b.x0 >= 0) & (b.y0 >= 0) & (b.x1 <= most) & (b.y1 <= most) & (b.x0 <= b.x1) & (b.y0 <= b.y1)
