"""Boxes as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> list[Column]:
    """Corners moved into the image and cut to whole pixels."""
    zero = F.lit(0.0)
    return [
        F.greatest(zero, x1.cast("double")).cast("int"),
        F.greatest(zero, y1.cast("double")).cast("int"),
        F.least(width.cast("double"), x2.cast("double")).cast("int"),
        F.least(height.cast("double"), y2.cast("double")).cast("int"),
    ]


def whole_pixels(*corners: Column) -> list[Column]:
    return [c.cast("int") for c in corners]


def unit_range(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def box_to_centre(points: Column, width: Column, height: Column) -> Column:
    """Two corners as centre and size relative to the image, each within 0..1."""
    x1, y1 = points[0][0], points[0][1]
    x2, y2 = points[1][0], points[1][1]
    return F.struct(
        unit_range(((x1 + x2) / 2) / width).alias("cx"),
        unit_range(((y1 + y2) / 2) / height).alias("cy"),
        unit_range(F.abs(x2 - x1) / width).alias("w"),
        unit_range(F.abs(y2 - y1) / height).alias("h"),
    )
