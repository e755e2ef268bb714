"""Column functions over boxes (x0, top, x1, bottom)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.text import finite


def clipped_area(x0: Column, top: Column, x1: Column, bottom: Column, width: Column, height: Column) -> Column:
    """Area inside the page; 0 if an edge is missing or not finite."""

    def clip(v: Column, most: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(most, v))

    area = F.greatest(F.lit(0.0), clip(x1, width) - clip(x0, width)) * F.greatest(F.lit(0.0), clip(bottom, height) - clip(top, height))
    bad = F.lit(False)
    for v in (x0, top, x1, bottom):
        bad = bad | v.isNull() | F.isnan(v)
    return F.when(bad, F.lit(0.0)).otherwise(area)


def overlap_ratio(a: str, b: str) -> Column:
    """Common area over the smaller area of the boxes in the columns a_x0 ... and b_x0 ..."""

    def c(side: str, edge: str) -> Column:
        return F.col(f"{side}_{edge}")

    def size(side: str) -> Column:
        return F.greatest(F.lit(0.0), c(side, "x1") - c(side, "x0")) * F.greatest(F.lit(0.0), c(side, "bottom") - c(side, "top"))

    w = F.greatest(F.lit(0.0), F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0")))
    h = F.greatest(F.lit(0.0), F.least(c(a, "bottom"), c(b, "bottom")) - F.greatest(c(a, "top"), c(b, "top")))
    smaller = F.least(size(a), size(b))
    return F.when(smaller > 0, w * h / smaller).otherwise(F.lit(0.0))


def centre(a: str, b: str) -> Column:
    return (finite(F.col(a)) + finite(F.col(b))) / 2
