"""Boxes, points, polygons and camera pointing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("bbox_left", "bbox_top", "bbox_width", "bbox_height")


def normalize_bbox(df: DataFrame, width: int = 1920, height: int = 1080) -> DataFrame:
    """Pixel boxes to shares of the frame."""
    by = {"bbox_left": width, "bbox_width": width, "bbox_top": height, "bbox_height": height}
    return df.withColumns({c: F.col(c) / F.lit(float(n)) for c, n in by.items()})


def bbox_to_px(df: DataFrame, width: int = 1920, height: int = 1080) -> DataFrame:
    """Corners x1, y1, x2, y2 in whole pixels, cut off towards zero."""
    right, bottom = F.col("bbox_left") + F.col("bbox_width"), F.col("bbox_top") + F.col("bbox_height")
    corner = lambda v, n: (v * F.lit(float(n))).cast("int")
    return df.withColumns({"x1": corner(F.col("bbox_left"), width), "y1": corner(F.col("bbox_top"), height), "x2": corner(right, width), "y2": corner(bottom, height)})


def with_center(df: DataFrame) -> DataFrame:
    return df.withColumns({"cx": F.col("bbox_left") + F.col("bbox_width") / 2, "cy": F.col("bbox_top") + F.col("bbox_height") / 2})


def pad_bbox(df: DataFrame, cls: int = 3, share: float = 0.05) -> DataFrame:
    """crop_left .. crop_height: the box that is cut out, wider by ``share`` on each side for one class.
    The reported box stays as it is."""
    padded = F.col("class_id") == cls
    out = {}
    for low, extent in (("left", "width"), ("top", "height")):
        size = F.col(f"bbox_{extent}")
        out[f"crop_{low}"] = F.when(padded, F.col(f"bbox_{low}") - size * share).otherwise(F.col(f"bbox_{low}"))
        out[f"crop_{extent}"] = F.when(padded, size + size * (2 * share)).otherwise(size)
    return df.withColumns(out)


def with_zone(df: DataFrame) -> DataFrame:
    """Side of the gate by the centre: source 0 has IN on the left, the others on the right."""
    left = F.col("bbox_left") + F.col("bbox_width") / 2 < 0.5
    return df.withColumn("zone", F.when((F.col("source_id") == 0) == left, "IN").otherwise("OUT"))


def hsv_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Distance of two colours; hue is a circle and weighs 1.5, value weighs 0.5."""
    dh = F.abs(a[0] - b[0])
    dh = F.least(dh, 1 - dh) * 1.5
    ds, dv = a[1] - b[1], (a[2] - b[2]) * 0.5
    return F.sqrt(dh * dh + ds * ds + dv * dv)


def dist_to_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point to a segment; to its end if it has no length."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / length))).otherwise(0.0)
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def polygon_anchor(points: str) -> tuple[Column, Column]:
    """Mean of the vertices of an array of (x, y)."""
    mean = lambda axis: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[axis]) / F.size(points)
    return mean("x"), mean("y")


def inside_polygon(px: Column, py: Column, points: Column) -> Column:
    """Whether a point is strictly inside a polygon: even-odd rule, edges excluded."""
    n = F.size(points)
    at = lambda i: F.get(points, i)

    def step(state: Column, i: Column) -> Column:
        a, b = at(i), at((i + 1) % n)
        cross = (b.x - a.x) * (py - a.y) - (b.y - a.y) * (px - a.x)
        on_edge = (cross == 0) & px.between(F.least(a.x, b.x), F.greatest(a.x, b.x)) & py.between(F.least(a.y, b.y), F.greatest(a.y, b.y))
        flips = ((a.y > py) != (b.y > py)) & (px < (b.x - a.x) * (py - a.y) / F.nullif(b.y - a.y, F.lit(0.0)) + a.x)
        flips = F.coalesce(flips, F.lit(False))
        return F.struct((state.odd != flips).alias("odd"), (state.edge | on_edge).alias("edge"))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.struct(F.lit(False).alias("odd"), F.lit(False).alias("edge")), step, lambda s: s.odd & ~s.edge)


def shapes_to_coords(df: DataFrame, width: int = 1280, height: int = 720) -> DataFrame:
    """``coords``: vertices as pixels ``x;y;x;y``, halves rounded to even."""
    px = lambda v, n: F.bround(v * n, 0).cast("int").cast("string")
    pairs = F.flatten(F.transform("points", lambda p: F.array(px(p.x, width), px(p.y, height))))
    return df.withColumn("coords", F.array_join(pairs, ";"))


def to_pan_tilt(df: DataFrame) -> DataFrame:
    """Absolute pan and tilt of a clicked point, by the field of view at the current zoom, within -1 and 1."""
    fov = lambda k: F.col(f"{k}_fov_wide") * (1 - F.col("zoom")) + F.col(f"{k}_fov_tele") * F.col("zoom")
    pan = F.col("pan") + (F.col("x") - 0.5) * fov("h") / (F.col("pan_range") / 2)
    tilt = F.col("tilt") + (0.5 - F.col("y")) * fov("v") / (F.col("tilt_range") / 2)
    within = lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))
    return df.withColumns({"new_pan": within(pan), "new_tilt": within(tilt)})
