"""Column expressions over points, polygons, boxes and landmarks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry import catalog as C
from docketry.schemas import PIXEL

_NO_POINTS = f"array<{PIXEL}>"


def pixel(x: Column, y: Column) -> Column:
    """Rounded (half to even) integer point."""
    return F.struct(F.rint(x.cast("double")).cast("int").alias("x"), F.rint(y.cast("double")).cast("int").alias("y"))


def rectangle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Four corners, clockwise from the top left."""
    return F.array(pixel(x1, y1), pixel(x2, y1), pixel(x2, y2), pixel(x1, y2))


# --- polygon shapes ----------------------------------------------------------------------------

def polygon_from_pairs(points: Column) -> Column:
    """[[x, y], ...] -> points; entries without two numbers are dropped."""
    good = F.filter(points, lambda p: (F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull())
    return F.transform(good, lambda p: pixel(F.get(p, F.lit(0)), F.get(p, F.lit(1))))


def polygon_from_flat(numbers: Column) -> Column:
    """[x1, y1, x2, y2, ...] -> points, for an even count of at least six numbers."""
    n = F.size(numbers)
    pts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.expr("0"), (n / 2).cast("int") - 1)),
        lambda i: pixel(F.get(numbers, i * 2), F.get(numbers, i * 2 + 1)),
    )
    return F.when((n >= 6) & (n % 2 == 0), pts)


def polygon_from_xywh(x: Column, y: Column, w: Column, h: Column) -> Column:
    return rectangle(x, y, x + w, y + h)


def polygon_from_xyxy(numbers: Column) -> Column:
    """[x1, y1, x2, y2] -> the rectangle's corners."""
    g = [F.get(numbers, F.lit(i)) for i in range(4)]
    return F.when(F.size(numbers) == 4, rectangle(*g))


def polygon_from_points(points: Column, compat: str | None = None) -> Column:
    """[{x, y}, ...] -> points; a point without x or y is dropped.

    ``compat='zero'`` also drops points with a zero coordinate, as the earlier version does.
    """
    ok = lambda p: p["x"].isNotNull() & p["y"].isNotNull()
    if compat == "zero":
        ok = lambda p: (p["x"] != 0) & (p["y"] != 0)
    pts = F.transform(F.filter(points, ok), lambda p: pixel(p["x"], p["y"]))
    return F.coalesce(pts, F.array().cast(_NO_POINTS))


def points_from_string(s: Column) -> Column:
    """``[x y]`` groups of a string -> points (first two integers of each group); a number beyond an int is null."""
    groups = F.regexp_extract_all(s, F.lit(r"\[[^\]]+\]"), F.lit(0))
    nums = F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"-?[0-9]+"), F.lit(0)))
    return F.transform(
        F.filter(nums, lambda n: F.size(n) >= 2),
        lambda n: F.struct(F.get(n, F.lit(0)).try_cast("int").alias("x"), F.get(n, F.lit(1)).try_cast("int").alias("y")),
    )


def polygons_from_string(s: Column) -> Column:
    """Polygons of a printed list: blocks are separated by ``]``, an empty line and ``[``.

    Cutting there removes the bracket on each side of the cut, so the group next to it has no pair.
    """
    cut = F.split(s, r"\]\s*\n\s*\n\s*\[")
    blocks = F.filter(F.transform(cut, points_from_string), lambda p: F.size(p) > 0)
    groups = F.regexp_extract_all(s, F.lit(r"\[[^\]]+\]"), F.lit(0))
    n = F.size(groups)
    fours = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), (n / 4).cast("int") - 1)),
        lambda i: points_from_string(F.array_join(F.slice(groups, i * 4 + 1, 4), "")),
    )
    fours = F.filter(fours, lambda p: F.size(p) > 0)
    whole = F.filter(F.array(points_from_string(s)), lambda p: F.size(p) > 0)
    return F.when(F.size(blocks) > 0, blocks).when((n > 0) & (n % 4 == 0) & (F.size(fours) > 0), fours).otherwise(whole)


# --- words -------------------------------------------------------------------------------------

def word_extent(vertices: Column) -> Column:
    """struct(x_left, y_top, y_bottom) of a polygon."""
    xs, ys = vertices["x"], vertices["y"]
    return F.struct(
        F.array_min(xs).cast("double").alias("x_left"), F.array_min(ys).cast("double").alias("y_top"),
        F.array_max(ys).cast("double").alias("y_bottom"),
    )


def word_geometry(extent: Column, vertices: Column) -> list[Column]:
    """x_left, y_top, y_bottom, y_center, height, cx, cy of a polygon with its ``word_extent``."""
    def mean(values: Column) -> Column:
        total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
        return total / F.size(values)

    top, bottom = extent["y_top"], extent["y_bottom"]
    return [
        extent["x_left"].alias("x_left"), top.alias("y_top"), bottom.alias("y_bottom"),
        ((top + bottom) / 2).alias("y_center"), F.greatest(F.lit(1.0), bottom - top).alias("height"),
        mean(vertices["x"]).alias("cx"), mean(vertices["y"]).alias("cy"),
    ]


# --- boxes -------------------------------------------------------------------------------------

def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two (x, y, w, h) boxes; 0 when the union is empty."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    zero = F.lit(0)
    iw = F.greatest(zero, F.least(ax + aw, bx + bw) - F.greatest(ax, bx)).cast("bigint")
    ih = F.greatest(zero, F.least(ay + ah, by + bh) - F.greatest(ay, by)).cast("bigint")
    inter = iw * ih
    union = aw.cast("bigint") * ah + bw.cast("bigint") * bh - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def contains(outer: tuple[Column, ...], inner: tuple[Column, ...]) -> Column:
    (ox, oy, ow, oh), (ix, iy, iw, ih) = outer, inner
    return (ix >= ox) & (iy >= oy) & (ix + iw <= ox + ow) & (iy + ih <= oy + oh)


def pad_clamp(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column, share: float = C.PAD_SHARE) -> Column:
    """Pad each side by a share of the box and clamp to the page: struct(x1, y1, x2, y2)."""
    px = F.bround(w * F.lit(share)).cast("int")
    py = F.bround(h * F.lit(share)).cast("int")
    return F.struct(
        F.greatest(F.lit(0), x - px).alias("x1"), F.greatest(F.lit(0), y - py).alias("y1"),
        F.least(page_w, x + w + px).alias("x2"), F.least(page_h, y + h + py).alias("y2"),
    )


# --- faces -------------------------------------------------------------------------------------

def landmark_pixel(landmarks: Column, index: int, w: Column, h: Column) -> Column:
    p = F.get(landmarks, F.lit(index))
    return F.struct((p["x"] * w).cast("int").alias("x"), (p["y"] * h).cast("int").alias("y"))


def landmark_box(landmarks: Column, w: Column, h: Column) -> Column:
    """struct(x, y, w, h, cx, cy) around all landmarks, in truncated pixels.

    Scaling and truncation keep the order of coordinates (a negative scale turns it round), so only the outermost are scaled.
    """
    def span(values: Column, scale: Column) -> tuple[Column, Column]:
        ends = [(end * scale).cast("int") for end in (F.array_min(values), F.array_max(values))]
        return F.least(*ends), F.greatest(*ends)

    (x1, x2), (y1, y2) = span(landmarks["x"], w), span(landmarks["y"], h)
    return F.struct(
        x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h"),
        F.floor((x1 + x2) / 2).cast("int").alias("cx"), F.floor((y1 + y2) / 2).cast("int").alias("cy"),
    )


def distance(a: Column, b: Column) -> Column:
    return F.hypot((a["x"] - b["x"]).cast("double"), (a["y"] - b["y"]).cast("double"))


def _one_eye(landmarks: Column, indices: tuple[int, ...], w: Column, h: Column) -> Column:
    p1, p2, p3, p4, p5, p6 = [landmark_pixel(landmarks, i, w, h) for i in indices]
    width = distance(p1, p4)
    ratio = (distance(p2, p6) + distance(p3, p5)) / (2 * width)
    # a missing landmark leaves no ratio
    return F.when(width > 0, F.coalesce(ratio, F.lit(0.0))).otherwise(F.lit(0.0))


def eye_aspect_ratio(landmarks: Column, w: Column, h: Column) -> Column:
    """Mean of both eyes' height-to-width ratios; an eye without width counts 0."""
    return (_one_eye(landmarks, C.RIGHT_EYE, w, h) + _one_eye(landmarks, C.LEFT_EYE, w, h)) / 2


def mouth_ratios(landmarks: Column, w: Column, h: Column, box_w: Column) -> Column:
    """struct(mouth_w, mouth_open, mouth_w_ratio, mouth_open_ratio)."""
    left, right, top, bottom = [
        landmark_pixel(landmarks, i, w, h) for i in (C.MOUTH_LEFT, C.MOUTH_RIGHT, C.MOUTH_TOP, C.MOUTH_BOTTOM)
    ]
    width, gap = distance(left, right), distance(top, bottom)
    return F.struct(
        width.alias("mouth_w"), gap.alias("mouth_open"),
        (width / (box_w + F.lit(1e-6))).alias("mouth_w_ratio"), (gap / (width + F.lit(1e-6))).alias("mouth_open_ratio"),
    )
