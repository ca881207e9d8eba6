"""Boxes, polygons and angles as column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def plate_type(width: Column, height: Column) -> Column:
    return F.when(width / height > 2.5, "1line").otherwise("2line")


def polygon_area(xs: Column, ys: Column) -> Column:
    """Shoelace area of a closed polygon."""
    n = F.size(xs)
    turn = F.transform(xs, lambda x, i: x * F.get(ys, (i + 1) % n) - F.get(xs, (i + 1) % n) * F.get(ys, i))
    return F.abs(F.aggregate(turn, F.lit(0.0), lambda a, t: a + t)) / 2


def clipped_box(xs: Column, ys: Column) -> Column:
    """Centre, width and height of the polygon's box inside the unit square; null where nothing is left."""
    clip = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    x1, x2, y1, y2 = clip(F.array_min(xs)), clip(F.array_max(xs)), clip(F.array_min(ys)), clip(F.array_max(ys))
    box = F.struct(((x1 + x2) / 2).alias("xc"), ((y1 + y2) / 2).alias("yc"), (x2 - x1).alias("w"), (y2 - y1).alias("h"))
    return F.when((x2 > x1) & (y2 > y1), box)


def ordered_corners(points: Column) -> Column:
    """Top left, top right, bottom right, bottom left of array<struct<x, y>>: least and most of the sum and difference; the first wins ties."""
    indexed = F.transform(points, lambda p, i: F.struct((p.x + p.y).alias("s"), (p.y - p.x).alias("d"), i.alias("i"), p.alias("p")))
    pick = lambda key, sign: F.array_min(F.transform(indexed, lambda q: F.struct((sign * q[key]).alias("k"), q.i.alias("i"), q.p.alias("p")))).p
    return F.array(pick("s", 1), pick("d", 1), pick("s", -1), pick("d", -1))


def folded_angle(dx: Column, dy: Column) -> Column:
    """Direction of a segment in degrees, folded to within 45 of level."""
    angle = F.degrees(F.atan2(dy, dx))
    return F.when(angle < -45, angle + 90).when(angle > 45, angle - 90).otherwise(angle)


def weighted_median(pairs: Column) -> Column:
    """Of array<struct<value, weight>>: the first value, in order, where the running weight reaches half."""
    ordered = F.array_sort(pairs)
    half = F.aggregate(ordered, F.lit(0.0), lambda a, p: a + p.weight) / 2
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("value"))
    step = lambda a, p: F.struct((a["sum"] + p.weight).alias("sum"), F.coalesce(a["value"], F.when(a["sum"] + p.weight >= half, p.value)).alias("value"))
    return F.aggregate(ordered, start, step)["value"]


def line_counts(centres: Column) -> Column:
    """How many centres lie above the middle of their range, and the others."""
    split = (F.array_min(centres) + F.array_max(centres)) / 2
    above = F.size(F.filter(centres, lambda y: y < split))
    return F.struct(above.alias("top"), (F.size(centres) - above).alias("bottom"))


def clipped_to(value: Column, most: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0)), most)


def hog_length(size: int, cell: int, block: int = 2, bins: int = 9) -> int:
    """Length of an oriented-gradient descriptor of a square image."""
    across = size // cell - block + 1
    return across * across * block * block * bins


def constrained_argmax(scores: Column, allowed: Column) -> Column:
    """Index of the largest score among allowed places (array<boolean>); the first wins ties."""
    return F.array_position(_masked(scores, allowed), F.array_max(_masked(scores, allowed))) - 1


def _masked(scores: Column, allowed: Column) -> Column:
    return F.zip_with(scores, allowed, lambda s, a: F.when(a, s).otherwise(F.lit(float("-inf"))))


def margin(scores: Column, own: Column) -> Column:
    """Own score less the best of the others."""
    others = F.filter(F.transform(scores, lambda s, i: F.when(i != own, s)), lambda s: s.isNotNull())
    return F.get(scores, own) - F.array_max(others)


def middle(values: Column) -> Column:
    """Median of a non-empty array."""
    v, n = F.array_sort(values), F.size(values)
    return (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2.0


def spread(values: Column) -> Column:
    """Population deviation of a non-empty array."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)


def line_score(boxes: Column, tall: Column, wide: Column, height: Column, width: Column, low: int | Column | None, high: int | Column | None) -> Column:
    """How much an array of boxes(x, w, h) of a line looks like ``low`` to ``high`` characters, or like any line where they are None.

    ``tall`` and ``wide`` are the boxes' median height and width (1 at least), as columns of their own: they are asked for with
    every box. Fixed values: the weights, which results must agree with.
    """
    n, w, h = F.size(boxes), boxes["w"].cast("array<double>"), boxes["h"].cast("array<double>")
    if low is None or high is None:
        count = F.when(n.between(3, 6), 25.0 - F.abs(4.5 - n)).otherwise(10.0 - F.abs(5 - n) * 4.0)
    else:
        count = F.when(n.between(low, high), 35.0 - F.abs((low + high) / 2.0 - n)).otherwise(20.0 - F.least(F.abs(n - low), F.abs(n - high)) * 7.0)
    size = F.when(tall.between(height * 0.35, height * 0.92), 8.0).otherwise(-8.0)
    uneven = F.least(F.lit(8.0), spread(w) / wide * 3.0) + F.least(F.lit(8.0), spread(h) / tall * 3.0)

    def fault(b: Column) -> Column:
        edge = (b["x"] <= 1) | (b["x"] + b["w"] >= width - 1)
        small = F.when(b["w"] * b["h"] < height * width * 0.006, 3.0).otherwise(0.0)
        return small + F.when(edge & (b["w"] < width * 0.07), 4.0).otherwise(0.0) + F.when(b["h"] < tall * 0.45, 4.0).otherwise(0.0)

    faults = F.aggregate(F.transform(boxes, fault), F.lit(0.0), lambda a, x: a + x)
    return F.when(n == 0, -50.0).otherwise(count + size - uneven - faults)


def character_shaped(box: Column, height: Column, width: Column, narrow: float, broad: float, low: float) -> Column:
    """Whether a component(w, h, area) has a character's share of its line: width between two shares, height above one, 30 pixels at least."""
    return (box["w"] >= width * narrow) & (box["w"] <= width * broad) & (box["h"] >= height * low) & (box["area"] >= 30)


def edge_artefact(box: Column, height: Column, width: Column) -> Column:
    """Whether a box(x, w, h) is a piece of the frame: it touches a side and is tall and thin."""
    touches = (box["x"] <= 1) | (box["x"] + box["w"] >= width - 1)
    thin = (box["h"] > height * 0.72) & (box["w"] < width * 0.08)
    return touches & (thin | (box["w"] / F.greatest(F.lit(1.0), box["h"].cast("double")) < 0.13))


def trimmed(boxes: Column, width: Column, least: int) -> Column:
    """Boxes(x, w) from left to right without narrow pieces at either end of the line, but never fewer than ``least``."""
    n, narrow = F.size(boxes), middle(boxes["w"].cast("array<double>")) * 0.65
    run = lambda ends: F.coalesce(F.nullif(F.array_position(ends, F.lit(False)), F.lit(0)) - 1, F.size(ends))  # noqa: E731  how many are True before the first False
    left = run(F.transform(boxes, lambda b: (b["x"] <= width * 0.03) & (b["w"] < narrow)))
    right = run(F.transform(F.reverse(boxes), lambda b: (b["x"] + b["w"] >= width * 0.97) & (b["w"] < narrow)))
    front = F.least(left, F.greatest(n - least, F.lit(0)))
    back = F.least(right, F.greatest(n - front - least, F.lit(0)))
    return F.slice(boxes, (front + 1).cast("int"), (n - front - back).cast("int"))


def binary_score(parts: Column, height: Column, width: Column, fill: Column) -> Column:
    """How much the components(x, y, w, h, area) of a binarised plate look like its characters.

    ``height`` and ``width`` are those of the inner part whose components they are, ``fill`` is the share of ink in all.
    Fixed values: the weights and shares, which results must agree with.
    """
    whole = (height * width).cast("double")
    huge = lambda b: (b["area"] > whole * 0.18) | ((b["w"] > width * 0.50) & (b["h"] > height * 0.35))
    sized = lambda b: (b["area"] >= F.greatest(F.lit(12.0), whole * 0.00045)) & b["h"].between(height * 0.10, height * 0.82) & b["w"].between(width * 0.008, width * 0.30)
    likely = F.filter(parts, lambda b: ~huge(b) & sized(b) & (b["w"] / F.greatest(F.lit(1), b["h"]) <= 1.9))
    total = lambda each, of: F.aggregate(F.transform(of, each), F.lit(0.0), lambda a, x: a + x)
    body = total(lambda b: F.least(F.lit(1.4), b["area"] / F.greatest(F.lit(1.0), whole * 0.025)) + F.least(F.lit(0.4), b["area"] / F.greatest(F.lit(1), b["w"] * b["h"])), likely)
    edges = total(lambda b: F.when((b["x"] <= 1) | (b["x"] + b["w"] >= width - 1), 0.8).otherwise(0.0), likely)
    n = F.size(likely)
    filled = F.when(fill.between(0.035, 0.28), 4.0).when(fill <= 0.40, 1.0).otherwise((fill - 0.40) * -10.0)
    count = n * 3.0 + F.when(n.between(6, 12), 8.0 - F.abs(8 - F.least(n, F.lit(10)))).when(n == 0, -12.0).otherwise(0.0)
    return count + body + filled - F.size(F.filter(parts, huge)) * 8.0 - edges


def segmentation_score(boxes: Column, two_line: Column, fill: Column, own: Column) -> Column:
    """How much the characters(y, w, h) found in a binarisation with score ``own`` look like a plate.

    Two-line plates are also judged by how many stand above the middle of the characters' centres. Fixed values: the weights.
    """
    n, wide, tall = F.size(boxes), boxes["w"].cast("array<double>"), boxes["h"].cast("array<double>")
    count = F.when(n.between(7, 9), 40.0 - F.abs(8 - n) * 2.0).when(n.between(5, 10), 18.0 - F.abs(8 - n) * 3.0).when(n > 10, 8.0 - (n - 10) * 3.0).otherwise((5 - n) * -7.0)
    filled = F.when(fill.between(0.035, 0.30), 5.0).when(fill > 0.42, -12.0 - (fill - 0.42) * 25.0).otherwise(0.0)
    uneven = lambda side: F.least(F.lit(8.0), spread(side) / F.greatest(F.lit(1.0), middle(side)) * 4.0)
    lines = line_counts(F.transform(boxes, lambda b: b["y"] + b["h"] / 2.0))
    top, bottom = lines["top"], lines["bottom"]
    award = lambda condition, points: F.when(condition, points).otherwise(0.0)
    split = award(top.between(2, 4), 8.0) + award(bottom.between(4, 6), 8.0) + award(bottom >= top, 3.0)
    return own * 0.20 + count + filled - F.when(n >= 4, uneven(wide) + uneven(tall)).otherwise(0.0) + F.when(two_line & (n > 0), split).otherwise(0.0)
