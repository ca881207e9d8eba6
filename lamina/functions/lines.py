"""Segmentation of a text line as column expressions over boxes and the runs of ink in its columns.

``boxes`` is an array of struct<x, y, w, h> (integers) from left to right. ``ink`` is the line's mask: for each pixel column
an array of its runs of ink struct<a, b>, rows a to b - 1 from top to bottom. Of that, profiles, tight boxes and valleys are
sums and extremes over arrays, so no pixels are needed after the runs are known. The shares and limits below are fixed
values, which results must agree with.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lamina.functions.geometry import edge_artefact

BOX = "struct<x:int,y:int,w:int,h:int>"


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*[c.cast("int").alias(n) for n, c in (("x", x), ("y", y), ("w", w), ("h", h))])


def without_frame(boxes: Column, height: Column, width: Column) -> Column:
    """Boxes that are no pieces of the frame."""
    return F.filter(boxes, lambda b: ~edge_artefact(b, height, width))


def merged_strokes(boxes: Column, height: Column, width: Column) -> Column:
    """Boxes whose parts of one character are joined: a fold from left to right that grows the last box or starts a new one.

    A box joins the last one if they share columns and are not far apart in height, or if it is near and they share rows.
    Of the result only boxes of some width and height stay.
    """
    near = F.greatest(F.lit(2), F.floor(width * 0.018).cast("int"))

    def push(stack: Column, b: Column) -> Column:
        last = F.element_at(stack, -1)
        right, bottom = last["x"] + last["w"], last["y"] + last["h"]
        across = F.least(right, b["x"] + b["w"]) - F.greatest(last["x"], b["x"])
        down = F.least(bottom, b["y"] + b["h"]) - F.greatest(last["y"], b["y"])
        same = ((across > 0) & (down > height * -0.08)) | ((b["x"] - right <= near) & (down > height * 0.12))
        x, y = F.least(last["x"], b["x"]), F.least(last["y"], b["y"])
        grown = box(x, y, F.greatest(right, b["x"] + b["w"]) - x, F.greatest(bottom, b["y"] + b["h"]) - y)
        own = F.array(box(b["x"], b["y"], b["w"], b["h"]))
        return F.when(F.size(stack) == 0, own).when(same, F.concat(F.slice(stack, F.lit(1), F.size(stack) - 1), F.array(grown))).otherwise(F.concat(stack, own))

    merged = F.aggregate(boxes, F.array().cast(f"array<{BOX}>"), push)
    return F.filter(merged, lambda b: (b["w"] >= width * 0.018) & (b["h"] >= height * 0.25))


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often ``use`` refers to it from within its own loops."""
    return F.get(F.transform(F.array(value), use), 0)


def runs(marks: Column) -> Column:
    """struct<first, last> of the maximal runs of true in an array of booleans."""

    def found(m: Column) -> Column:
        n = F.size(m)
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: F.get(m, i) & ~F.coalesce(F.get(m, F.when(i > 0, i - 1)), F.lit(False)))
        stops = F.filter(places, lambda i: F.get(m, i) & ~F.coalesce(F.get(m, i + 1), F.lit(False)))
        return F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("first"), b.alias("last")))

    return bound(marks, found)


def profile(ink: Column) -> Column:
    """Pixels of ink in each column."""
    return F.transform(ink, lambda column: F.aggregate(column, F.lit(0), lambda n, r: n + (r["b"] - r["a"])))


def tight(ink: Column, x1: Column, x2: Column, y1: Column, y2: Column) -> Column:
    """The box around the ink in columns x1 to x2 - 1 and rows y1 to y2 - 1; null without ink."""
    part = F.transform(F.slice(ink, x1 + 1, F.greatest(x2 - x1, F.lit(0))), lambda column: F.filter(column, lambda r: (r["a"] < y2) & (r["b"] > y1)))
    held = F.transform(part, lambda column, i: F.when(F.size(column) > 0, F.struct((x1 + i).alias("x"), F.greatest(F.element_at(column, 1)["a"], y1).alias("top"), F.least(F.element_at(column, -1)["b"], y2).alias("end"))))
    held = F.filter(held, lambda c: c.isNotNull())

    def around(columns: Column) -> Column:
        left, top = F.array_min(columns["x"]), F.array_min(columns["top"])
        return box(left, top, F.array_max(columns["x"]) + 1 - left, F.array_max(columns["end"]) - top)

    return bound(held, lambda c: F.when(F.size(c) > 0, around(c)))


def projected(ink: Column, height: Column, width: Column, narrow: float, broad: float, low: float) -> Column:
    """Boxes by projection: runs of columns with more ink than a share of the height, of plausible width and tight height."""
    active = F.transform(profile(ink), lambda n: n > F.greatest(F.lit(1.0), height * 0.05))
    found = F.filter(runs(active), lambda r: (r["last"] - r["first"] + 1).between(width * narrow, width * broad))
    boxes = F.transform(found, lambda r: tight(ink, r["first"], r["last"] + 1, F.lit(0), height))
    return F.filter(boxes, lambda b: b.isNotNull() & (b["h"] >= height * low) & (b["w"] >= width * narrow))


def valley(ink: Column, b: Column) -> Column:
    """struct<at, depth> of the emptiest column in the middle of a box after smoothing over five, and its share of the lower peak beside it.

    Null for boxes under eight columns. Sums are whole numbers, so the first of equal columns is found exactly.
    """
    top, bottom = b["y"], b["y"] + b["h"]
    part = F.slice(ink, b["x"] + 1, b["w"])
    counts = F.transform(part, lambda column: F.aggregate(column, F.lit(0), lambda n, r: n + F.greatest(F.lit(0), F.least(r["b"], bottom) - F.greatest(r["a"], top))))

    def found(c: Column) -> Column:
        smooth = F.transform(c, lambda n, i: F.aggregate(F.slice(c, F.greatest(i - 1, F.lit(1)), F.least(i + 3, F.size(c)) - F.greatest(i - 2, F.lit(0))), F.lit(0), lambda a, x: a + x))

        def cut(s: Column) -> Column:
            low, high = F.greatest(F.lit(2), F.floor(b["w"] * 0.30).cast("int")), F.least(b["w"] - 2, F.floor(b["w"] * 0.70).cast("int"))
            middle = F.slice(s, low + 1, high - low)
            at = low + F.array_position(middle, F.array_min(middle)).cast("int") - 1
            peak = F.least(F.array_max(F.slice(s, F.lit(1), at)), F.coalesce(F.array_max(F.slice(s, at + 2, b["w"])), F.lit(0)))
            return F.when(high > low, F.struct(at.alias("at"), (F.get(s, at) / F.greatest(F.lit(5.0), peak.cast("double"))).alias("depth")))

        return bound(smooth, cut)

    return F.when(F.size(part) >= 8, bound(counts, found))


def halves(ink: Column, b: Column, usual: Column, height: Column, width: Column) -> Column:
    """The two tight boxes of a box that holds two characters, else null: too wide for the line, not slim, and with a valley
    (only very wide boxes are cut at a shallow one)."""
    wide = (b["w"] >= F.greatest(usual * 1.45, width * 0.09)) & (b["w"] / F.greatest(F.lit(1), b["h"]) >= 0.62) & (b["h"] >= height * 0.28) & (usual > 0)

    def cut(v: Column) -> Column:
        at, bottom = b["x"] + v["at"], b["y"] + b["h"]
        pair = F.array(tight(ink, b["x"], at + 1, b["y"], bottom), tight(ink, at + 1, b["x"] + b["w"], b["y"], bottom))
        good = lambda p: F.forall(p, lambda c: c.isNotNull() & (c["w"] > 1) & (c["h"] > 1) & (c["w"] >= width * 0.012) & (c["h"] >= height * 0.18))
        return F.get(F.filter(F.array(pair), good), 0)

    deep = lambda v: v.isNotNull() & ((v["depth"] <= 0.82) | (b["w"] >= usual * 1.85))
    return F.when(wide, F.get(F.transform(F.filter(F.array(valley(ink, b)), deep), cut), 0))


def split_budget(boxes: Column, most: Column, split) -> Column:
    """Boxes of which, from left to right, those that ``split`` cuts in two are replaced, until there are ``most`` of them."""
    n = F.size(boxes)
    start = F.struct((most - n).cast("int").alias("left"), F.array().cast(f"array<{BOX}>").alias("out"))

    def take(state: Column, b: Column) -> Column:
        pair = F.when(state["left"] > 0, split(b))
        return F.get(F.transform(F.array(pair), lambda p: F.struct((state["left"] - p.isNotNull().cast("int")).cast("int").alias("left"), F.concat(state["out"], F.coalesce(p, F.array(box(b["x"], b["y"], b["w"], b["h"])))).alias("out"))), 0)

    return F.when((n < 2) | (n >= most), F.transform(boxes, lambda b: box(b["x"], b["y"], b["w"], b["h"]))).otherwise(F.aggregate(boxes, start, take, lambda s: s["out"]))
