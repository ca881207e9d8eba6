"""Line segmentation as columns against plain pixel loops over the same masks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import geometry, lines
from lamina.operators import images

H, WIDTH = 30, 90


def masks(seed, n):
    """Lines of blobs that stand apart, touch, or have deep and shallow valleys; and an empty one."""
    rng = np.random.default_rng(seed)
    out = [np.zeros((H, WIDTH), bool)]
    for _ in range(n):
        mask = np.zeros((H, WIDTH), bool)
        x = int(rng.integers(0, 6))
        while x < WIDTH - 14:
            w, top, end = int(rng.integers(4, 14)), int(rng.integers(0, 12)), int(rng.integers(16, H + 1))
            mask[top:end, x : x + w] = rng.random((end - top, w)) < 0.8
            if rng.random() < 0.5:  # a neck to the next one
                neck = int(rng.integers(1, 10))
                mask[15 : 15 + neck, x + w : x + w + 3] = True
                x += w + 3
            else:
                x += w + int(rng.integers(1, 5))
        out.append(mask)
    return out


@pytest.fixture(scope="module")
def drawn(spark):
    rows = [(i, [[(r["a"], r["b"]) for r in c] for c in images.column_runs(m)]) for i, m in enumerate(masks(4, 40))]
    return spark.createDataFrame(rows, "id int, ink array<array<struct<a:int,b:int>>>").repartition(3), masks(4, 40)


def around(mask, x1, x2, y1, y2):
    ys, xs = np.nonzero(mask[y1:y2, x1:x2])
    return (x1 + xs.min(), y1 + ys.min(), xs.max() - xs.min() + 1, ys.max() - ys.min() + 1) if len(xs) else None


def spans_of_ink(mask, narrow, broad, low):
    found, first = [], None
    for x in range(WIDTH + 1):
        on = x < WIDTH and mask[:, x].sum() > max(1, H * 0.05)
        if on and first is None:
            first = x
        if not on and first is not None:
            if WIDTH * narrow <= x - first <= WIDTH * broad:
                box = around(mask, first, x, 0, H)
                if box[3] >= H * low:
                    found.append(box)
            first = None
    return found


def cut_in_two(mask, box, usual):
    x, y, w, h = box
    if w < max(usual * 1.45, WIDTH * 0.09) or w / max(1, h) < 0.62 or h < H * 0.28 or usual <= 0 or w < 8:
        return None
    counts = mask[y : y + h, x : x + w].sum(0)
    smooth = [sum(counts[max(0, i - 2) : i + 3]) for i in range(w)]
    low, high = max(2, int(w * 0.3)), min(w - 2, int(w * 0.7))
    if high <= low:
        return None
    at = min(range(low, high), key=lambda i: (smooth[i], i))
    depth = smooth[at] / max(5, min(max(smooth[:at]), max(smooth[at + 1 :])))
    if depth > 0.82 and w < usual * 1.85:
        return None
    pair = [around(mask, x, x + at + 1, y, y + h), around(mask, x + at + 1, x + w, y, y + h)]
    if any(p is None or p[2] <= 1 or p[3] <= 1 or p[2] < WIDTH * 0.012 or p[3] < H * 0.18 for p in pair):
        return None
    return pair


def as_tuples(boxes):
    return [tuple(b) for b in boxes]


def test_projection_finds_the_spans_of_ink(drawn):
    rows, drawn_masks = drawn
    found = rows.select("id", lines.projected(F.col("ink"), F.lit(H), F.lit(WIDTH), 0.03, 0.5, 0.3).alias("boxes")).collect()
    for r in found:
        assert as_tuples(r["boxes"]) == spans_of_ink(drawn_masks[r["id"]], 0.03, 0.5, 0.3)
    assert sum(len(r["boxes"]) for r in found) > 60


@pytest.mark.parametrize("most", [4, 9])
def test_wide_boxes_are_split_within_the_budget(drawn, most):
    rows, drawn_masks = drawn
    boxes = rows.withColumn("boxes", lines.projected(F.col("ink"), F.lit(H), F.lit(WIDTH), 0.01, 1.0, 0.2))
    boxes = boxes.withColumn("usual", F.when(F.size("boxes") > 0, geometry.middle(F.col("boxes.w").cast("array<double>"))).otherwise(0.0))
    split = lines.split_budget(F.col("boxes"), F.lit(most), lambda b: lines.halves(F.col("ink"), b, F.col("usual"), F.lit(H), F.lit(WIDTH)))
    cuts = 0
    for r in boxes.select("id", "boxes", "usual", split.alias("split")).collect():
        mask, start = drawn_masks[r["id"]], as_tuples(r["boxes"])
        expected, left = [], most - len(start)
        for box in start:
            pair = cut_in_two(mask, box, r["usual"]) if 2 <= len(start) < most and left > 0 else None
            left -= pair is not None
            cuts += pair is not None
            expected += pair or [box]
        assert as_tuples(r["split"]) == expected
    assert cuts > 3


def test_strokes_of_one_character_are_merged(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        rows.append((i, sorted((rng.randrange(80), rng.randrange(20), rng.randint(1, 12), rng.randint(1, 12)) for _ in range(rng.randint(0, 9)))))
    frame = spark.createDataFrame(rows, f"id int, boxes array<{lines.BOX}>")
    found = {r["id"]: as_tuples(r["m"]) for r in frame.select("id", lines.merged_strokes(F.col("boxes"), F.lit(H), F.lit(WIDTH)).alias("m")).collect()}
    for i, boxes in rows:
        groups = []
        for x, y, w, h in boxes:
            if groups:
                a, b, c, d = groups[-1]
                across, down = min(c, x + w) - max(a, x), min(d, y + h) - max(b, y)
                if (across > 0 and down > -0.08 * H) or (x - c <= max(2, int(0.018 * WIDTH)) and down > 0.12 * H):
                    groups[-1] = (min(a, x), min(b, y), max(c, x + w), max(d, y + h))
                    continue
            groups.append((x, y, x + w, y + h))
        assert found[i] == [(a, b, c - a, d - b) for a, b, c, d in groups if c - a >= 0.018 * WIDTH and d - b >= 0.25 * H]


def test_the_first_of_the_best_segmentations_stays(spark):
    """Broken strokes, touching characters and a clean line are each read by another way."""
    from lamina.functions import pixels

    plates = [pixels.drawn_text(["51F12345"]), pixels.drawn_text(["29A8", "12345"])]
    image = images.T.StructType([images.T.StructField("id", images.T.LongType()), images.T.StructField("image", images.IMAGE)])
    frame = spark.createDataFrame([(i, images.packed(p)) for i, p in enumerate(plates)], image)
    counts = {(r["id"], r["line"]): r["count"] for r in images.segmented(frame, "id").groupBy("id", "line").count().collect()}
    assert counts == {(0, 0): 8, (1, 0): 4, (1, 1): 5}


def test_score_without_a_number_of_characters(spark):
    boxes = [[(i * 12, 2, 8, 20) for i in range(n)] for n in (0, 1, 4, 6, 9)]
    frame = spark.createDataFrame([(b,) for b in boxes], f"b array<{lines.BOX}>")
    score = geometry.line_score(F.col("b"), F.lit(20.0), F.lit(8.0), F.lit(28), F.lit(120), None, None)
    assert [r[0] for r in frame.select(score).collect()] == [-50.0, 10 - 16 + 8 - 4, 25 - 0.5 + 8 - 4, 25 - 1.5 + 8 - 4, 10 - 16 + 8 - 4]


def test_ink_of_orders_is_drawn_after_one_shuffle_without_lookups(spark, tmp_path):
    from lamina.plans import reading

    rows = [(1, 1, 12), (1, 1, 31), (1, 3, 7), (2, 7, 50), (3, 2, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity int").write.parquet(f"{tmp_path}/lineitem.parquet")
    frame = reading.drawn_ink(spark, str(tmp_path))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "lambdafunction" not in plan
    found = {r["l_orderkey"]: [[tuple(run) for run in column] for column in r["ink"]] for r in frame.collect()}
    for key, amounts in ((1, {1: 31, 3: 7}), (2, {7: 50}), (3, {})):
        for c in range(56):
            q = amounts.get(c // 8 + 1)
            assert found[key][c] == ([] if q is None or (q + 3 * (c % 8)) % 5 == 0 else [(q % 10, q % 10 + 1 + (q + c) % 17)])
