import numpy as np
from pyspark.sql import functions as F

from lamina.functions import geometry, pixels, plates
from lamina.operators import classifiers, images, scenes


def as_frame(spark, arrays):
    schema = images.T.StructType([images.T.StructField("id", images.T.LongType()), images.T.StructField("image", images.IMAGE)])
    return spark.createDataFrame([(i, None if a is None else images.packed(a)) for i, a in enumerate(arrays)], schema)


def around(image, y, x, height, width):
    ys = np.clip(np.arange(y - height // 2, y - height // 2 + height), 0, image.shape[0] - 1)
    xs = np.clip(np.arange(x - width // 2, x - width // 2 + width), 0, image.shape[1] - 1)
    return image[np.ix_(ys, xs)]


def test_local_means_and_extremes_match_their_definition():
    image = np.random.default_rng(4).integers(0, 256, (23, 31), dtype=np.uint8)
    mean, most, least = pixels.box_mean(image, 5), pixels.extreme(image, 7, 3, np.max), pixels.extreme(image, 4, 5, np.min)
    for y in range(23):
        for x in range(31):
            assert abs(mean[y, x] - around(image, y, x, 5, 5).mean()) < 1e-6
            assert most[y, x] == around(image, y, x, 3, 7).max() and least[y, x] == around(image, y, x, 5, 4).min()


def test_binarisations_are_distinct_and_show_dark_and_bright_ink():
    plate = pixels.drawn_text(["51F12345"])
    for image in (plate, 255 - plate):
        found = dict(pixels.binarisations(image))
        assert len({m.tobytes() for m in found.values()}) == len(found) >= 6
        assert all(m.shape == image.shape and m.dtype == bool for m in found.values())
        assert (dict(pixels.first_binarisations(image))["gray_dark"] != dict(pixels.first_binarisations(image))["gray_light"]).all()


def test_the_polarity_that_shows_characters_is_taken(spark):
    plate = pixels.drawn_text(["51F12345"])
    rows = scenes.first_masks(as_frame(spark, [plate, 255 - plate, None]), "id").orderBy("id").collect()
    assert [(r["id"], r["name"]) for r in rows] == [(0, "gray_dark"), (1, "gray_light")]
    assert rows[0]["score"] == rows[1]["score"] > 25


def test_candidates_are_ranked_and_at_most_ten(spark):
    rows = scenes.candidate_masks(as_frame(spark, [pixels.drawn_text(["51F12345"]), np.full((40, 90), 120, np.uint8)]), "id").orderBy("id", "place").collect()
    for i in (0, 1):
        own = [r for r in rows if r["id"] == i]
        assert [r["place"] for r in own] == list(range(1, len(own) + 1)) and 1 <= len(own) <= 10
        assert [r["score"] for r in own] == sorted((r["score"] for r in own), reverse=True)


def test_scores_of_nothing_are_defined(spark):
    boxes = "array<struct<x:int,y:int,w:int,h:int,area:int>>"
    row = spark.range(1).select(F.array().cast(boxes).alias("b"))
    one, two = geometry.binary_score(F.col("b"), F.lit(30), F.lit(90), F.lit(0.0)), geometry.segmentation_score(F.col("b"), F.lit(True), F.lit(0.1), F.lit(10.0))
    assert tuple(row.select(one, two).first()) == (-11.0, 2.0 - 35.0 + 5.0)


def test_shaded_plates_are_segmented_by_other_binarisations(spark):
    """A shadow over half the plate merges its characters in one global threshold; a local one parts them."""
    plate = pixels.drawn_text(["51F12345"])
    shade = np.where(np.arange(plate.shape[1]) < plate.shape[1] // 2, 1.0, 0.16)
    frame = as_frame(spark, [plate, (plate * shade).astype(np.uint8)])
    plain = {r["id"]: r["count"] for r in images.segmented(frame, "id").groupBy("id").count().collect()}
    better = {r["id"]: r["count"] for r in scenes.segmented_with_candidates(frame, "id").groupBy("id").count().collect()}
    assert plain[0] == better[0] == 8 and plain.get(1, 0) < 7 <= better[1] <= 9


def test_the_best_region_is_that_of_detection(spark):
    scene, square, two = (np.zeros((480, 640), np.uint8) for _ in range(3))
    scene[200:280, 200:440] = 255
    square[100:300, 100:300] = 255
    two[20:80, 30:230], two[300:380, 300:560] = 255, 255
    frame = as_frame(spark, [scene, square, two, None])
    found = {r["id"]: tuple(r["box"]) if r["box"] else None for r in scenes.located(frame).select("id", "box").collect()}
    first = {r["id"]: (r["x1"], r["y1"], r["x2"] - r["x1"], r["y2"] - r["y1"]) for r in images.detected(frame, "id").filter("ordinal = 1").collect()}
    assert found == {0: (200, 200, 240, 80), 1: None, 2: (300, 300, 260, 80), 3: None} and {k: v for k, v in found.items() if v} == first


def test_bodies_are_cut_out_of_their_ground(spark):
    ground = np.full((160, 400), 50, np.uint8)
    ground[40:120, 60:340] = 230
    shapes = [(r["image"]["height"], r["image"]["width"]) if r["image"] else None for r in scenes.body_cropped(as_frame(spark, [ground, np.full((60, 90), 50, np.uint8), np.zeros((10, 10), np.uint8), None])).orderBy("id").collect()]
    assert abs(shapes[0][0] - 80 * 1.08) <= 8 and abs(shapes[0][1] - 280 * 1.08) <= 8
    assert shapes[1:] == [(60, 90), (10, 10), None]


def test_scenes_are_read_in_passes(spark):
    texts = spark.range(12).select(
        F.col("id").alias("scene"), F.concat((F.col("id") * 7 + 11).cast("string"), F.substring(F.lit("ABCDEFGHKLMNPRSTUVXYZ"), (F.col("id") + 1).cast("int"), F.lit(1))).alias("head"),
        F.lpad((F.col("id") * 7919 % 100000).cast("string"), 5, "0").alias("tail"), (F.col("id") % 3 == 2).alias("two"))
    texts = texts.withColumn("head", F.concat("head", F.when(F.col("two"), "4").otherwise("")))
    texts = texts.select("scene", F.concat("head", "tail").alias("label"), F.when(F.col("two"), F.array("head", "tail")).otherwise(F.array(F.concat("head", "tail"))).alias("lines")).persist()
    drawn = scenes.drawn_scenes(texts, "scene", "lines", 5)
    extra = as_frame(spark, [None, np.zeros((480, 640), np.uint8)]).select((F.col("id") + 100).alias("scene"), "image")
    turned = images.with_image(drawn.filter("scene = 0").withColumn("scene", F.lit(200).cast("long")), lambda image: np.ascontiguousarray(image[::-1, ::-1]))
    read = {r["scene"]: r for r in scenes.read_scenes(drawn.unionByName(extra).unionByName(turned), scenes.drawn_reader(spark), "wavelet", "scene").collect()}
    labels = {r["scene"]: r["label"] for r in texts.collect()}
    assert set(read) == {*labels, 100, 101, 200}
    assert all(not read[i]["success"] and read[i]["text"] is None and read[i]["box"] is None for i in (100, 101))
    right = sum(read[i]["text"] == label for i, label in labels.items())
    assert right >= 9, {i: (read[i]["text"], label) for i, label in labels.items()}
    assert read[200]["box"] is not None and read[200]["success"]


def test_scenes_are_searched_once_and_columns_of_lines_are_built_once(spark):
    scene = np.zeros((480, 640), np.uint8)
    scene[200:280, 200:440] = 255
    plan = scenes.plate_crops(as_frame(spark, [scene]), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 3  # turning, the body's regions and its cut, after one written search
    assert images._box_steps(spark.sparkContext) is images._box_steps(spark.sparkContext)


def test_windows_equal_sums_over_all_their_shifts():
    gray = np.random.default_rng(4).integers(0, 256, (23, 37)).astype(np.uint8)
    mask, nine = gray > 128, pixels.shifted(gray.astype(np.float64), 1)
    assert (pixels.nine_sums(gray) == nine.sum(0)).all() and (pixels.sharpened(gray) == np.clip(1.65 * gray - 0.65 * nine.mean(0), 0, 255).astype(np.uint8)).all()
    assert (pixels.spread(mask, 2) == pixels.shifted(mask, 2).any(0)).all()
    around = pixels.shifted(gray.astype(np.float64), 2)
    y, x = np.meshgrid(range(-2, 3), range(-2, 3), indexing="ij")
    weight = np.exp(-((around - gray) ** 2) / (2 * 45**2) - ((y**2 + x**2).ravel() / 8)[:, None, None])
    assert (pixels.edge_smooth(gray, 2, 45, 2) == ((around * weight).sum(0) / weight.sum(0) + 0.5).astype(np.uint8)).all()


class Rising:
    """A model for which every glyph is the last class."""

    @staticmethod
    def scored(glyphs):
        return glyphs.withColumn("scores", F.array(*[F.lit(float(i)) for i in range(len(plates.CLASSES))]))


def test_scenes_are_drawn_once_and_glyphs_are_dealt_to_all_tasks(spark):
    texts = spark.createDataFrame([(1, ["51F12345"]), (2, ["51F1", "23456"])], "scene long, lines array<string>")
    drawn = scenes.drawn_scenes(texts, "scene", "lines").unionByName(as_frame(spark, [np.zeros((480, 640), np.uint8)]).withColumnRenamed("id", "scene"))
    read = scenes.read_scenes(drawn, Rising(), "raw", "scene")
    assert "MapInPandas" not in read._jdf.queryExecution().optimizedPlan().toString()  # scenes are written once, then only keys and texts are read
    assert {r["scene"]: r["success"] for r in read.collect()} == {0: False, 1: True, 2: True}
    crops = as_frame(spark, [pixels.drawn_text(["51F12345"])]).withColumn("angle", F.lit(0.0))
    plan = images.recognised(crops, Rising(), "raw", "id", "angle")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == plan.count("Exchange hashpartitioning") == 1


def test_parts_are_found_as_by_flooding():
    rng = np.random.default_rng(6)
    snake = np.zeros((40, 40), bool)
    for i in range(0, 40, 4):
        snake[i], snake[i : i + 4, 39 if i % 8 else 0] = True, True
    for mask in (*(rng.random((h, w)) < share for h, w, share in ((1, 1, 1.0), (20, 30, 0.3), (30, 20, 0.5), (9, 50, 0.7))), snake, np.zeros((3, 4), bool)):
        left, found = {tuple(p) for p in np.argwhere(mask).tolist()}, []
        while left:
            part = edge = {min(left)}
            while edge:
                edge = {(y + dy, x + dx) for y, x in edge for dy in (-1, 0, 1) for dx in (-1, 0, 1)} & left - part
                part = part | edge
            left -= part
            ys, xs = [p[0] for p in part], [p[1] for p in part]
            found.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(part)))
        assert pixels.components(mask) == found


def test_turned_and_resized_images_and_tile_contrast_match_their_definition():
    gray = np.random.default_rng(5).integers(0, 256, (37, 53)).astype(np.uint8)
    ys, xs = np.meshgrid((np.arange(41) + 0.5) * 37 / 41 - 0.5, (np.arange(60) + 0.5) * 53 / 60 - 0.5, indexing="ij")
    assert (pixels.resize(gray, 60, 41) == pixels.sample(gray, ys, xs)).all()
    assert (pixels.sample(gray, *np.meshgrid(np.arange(37.0), np.arange(53.0), indexing="ij")) == gray).all()
    cdf = np.stack([np.cumsum(np.bincount(t.ravel(), minlength=256)) * 255 / t.size for rows in np.array_split(gray, 2) for t in np.array_split(rows, 2, axis=1)])
    fy, fx = np.clip((np.arange(37) + 0.5) * 2 / 37 - 0.5, 0, 1)[:, None], np.clip((np.arange(53) + 0.5) * 2 / 53 - 0.5, 0, 1)[None]
    of = cdf[:, gray]
    blended = (of[0] * (1 - fx) + of[1] * fx) * (1 - fy) + (of[2] * (1 - fx) + of[3] * fx) * fy
    assert abs(pixels.local_contrast(gray, 1e9, 2).astype(float) - blended).max() <= 0.5 + 1e-6


def test_a_glyph_is_compared_once_with_the_vectors_that_machines_share():
    rng = np.random.default_rng(3)
    known = rng.normal(size=(40, 6)).astype(np.float32)
    machines = [(a, b, known[rng.permutation(40)[:12]], rng.normal(size=12), float(rng.normal())) for a in range(6) for b in range(a + 1, 6)]
    machine, x = classifiers.KernelMachine((np.zeros(6), np.ones(6)), 0.2, machines), rng.normal(size=(700, 6))
    wins, sums = np.zeros((700, len(plates.CLASSES))), np.zeros((700, len(plates.CLASSES)))
    for a, b, vectors, weights, bias in machines:
        margin = np.exp(-0.2 * ((x[:, None] - vectors[None]) ** 2).sum(2)) @ weights + bias
        wins[:, a], wins[:, b] = wins[:, a] + (margin > 0), wins[:, b] + (margin <= 0)
        sums[:, a], sums[:, b] = sums[:, a] + margin, sums[:, b] - margin
    assert np.allclose(machine.decide(x), wins + sums / (3 * (np.abs(sums) + 1)), atol=1e-5)
    assert len(machine.shared[0]) <= 40 and machine.decide(x[:0]).shape == (0, len(plates.CLASSES))
