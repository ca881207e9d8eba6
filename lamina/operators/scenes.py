"""From a scene to the text of its plate: a staged plan in which a row leaves at its first good reading.

Kernels produce regions, masks and variants of one image; which of them to take, and who goes on to the next pass, is
decided by columns. Between the passes only keys and texts move; the crops, and each pass's variants of them, are written once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from lamina.functions import geometry, pixels, plates
from lamina.operators import classifiers, evaluation, images
from lamina.session import cut_lineage, held_setting

REGION = "struct<x:int,y:int,w:int,h:int,area:int>"
CANDIDATE = f"array<struct<name:string,fill:double,mask:binary,parts:array<{REGION}>>>"
#: Binarisations that are segmented, width of a crop, smallest crop, shares of its margin.
CANDIDATES, OCR_WIDTH, LEAST_HEIGHT, LEAST_WIDTH = 10, 400, 18, 35
#: Turns that a weak reading is tried at, beside that of its skew.
RESIDUALS = (-10, -5, 5, 10)


#: Images in an Arrow batch, and in the rows that a drawing task makes at a time; Spark's default of 10,000 would be gigabytes.
IMAGE_ROWS = 64
#: Keys that are broadcast at most to pick the images they belong to; more are joined, which moves the images.
FEW_KEYS = 200_000


def _written(rows: DataFrame) -> DataFrame:
    """cut_lineage with few images in an Arrow batch."""
    with held_setting(rows.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(IMAGE_ROWS)):
        return cut_lineage(rows)


def _picked(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The rows of the wanted keys. These are written and broadcast, unless they are too many, so that no image is moved for it."""
    wanted = cut_lineage(wanted.select(*keys).distinct())
    return rows.join(F.broadcast(wanted) if wanted.count() <= FEW_KEYS else wanted, [*keys], "left_semi")


def _typed(rows: DataFrame, keys: tuple[str, ...]) -> str:
    return ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)


# Binarisations ----------------------------------------------------------------------------------------------------------


def _binarised(crops: DataFrame, kernel, keys: tuple[str, ...]) -> DataFrame:
    """Keys, height, width, inner_h, inner_w, found (CANDIDATE) of each crop's masks, in the kernel's order, with their scores."""
    sides = ("height", "width", "inner_h", "inner_w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, counts, masks, parts = [], [], [], [], []
            for i, value in enumerate(batch.column("image").to_pylist()):
                image = images.unpacked(value)
                if image is None:
                    continue
                gray = pixels.to_gray(image)
                h, w = gray.shape
                mx, my = int(w * 0.02), int(h * 0.08)
                if h - 2 * my <= 5 or w - 2 * mx <= 5:
                    mx = my = 0
                found = kernel(gray)
                kept.append(i)
                sizes.append((h, w, h - 2 * my, w - 2 * mx))
                counts.append(len(found))
                masks += [(name, float(m.mean()), np.packbits(m).tobytes()) for name, m in found]
                parts += [pixels.components(m[my : h - my, mx : w - mx]) for _, m in found]
            columns = [pa.array([m[j] for m in masks], kind) for j, kind in enumerate((pa.string(), pa.float64(), pa.binary()))]
            found = pa.StructArray.from_arrays([*columns, images.box_lists(parts)], ["name", "fill", "mask", "parts"])
            own = [batch.column(k).take(pa.array(kept, pa.int64())) for k in keys]
            own += [pa.array([s[j] for s in sizes], pa.int32()) for j in range(len(sides))]
            yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(images.offsets(counts), found)], [*keys, *sides, "found"])

    rows = crops.select(*keys, "image").mapInArrow(run, f"{_typed(crops, keys)}, height int, width int, inner_h int, inner_w int, found {CANDIDATE}")
    h, w = F.col("inner_h"), F.col("inner_w")
    scored = F.transform("found", lambda c, i: F.struct(geometry.binary_score(c["parts"], h, w, c["fill"]).alias("score"), i.alias("i"), c["name"].alias("name"), c["fill"].alias("fill"), c["mask"].alias("mask")))
    return rows.select(*keys, "height", "width", scored.alias("found"))


def _one_each(rows: DataFrame, keys: tuple[str, ...], *more: Column) -> DataFrame:
    kind = geometry.plate_type(F.col("width"), F.col("height")).alias("plate_type")
    return rows.select(*keys, kind, "height", "width", F.col("c.name").alias("name"), F.col("c.score").alias("score"), F.col("c.fill").alias("fill"), F.col("c.mask").alias("mask"), *more)


def first_masks(crops: DataFrame, *keys: str) -> DataFrame:
    """Keys, plate_type, height, width, name, score, fill, mask: one global threshold, its polarity the one that scores higher.

    Of equal scores the likelier polarity stays, unless it fills more than 0.6.
    """
    rows = _binarised(crops, pixels.first_binarisations, keys)
    own, other = F.get("found", 0), F.get("found", 1)
    turn = (other["score"] > own["score"]) | ((other["score"] == own["score"]) & (own["fill"] > 0.60))
    return _one_each(rows.withColumn("c", F.when(turn, other).otherwise(own)), keys)


def candidate_masks(crops: DataFrame, *keys: str) -> DataFrame:
    """As first_masks, with place: the ten binarisations of each crop that score highest, best first; the earlier wins ties."""
    rows = _binarised(crops, pixels.binarisations, keys)
    ranked = F.array_sort("found", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(a["i"] - b["i"]))
    rows = rows.select(*keys, "height", "width", F.posexplode(F.slice(ranked, 1, CANDIDATES)).alias("at", "c"))
    return _one_each(rows, keys, (F.col("at") + 1).alias("place"))


def mask_lines(masks: DataFrame, *keys: str) -> DataFrame:
    """The text lines of masks, as images.text_lines gives them for crops."""
    own = [*keys, "plate_type"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, IMAGE_ROWS):
                batch, found = whole.slice(first, IMAGE_ROWS), []
                for kind, height, width, bits in zip(*(batch.column(c).to_pylist() for c in ("plate_type", "height", "width", "mask")), strict=True):
                    mask = np.unpackbits(np.frombuffer(bits, np.uint8), count=height * width).reshape(height, width).astype(bool)
                    found.append(images.lines_of(mask, kind == "2line"))
                yield images.line_rows(batch.select(own), found)

    return masks.select(*own, "height", "width", "mask").mapInArrow(run, f"{_typed(masks, keys)}, plate_type string, {images.LINE}")


def segmented_with_candidates(crops: DataFrame, *keys: str) -> DataFrame:
    """As images.segmented. Crops whose first binarisation gives too few characters (under 7, 6 in two lines) take the best of it and ten others.

    The best is by the characters that they give (geometry.segmentation_score); the first binarisation and then the better
    ranked one win ties. ``keys`` must name a crop; the first lines are written, since both ways read them. All lines are dealt to
    a fixed number of partitions: few bytes, much work, so small shuffle files must not be put into one task.
    """
    whole = W.partitionBy(*keys)
    own = (*keys, "place", "score", "fill")
    first = images.line_boxes(mask_lines(first_masks(crops, *keys).withColumn("place", F.lit(0)), *own))
    slim = [*own, "plate_type", "line", "top", "height", "width", "mask", "boxes"]
    first = _written(images.dealt(first.select(*slim), *keys).select(*slim, F.sum(F.size("boxes")).over(whole).alias("n")))
    enough = F.col("n") >= F.when(F.col("plate_type") == "1line", 7).otherwise(6)
    again = images.dealt(_picked(crops, first.filter(~enough), *keys), *keys)
    more = images.line_boxes(mask_lines(candidate_masks(again, *keys), *own))
    tried = _written(images.dealt(first.filter(~enough).select(*slim).unionByName(more.select(*slim)), *keys))
    lifted = F.transform("boxes", lambda b: F.struct((b["y"] + F.col("top")).alias("y"), b["w"].alias("w"), b["h"].alias("h")))
    sets = tried.withColumn("b", lifted).groupBy(*own).agg(F.flatten(F.collect_list("b")).alias("b"), F.first("plate_type").alias("kind"))
    value = geometry.segmentation_score(F.col("b"), F.col("kind") == "2line", F.col("fill"), F.col("score"))
    order = W.partitionBy(*keys).orderBy(F.desc("value"), "place")
    best = sets.withColumn("value", value).withColumn("nth", F.row_number().over(order)).filter("nth = 1").select(*keys, "place")
    return images.cut_glyphs(first.filter(enough).select(*slim).unionByName(_picked(tried, best, *keys, "place").select(*slim)), *keys)


# Crops ------------------------------------------------------------------------------------------------------------------


def _with_regions(rows: DataFrame, kernel, name: str) -> DataFrame:
    """rows with the regions that the kernel finds in image, as an array column; null without an image."""
    kind = T.ArrayType(T.StructType([T.StructField(f, T.IntegerType()) for f in ("level", "x", "y", "w", "h", "area")]))
    schema = T.StructType([*rows.schema, T.StructField(name, kind)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            arrays = [images.unpacked(i) for i in pdf["image"]]
            yield pdf.assign(**{name: [None if a is None else [dict(zip(("level", "x", "y", "w", "h", "area"), r, strict=True)) for r in kernel(pixels.to_gray(a))] for a in arrays]})

    return rows.mapInPandas(run, schema)


def _cut(image: np.ndarray, box) -> np.ndarray | None:
    if box is None:
        return None
    x, y, w, h = (int(box[s]) for s in "xywh")
    return np.ascontiguousarray(image[y : y + h, x : x + w])


def located(scenes: DataFrame) -> DataFrame:
    """Scenes with box(x, y, w, h) of the most plate-like bright region, null where there is none; nothing is shuffled.

    Regions have an aspect of 1.2 to 5.5, more than 5,000 pixels in their box and fill over a quarter of it. The largest
    wins, then the upper, then the left one: the box that operators.images.detected numbers 1.
    """
    rows = _with_regions(scenes, lambda gray: [(0, *r) for r in pixels.bright_regions(gray, max(150, pixels.otsu(gray)))], "__regions")
    size = lambda r: r["w"] * r["h"]
    likely = F.filter("__regions", lambda r: (r["w"] / r["h"]).between(1.2, 5.5) & (size(r) > 5000) & (r["area"] / size(r) > 0.25))
    keyed = F.transform(likely, lambda r: F.struct((-size(r)).alias("k"), r["y"].alias("y"), r["x"].alias("x"), r["w"].alias("w"), r["h"].alias("h")))
    best = F.array_min(keyed)
    return rows.withColumn("box", F.when(best.isNotNull(), F.struct(*[best[s].alias(s) for s in "xywh"]))).drop("__regions")


#: Brightness that a plate's body is looked for at, in turn (None: at the 72nd percentile, 150 at least; -1: at the global threshold).
BODY_LEVELS = (210, 190, 170, None, -1)


def _body_regions(gray: np.ndarray) -> list[tuple]:
    if gray.shape[0] < 20 or gray.shape[1] < 40:
        return []
    smooth = pixels.box_mean(gray, 5).astype(np.uint8)
    out = []
    for level, least in enumerate(BODY_LEVELS):
        cut = max(150, int(np.percentile(smooth, 72))) if least is None else pixels.otsu(smooth) if least < 0 else least
        mask = (smooth > cut).astype(np.uint8)
        shut = pixels.extreme(pixels.extreme(mask, 21, 9, np.max), 21, 9, np.min)
        out += [(level, *r) for r in pixels.components(shut > 0) if r[4] >= gray.size * 0.05]
    return out


def body_cropped(rows: DataFrame, margin: float = 0.04) -> DataFrame:
    """rows with image cut to the bright body of its plate, as rotation leaves ground around it; unchanged where none is found.

    The first brightness with a region of the right size and aspect decides; of its regions the largest is taken, where one
    that touches the border counts 0.35. Bodies under 40 by 20 pixels leave the image as it is.
    """
    found = _with_regions(rows, _body_regions, "__regions")
    h, w = F.col("image.height"), F.col("image.width")
    last = F.lit(len(BODY_LEVELS) - 1)
    aspect = lambda r: r["w"] / r["h"]
    fits = lambda r: F.when(r["level"] < last, (r["area"] >= h * w * 0.08) & aspect(r).between(1.1, 6.8)).otherwise((r["area"] >= h * w * 0.06) & aspect(r).between(0.75, 6.5))
    edge = lambda r: (r["x"] <= 1) | (r["y"] <= 1) | (r["x"] + r["w"] >= w - 1) | (r["y"] + r["h"] >= h - 1)
    keyed = F.transform(F.filter("__regions", fits), lambda r: F.struct(r["level"].alias("level"), (r["area"] * F.when(edge(r), -0.35).otherwise(-1.0)).alias("k"), r["x"].alias("x"), r["y"].alias("y"), r["w"].alias("w"), r["h"].alias("h")))
    best = F.array_min(keyed)
    mx, my = F.floor(best["w"] * margin), F.floor(best["h"] * margin)
    x1, y1 = F.greatest(F.lit(0), best["x"] - mx), F.greatest(F.lit(0), best["y"] - my)
    x2, y2 = F.least(w, best["x"] + best["w"] + mx), F.least(h, best["y"] + best["h"] + my)
    box = F.struct(*[c.cast("int").alias(s) for s, c in zip("xywh", (x1, y1, x2 - x1, y2 - y1), strict=True)])
    boxed = found.withColumn("__box", F.when(best.isNotNull() & (x2 - x1 >= 40) & (y2 - y1 >= 20), box)).drop("__regions")
    return images.with_image(boxed, lambda image, b: image if b is None else _cut(image, b), "image", "image", "__box").drop("__box")


def _for_ocr(image: np.ndarray) -> np.ndarray:
    h, w = image.shape[:2]
    return image if w == OCR_WIDTH else pixels.resize(image, OCR_WIDTH, max(1, h * OCR_WIDTH // w))


def plate_crops(scenes: DataFrame, key: str) -> DataFrame:
    """key, box, angle (of the skew, in degrees), plain and image: each scene's plate 400 pixels wide as it is, and level and cut to its body."""
    angled = searched(scenes, key).filter("image is not null").withColumn("plain", F.col("image"))
    return levelled(angled).select(key, "box", "angle", "plain", "image")


def searched(scenes: DataFrame, key: str) -> DataFrame:
    """key, box, angle (of the skew, in degrees) and image: each scene's plate 400 pixels wide as it is, null where there is none.

    Written, as several ways read it: else every scene would be enhanced and searched once for each.
    """
    found = located(images.enhanced_scenes(scenes.select(key, "image")))
    plain = images.with_image(found, lambda image, b: None if b is None else _for_ocr(_cut(image, b)), "image", "image", "box")
    return _written(images.with_skew(plain).select(key, "box", "angle", "image"))


def levelled(angled: DataFrame) -> DataFrame:
    """angled with image turned by angle and cut to its body, unless it is within one degree."""
    turned = images.with_image(angled.filter("abs(angle) >= 1"), lambda image, a: pixels.rotate(image, a, 60), "image", "image", "angle")
    return body_cropped(turned).unionByName(angled.filter("abs(angle) < 1").select(*turned.columns))


# Passes -----------------------------------------------------------------------------------------------------------------


def _turned(rows: DataFrame) -> DataFrame:
    return images.with_image(rows, lambda image: np.ascontiguousarray(image[::-1, ::-1]))


def _large_enough(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("image.height") >= LEAST_HEIGHT) & (F.col("image.width") >= LEAST_WIDTH))


def _pass(variants: DataFrame, model, method: str, key: str) -> DataFrame:
    """Readings of variants(key, variant, angle, image), upside down also for those whose reading is not done yet.

    The variants should be written: both ways of each read them, and the candidate binarisations once more.
    """
    names = (key, "variant", "angle")
    good = _large_enough(variants)
    up = cut_lineage(images.recognised(good, model, method, *names, segment=segmented_with_candidates).withColumn("flipped", F.lit(False)))
    done = up.filter(plates.done_early(F.col("valid"), F.col("score"))).select(key, "variant")
    doubtful = good.select(key, "variant").join(done, [key, "variant"], "left_anti")
    down = _written(images.dealt(_turned(_picked(good, doubtful, key, "variant")), key, "variant"))
    read = images.recognised(down, model, method, *names, segment=segmented_with_candidates).withColumn("flipped", F.lit(True))
    return cut_lineage(up.unionByName(read))


def _best(readings: DataFrame, key: str) -> DataFrame:
    """The best reading of each key: plausibility of the text, least angle, most characters; the earlier variant wins ties."""
    text = F.col("text")
    award = F.when(text.rlike(plates.PREFERRED), 6.0).otherwise(0.0) + F.when(text.rlike(plates.VALID), 2.0).otherwise(0.0) + F.col("score")
    return evaluation.best_of(readings, key, [F.desc(award), F.abs("angle"), F.desc(F.length("raw")), F.col("variant"), F.col("flipped")])


def _first_variants(crops: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """The level crop, after the whole one where levelling has left only one line of a square plate."""
    square = crops.filter((F.col("aspect") <= 2.2) & (F.col("image.width") / F.col("image.height") >= 2.5))
    square = _picked(whole, square, key).select(key, F.lit(0).alias("variant"), F.lit(0.0).alias("angle"), "image")
    return square.unionByName(crops.select(key, F.lit(1).alias("variant"), "angle", "image"))


def _more_variants(crops: DataFrame, key: str) -> DataFrame:
    """The level crop enhanced, the whole one plain and enhanced, turned the other way, and the level one at four more angles, enhanced."""
    of = lambda source, n, angle, where="true": crops.filter(where).select(key, F.lit(n).alias("variant"), F.lit(angle).cast("double").alias("angle") if not isinstance(angle, Column) else angle.alias("angle"), F.col(source).alias("image"))
    plain = of("plain", 3, 0.0)
    rotated = lambda rows, turn: body_cropped(images.with_image(rows, lambda image, a: pixels.rotate(image, a, 60), "image", "image", "__turn").drop("__turn") if turn is None else rows)
    opposite = rotated(of("plain", 5, -F.col("angle"), "abs(angle) >= 1").withColumn("__turn", F.col("angle")), None)
    residual = crops.select(key, F.posexplode(F.array(*[F.lit(float(r)) for r in RESIDUALS])).alias("at", "__turn"), "angle", "image")
    residual = rotated(residual.select(key, (F.col("at") + 6).alias("variant"), (F.col("angle") + F.col("__turn")).alias("angle"), "image", "__turn"), None)
    bettered = [of("image", 2, F.col("angle")), of("plain", 4, 0.0), opposite, residual]
    return plain.unionByName(images.enhanced_plates(reduce(DataFrame.unionByName, [b.select(key, "variant", "angle", "image") for b in bettered])))


def read_scenes(scenes: DataFrame, model, method: str, key: str) -> DataFrame:
    """key, box, text, raw, score, valid, plate_type, angle, flipped, success of each scene(key, image); ``key`` must be unique.

    Scenes are enhanced, their plate is found, cut out, levelled and read (upside down too, unless the reading is done
    early). Readings that need it get a second pass over more variants, which replaces the first one only if it is better.
    Null images, scenes without a plate and plates without characters give a row with success false and no text.
    """
    whole = searched(scenes, key)
    angled = whole.filter("image is not null").withColumn("aspect", F.col("image.width") / F.col("image.height"))
    # A fixed number of partitions at least: a crop costs a hundred times its bytes in work, so few files must not make few tasks.
    few = whole.rdd.getNumPartitions() < int(scenes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crops = _written(levelled(images.dealt(angled, key) if few else angled))
    first = _written(_best(_pass(_first_variants(crops, whole, key), model, method, key), key))
    weak = plates.needs_fallback(F.col("valid"), F.col("score"), F.length("raw"), F.col("angle"))
    poor = _written(crops.select(key).join(first.filter(~weak).select(key), key, "left_anti"))
    both = _picked(crops, poor, key).join(_picked(whole, poor, key).select(key, F.col("image").alias("plain")), key)
    both = _written(images.dealt(both, key))
    again = _pass(_written(images.dealt(_more_variants(both, key), key, "variant")), model, method, key)
    best = _best(first.unionByName(again), key)
    read = best.select(key, "text", "raw", "score", "valid", "plate_type", "angle", "flipped")
    return whole.select(key, "box").join(read, key, "left").withColumn("success", F.col("text").isNotNull())


def drawn_scenes(rows: DataFrame, key: str, lines: str, seed: int = 0) -> DataFrame:
    """key, image: the text lines of each row (array<string>) as a plate in a dark scene of 640 by 480 with noise, tilted up to six degrees."""
    salted = rows.select(key, lines, F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 31)).alias("__seed"))

    def draw(text: list[str], salt: int) -> dict:
        rng = np.random.default_rng(salt)
        scene = np.clip(rng.normal(60, 8, (480, 640)), 0, 255).astype(np.uint8)
        plate = pixels.rotate(pixels.drawn_text(text), float(rng.uniform(-6, 6)), 60)
        y, x = rng.integers(8, 472 - plate.shape[0]), rng.integers(8, 632 - plate.shape[1])
        scene[y : y + plate.shape[0], x : x + plate.shape[1]] = plate
        return images.packed(scene)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first in range(0, len(pdf), IMAGE_ROWS):
                part = pdf.iloc[first : first + IMAGE_ROWS]
                yield pd.DataFrame({key: part[key], "image": [draw(list(t), s) for t, s in zip(part[lines], part["__seed"], strict=True)]})

    return salted.mapInPandas(run, T.StructType([rows.schema[key], T.StructField("image", images.IMAGE)]))


def drawn_reader(spark, method: str = "wavelet", per_class: int = 24, copies: int = 2, seed: int = 1) -> classifiers.KernelMachine:
    """A machine for scenes, from drawn glyphs and variants of them: on the clean ones alone, blurred glyphs are far from all it knows."""
    clean = images.synthetic_glyphs(spark, per_class, seed)
    glyphs = cut_lineage(clean.select("label", "px").unionByName(images.augmented(clean, copies, seed)))
    return classifiers.KernelMachine.fit(images.featured(glyphs, method), per_class=per_class * (copies + 1))
