"""Image stages as DataFrame operators over an image column.

An image is struct<height, width, channels, data> with RGB or gray bytes by row. Each stage
is one mapInPandas of a small kernel from lamina.functions.pixels; filters, ranking,
grammar and assembly between the stages are column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from lamina.functions import geometry, lines, pixels, plates
from lamina.operators import evaluation

IMAGE = T.StructType([T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("data", T.BinaryType())])

#: Rows that are ranked together when rows are numbered, about.
BUCKET_ROWS = 100_000
#: Share of characters whose place forced them to another class, above which a reading is weak.
FORCED = 0.25


def unpacked(image) -> np.ndarray | None:
    """The array of an image value; None for a null or unreadable one."""
    if image is None or image["data"] is None or image["height"] is None or image["height"] <= 0:
        return None
    shape = (image["height"], image["width"], image["channels"])
    array = np.frombuffer(image["data"], np.uint8).reshape(shape)
    return array[..., 0] if shape[2] == 1 else array


def packed(array: np.ndarray) -> dict:
    return {"height": array.shape[0], "width": array.shape[1], "channels": 1 if array.ndim == 2 else array.shape[2], "data": array.tobytes()}


def with_image(rows: DataFrame, kernel: Callable, source: str = "image", target: str = "image", *more: str) -> DataFrame:
    """``rows`` with ``target`` = kernel(image, *values of ``more``); null where the source or the result is None."""
    schema = T.StructType([f for f in rows.schema if f.name != target] + [T.StructField(target, IMAGE)])
    names = [f.name for f in schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for value, *others in zip(pdf[source], *(pdf[m] for m in more), strict=True):
                image = unpacked(value)
                result = None if image is None else kernel(image, *others)
                out.append(None if result is None else packed(result))
            yield pdf.assign(**{target: out})[names]

    return rows.mapInPandas(run, schema)


def read_images(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("png", "jpg", "jpeg", "bmp")) -> DataFrame:
    """path, label (parent folder), image in RGB of all images below a folder; unreadable files have a null image."""
    raw = spark.read.format("image").option("recursiveFileLookup", "true").load(path).select("image.*")
    raw = raw.filter(F.lower(F.regexp_extract("origin", r"\.([^./]+)$", 1)).isin(*extensions))
    struct = F.struct("height", "width", F.col("nChannels").alias("channels"), "data")
    rows = raw.select(F.col("origin").alias("path"), F.regexp_extract("origin", r"([^/]+)/[^/]+$", 1).alias("label"), F.when(F.col("height") > 0, struct).alias("image"))
    # Spark's source keeps blue first.
    return with_image(rows, lambda x: pixels.over_white(x if x.ndim == 2 else x[..., [2, 1, 0, 3][: x.shape[2]]]))


def decoded(rows: DataFrame, data: str = "data") -> DataFrame:
    """rows with image decoded from PNG bytes, and error where that fails."""
    schema = T.StructType([*rows.schema, T.StructField("image", IMAGE), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            images = [pixels.decode_png(bytes(d)) if d is not None else None for d in pdf[data]]
            yield pdf.assign(image=[None if i is None else packed(i) for i in images], error=[None if i is not None else "undecodable" for i in images])

    return rows.mapInPandas(run, schema)


def _enhanced(image: np.ndarray, limit: float, tiles: int, gamma: float) -> np.ndarray:
    gray = pixels.to_gray(image)
    better = pixels.edge_smooth(pixels.local_contrast(gray, limit, tiles), 2, 45, 2)
    better = (255 * (np.arange(256) / 255.0) ** (1 / gamma) + 0.5).astype(np.uint8)[better]
    if image.ndim == 2:
        return better
    gain = better.astype(np.float64) - gray
    return np.clip(image + gain[..., None], 0, 255).astype(np.uint8)


def enhanced_scenes(images: DataFrame, longest: int = 1280) -> DataFrame:
    """No side above ``longest``, local contrast, smoothing, gamma; the colours stay."""

    def kernel(image: np.ndarray) -> np.ndarray:
        h, w = image.shape[:2]
        if max(h, w) > longest:
            image = pixels.resize(image, max(1, w * longest // max(h, w)), max(1, h * longest // max(h, w)))
        return _enhanced(image, 2.0, 8, 1.1)

    return with_image(images, kernel)


def enhanced_plates(images: DataFrame) -> DataFrame:
    return with_image(images, lambda image: pixels.sharpened(pixels.to_gray(_enhanced(image, 3.0, 4, 1.0))))


def with_skew(images: DataFrame) -> DataFrame:
    """images with angle, the slope of their lines in degrees: downwards to the right is positive.

    It is the median of the directions of nearly level lines, weighted by their votes; where there are none, the direction
    of the least box around the bright part. 0 for images under 20 by 40 pixels and without either, null for null images.
    """
    votes = T.ArrayType(T.StructType([T.StructField("value", T.DoubleType()), T.StructField("weight", T.DoubleType())]))
    schema = T.StructType([*images.schema, T.StructField("__votes", votes), T.StructField("__body", T.DoubleType())])

    def found(value) -> tuple[list[dict], float | None]:
        gray = pixels.to_gray(unpacked(value))
        if gray.shape[0] < 20 or gray.shape[1] < 40:
            return [], None
        lines_ = [{"value": a, "weight": n} for a, n in pixels.line_votes(gray)]
        return lines_, None if lines_ else pixels.least_box_angle(gray > pixels.otsu(gray))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [(None, None) if v is None else found(v) for v in pdf["image"]]
            yield pdf.assign(__votes=[b[0] for b in both], __body=[b[1] for b in both])

    rows = images.mapInPandas(run, schema)
    angle = F.when(F.size("__votes") > 0, geometry.weighted_median(F.col("__votes"))).otherwise(F.coalesce("__body", F.lit(0.0)))
    return rows.withColumn("angle", F.when(F.col("image").isNotNull(), angle)).drop("__votes", "__body")


def deskewed(images: DataFrame, least: float = 1.0) -> DataFrame:
    """images turned so that their lines are level; those within ``least`` degrees stay."""
    turn = lambda image, angle: image if abs(angle) < least else pixels.rotate(image, angle)
    return with_image(with_skew(images), turn, "image", "image", "angle").drop("angle")


def detected(images: DataFrame, key: str) -> DataFrame:
    """key, ordinal, x1, y1, x2, y2, conf of bright plate-like regions: aspect 1.2 to 5.5, largest area first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, value in zip(pdf[key], pdf["image"], strict=True):
                image = unpacked(value)
                if image is None:
                    continue
                gray = pixels.to_gray(image)
                parts = pixels.components(pixels.closed(gray > max(150, pixels.otsu(gray)), 2))
                out += [(name, x, y, x + w, y + h, n / (w * h), w * h) for x, y, w, h, n in parts]
            yield pd.DataFrame(out, columns=[key, "x1", "y1", "x2", "y2", "conf", "area"])

    found = images.select(key, "image").mapInPandas(run, f"{key} {images.schema[key].dataType.simpleString()}, x1 int, y1 int, x2 int, y2 int, conf double, area long")
    aspect = (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    nth = F.row_number().over(W.partitionBy(key).orderBy(F.desc("area"), "y1", "x1"))
    return found.filter(aspect.between(1.2, 5.5) & (F.col("area") > 5000) & (F.col("conf") > 0.25)).withColumn("ordinal", nth).filter("ordinal <= 20")


def cropped(images: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """The image of each box, clipped to the scene."""
    joined = images.join(boxes, key)
    joined = joined.withColumns({
        "x1": geometry.clipped_to(F.col("x1"), F.col("image.width")), "x2": geometry.clipped_to(F.col("x2"), F.col("image.width")),
        "y1": geometry.clipped_to(F.col("y1"), F.col("image.height")), "y2": geometry.clipped_to(F.col("y2"), F.col("image.height")),
    }).filter("x2 > x1 and y2 > y1")
    return with_image(joined, lambda image, x1, y1, x2, y2: np.ascontiguousarray(image[y1:y2, x1:x2]), "image", "image", "x1", "y1", "x2", "y2")


def warped(images: DataFrame, corners: str, margin: float = 0.06) -> DataFrame:
    """images with the quadrilateral of ``corners`` (array of x, y pairs in order) upright; null where it is too small."""
    return with_image(images, lambda image, c: pixels.warp(image, np.array([[p["x"], p["y"]] for p in c]), margin), "image", "image", corners)


def drifted(images: DataFrame, specs: list[tuple[str, dict]], key: str, seed: int = 0) -> DataFrame:
    """The drift transforms in order, each row with a seed of its own."""
    for name, _ in specs:
        if name not in pixels.TRANSFORMS:
            raise ValueError(f"unknown transform: {name}")
    rows = images.withColumn("__seed", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 31)))
    return with_image(rows, lambda image, s: pixels.transformed(image, specs, int(s)), "image", "image", "__seed").drop("__seed")


def input_statistics(images: DataFrame) -> DataFrame:
    """brightness and width of each image, as drift is watched by."""
    schema = T.StructType([*images.schema, T.StructField("brightness", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            arrays = [unpacked(i) for i in pdf["image"]]
            yield pdf.assign(brightness=[None if a is None else float(pixels.to_gray(a).mean()) for a in arrays])

    return images.mapInPandas(run, schema).withColumn("width", F.col("image.width")).drop("image")


PARTS = "parts array<struct<x:int,y:int,w:int,h:int,area:int>>, ink array<array<struct<a:int,b:int>>>"


def column_runs(mask: np.ndarray) -> list[list[dict]]:
    """The runs of ink of each pixel column, rows a to b - 1."""
    return ink_lists([mask])[0].as_py()


def offsets(counts) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())


def box_lists(found: list[list[tuple]]) -> pa.ListArray:
    """Lists of components(x, y, w, h, area), built without a dict for each."""
    flat = np.array([c for one in found for c in one], np.int32).reshape(-1, 5)
    return pa.ListArray.from_arrays(offsets([len(one) for one in found]), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(v)) for v in flat.T], ["x", "y", "w", "h", "area"]))


def ink_lists(masks: list[np.ndarray]) -> pa.ListArray:
    """For each mask the runs of ink of each pixel column, rows a to b - 1."""
    runs = [pixels.ink_runs(m.T) for m in masks]
    counts = [np.bincount(column, minlength=m.shape[1]) for (column, _, _), m in zip(runs, masks, strict=True)]
    ends = [pa.array(np.concatenate([r[i] for r in runs] or [np.zeros(0)]).astype(np.int32)) for i in (1, 2)]
    columns = pa.ListArray.from_arrays(offsets(np.concatenate(counts or [np.zeros(0, int)])), pa.StructArray.from_arrays(ends, ["a", "b"]))
    return pa.ListArray.from_arrays(offsets([m.shape[1] for m in masks]), columns)


def lines_of(mask: np.ndarray, two: bool) -> list[tuple[int, int, np.ndarray]]:
    """(line, top, mask) of the one or two text lines of a plate's mask."""
    split = pixels.row_split(mask) if two else 0
    return [(0, 0, mask[:split]), (1, split, mask[split:])] if two and split else [(0, 0, mask)]


#: What line_rows makes of the text lines beside their keys and plate_type.
LINE = f"line int, top int, height int, width int, mask binary, {PARTS}"


def line_rows(own: pa.RecordBatch, found: list[list[tuple[int, int, np.ndarray]]]) -> pa.RecordBatch:
    """A row for each text line found(lines_of) for the rows of ``own``, with its columns and those of LINE."""
    at = pa.array(np.repeat(np.arange(len(found)), [len(lines_) for lines_ in found]), pa.int64())
    flat = [line for lines_ in found for line in lines_]
    masks = [m for _, _, m in flat]
    whole = lambda values: pa.array(list(values), pa.int32())
    more = {
        "line": whole(n for n, _, _ in flat), "top": whole(t for _, t, _ in flat), "height": whole(m.shape[0] for m in masks), "width": whole(m.shape[1] for m in masks),
        "mask": pa.array([np.packbits(m).tobytes() for m in masks], pa.binary()), "parts": box_lists([sorted(pixels.components(m)) for m in masks]), "ink": ink_lists(masks),
    }
    return pa.RecordBatch.from_arrays([*(c.take(at) for c in own.columns), *more.values()], [*own.schema.names, *more])


def text_lines(crops: DataFrame, *keys: str) -> DataFrame:
    """Keys, plate_type, line, top, height, width, mask (packed bits by row), parts and ink of the text lines of plates."""
    kinds = ", ".join(f"{k} {crops.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grays = [None if (image := unpacked(value)) is None else pixels.to_gray(image) for value in batch.column("image").to_pylist()]
            two = [g is not None and g.shape[1] / g.shape[0] <= 2.5 for g in grays]
            own = batch.select(list(keys)).append_column("plate_type", pa.array(["2line" if t else "1line" for t in two], pa.string()))
            yield line_rows(own, [[] if g is None else lines_of(pixels.ink(g), t) for g, t in zip(grays, two, strict=True)])

    return crops.select(*keys, "image").mapInArrow(run, f"{kinds}, plate_type string, {LINE}")


def line_boxes(rows: DataFrame) -> DataFrame:
    """``rows`` of text_lines with boxes: the best of three segmentations of each line.

    They are the parts with strokes merged, the parts that are shaped like characters, and the runs of the projection. Each
    loses pieces of the frame, has its wide boxes split while the line has fewer characters than it may, and is scored
    against the number of characters that its line should have; the first of the best stays. Nothing is shuffled.
    """
    for step in _box_steps(rows.sparkSession.sparkContext):
        rows = rows.withColumns(step)
    return rows.select(*[c for c in rows.columns if not c.startswith("__")])


@lru_cache(maxsize=1)
def _box_steps(_context: SparkContext) -> list[dict[str, Column]]:
    """The columns of line_boxes, step by step. They are thousands of expressions, so they are built once for a context and not for each of the passes."""
    h, w = F.col("height"), F.col("width")
    one, upper = F.col("plate_type") == "1line", F.col("line") == 0
    steps = [{"__low": F.when(one, 7).when(upper, 3).otherwise(4), "__high": F.when(one, 9).when(upper, 4).otherwise(6)}]
    # The least and largest shares of width and height of a character in each way.
    grown = F.filter("parts", lambda b: (b["area"] >= 12) & (b["h"] >= h * 0.12) & (b["w"] <= w * 0.5) & (b["w"] * b["h"] < h * w * 0.5))
    shaped = F.filter("parts", lambda b: geometry.character_shaped(b, h, w, 0.012, 0.50, 0.18))
    found = [lines.merged_strokes(lines.without_frame(grown, h, w), h, w), F.transform(shaped, lambda b: lines.box(b["x"], b["y"], b["w"], b["h"])), lines.projected(F.col("ink"), h, w, 0.010, 0.34, 0.18)]
    names = range(len(found))
    steps.append({f"__b{i}": lines.without_frame(f, h, w) for i, f in enumerate(found)})
    side = lambda i, s: F.col(f"__b{i}.{s}").cast("array<double>")
    usual = lambda i, s: F.when(F.size(f"__b{i}") > 0, geometry.middle(side(i, s))).otherwise(0.0)
    steps.append({f"__u{i}": usual(i, "w") for i in names})
    steps.append({f"__b{i}": lines.split_budget(F.col(f"__b{i}"), F.col("__high"), lambda b, i=i: lines.halves(F.col("ink"), b, F.col(f"__u{i}"), h, w)) for i in names})
    steps.append({f"__b{i}": lines.without_frame(F.col(f"__b{i}"), h, w) for i in names})
    steps.append({f"__{s}{i}": F.greatest(F.lit(1.0), usual(i, s)) for i in names for s in "wh"})
    steps.append({f"__s{i}": geometry.line_score(F.col(f"__b{i}"), F.col(f"__h{i}"), F.col(f"__w{i}"), h, w, F.col("__low"), F.col("__high")) for i in names})
    best = F.greatest(*[f"__s{i}" for i in names])
    chosen = F.coalesce(*[F.when(F.col(f"__s{i}") == best, F.col(f"__b{i}")) for i in names])
    steps.append({"boxes": F.when(one, geometry.trimmed(chosen, w, 9)).otherwise(chosen)})
    return steps


def segmented(crops: DataFrame, *keys: str) -> DataFrame:
    """Keys, plate_type, line, place, x, y, w, h, px (32 by 32 bytes) of every character in reading order.

    Kernels find the ink of the lines and cut out glyphs; which boxes are characters is decided by columns in between.
    """
    return cut_glyphs(line_boxes(text_lines(crops, *keys)), *keys)


def cut_glyphs(rows: DataFrame, *keys: str) -> DataFrame:
    """The characters that the boxes of lines (of line_boxes) hold, as segmented gives them."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    rows = rows.select(*keys, "plate_type", "line", "top", "height", "width", "mask", "boxes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for *own, kind, line, top, height, width, mask, boxes in pdf.itertuples(index=False, name=None):
                part = np.unpackbits(np.frombuffer(mask, np.uint8), count=height * width).reshape(height, width).astype(bool)
                for place, b in enumerate(boxes):
                    x, y, w, h = (int(b[s]) for s in "xywh")
                    out.append((*own, kind, line, place, x, top + y, w, h, pixels.glyph(part[y : y + h, x : x + w]).tobytes()))
            yield pd.DataFrame(out, columns=[*keys, "plate_type", "line", "place", "x", "y", "w", "h", "px"])

    return rows.mapInPandas(run, f"{kinds}, plate_type string, line int, place int, x int, y int, w int, h int, px binary")


def featured(glyphs: DataFrame, method: str) -> DataFrame:
    """glyphs with vec: the features of ``method`` (raw, hog, hog_legacy, wavelet)."""
    if method not in pixels.FEATURES:
        raise ValueError(f"unknown feature method: {method}")
    schema = T.StructType([*glyphs.schema, T.StructField("vec", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kernel = pixels.FEATURES[method]
        for pdf in batches:
            yield pdf.assign(vec=[kernel(np.frombuffer(p, np.uint8).reshape(32, 32)).astype(np.float32) for p in pdf["px"]])

    return glyphs.mapInPandas(run, schema)


def synthetic_glyphs(spark: SparkSession, per_class: int, seed: int = 0) -> DataFrame:
    """glyph_id, label, px: each class drawn with shifts, slant, strokes and noise of a seed of its own."""
    rows = spark.range(len(plates.CLASSES) * per_class).select(
        F.col("id").alias("glyph_id"), F.substring(F.lit(plates.CLASSES), (F.col("id") % len(plates.CLASSES) + 1).cast("int"), F.lit(1)).alias("label"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 31)).alias("seed"))

    def draw(character: str, seed: int) -> bytes:
        rng = np.random.default_rng(seed)
        image = np.kron(pixels.font_mask(character), np.ones((6, 6), bool)).astype(np.uint8) * 255
        image = pixels.rotate(np.pad(image, 4), float(rng.uniform(-6, 6)), 0)
        if rng.random() < 0.4:
            image = pixels.spread(image > 127, 1).astype(np.uint8) * 255
        noisy = image + rng.normal(0, 12, image.shape)
        mask = np.clip(noisy, 0, 255) > 127
        ys, xs = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
        return pixels.glyph(mask[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1]).tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"glyph_id": pdf["glyph_id"], "label": pdf["label"], "px": [draw(c, s) for c, s in zip(pdf["label"], pdf["seed"], strict=True)]})

    return rows.mapInPandas(run, "glyph_id long, label string, px binary")


def synthetic_plates(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """plate_id, label, two_line, image: every third plate has two lines and a series digit."""
    h = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(1 << 31))
    two_line = F.col("id") % 3 == 2
    letters = "ABCDEFGHKLMNPRSTUVXYZ"
    head = F.concat(F.lpad((h(1) % 89 + 11).cast("string"), 2, "0"), F.substring(F.lit(letters), (h(2) % len(letters) + 1).cast("int"), F.lit(1)))
    series = F.when(two_line, (h(3) % 9 + 1).cast("string")).otherwise("")
    rows = spark.range(n).select(F.col("id").alias("plate_id"), head.alias("head"), series.alias("series"), F.lpad((h(4) % 100000).cast("string"), 5, "0").alias("serial"), two_line.alias("two_line"))
    rows = rows.withColumn("label", F.concat("head", "series", "serial"))
    schema = T.StructType([*rows.schema, T.StructField("image", IMAGE)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lines = [[a + b, c] if two else [a + b + c] for a, b, c, two in zip(pdf["head"], pdf["series"], pdf["serial"], pdf["two_line"], strict=True)]
            yield pdf.assign(image=[packed(pixels.drawn_text(x)) for x in lines])

    return rows.mapInPandas(run, schema).select("plate_id", "label", "two_line", "image")


def noise_images(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """image_id, image of things that are no plates: noise, a flat tone or a slope in turn."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i in pdf["image_id"]:
                rng = np.random.default_rng((seed, i))
                slope = np.add.outer(np.arange(96), np.arange(128)) * 255 // 222
                out.append((rng.integers(0, 256, (96, 128)), np.full((96, 128), rng.integers(0, 256)), slope)[i % 3].astype(np.uint8))
            yield pdf.assign(image=[packed(x) for x in out])

    ids = spark.range(n).withColumnRenamed("id", "image_id")
    return ids.mapInPandas(run, T.StructType([T.StructField("image_id", T.LongType()), T.StructField("image", IMAGE)]))


def augmented(glyphs: DataFrame, copies: int, seed: int = 0) -> DataFrame:
    """label, px of ``copies`` variants of each glyph(glyph_id, label, px): turned, shifted, blurred, speckled, cut to black and white."""
    rows = glyphs.select("label", "px", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"), "glyph_id")
    rows = rows.withColumn("seed", F.pmod(F.xxhash64(F.lit(seed), "glyph_id", "copy"), F.lit(1 << 31)))

    def vary(px: bytes, seed: int) -> bytes:
        rng = np.random.default_rng(seed)
        image = pixels.resize(pixels.rotate(np.frombuffer(px, np.uint8).reshape(32, 32), float(rng.uniform(-4, 4)), 0), 32, 32)
        image = np.roll(image, rng.integers(-2, 3, 2), (0, 1)).astype(np.float64)
        if rng.random() < 0.5:
            image = pixels.shifted(image, 1).mean(0)
        return ((image + rng.normal(0, 15, image.shape) > 127) * np.uint8(255)).astype(np.uint8).tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"label": pdf["label"], "px": [vary(p, s) for p, s in zip(pdf["px"], pdf["seed"], strict=True)]})

    return rows.mapInPandas(run, "label string, px binary")


def pixel_statistics(glyphs: DataFrame, *keys: str) -> DataFrame:
    """Mean pixel and share of ink (above 127) of the glyphs of each group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            arrays = [np.frombuffer(p, np.uint8) for p in pdf["px"]]
            yield pdf[list(keys)].assign(mean=[float(a.mean()) for a in arrays], ink=[float((a > 127).mean()) for a in arrays])

    kinds = ", ".join(f"{k} {glyphs.schema[k].dataType.simpleString()}" for k in keys)
    return glyphs.select(*keys, "px").mapInPandas(run, f"{kinds}, mean double, ink double").groupBy(*keys).agg(F.avg("mean").alias("mean"), F.avg("ink").alias("ink"), F.count("*").alias("n"))


def mean_images(glyphs: DataFrame) -> DataFrame:
    """label, pixels: the mean image of each class; each task sums up before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for label, px in zip(pdf["label"], pdf["px"], strict=True):
                sums.setdefault(label, np.zeros(1025))[:] += np.append(np.frombuffer(px, np.uint8), 1)
        yield pd.DataFrame({"label": list(sums), "sums": [list(v) for v in sums.values()]})

    parts = glyphs.select("label", "px").mapInPandas(run, "label string, sums array<double>").select("label", F.posexplode("sums").alias("at", "v"))
    whole = parts.groupBy("label", "at").agg(F.sum("v").alias("v")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("p"))
    count = F.element_at("p", -1)["v"]
    return whole.select("label", F.transform(F.slice("p", 1, 1024), lambda x: x.v / count).alias("pixels"))


def sampled(images: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows drawn with replacement: hashed draws joined to the rows' numbers, so a seed gives the same sample.

    A row's number is its rank by the hash bucket of ``key`` and then by ``key``, which must be unique: it doesn't depend
    on how the rows are partitioned, now or when a task is run again.
    """
    total = images.count()
    if not total:
        return images.withColumn("draw", F.lit(0).cast("long")).limit(0)
    dealt = images.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(total // BUCKET_ROWS + 1)))
    before = W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)  # one row a bucket
    starts = dealt.groupBy("__bucket").agg(F.count("*").alias("n")).select("__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(W.partitionBy("__bucket").orderBy(key)) - 1
    numbered = dealt.withColumn("__place", place).join(starts, "__bucket").withColumn("number", F.col("__start") + F.col("__place"))
    draws = images.sparkSession.range(n).select(F.col("id").alias("draw"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(total)).alias("number"))
    return draws.join(numbered, "number").drop("number", "__bucket", "__start", "__place")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by their keys to a fixed number of partitions: few bytes make much work, so small shuffle files must not be put into one task.

    Keys that are fractions depend on the others; Spark makes zeros and NaN alike before it groups by them and would deal anew.
    """
    whole = [k for k in keys if rows.schema[k].dataType not in (T.DoubleType(), T.FloatType())]
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(whole or keys))


def recognised(crops: DataFrame, model, method: str, *keys: str, segment: Callable | None = None) -> DataFrame:
    """Keys, plate_type, top_count, raw and corrected text, score, the share of characters forced by their place, and validity.

    ``model`` scores glyph features (lamina.operators.classifiers): rows with scores over the class set.
    Characters are held to digits or letters by their place before the grammar sees the text. ``segment`` finds the
    characters; segmented does, if none is given.
    """
    glyphs = featured((segment or segmented)(crops, *keys), method)
    scored = dealt(model.scored(glyphs).select(*keys, "plate_type", "line", "place", "w", "h", "scores"), *keys)
    plate = W.partitionBy(*keys)
    scored = scored.withColumns({
        "at": F.row_number().over(plate.orderBy("line", "place")) - 1, "top_count": F.sum((F.col("line") == 0).cast("int")).over(plate), "n": F.count("*").over(plate),
    })
    digits = F.array(*[F.lit(c.isdigit()) for c in plates.CLASSES])
    letters = F.transform(digits, lambda d: ~d)
    either = F.transform(digits, lambda d: F.lit(True))
    two = F.col("plate_type") == "2line"
    allowed = F.when(F.col("at") == 2, letters).when(two & (F.col("at") == 3) & (F.col("top_count") >= 4), either).otherwise(digits)
    free = F.array_position("scores", F.array_max("scores")) - 1
    index = F.when(F.get(allowed, free.cast("int")), free).otherwise(geometry.constrained_argmax(F.col("scores"), allowed))
    character = plates.thin_seven(F.substring(F.lit(plates.CLASSES), (index + 1).cast("int"), F.lit(1)), F.col("w") / F.col("h"))
    read = scored.select(*keys, "plate_type", "top_count", (free != index).cast("double").alias("forced"), F.struct("at", character.alias("c")).alias("p"))
    text = F.concat_ws("", F.transform(F.array_sort(F.collect_list("p")), lambda p: p.c))
    rows = read.groupBy(*keys).agg(F.first("plate_type").alias("plate_type"), F.first("top_count").alias("top_count"), F.avg("forced").alias("forced"), text.alias("raw"))
    fixed = rows.withColumn("text", plates.corrected(F.col("raw")))
    score = plates.format_score(F.col("text"), F.col("plate_type") == "2line", F.col("top_count").cast("int"))
    return fixed.withColumn("score", score).withColumn("valid", plates.is_valid(F.col("text")))


def recognised_with_rescue(crops: DataFrame, model, method: str, key: str) -> DataFrame:
    """As recognised; weak readings get a second pass over variants, and the best reading of each key stays.

    Variants are the deskewed, the enhanced and the upside-down crop. The order is validity, few forced characters,
    score, length; the earlier variant wins ties.
    """
    first = recognised(crops, model, method, key).withColumn("variant", F.lit(0)).persist()
    weak = first.filter((F.length("text") < 7) | (~F.col("valid") & (F.col("score") < 10)) | (F.col("forced") > FORCED)).select(key)
    missing = crops.select(key).join(first.select(key), key, "left_anti")
    again = crops.join(weak.unionByName(missing).distinct(), key, "left_semi")
    variants = [deskewed(again), enhanced_plates(again), with_image(again, lambda image: np.ascontiguousarray(image[::-1, ::-1]))]
    out = first
    for number, variant in enumerate(variants, 1):
        out = out.unionByName(recognised(variant, model, method, key).withColumn("variant", F.lit(number)))
    return evaluation.best_of(out, key, [F.desc("valid"), F.col("forced") > FORCED, F.desc("score"), F.col("forced"), F.desc(F.length("text")), F.col("variant")])
