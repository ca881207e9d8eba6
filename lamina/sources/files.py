"""Manifests, polygon labels and registries as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lamina.functions import plates

MANIFEST = ("image", "label", "plate_crop", "confidence", "note")


def read_manifest(spark: SparkSession, path: str, required: tuple[str, ...] = ("image", "label")) -> DataFrame:
    """A CSV manifest, all columns text, absent optional ones null; a missing required column raises. Notes may span lines."""
    rows = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"manifest lacks columns: {', '.join(missing)}")
    rows = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in MANIFEST])
    return rows.withColumn("plate_crop", plates.flag(F.col("plate_crop"), False))


def read_polygons(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """path, ordinal, cls, xs, ys of label files: class and four points a line.

    Strict takes lines of exactly nine numbers. Lenient takes the first nine fields of longer lines and leaves out
    lines that aren't numbers.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\n")).alias("ordinal", "line"))
    parts = F.split(F.trim("line"), r"\s+")
    rows = lines.select("path", "ordinal", parts.alias("parts")).filter(F.size("parts") == 9 if strict else F.size("parts") >= 9)
    numbers = F.transform(F.slice("parts", 1, 9), lambda p: p.try_cast("double"))
    rows = rows.select("path", "ordinal", numbers.alias("v")).filter(~F.exists("v", lambda x: x.isNull()))
    pick = lambda start: F.transform(F.sequence(F.lit(start), F.lit(start + 6), F.lit(2)), lambda i: F.get("v", i))
    return rows.select("path", "ordinal", F.get("v", F.lit(0)).cast("int").alias("cls"), pick(1).alias("xs"), pick(2).alias("ys"))


def in_pixels(polygons: DataFrame, width: str, height: str) -> DataFrame:
    """Points scaled by the image's size where they are shares of it (none above 1.5)."""
    shares = F.array_max(F.concat("xs", "ys")) <= 1.5
    scale = lambda c, size: F.when(shares, F.transform(c, lambda v: v * F.col(size))).otherwise(F.col(c))
    return polygons.withColumns({"xs": scale("xs", width), "ys": scale("ys", height)})


def with_labels(images: DataFrame, labels: DataFrame, lenient: bool = False) -> DataFrame:
    """images(path) with the polygons of their label files; strict raises for an image without one."""
    rows = images.withColumn("label_path", plates.label_path(F.col("path")))
    joined = rows.join(labels.withColumnRenamed("path", "label_path"), "label_path", "left")
    if lenient:
        return joined.withColumn("reason", F.when(F.col("cls").isNull(), "missing_plate_polygon"))
    return joined.filter(F.when(F.col("cls").isNotNull(), True).otherwise(F.raise_error(F.concat(F.lit("no label for "), "path")).cast("boolean")))


def is_pointer(spark: SparkSession, path: str) -> DataFrame:
    """path, pointer: whether files hold a large-file pointer instead of their content."""
    head = F.substring(F.col("content"), 1, 60).cast("string")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", head.startswith("version https://git-lfs.github.com/spec/").alias("pointer"))


def resolve_alias(versions: DataFrame, aliases: DataFrame, alias: str) -> DataFrame:
    """The version row of each name that an alias points to."""
    return aliases.filter(F.col("alias") == alias).join(versions, ["name", "version"])
