import numpy as np
import pytest

from lamina.functions import pixels
from lamina.operators import images
from lamina.sources import files, sinks


def test_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text("image,label,plate_crop\na.png,51F12345,yes\nb.png,59S212345,\n")
    rows = {r["image"]: r for r in files.read_manifest(spark, str(tmp_path / "m.csv")).collect()}
    assert rows["a.png"]["plate_crop"] is True and rows["b.png"]["plate_crop"] is False and rows["a.png"]["note"] is None
    (tmp_path / "bad.csv").write_text("image,text\na,b\n")
    with pytest.raises(ValueError, match="label"):
        files.read_manifest(spark, str(tmp_path / "bad.csv"))


def test_polygons_strict_and_lenient(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 .1 .1 .3 .1 .3 .2 .1 .2\nbad line\n1 0 0 1 0 1 1 0 1 9\n1 x 0 1 0 1 1 0 1\n")
    assert files.read_polygons(spark, str(tmp_path)).count() == 1
    lenient = files.read_polygons(spark, str(tmp_path), strict=False)
    assert lenient.count() == 2
    sized = files.in_pixels(lenient.selectExpr("*", "100 as w", "50 as h"), "w", "h").orderBy("ordinal").first()
    assert [round(x, 6) for x in sized["xs"]] == [10, 30, 30, 10] and [round(y, 6) for y in sized["ys"]] == [5, 5, 10, 10]


def test_image_scan_reads_rgb_and_skips_unreadable(spark, tmp_path):
    (tmp_path / "A").mkdir()
    image = np.zeros((4, 5, 3), np.uint8)
    image[..., 0], image[..., 2] = 10, 30
    (tmp_path / "A" / "x.png").write_bytes(pixels.encode_png(image))
    (tmp_path / "A" / "y.png").write_bytes(b"broken")
    (tmp_path / "A" / "z.txt").write_text("no image")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert set(rows) <= {"x.png", "y.png"} and rows["x.png"]["label"] == "A"
    assert (images.unpacked(rows["x.png"]["image"]) == image).all()


def test_missing_label_raises(spark):
    image = spark.createDataFrame([("d/images/a.png",)], "path string")
    labels = spark.createDataFrame([("d/labels/b.txt", 0)], "path string, cls int")
    with pytest.raises(Exception, match="no label for"):
        files.with_labels(image, labels).collect()
    assert files.with_labels(image, labels, lenient=True).first()["reason"] == "missing_plate_polygon"


def test_pointer_files_and_sinks(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.pt").write_text("version https://git-lfs.github.com/spec/v1\noid")
    (tmp_path / "p" / "b.pt").write_bytes(b"\0\1")
    assert sorted(r["pointer"] for r in files.is_pointer(spark, str(tmp_path / "p")).collect()) == [False, True]
    scores = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.75)], "config string, fold int, score double")
    sinks.write_fold_scores(scores, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).first()["scores"] == "0.5;0.75"
    boxes = spark.createDataFrame([(0, 0.5, 0.25, 0.1, 0.2)], "cls int, xc double, yc double, w double, h double")
    assert sinks.box_lines(boxes).first()["value"] == "0 0.500000 0.250000 0.100000 0.200000"
    versions = spark.createDataFrame([("m", 1, 0.9), ("m", 2, 0.8)], "name string, version int, accuracy double")
    assert files.resolve_alias(versions, spark.createDataFrame([("m", "production", 1)], "name string, alias string, version int"), "production").first()["accuracy"] == 0.9


def test_notes_of_several_lines_and_numbers_within_a_class(spark, tmp_path):
    (tmp_path / "m.csv").write_text('image,label,note\na.png,51F1,"first ""line""\nsecond"\nb.png,51F2,\n')
    rows = {r["image"]: (r["label"], r["note"]) for r in files.read_manifest(spark, str(tmp_path / "m.csv")).collect()}
    assert rows == {"a.png": ("51F1", 'first "line"\nsecond'), "b.png": ("51F2", None)}
    glyphs = spark.range(60).selectExpr("id as glyph_id", "if(id % 3 = 0, 'A', 'B') as label", "cast('x' as binary) as px").repartition(4)
    sinks.write_by_class(glyphs, str(tmp_path / "g"))
    names = [(r["label"], r["name"], r["glyph_id"]) for r in spark.read.parquet(str(tmp_path / "g")).collect()]
    for label, n in (("A", 20), ("B", 40)):
        own = sorted((name, i) for c, name, i in names if c == label)
        assert [name for name, _ in own] == [f"{label}_{k:06d}" for k in range(1, n + 1)] and [i for _, i in own] == sorted(i for _, i in own)
