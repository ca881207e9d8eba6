"""Cached features and crop files: what numpy wrote is read, and only committed crops are there."""

import os

import numpy as np
import pytest

from lamina.functions import pixels
from lamina.operators import images
from lamina.sources import arrays, crops


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    spark.dataSource.register(arrays.CachedFeatures)


def written(spark, path, rows=7):
    found = spark.read.format("features").option("rows", rows).load(str(path))
    return {r["row"]: (r["label"], list(r["vec"])) for r in found.collect()}, found.rdd.getNumPartitions()


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
@pytest.mark.parametrize("names", [("X", "y"), ("hog", "targets"), ("features", "labels")])
def test_archives_by_any_name(spark, tmp_path, monkeypatch, save, names):
    monkeypatch.setattr(arrays, "ROWS_AT_ONCE", 3)
    x, y = np.random.default_rng(1).random((40, 2, 3)), np.array(list("AB10") * 10)
    save(tmp_path / "f.npz", **dict(zip(names, (x, y), strict=True)), other=np.zeros(3))
    rows, parts = written(spark, tmp_path / "f.npz")
    assert parts == 6 and len(rows) == 40
    for i in range(40):
        assert rows[i][0] == y[i] and np.allclose(rows[i][1], x[i].reshape(-1))


def test_folders_and_single_files(spark, tmp_path):
    x, y = np.arange(20, dtype=np.int16).reshape(10, 2), np.arange(10) % 3
    np.save(tmp_path / "hog.npy", x)
    np.save(tmp_path / "y.npy", y)
    assert written(spark, tmp_path)[0] == written(spark, tmp_path / "hog.npy")[0] == {i: (str(y[i]), [2.0 * i, 2.0 * i + 1]) for i in range(10)}
    (tmp_path / "alone").mkdir()
    np.save(tmp_path / "alone" / "X.npy", x)
    assert written(spark, tmp_path / "alone" / "X.npy")[0][3] == (None, [6.0, 7.0])
    np.save(tmp_path / "alone" / "empty.npy", np.zeros((0, 4)))
    assert written(spark, tmp_path / "alone" / "empty.npy")[0] == {}


def test_what_cannot_be_read_is_said(spark, tmp_path):
    np.savez(tmp_path / "a.npz", X=np.zeros((3, 2)))
    np.savez(tmp_path / "b.npz", X=np.zeros((3, 2)), y=np.zeros(4))
    np.savez(tmp_path / "c.npz", X=np.zeros((3, 2)), y=np.array([{}, 1, "x"], object))
    np.savez(tmp_path / "d.npz", X=np.asfortranarray(np.zeros((3, 2))), y=np.zeros(3))
    for name, said in (("a", "needs features"), ("b", "labels of shape"), ("c", "pickle"), ("d", "by columns"), ("none", "none.npz")):
        with pytest.raises(Exception, match=said):
            written(spark, tmp_path / f"{name}.npz")


def crop_rows(spark, n, parts=3):
    values = [(f"d{i % 4}/images/a{i // 4}.jpg", f"51F{i:05d}", images.packed(np.full((4, 6), i, np.uint8))) for i in range(n)]
    schema = images.T.StructType([images.T.StructField("path", images.T.StringType()), images.T.StructField("label", images.T.StringType()), images.T.StructField("image", images.IMAGE)])
    return spark.createDataFrame([*values, ("gone.jpg", "x", None)], schema).repartition(parts)


def test_crops_and_their_manifest(spark, tmp_path):
    crops.write_crops(crop_rows(spark, 12), str(tmp_path))
    listed = crops.read_crop_manifest(spark, str(tmp_path)).collect()
    assert sorted(r["label"] for r in listed) == [f"51F{i:05d}" for i in range(12)] and {r["plate_crop"] for r in listed} == {"true"}
    for r in listed:
        image = pixels.decode_png((tmp_path / r["image"]).read_bytes())
        assert image.shape[:2] == (4, 6) and (image == int(r["label"][3:])).all()
    crops.write_crops(crop_rows(spark, 5, 1), str(tmp_path))
    assert crops.read_crop_manifest(spark, str(tmp_path)).count() == 17
    assert not os.listdir(tmp_path / "_staging")


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    late = crop_rows(spark, 12, 1).withColumn("label", F.when(F.col("label") == "51F00007", F.raise_error(F.lit("lost"))).otherwise(F.col("label")))
    with pytest.raises(Exception, match="lost"):
        crops.write_crops(late, str(tmp_path))
    left = [f for _, _, names in os.walk(tmp_path) for f in names]
    assert left == []
    with pytest.raises(Exception, match="image"):
        crop_rows(spark, 2).drop("image").write.format("crops").mode("append").save(str(tmp_path))
