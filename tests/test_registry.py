"""The registry under writers that race, runs that come twice, and batches between two versions."""

import threading

import pytest

from lamina.operators import learning
from lamina.sources.registry import Registry, installed, serving


def test_racing_writers_get_different_versions_and_one_champion(spark, tmp_path):
    found, errors = [], []

    def write(i):
        try:
            found.append(Registry(spark, str(tmp_path)).register("ocr", f"run{i}", {"accuracy": 0.9 + i / 1000}, 0.9))
        except Exception as error:  # shown by the assertion
            errors.append(error)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert not errors and sorted(f["version"] for f in found) == list(range(1, 9))
    registry = Registry(spark, str(tmp_path))
    moves, champion = registry.alias("ocr")
    assert champion["accuracy"] == max(f["accuracy"] for f in found) and sum(f["promoted"] for f in found) >= moves >= 1
    assert not registry.move("ocr", "production", 1, moves - 1)  # judged by an old value


def test_a_run_that_comes_again_changes_nothing(spark, tmp_path):
    registry = Registry(spark, str(tmp_path))
    first = registry.register("ocr", "a", {"accuracy": 0.95}, 0.9)
    assert registry.register("ocr", "a", {"accuracy": 0.95}, 0.9) == first and len(registry.versions("ocr")) == 1
    assert not registry.register("ocr", "b", {"accuracy": 0.94}, 0.9)["promoted"]
    assert not registry.register("other", "c", {"accuracy": 0.5}, 0.9)["promoted"] and registry.alias("other") == (0, None)


def test_promotions_are_those_of_the_query(spark, tmp_path):
    rows = [("m", 1, 0.8), ("m", 2, 0.95), ("m", 3, 0.93), ("m", 4, 0.95), ("n", 1, 0.91)]
    versions = spark.createDataFrame(rows, "name string, version int, accuracy double")
    expected = {(r["name"], r["version"]): r["promoted"] for r in learning.promotions(versions, 0.9).collect()}
    assert {(r["name"], r["version"]): r["promoted"] for r in Registry(spark, str(tmp_path)).register_all(versions, 0.9)} == expected


def test_models_are_swapped_between_batches(spark, tmp_path):
    registry, served = Registry(spark, str(tmp_path / "r")), []

    def load(version):
        if version.get("broken"):
            raise OSError("no such model")
        return version["version"]

    batch = serving(registry, "ocr", load, lambda model, rows, number: served.append((number, model)))
    rows = spark.range(1)
    with pytest.raises(LookupError):
        batch(rows, 0)
    registry.register("ocr", "a", {"accuracy": 0.91}, 0.9)
    batch(rows, 1)
    batch(rows, 2)
    registry.register("ocr", "b", {"accuracy": 0.92, "broken": True}, 0.9)
    batch(rows, 3)
    registry.register("ocr", "c", {"accuracy": 0.93}, 0.9)
    batch(rows, 4)
    assert served == [(1, 1), (2, 1), (3, 1), (4, 3)]


def test_dimensions_are_guarded():
    assert installed({"feature_method": "hog"}, 324)["feature_method"] == "hog_legacy"
    assert installed({"feature_method": "hog", "feature_dim": 1764}, 1764)["feature_method"] == "hog"
    with pytest.raises(ValueError, match="declares 1764"):
        installed({"feature_dim": 1764}, 324)
